"""Daily series without gaps, months, peaks and ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def daily(events: DataFrame, at: str, placed: Column | None = None) -> DataFrame:
    """Columns ``date, count, placed`` for every day from the first to the last that occurs, absent days with zeros."""
    placed = F.lit(False) if placed is None else placed
    days = events.where(F.col(at).isNotNull()).groupBy(F.to_date(at).alias("date")).agg(F.count("*").alias("count"), F.count_if(placed).alias("placed"))
    span = days.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).where("lo is not null").select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("date"))
    return span.join(days, "date", "left").na.fill(0, ["count", "placed"])


def months(events: DataFrame, at: str) -> DataFrame:
    """Columns ``month, count``."""
    return events.where(F.col(at).isNotNull()).groupBy(F.date_format(at, "yyyy-MM").alias("month")).agg(F.count("*").alias("count"))


def peak(days: DataFrame) -> DataFrame:
    """One row: the busiest day (the earliest of equal ones), its count, and step and top of an axis for it."""
    best = days.agg(F.max_by("date", F.struct("count", -F.datediff("date", F.lit("1970-01-01")))).alias("date"), F.max("count").alias("peak"))
    step = F.when(F.col("peak") <= 5, 1).when(F.col("peak") <= 12, 2).when(F.col("peak") <= 30, 5).otherwise(10)
    return best.withColumn("step", step).withColumn("top", (F.ceil(F.col("peak") / F.col("step")) * F.col("step")).cast("bigint"))


def brush(df: DataFrame, date: str, one: Column, other: Column) -> DataFrame:
    """Rows between two days, both included, in whichever order they are given."""
    return df.where(F.col(date).between(F.least(one, other), F.greatest(one, other)))


def span(df: DataFrame, at: str) -> DataFrame:
    """One row: the years that occur, first and last day, rows."""
    return df.where(F.col(at).isNotNull()).agg(F.array_sort(F.collect_set(F.year(at))).alias("years"), F.min(F.to_date(at)).alias("first"), F.max(F.to_date(at)).alias("last"), F.count("*").alias("rows"))
