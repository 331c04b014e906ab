"""Joins of many rows with a few figures for each of their keys, whatever share of the rows one key has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT = 500_000  # rows of a key from which it is cut into parts of about so many


def salted_join(rows: DataFrame, stats: DataFrame, keys: list[str], count: str, by: list[str], how: str = "inner", hot: int = HOT, counts: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with ``stats`` (few rows for each key, best cut before, as it is read twice) on ``keys``; inner, left, left_semi or left_anti.

    Rows of one key are spread by the columns ``by``, so a task that is run again spreads them alike. ``count`` is a column of ``stats``: about how many of ``rows`` have the key. Keys of more than ``hot`` rows are at most
    rows / hot, so these alone are broadcast, and tell each of their rows the number of salts; all other keys have
    one. ``counts`` may name keys and their counts apart, where ``stats`` is dear. Null keys meet nothing. Columns of ``rows`` come first; ``count`` and the other columns of ``stats`` follow.
    """
    parts = F.greatest(F.ceil(F.col(count) / hot), F.lit(1)).cast("int")
    many = F.broadcast((stats if counts is None else counts).where(F.col(count) > hot).select(*keys, parts.alias("_parts")).distinct())
    spread = rows.join(many, keys, "left").withColumn("_salt", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*by), F.col("_parts")).cast("int"))).drop("_parts")
    every = stats.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return spread.join(every, [*keys, "_salt"], how).drop("_salt")
