"""The item store: first-sighting-wins merge, upsert outcomes, conflict union, patches and writes of touched days only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyweft.schema import TOPICS

KEPT = ["title", "title_norm", "publisher", "tier", "published_at", "first_seen_at", "feed_id"]


def merge_first_wins(items: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """One row for each id: who it is from its first sighting, what is known from all.

    Identity columns come from the first row by ``order`` (``first_seen_at``, then the columns that make ties definite); topics are the
    union in display order, flags the sorted union; snippet, image and publisher address the first that isn't null; the url is
    the first row's, or if that is opaque the first that isn't. Null ids are left out; an empty table gives
    an empty result; merging a merged table changes nothing. Aggregates combine before the shuffle.
    """
    by = F.struct(*(order or [F.col("first_seen_at"), F.col("published_at"), F.col("url"), F.coalesce("image", F.lit(""))]))
    first_known = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), by)).alias(c)
    union = lambda c: F.array_distinct(F.flatten(F.collect_set(F.coalesce(c, F.array().cast("array<string>")))))
    plain = F.when(~F.coalesce("url_opaque", F.lit(False)), by)
    merged = items.where(F.col("id").isNotNull()).groupBy("id").agg(
        *(F.min_by(c, by).alias(c) for c in KEPT),
        F.coalesce(F.min_by("url", plain), F.min_by("url", by)).alias("url"),
        F.min(F.coalesce("url_opaque", F.lit(False))).alias("url_opaque"),
        *(first_known(c) for c in ("publisher_url", "snippet", "image")),
        F.array_intersect(F.lit(TOPICS), union("topics")).alias("topics"),
        F.array_sort(union("flags")).alias("flags"),
    )
    columns = "id title title_norm url url_opaque publisher publisher_url tier topics flags published_at first_seen_at feed_id snippet image".split()
    return merged.select(*columns)


def upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The merged table with ``outcome``: added, updated or unchanged; rows of ``existing`` win ties."""
    both = existing.withColumn("__side", F.lit(0)).unionByName(incoming.withColumn("__side", F.lit(1)))
    merged = merge_first_wins(both, [F.col("__side"), F.col("first_seen_at"), F.col("published_at"), F.col("url"), F.coalesce("image", F.lit(""))])
    columns = [c for c in merged.columns if c != "id"]
    old = existing.select("id", F.struct(*columns).alias("__old"))
    seen = incoming.select("id").distinct().withColumn("__seen", F.lit(True))
    same = F.col("__old").eqNullSafe(F.struct(*columns))
    outcome = F.when(F.col("__old").isNull(), "added").when(~same & F.col("__seen"), "updated").when(F.col("__seen"), "unchanged")
    return merged.join(old, "id", "left").join(seen, "id", "left").withColumn("outcome", outcome).drop("__old", "__seen")


def conflict_union(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Of each id the row seen first, ours on a tie."""
    columns = ours.columns
    both = ours.withColumn("__side", F.lit(0)).unionByName(theirs.withColumn("__side", F.lit(1)))
    best = both.groupBy("id").agg(F.min_by(F.struct(*columns), F.struct("first_seen_at", "__side")).alias("x"))
    return best.select("x.*")


def patch(items: DataFrame, patches: DataFrame) -> DataFrame:
    """``items`` with the fields that ``patches`` (id and some of the columns) has a value for."""
    named = [c for c in patches.columns if c != "id"]
    p = patches.select("id", *(F.col(c).alias(f"__{c}") for c in named))
    out = items.join(p, "id", "left")
    return out.select(*(F.coalesce(f"__{c}", c).alias(c) if c in named else F.col(c) for c in items.columns))


def write_days(merged: DataFrame, path: str, day: str = "published_at") -> None:
    """Write the days in which a row was added or updated, whole, sorted by id; other days stay as they are."""
    dated = merged.withColumn("pub_date", F.to_date(day))
    touched = dated.where(F.col("outcome").isin("added", "updated")).select("pub_date").distinct()
    out = dated.join(touched, "pub_date", "left_semi").drop("outcome")
    out.repartition("pub_date").sortWithinPartitions("pub_date", "id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pub_date").parquet(path)


def window(items: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Items of the last days by their day, a filter on the partition column where there is one."""
    day = F.col("pub_date") if "pub_date" in items.columns else F.to_date("published_at")
    return items.where(day >= F.date_sub(F.to_date(now), days))


def run_totals(merged: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """One row of an ingest run, from :func:`upsert`: items added and updated, all that are kept, and those of the last days."""
    recent = F.col("published_at") >= F.timestamp_micros(F.unix_micros(now) - days * F.lit(86_400_000_000))
    return merged.agg(F.count_if(F.col("outcome") == "added").alias("added"), F.count_if(F.col("outcome") == "updated").alias("updated"), F.count("*").alias("kept"), F.count_if(recent).alias("recent"))
