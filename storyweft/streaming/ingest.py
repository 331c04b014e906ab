"""The incremental path: micro-batches merged into the store by day, tumbling counts, and health state per source."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from storyweft.operators.health import EMPTY_ALLOWED, QUARANTINE_AFTER
from storyweft.operators.store import merge_first_wins, upsert, write_days
from storyweft.schema import ITEM
from storyweft.session import cut


def merge_batch(path: str, late_days: int = 45, clock: Callable[[], datetime] | None = None):
    """A ``foreachBatch`` function: items of a batch into the store at ``path``.

    Only the days that the batch's ids live in, or go to, are read and written. Items older than ``late_days`` against ``clock``
    (for replays, where there is none, the newest first sighting of the batch) are dropped unless known. An empty batch writes nothing,
    the same batch again changes nothing. What is read of the store is cut to the shared folder before its files are replaced, so
    an executor may be lost at any time.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        incoming = cut(merge_first_wins(batch))
        bounds = incoming.agg(F.max("first_seen_at").alias("now"), F.count("*").alias("n")).first()
        if not bounds["n"]:
            return
        try:
            stored = spark.read.parquet(path)
        except Exception as e:  # no store yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            stored = spark.createDataFrame([], ITEM + ", pub_date DATE")
        known = cut(stored.select("id", "pub_date").join(incoming.select("id"), "id", "left_semi"))
        fresh = incoming.join(known.select("id").distinct().withColumn("__k", F.lit(True)), "id", "left")
        fresh = fresh.where((F.col("published_at") >= F.lit(clock() if clock else bounds["now"]) - F.expr(f"interval {late_days} days")) | F.coalesce("__k", F.lit(False))).drop("__k")
        days = known.select("pub_date").union(fresh.select(F.to_date("published_at"))).distinct()
        near = cut(stored.join(days, "pub_date", "left_semi").drop("pub_date"))
        merged = cut(upsert(near, fresh).withColumn("outcome", F.coalesce("outcome", F.lit("kept"))))
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        write_days(merged, path)

    return run


def stream_items(items: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Start the merge of a stream of items into the store; the default trigger takes what is there and ends."""
    return items.writeStream.foreachBatch(merge_batch(path)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def daily_counts(items: DataFrame, lateness: str = "45 days") -> DataFrame:
    """Columns ``date, count`` of a stream, by event time, each day closed once the watermark has passed it."""
    days = items.withWatermark("published_at", lateness).groupBy(F.window("published_at", "1 day")).agg(F.count("*").alias("count"))
    return days.select(F.to_date("window.start").alias("date"), "count")


HEALTH_STATE = "status string, fails int, empty int"
HEALTH_OUT = "id string, ts timestamp, status string, consecutive_failures int, consecutive_empty int"


def live_health(polls: DataFrame, after: int = QUARANTINE_AFTER, allowed: int = EMPTY_ALLOWED) -> DataFrame:
    """State of each source after each micro-batch of polls (``source_id, ts, kind, item_count``), kept between batches."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, fails, empty = state.get if state.exists else ("ok", 0, 0)
        events = pd.concat(list(batches)).sort_values(["ts", "kind"])
        for kind, count in zip(events["kind"], events["item_count"]):
            if kind == "disabled":
                status, fails = "disabled", 0
                continue
            gone = False
            if kind == "success":
                empty = 0 if count and count > 0 else empty + 1
                gone = empty >= allowed
            if kind in ("success", "not_modified") and not gone:
                status, fails = "ok", 0
                continue
            fails, empty = (1 if gone else fails + 1), 0
            status = "quarantined" if fails >= after or (status == "quarantined" and not gone) else "failing"
        state.update((status, fails, empty))
        yield pd.DataFrame([(key[0], events["ts"].iloc[-1], status, fails, empty)], columns=["id", "ts", "status", "consecutive_failures", "consecutive_empty"])

    source = polls.select("source_id", "ts", "kind", "item_count")
    return source.groupBy("source_id").applyInPandasWithState(run, HEALTH_OUT, HEALTH_STATE, "update", GroupStateTimeout.NoTimeout)


def read_item_stream(spark: SparkSession, path: str) -> DataFrame:
    """Items as they are dropped into a folder of JSON lines."""
    return spark.readStream.schema(ITEM).json(path)


def guard(polls: DataFrame) -> DataFrame:
    """``polls`` (``status, error``), or an error if every one of them failed: nothing is written then."""
    total = polls.agg(F.count("*").alias("n"), F.count_if(F.col("error").isNotNull()).alias("bad")).first()
    if total["n"] and total["n"] == total["bad"]:
        raise RuntimeError("every source failed; nothing is written")
    return polls
