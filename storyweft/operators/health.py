"""Health of sources and state of retries: ordered folds over logs of polls and attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Failures to quarantine, hours to the next probe, empty polls that count as a failure; tries, and hours after the first and second.
QUARANTINE_AFTER, REPROBE_HOURS, EMPTY_ALLOWED = 3, 24, 48
MAX_ATTEMPTS, BACKOFF_HOURS = 3, (2, 8)

STATE = "struct<status:string,fails:int,empty:int,ok_at:timestamp,checked_at:timestamp,error:string,http:int,items:int,quarantined_at:timestamp,etag:string,modified:string>"


def step(state: Column, e: Column, after: int = QUARANTINE_AFTER, allowed: int = EMPTY_ALLOWED) -> Column:
    """The state after one event (``ts, kind, http, items, etag, modified, error``; kind: success, not_modified, failure, disabled).

    A success heals. A feed that wasn't modified keeps its validators and counts. A failure drops validators and the empty count,
    and quarantines at the nth in a row. So many empty polls in a row count as one failure.
    """
    none = lambda t: F.lit(None).cast(t)
    good, same, off = e["kind"] == "success", e["kind"] == "not_modified", e["kind"] == "disabled"
    empty = F.when(good, F.when(F.coalesce(e["items"], F.lit(0)) > 0, 0).otherwise(state["empty"] + 1)).otherwise(state["empty"])
    gone = good & (empty >= allowed)
    well = (good | same) & ~gone
    fails = F.when(well | off, 0).when(gone, 1).otherwise(state["fails"] + 1)
    held = state["status"] == "quarantined"
    bad_status = F.when(held & ~gone, "quarantined").when(fails >= after, "quarantined").otherwise("failing")
    status = F.when(off, "disabled").when(well, "ok").otherwise(bad_status)
    since = F.when(well | off, none("timestamp")).when((status == "quarantined") & ~held, e["ts"]).when(gone, none("timestamp")).otherwise(state["quarantined_at"])
    keep = lambda new, old: F.when(off, old).when(~well, none("string")).otherwise(F.coalesce(new, F.when(same, old)))
    return F.struct(
        status.alias("status"), fails.cast("int").alias("fails"), F.when(well | off, empty).otherwise(0).cast("int").alias("empty"),
        F.when(good | same, e["ts"]).otherwise(state["ok_at"]).alias("ok_at"), F.when(off, state["checked_at"]).otherwise(e["ts"]).alias("checked_at"),
        F.when(well | off, none("string")).when(gone, F.lit("feed is empty")).otherwise(e["error"]).alias("error"), F.when(off, state["http"]).otherwise(e["http"]).alias("http"),
        F.when(good, e["items"]).otherwise(state["items"]).alias("items"), since.alias("quarantined_at"), keep(e["etag"], state["etag"]).alias("etag"), keep(e["modified"], state["modified"]).alias("modified"),
    ).cast(STATE)


def fold_health(events: DataFrame, allowed: int = EMPTY_ALLOWED, state: DataFrame | None = None) -> DataFrame:
    """HEALTH rows: each source's state after its events in order of time, then of the events' text.

    ``state`` are HEALTH rows from which the fold goes on, so that only the events since are read: what a source's row holds at once
    is its new events, not its whole log. Without it a source begins healthy. Sources without new events keep their state.
    """
    zero = F.struct(
        F.lit("ok").alias("status"), F.lit(0).alias("fails"), F.lit(0).alias("empty"), *(F.lit(None).alias(n) for n in ("ok_at", "checked_at", "error", "http", "items", "quarantined_at", "etag", "modified"))
    ).cast(STATE)
    event = F.struct("ts", "kind", F.col("status").alias("http"), F.col("item_count").alias("items"), "etag", F.col("last_modified").alias("modified"), "error")
    folded = events.groupBy(F.col("source_id").alias("id")).agg(F.array_sort(F.collect_list(event)).alias("log"))
    first = zero
    if state is not None:
        names = ["status", "consecutive_failures", "consecutive_empty", "last_ok_at", "last_checked_at", "last_error", "last_http_status", "last_item_count", "quarantined_at", "etag", "last_modified"]
        folded = folded.join(state.select("id", F.struct(*names).cast(STATE).alias("was")), "id", "full_outer").withColumn("log", F.coalesce("log", F.slice(F.array(F.lit(None).cast(folded.schema["log"].dataType.elementType)), 1, 0)))
        first = F.coalesce("was", zero)
    state_after = folded.select("id", F.aggregate("log", first, lambda s, e: step(s, e, allowed=allowed)).alias("s"))
    return state_after.select(
        "id", "s.status", F.col("s.fails").alias("consecutive_failures"), F.col("s.empty").alias("consecutive_empty"), F.col("s.ok_at").alias("last_ok_at"), F.col("s.checked_at").alias("last_checked_at"),
        F.col("s.error").alias("last_error"), F.col("s.http").alias("last_http_status"), F.col("s.items").alias("last_item_count"), "s.quarantined_at", "s.etag", F.col("s.modified").alias("last_modified"),
    )


def streaks(events: DataFrame, key: str, ts: str, failed: Column, tie: str) -> DataFrame:
    """``events`` with ``streak``: how many failures in a row end with each event, 0 for a success."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    marked = events.withColumn("__ok", F.sum((~failed).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy(key, "__ok").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("streak", F.sum(failed.cast("int")).over(within)).drop("__ok")


def skip(health: DataFrame, now: Column) -> DataFrame:
    """Ids of quarantined sources probed within the last day."""
    return health.where((F.col("status") == "quarantined") & (F.unix_micros(now) - F.unix_micros("last_checked_at") < REPROBE_HOURS * 3_600_000_000)).select("id")


def fold_attempts(events: DataFrame) -> DataFrame:
    """ATTEMPT rows of a log (``id, ts, error, final``): tries so far, when the next is due, whether that was the last."""
    log = events.groupBy("id").agg(F.count("*").cast("int").alias("attempts"), F.max_by(F.struct("ts", "error"), F.struct("ts", "error")).alias("x"), F.max(F.coalesce("final", F.lit(False))).alias("final"))
    done = F.col("final") | (F.col("attempts") >= MAX_ATTEMPTS)
    wait = F.when(F.col("attempts") == 1, BACKOFF_HOURS[0]).otherwise(BACKOFF_HOURS[1])
    due = F.timestamp_micros(F.unix_micros("x.ts") + wait * F.lit(3_600_000_000))
    return log.select("id", "attempts", F.col("x.ts").alias("last_attempt_at"), F.when(~done, due).alias("next_attempt_at"), F.col("x.error").alias("error"), done.alias("final"))


def due(ids: DataFrame, attempts: DataFrame, now: Column) -> DataFrame:
    """Rows of ``ids`` that were never tried, or whose next try is due."""
    a = attempts.select("id", F.col("final").alias("__f"), F.col("next_attempt_at").alias("__n"), F.lit(True).alias("__t"))
    return ids.join(a, "id", "left").where(F.col("__t").isNull() | (~F.col("__f") & (F.col("__n").isNull() | (F.col("__n") <= now)))).drop("__f", "__n", "__t")


def listed(health: DataFrame, sources: DataFrame) -> DataFrame:
    """Health rows of sources that the registry still has."""
    return health.join(sources.select("id").distinct(), "id", "left_semi")


def open_attempts(attempts: DataFrame, items: DataFrame, articles: DataFrame) -> DataFrame:
    """Attempts at items that are still kept and have no article yet; all others are forgotten."""
    return attempts.join(items.select("id").distinct(), "id", "left_semi").join(articles.select("id").distinct(), "id", "left_anti")
