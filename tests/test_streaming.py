import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from storyweft.schema import ITEM
from storyweft.streaming import ingest
from tests.test_store import item

NAMES = [x.split()[0] for x in ITEM.split(", ")]


def drop(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(json.dumps({k: v.isoformat() if isinstance(v, datetime) else v for k, v in zip(NAMES, r)}) for r in rows))


def test_batches_merge_into_days(spark, tmp_path):
    src, store = tmp_path / "in", str(tmp_path / "store")

    def run():
        ingest.stream_items(ingest.read_item_stream(spark, str(src)), store, str(tmp_path / "cp")).awaitTermination()
        return {r["id"]: r for r in spark.read.parquet(store).collect()}

    drop(src, "1.json", [item("a", 1), item("b", 1, published_at=datetime(2026, 1, 3)), item("old", 1, published_at=datetime(2025, 1, 1))])
    assert set(run()) == {"a", "b"}
    drop(src, "2.json", [item("a", 2, image="i.png", published_at=datetime(2026, 1, 9)), item("c", 2)])
    got = run()
    assert set(got) == {"a", "b", "c"} and got["a"].image == "i.png" and got["a"].title == "T 1" and str(got["a"].pub_date) == "2026-01-01"
    assert run() == got  # nothing new


def test_daily_counts_close_by_watermark(spark, tmp_path):
    src = tmp_path / "in"
    drop(src, "1.json", [item("a", 1), item("b", 1), item("z", 1, published_at=datetime(2026, 3, 1))])
    counts = ingest.daily_counts(ingest.read_item_stream(spark, str(src)), "1 day")
    q = counts.writeStream.format("memory").queryName("days").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.sql("select cast(date as string), count from days").collect()] == [("2026-01-01", 2)]


def test_health_is_kept_between_batches(spark, tmp_path):
    src = tmp_path / "polls"
    src.mkdir()
    start = datetime(2026, 1, 1)

    def write(name, kinds, at):
        (src / name).write_text("\n".join(json.dumps({"source_id": "s", "ts": (start + timedelta(hours=at + i)).isoformat(), "kind": k, "item_count": 1}) for i, k in enumerate(kinds)))

    polls = spark.readStream.schema("source_id string, ts timestamp, kind string, item_count int").json(str(src))

    def run():
        seen = []
        q = ingest.live_health(polls).writeStream.outputMode("update").foreachBatch(lambda df, n: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        return seen[-1]

    write("1.json", ["success", "failure", "failure"], 0)
    assert (run()["status"]) == "failing"
    write("2.json", ["failure"], 5)
    assert tuple(run())[2:] == ("quarantined", 3, 0)
    write("3.json", ["success"], 9)
    assert run()["status"] == "ok"


def test_a_lost_cache_loses_no_rows(spark, tmp_path, monkeypatch):
    """What is kept in memory goes right before the store's files are replaced, as when an executor is lost."""
    store = str(tmp_path / "store")
    merge = ingest.merge_batch(store)
    frame = lambda rows: spark.createDataFrame(rows, ITEM)
    merge(frame([item("a", 1), item("b", 1)]), 0)
    write = ingest.write_days

    def forgetful(merged, path, *args):
        spark.catalog.clearCache()
        write(merged, path, *args)

    monkeypatch.setattr(ingest, "write_days", forgetful)
    merge(frame([item("b", 2, image="i.png"), item("c", 2)]), 1)
    got = {r["id"]: r for r in spark.read.parquet(store).collect()}
    assert set(got) == {"a", "b", "c"} and got["b"].image == "i.png"


def test_late_items_by_the_clock(spark, tmp_path):
    store = str(tmp_path / "store")
    rows = [item("a", 1), item("old", 1, published_at=datetime(2025, 1, 1))]
    ingest.merge_batch(store, clock=lambda: datetime(2025, 1, 20))(spark.createDataFrame(rows, ITEM), 0)
    assert {r["id"] for r in spark.read.parquet(store).collect()} == {"a", "old"}
    ingest.merge_batch(store, clock=lambda: datetime(2026, 6, 1))(spark.createDataFrame([item("new", 1), item("old", 2, published_at=datetime(2025, 1, 1))], ITEM), 1)
    assert {r["id"] for r in spark.read.parquet(store).collect()} == {"a", "old"}  # known ones may be old
