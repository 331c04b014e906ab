from datetime import datetime

from pyspark.sql import functions as F

from storyweft.operators import store
from storyweft.schema import ITEM


def item(id, seen, **k):
    d = {"id": id, "title": f"T {seen}", "title_norm": f"t {seen}", "url": f"https://a.example/{seen}", "url_opaque": False, "publisher": "P", "publisher_url": None, "tier": "press", "topics": ["science", "ufo"], "flags": [], "published_at": datetime(2026, 1, 1), "first_seen_at": datetime(2026, 1, seen), "feed_id": "f", "snippet": None, "image": None}
    return tuple((d | k)[c] for c in d)


def test_first_sighting_wins(spark):
    rows = [item("a", 2, image="late.png", flags=["notice"]), item("a", 1, url="https://x/rss/articles/q", url_opaque=True, topics=["ghosts"], flags=["attraction"]), item("a", 3, snippet="s", image="later.png"), item(None, 1)]
    got = store.merge_first_wins(spark.createDataFrame(rows, ITEM)).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.title, r.url, r.url_opaque, r.image, r.snippet) == ("T 1", "https://a.example/2", False, "late.png", "s")
    assert r.topics == ["ufo", "ghosts", "science"] and r.flags == ["attraction", "notice"]


def test_merge_is_idempotent_and_empty_is_empty(spark):
    df = spark.createDataFrame([item("a", 2), item("a", 2), item("b", 1)], ITEM)
    once = store.merge_first_wins(df)
    assert sorted(map(str, store.merge_first_wins(once).collect())) == sorted(map(str, once.collect()))
    assert store.merge_first_wins(spark.createDataFrame([], ITEM)).count() == 0


def test_upsert_outcomes(spark):
    old = store.merge_first_wins(spark.createDataFrame([item("same", 1), item("more", 1), item("kept", 1)], ITEM))
    new = spark.createDataFrame([item("same", 1), item("more", 2, image="i"), item("new", 1)], ITEM)
    got = {r["id"]: r["outcome"] for r in store.upsert(old, store.merge_first_wins(new)).collect()}
    assert got == {"same": "unchanged", "more": "updated", "new": "added", "kept": None}


def test_conflicts_and_patches(spark):
    ours, theirs = spark.createDataFrame([item("a", 2), item("b", 2, title="ours")], ITEM), spark.createDataFrame([item("a", 1), item("b", 2, title="theirs")], ITEM)
    got = {r["id"]: r["title"] for r in store.conflict_union(ours, theirs).collect()}
    assert got == {"a": "T 1", "b": "ours"}
    fixed = store.patch(ours, spark.createDataFrame([("a", "https://new.example/")], "id string, url string"))
    assert {r["id"]: r["url"] for r in fixed.collect()} == {"a": "https://new.example/", "b": "https://a.example/2"}


def test_only_touched_days_are_written(spark, tmp_path):
    path = str(tmp_path / "items")
    first = store.upsert(spark.createDataFrame([], ITEM), store.merge_first_wins(spark.createDataFrame([item("a", 1), item("b", 1, published_at=datetime(2026, 1, 5))], ITEM)))
    store.write_days(first, path)
    stored = spark.read.parquet(path)
    assert stored.count() == 2
    before = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "items").glob("pub_date=2026-01-05/*.parquet")}
    old = spark.createDataFrame(stored.drop("pub_date").collect(), ITEM)
    store.write_days(store.upsert(old, spark.createDataFrame([item("c", 1)], ITEM)), path)
    assert {f.name: f.stat().st_mtime_ns for f in (tmp_path / "items").glob("pub_date=2026-01-05/*.parquet")} == before
    assert spark.read.parquet(path).count() == 3
    recent = store.window(spark.read.parquet(path), F.to_timestamp(F.lit("2026-02-04")), 30)
    assert [r["id"] for r in recent.collect()] == ["b"]
