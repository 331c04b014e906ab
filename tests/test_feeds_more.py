"""Listings with credentials and gates, transports without a network, stored states, skewed joins."""

import base64
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from storyweft import schema, session
from storyweft.operators import rules
from storyweft.operators.skew import salted_join
from storyweft.plans.views import dedupe_members, sort_sightings
from storyweft.sources import feeds, files, replay


def test_tokens_are_kept_until_a_minute_before_they_end():
    asked = []

    def ask(url, headers, body):
        asked.append((url, headers, body))
        return 200, json.dumps({"access_token": f"t{len(asked)}", "expires_in": 600})

    t = feeds.TokenCache("id", "secret", "agent", ask)
    assert [t.token(0), t.token(539), t.token(540)] == ["t1", "t1", "t2"]
    assert asked[0][1]["Authorization"] == "Basic " + base64.b64encode(b"id:secret").decode() and asked[0][2] == "grant_type=client_credentials"
    answers = iter([(200, {}, "{}"), (401, {}, ""), (200, {}, "[]")])
    got = [feeds.fetch_listing("u", t, lambda u, h: next(answers), 541) for _ in range(3)]
    assert got == [(200, "{}", None), (401, None, "HTTP 401"), (200, "[]", None)] and len(asked) == 3  # refused once, so asked anew
    with pytest.raises(OSError):
        feeds.TokenCache("i", "s", "a", lambda *x: (500, "")).token(0)
    assert feeds.fetch_listing("u", feeds.TokenCache("i", "s", "a", lambda *x: (200, "{}")), None, 0) == (0, None, "no access_token")


def test_listings_need_credentials(spark):
    s = spark.createDataFrame([("a", "rss"), ("b", "reddit")], "id string, kind string")
    assert [r["id"] for r in feeds.permitted(s, None).collect()] == ["a"] and feeds.permitted(s, {"client_id": "x", "client_secret": " "}).count() == 1
    assert feeds.permitted(s, {"client_id": "x", "client_secret": "y"}).count() == 2


def test_gates_of_each_source(spark):
    names = [x.split()[0] for x in feeds.POST.split(", ")]
    rows = []
    for source, ident, score, own, flair, title in [("s", "low", 30, False, "Odd", "Five words make a story"), ("s", "ok", 41, False, "A SIGHTING", "Five words make a story"), ("s", "flair", 90, False, None, "Five words make a story"), ("t", "ok2", 25, False, None, "Five words make a story"), ("t", "self", 200, True, None, "Five words make a story"), ("u", "ask", 99, False, None, "what is this thing here"), ("u", "ask2", 99, False, None, "what is this Thing here")]:
        post = dict.fromkeys(names) | {"id": ident, "title": title, "score": score, "is_self": own, "link_flair_text": flair, "author": "x"}
        rows.append((source, *(post[n] for n in names)))
    posts = spark.createDataFrame(rows, f"source_id string, {feeds.POST}")
    gates = spark.createDataFrame([("s", 40, None, ["sighting"]), ("t", None, None, None)], "id string, min_score int, min_self_score int, flairs array<string>")
    assert {r["id"] for r in feeds.keep_post(posts, gates).collect()} == {"ok", "ok2", "ask2"}
    assert {r["id"] for r in feeds.keep_post(posts).collect()} == {"low", "ok", "flair", "ok2", "ask2"}
    assert feeds.keep_post(posts.where("false"), gates).count() == 0


def test_replayed_answers():
    assert replay.feed("x" * 7, {})[0] == 503 and replay.feed("x" * 8, {"If-None-Match": '"8"'})[0] == 304 and replay.feed("x" * 8, {})[0] == 200
    assert replay.page("x" * 9, 5) == (200, "x" * 9 + "?", "image/png", b"x" * 6)


def test_states_and_articles_are_stored(spark, tmp_path):
    at = datetime(2026, 1, 1)
    row = lambda i, when, body: (i, "u", when, "t", None, "s", None, "en", 3, None, body)
    a = spark.createDataFrame([row("0a", at, "old"), row("0a", datetime(2026, 2, 1), "new\n<p>"), row("1b", at, None), row(None, at, "x")], schema.ARTICLE)
    files.write_articles(a, str(tmp_path / "a"))
    assert {r["id"]: r["content"] for r in files.read_article_lines(spark, str(tmp_path / "a")).collect()} == {"0a": "new\n<p>", "1b": None}
    tries = spark.createDataFrame([("b", 2, at, None, "e", True), ("a", 1, at, at, None, False)], schema.ATTEMPT)
    files.write_state(tries, str(tmp_path / "s"), "attempt")
    assert {(r["id"], r["attempts"], r["final"]) for r in files.read_state(spark, str(tmp_path / "s"), "attempt").collect()} == {("a", 1, False), ("b", 2, True)}
    assert files.read_state(spark, str(tmp_path / "none"), "health").count() == 0
    ours, theirs = files.read_conflict(spark, str(tmp_path / "none"), str(tmp_path / "none2"))
    assert ours.count() == theirs.count() == 0
    files.write_images(spark.createDataFrame([("0a", b"x")], "id string, data binary"), str(tmp_path / "i"))
    assert spark.read.parquet(str(tmp_path / "i")).first()["data"] == b"x"


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_hot_keys_are_joined_in_parts(spark, how):
    rows = spark.createDataFrame([("hot" if i % 3 == 0 else f"k{i % 7}" if i % 5 else None, i) for i in range(300)], "k string, i int")
    stats = rows.where("k != 'k4'").groupBy("k").agg(F.count("*").alias("n"))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(salted_join(rows, stats, ["k"], "n", ["i"], how, 10).select("k", "i")) == key(rows.join(stats, "k", how).select("k", "i"))
    assert salted_join(rows.where("false"), stats, ["k"], "n", ["i"], how, 10).count() == 0


def test_members_and_sightings(spark):
    m = spark.createDataFrame([("s", 0, "The Post", "a b", 1), ("s", 1, "the post", "a b", 2), ("s", 2, "Post", "a c", 3), ("t", 0, "Post", "a b", 4)], "story string, pos int, publisher string, title_norm string, n int")
    assert sorted(r["n"] for r in dedupe_members(m).collect()) == [1, 3, 4]
    s = spark.createDataFrame([("a", 1, "Y", 2), ("b", 2, "X", 9), ("c", 3, "X", 2)], "id string, date int, place string, outlets int")
    order = lambda *x: [r["id"] for r in sort_sightings(s, *x).collect()]
    assert order() == ["a", "b", "c"] and order("outlets") == ["b", "a", "c"] and order("place") == ["b", "c", "a"] and order("date", True) == ["c", "b", "a"]
    with pytest.raises(ValueError):
        order("tier")


def test_listed_publishers(spark):
    df = spark.createDataFrame([("The Post",), ("Ghost TV",), ("Mill",), (None,)], "p string")
    keys = spark.createDataFrame([("post",), ("post",)], "publisher_key string")
    assert [(r["p"], r["listed"]) for r in rules.publisher_in(df, "p", keys, (r"\bTV\b",)).orderBy("p").collect()] == [(None, False), ("Ghost TV", True), ("Mill", False), ("The Post", True)]
    assert rules.publisher_in(df, "p", None).where("listed").count() == 0


def test_a_cluster_needs_a_shared_folder():
    class Nothing:
        def isDefined(self):
            return False

    class Inner:
        def sc(self):
            return self

        def getCheckpointDir(self):
            return Nothing()

    class Context:
        master, _jsc = "spark://host:7077", Inner()

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        session.shared_folder(Session())


def test_states_go_on_from_where_they_were(spark):
    """Folding a log in two parts gives what folding it at once gives."""
    from storyweft.operators.health import fold_health

    kinds = ["success", "failure", "failure", "not_modified", "success", "success", "failure", "failure", "failure", "disabled"]
    rows = [(s, datetime(2026, 1, 1 + i), k, 500 if k == "failure" else 200, i % 3, "e", "m", f"x{i}") for s, n in (("a", 10), ("b", 7), ("c", 4)) for i, k in enumerate(kinds[:n])] + [("d", datetime(2026, 1, 9), "failure", None, None, None, None, None)]
    log = spark.createDataFrame(rows, "source_id string, ts timestamp, kind string, status int, item_count int, etag string, last_modified string, error string")
    early = F.col("ts") < "2026-01-06"
    whole = {tuple(r) for r in fold_health(log, 2).collect()}
    assert {tuple(r) for r in fold_health(log.where(~early), 2, fold_health(log.where(early), 2)).collect()} == whole
    assert {tuple(r) for r in fold_health(log.where("false"), 2, fold_health(log, 2)).collect()} == whole
