import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from storyweft.operators import cluster, rank, similarity
from storyweft.operators.components import components
from storyweft.schema import ITEM
from storyweft.session import cut

START = datetime(2026, 9, 6, 12)


def now():
    return F.to_timestamp(F.lit("2026-09-06 12:00:00"))


def item(id, title, publisher="P", hours=1.0, **k):
    norm = " ".join("".join(c if c.isalnum() else " " for c in title.lower()).split())
    d = {"id": id, "title": title, "title_norm": norm, "url": f"https://a.example/{id}", "url_opaque": False, "publisher": publisher, "publisher_url": None, "tier": "press", "topics": ["ufo"], "flags": [], "published_at": START - timedelta(hours=hours), "first_seen_at": START, "feed_id": "f", "snippet": None, "image": None}
    return tuple((d | k)[c] for c in [x.split()[0] for x in ITEM.split(", ")])


def filler(n=30):
    return [item(f"z{i:03d}", f"Common words stay here alpha{i} beta{i}", f"F{i}", 200 + i) for i in range(n)]


def stories(spark, rows):
    return {tuple(sorted(r["items"])): r for r in cluster.build_stories(spark.createDataFrame(rows, ITEM), now()).collect()}


def test_components_of_random_graphs(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = {n: n for e in edges if None not in e for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {n: find(n) for n in root}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_syndicated_copies_are_one_story_of_one_write_up(spark):
    rows = filler() + [item(f"s{i:02d}", "Glowing lantern drifts across Tarn Valley quarry", f"Paper {i}", 2) for i in range(20)] + [item("x", "Glowing lantern drifts across Tarn Valley", "Other", 200 * 24)]
    got = stories(spark, rows)
    big = next(v for k, v in got.items() if "s00" in k)
    assert len(big["items"]) == 20 and big["corroboration"] == 1 and len(big["publishers"]) == 20


def test_independent_write_ups_beat_copies(spark):
    copies = [item(f"s{i:02d}", "Glowing lantern drifts across Tarn Valley quarry", f"Paper {i}", 2) for i in range(20)]
    three = [item("a", "Hairy walker crosses Fenwick orchard twice", "A", 2), item("b", "Twice seen: hairy walker in Fenwick orchard", "B", 2), item("c", "Fenwick orchard hairy walker baffles warden", "C", 2)]
    got = stories(spark, filler() + copies + three)
    assert got[("a", "b", "c")]["score"] > got[tuple(f"s{i:02d}" for i in range(20))]["score"]


def test_same_headline_weeks_apart_is_two_stories(spark):
    got = stories(spark, filler() + [item("a", "Bells ring unaided at Hob chapel", "A", 1), item("b", "Bells ring unaided at Hob chapel", "B", 20 * 24)])
    assert ("a",) in got and ("b",) in got


def test_majority_of_one_in_two_does_not_stick(spark):
    t = "Strange hum over Dunmore weir returns"
    two = stories(spark, filler() + [item("a", t, "A", 1, flags=["offbeat"]), item("b", t, "B", 1)])
    assert two[("a", "b")]["flags"] == []
    three = stories(spark, filler() + [item("a", t, "A", 1, flags=["offbeat"]), item("b", t, "B", 1), item("c", t, "C", 1, flags=["offbeat"])])
    assert three[("a", "b", "c")]["flags"] == ["offbeat"]


def test_roll_up_fields(spark):
    t = "Pale orb hovers over Skelling reservoir"
    rows = filler() + [
        item("a", t, "kptv.com", 9, tier="genre", snippet="late"), item("b", "RAW: PALE ORB", "KPTV", 8, tier="official", url_opaque=True, title_norm="pale orb hovers over skelling reservoir"),
        item("c", t, "KPTV", 5, tier="press", topics=["science", "ghosts"], image="i.png"),
    ]
    r = stories(spark, rows)[("a", "b", "c")]
    assert r["id"] == "a" and r["tier"] == "official" and r["items"] == ["b", "c", "a"] and r["primary_id"] == "c"
    assert r["publishers"] == ["KPTV"] and r["topics"] == ["ufo", "ghosts", "science"] and r["snippet"] == "late" and r["image"] == "i.png"
    assert r["corroboration"] == 1 and r["first_published"] < r["latest_published"]


def test_consensus_headline(spark):
    rows = filler() + [
        item("a", "On cam: mystery lamps spark buzz, craft or aliens above Orme pier", "A", 3), item("b", "Mystery lamps above Orme pier", "B", 3), item("c", "Mystery lamps seen above Orme pier crowd", "C", 3), item("d", "Mystery lamps above Orme pier again baffle", "D", 3),
    ]
    got = stories(spark, rows)
    assert got[("a", "b", "c", "d")]["title"] == "Mystery lamps above Orme pier"


def test_guarded_components_are_those_of_one_sequential_pass(spark):
    """Random links over wide spans, replayed by component, against one pass over all links in order."""
    rng = random.Random(7)
    for _ in range(3):
        n = 60
        items = [(f"i{k:02d}", START + timedelta(hours=rng.randrange(0, 900))) for k in range(n)]
        when = dict(items)
        order = lambda i: (when[i], i)
        pairs = set()
        for _ in range(55):
            a, b = sorted(rng.sample([i for i, _ in items], 2), key=order)
            pairs.add((a, b))
        rows = [(a, b, 0.5, rng.randrange(2), rng.randrange(4)) for a, b in sorted(pairs)]
        root, lo, hi = {i: i for i in when}, dict(when), dict(when)

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b, _, phase, pos in sorted(rows, key=lambda r: (r[3], order(r[0]), r[4], order(r[1]))):
            x, y = find(a), find(b)
            if x != y and max(hi[x], hi[y]) - min(lo[x], lo[y]) <= timedelta(hours=168):
                root[y] = x
                lo[x], hi[x] = min(lo[x], lo[y]), max(hi[x], hi[y])
        groups = {}
        for i in when:
            groups.setdefault(find(i), []).append(i)
        expected = {i: min(g, key=order) for g in groups.values() for i in g}
        df = spark.createDataFrame(items, "id string, published_at timestamp")
        links = cut(spark.createDataFrame(rows, "a string, b string, similarity double, phase int, pos int"))
        got = {r["id"]: r["story"] for r in cluster.guarded_components(df, links).collect()}
        assert got == expected


def test_similar_pairs_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    items = [(f"i{k:02d}", " ".join(rng.sample(words, 5)), START + timedelta(hours=rng.randrange(0, 200))) for k in range(70)]
    items += [("i98", items[0][1], items[0][2]), ("i99", "", START)]
    import math

    toks = {i: set(t.split()) for i, t, _ in items}
    n = len(items)
    df = {w: sum(w in s for s in toks.values()) for w in words}
    idf = {w: math.log((n + 1) / (df[w] + 1)) + 1 for w in words}
    expected = set()
    for i, a, ta in items:
        for j, b, tb in items:
            s = toks[i] & toks[j]
            if (ta, i) < (tb, j) and a != b and len(s) >= 2 and any(df[w] <= 10 for w in s) and abs((ta - tb).total_seconds()) <= 72 * 3600:
                if sum(idf[w] for w in s) / sum(idf[w] for w in toks[i] | toks[j]) >= 0.3:
                    expected.add((i, j))
    table = spark.createDataFrame(items, "id string, title_norm string, published_at timestamp")
    got = similarity.similar_pairs(table, least_df=10).collect()
    assert {(r["a"], r["b"]) for r in got if r["phase"] == 1} == expected
    assert {(r["a"], r["b"]) for r in got if r["phase"] == 0} == {("i00", "i98")}


def test_write_ups_are_transitive(spark):
    rows = [("s", "a", "t1", "P"), ("s", "b", "t1", "Q"), ("s", "c", "t2", "q.com"), ("s", "d", "t3", "R"), ("u", "a", "t1", "P")]
    got = {(r["story"], r["id"]): r["write_up"] for r in cluster.write_ups(spark.createDataFrame(rows, "story string, id string, title_norm string, publisher string")).collect()}
    assert got == {("s", "a"): "a", ("s", "b"): "a", ("s", "c"): "a", ("s", "d"): "d", ("u", "a"): "a"}


def test_interleave(spark):
    rows = [(i + 1, t) for i, t in enumerate("uuuugcu")]
    got = rank.interleave(spark.createDataFrame(rows, "rank int, topic string")).orderBy("place").collect()
    assert " ".join(f"{r['rank']}{r['topic']}" for r in got) == "1u 2u 5g 3u 4u 6c 7u"


def test_score_penalties_multiply(spark):
    s = lambda flags: spark.range(1).select(cluster.score(F.lit(4.0), F.lit(3), now(), F.lit(flags).cast("array<string>"), now())).first()[0]
    import math

    assert s([]) == pytest.approx(4 * (1 + math.log(3)) / 6) and s(["notice", "offbeat"]) == pytest.approx(s([]) * 0.3 * 0.25)


def test_empty_items(spark):
    assert cluster.build_stories(spark.createDataFrame([], ITEM), now()).count() == 0
