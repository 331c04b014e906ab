import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from storyweft.functions.instants import UNLIKELY, readings
from storyweft.operators.instants import _best, misdated, read_instants

NY, LONDON, DUBLIN, DELHI, SYDNEY = "America/New_York", "Europe/London", "Europe/Dublin", "Asia/Kolkata", "Australia/Sydney"


def us(*a):
    return int((datetime(*a, tzinfo=timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1))


def likely(text, tz=None, edition=None):
    found = {u for _, u, c in readings(text, tz, edition) if c == 0}
    assert len(found) <= 1 or not edition
    return min(found) if found else None


CASES = [
    ("Tue, 08 Sep 2026 18:33:50 GMT", NY, "US", us(2026, 9, 8, 18, 33, 50)),
    (" Mon, 13 Apr 2026 06:55:38 +0530 \n", NY, "US", us(2026, 4, 13, 1, 25, 38)),
    ("2025-12-26T17:16:49Z", NY, "US", us(2025, 12, 26, 17, 16, 49)),
    ("2025-12-26t17:16:49z", NY, "US", us(2025, 12, 26, 17, 16, 49)),
    ("2026-09-01T09:13:33.511607-04:00", None, None, us(2026, 9, 1, 13, 13, 33, 511607)),
    ("2026-09-01T09:13:33.5", LONDON, "GB", us(2026, 9, 1, 8, 13, 33, 500000)),
    ("20260831T080301Z", NY, "US", us(2026, 8, 31, 8, 3, 1)),
    ("09/10/2026 18:40", NY, "US", us(2026, 9, 10, 22, 40)),
    ("09/10/2026 18:40", LONDON, "GB", us(2026, 10, 9, 17, 40)),
    ("29/2/2026, 8:38 AM", LONDON, "GB", None),
    ("13/05/2026 10:00", NY, "US", None),
    ("29.05.2026 01:34", SYDNEY, "AU", us(2026, 5, 28, 15, 34)),
    ("1786510773463", NY, "US", 1786510773463000),
    ("1758323604", NY, "US", 1758323604000000),
    ("May 16, 2026 at 12:16 AM CDT", "America/Chicago", "US", us(2026, 5, 16, 5, 16)),
    ("May 16, 2026 at 12:16 PM EST", NY, "US", us(2026, 5, 16, 17, 16)),
    ("19 Jun 26 03:13:57 -0400", NY, "US", us(2026, 6, 19, 7, 13, 57)),
    ("19 March 2026, 06:31 (UTC-05:00)", NY, "US", us(2026, 3, 19, 11, 31)),
    ("Wed 11 Mar 2026 12:04 IST", DELHI, "IN", us(2026, 3, 11, 6, 34)),
    ("Wed 11 Mar 2026 12:04 IST", DUBLIN, "IE", us(2026, 3, 11, 11, 4)),
    ("Fri, 09 Jan 2026 12:04 BST", LONDON, "GB", us(2026, 1, 9, 11, 4)),
    ("January 3, 2026", SYDNEY, "AU", us(2026, 1, 2, 13)),
    ("2025-12-06", NY, "US", us(2025, 12, 6, 5)),
    ("2025-11-02 01:30:00", NY, "US", us(2025, 11, 2, 5, 30)),  # twice: the earlier
    ("2026-03-08 02:30:00", NY, "US", us(2026, 3, 8, 7, 30)),  # skipped: the offset before
    ("31 Feb 2026 10:00:00 GMT", NY, "US", None),
    ("2026-13-40T25:61:00Z", NY, "US", None),
    ("0000-00-00 00:00:00", NY, "US", None),
    ("Mon, Foo 2026", NY, "US", None),
    ("yesterday", NY, "US", None),
    ("13:00 PM", NY, "US", None),
    ("x" * 100_000, NY, "US", None),
    ("", NY, "US", None),
    (None, NY, "US", None),
]


@pytest.mark.parametrize("text,tz,edition,expected", CASES)
def test_reading(text, tz, edition, expected):
    assert likely(text, tz, edition) == expected


def test_all_readings_are_offered():
    both = readings("03/04/2026 10:00", LONDON, None)
    assert {f for f, _, _ in both} == {"slash-mdy", "slash-dmy"} and {c for _, _, c in both} == {0.0}
    twice = readings("2025-11-02 01:30:00", NY, "US")
    assert sorted(c for _, _, c in twice) == [0.0, UNLIKELY]


def sources(spark):
    return spark.createDataFrame([("us", NY, "US"), ("gb", LONDON, "GB"), ("none", LONDON, None)], "id string, tz string, edition string")


ENTRY = "entry_id bigint, source_id string, published string, fetched_at timestamp, tz string"


def entries(spark, rows):
    return spark.createDataFrame([(i, s, p, datetime(2026, 5, 1) + timedelta(minutes=i), "clash") for i, s, p in rows], ENTRY)


def test_order_decides_what_nothing_else_does(spark):
    rows = [(1, "none", "25/03/2026 10:00"), (2, "none", "04/05/2026 10:00"), (3, "none", "26/03/2026 10:00"), (4, "us", "04/05/2026 10:00"), (5, "none", None), (6, None, "2026-01-01T00:00:00Z")]
    got = {r["entry_id"]: r for r in read_instants(entries(spark, rows), sources(spark)).collect()}
    assert got[2]["form"] == "slash-dmy" and got[4]["form"] == "slash-mdy"
    assert set(got) == {1, 2, 3, 4, 6} and got[6]["utc_us"] == us(2026, 1, 1)


def test_partitions_give_what_one_pass_gives(spark):
    """A source over many partitions, nearly all of it ambiguous, against Viterbi over the whole of it."""
    rng = random.Random(4)
    rows = []
    for i in range(400):
        d, m = rng.randint(1, 13), rng.randint(1, 12)
        rows.append((i, "none", f"{d:02d}/{m:02d}/2026 10:00" if rng.random() < 0.9 else f"2026-{m:02d}-{min(d, 28):02d}T00:00:00Z"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        got = {r["entry_id"]: (r["form"], r["utc_us"]) for r in read_instants(entries(spark, rows), sources(spark)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    from storyweft.operators.instants import FORMS, _step

    chain = [[(FORMS.index(f), u, c) for f, u, c in readings(p, LONDON, None)] for _, _, p in rows]
    rows = [r for r, c in zip(rows, chain) if c]
    chain = [c for c in chain if c]
    price = lambda path: path[0][2] + sum(_step([a], [b])[0, 0] for a, b in zip(path, path[1:]))
    best = price([c[k] for c, k in zip(chain, _best(chain))])
    own = [next(x for x in c if (FORMS[x[0]], x[1]) == got[r[0]]) for r, c in zip(rows, chain)]
    assert price(own) == pytest.approx(best)


def test_empty_and_repeated(spark):
    assert read_instants(entries(spark, []), sources(spark)).count() == 0
    twice = entries(spark, [(1, "us", "2026-01-01"), (1, "us", "2026-01-01")])
    assert read_instants(twice, sources(spark)).count() == 2


def test_misdated(spark):
    items = spark.sql("select * from values ('a', 'us', 'u1', timestamp'2026-01-01 00:00:00'), ('b', 'us', 'u2', timestamp'2026-01-01 00:00:00'), ('c', 'us', 'u3', null), ('d', 'us', 'u9', timestamp'2026-01-01 00:00:00') t(id, feed_id, url, published_at)")
    inst = spark.sql(f"select * from values ('us', 'u1', {us(2026, 1, 1)}), ('us', 'u2', {us(2026, 1, 2)}), ('us', 'u3', 5) t(source_id, link, utc_us)").withColumn("link_hash", F.xxhash64("link"))
    assert {tuple(r) for r in misdated(items, inst).collect()} == {("b", us(2026, 1, 2)), ("c", 5)}


def test_the_order_of_records_decides(spark, monkeypatch):
    """Where no edition is known, the days first in the records around decide; without the chain they don't, nor against an edition."""
    from storyweft.operators import instants

    texts = ["13/05/2026 08:00", "05/06/2026 09:00", "14/06/2026 08:00", "15/06/2026 08:00"]
    start = datetime(2026, 6, 20)
    rows = [(i, s, t, start + timedelta(hours=i)) for s in ("none", "us") for i, t in enumerate(texts)] + [(9, "lone", texts[1], start)]
    entries = spark.createDataFrame(rows, "entry_id bigint, source_id string, published string, fetched_at timestamp")
    sources = spark.createDataFrame([("none", NY, None), ("us", NY, "US"), ("lone", NY, None)], "id string, tz string, edition string")
    for size in (1_000_000, 2):
        got = {(r["source_id"], r["entry_id"]): r["utc_us"] for r in read_instants(entries, sources, rows=size).collect()}
        assert got["none", 1] == us(2026, 6, 5, 13) and got["us", 1] == us(2026, 5, 6, 13) and got["lone", 9] == us(2026, 5, 6, 13)
        assert ("us", 0) not in got and ("none", 3) in got
    chain = [[(f, u, c) for f, u, c in readings(t, NY, None)] for t in texts]
    assert chain[1][_best(chain)[1]][0] == "slash-dmy"
    monkeypatch.setattr(instants, "SWITCH", 0.0)
    monkeypatch.setattr(instants, "BACK", 0.0)
    assert chain[1][_best(chain)[1]][0] == "slash-mdy"


def test_zone_letters_without_a_country():
    found = {c: u for _, u, c in readings("Fri, 09 Jan 2026 12:00 CST", None, None)}
    assert found[0.0] == us(2026, 1, 9, 18) and min(c for c in found if c) < 1
    assert {c for _, _, c in readings("Fri, 09 Jan 2026 12:00 CST", "Asia/Shanghai", None)} == {0.0, UNLIKELY}
