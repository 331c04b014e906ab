import base64
import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from storyweft.functions import text as t
from storyweft.operators import extract, geo, health, robots, rules, timeseries
from storyweft.schema import PLACE, SOURCE
from storyweft.sources import feeds, files

T0 = datetime(2026, 1, 1)


# --- rules


def test_rules(spark):
    r = [rules.Rule("a", rules.words("owl"), unless=rules.words("film"), override=rules.words("witness")), rules.Rule("b", rules.near("lost", "hours")), rules.Rule("a", "barn")]
    df = spark.createDataFrame([("Owl seen",), ("Owl film",), ("Owl film witness",), ("Hours were lost; barn",), (None,), ("ÖWL",)], "x string")
    got = [x[0] for x in df.select(rules.labels(F.col("x"), r)).collect()]
    assert got == [["a"], [], ["a"], ["b", "a"], [], []]
    assert [x[0] for x in df.select(rules.first_match(F.col("x"), r, "none")).collect()][:2] == ["a", "none"]


def test_tier_lookup(spark):
    exact = spark.createDataFrame([("kptv", "press"), ("wire", "official")], "publisher_key string, tier string")
    df = spark.createDataFrame([("kptv.com",), ("The Wire",), ("University of X",), ("Blog",), (None,)], "publisher string")
    got = {r["publisher"]: r["tier"] for r in rules.publisher_tier(df, "publisher", exact, [rules.Rule("official", "university")]).collect()}
    assert got == {"kptv.com": "press", "The Wire": "official", "University of X": "official", "Blog": "genre", None: "genre"}


# --- time


def test_gap_free_days(spark):
    df = spark.createDataFrame([(datetime(2026, 1, 1, 5), True), (datetime(2026, 1, 4), False), (datetime(2026, 1, 4, 23), True), (None, True)], "at timestamp, p boolean")
    got = [tuple(r) for r in timeseries.daily(df, "at", F.col("p")).orderBy("date").collect()]
    assert got == [(date(2026, 1, 1), 1, 1), (date(2026, 1, 2), 0, 0), (date(2026, 1, 3), 0, 0), (date(2026, 1, 4), 2, 1)]
    assert timeseries.daily(df.where("false"), "at").count() == 0
    assert timeseries.daily(df.limit(1), "at").count() == 1
    assert tuple(timeseries.peak(timeseries.daily(df, "at")).first()) == (date(2026, 1, 4), 2, 1, 2)


def test_brush_in_any_order(spark):
    df = spark.sql("select explode(sequence(date'2026-01-01', date'2026-01-09')) d")
    a, b = F.lit(date(2026, 1, 3)), F.lit(date(2026, 1, 5))
    assert timeseries.brush(df, "d", a, b).count() == timeseries.brush(df, "d", b, a).count() == 3


# --- health


def polls(spark, kinds, start=T0):
    rows = [("s", start + timedelta(hours=i), k, 200 if k != "failure" else 500, n, "e1" if k == "success" else None, None, "boom" if k == "failure" else None) for i, (k, n) in enumerate(kinds)]
    return spark.createDataFrame(rows, "source_id string, ts timestamp, kind string, status int, item_count int, etag string, last_modified string, error string")


def state(spark, kinds, **k):
    return health.fold_health(polls(spark, kinds), **k).first()


def test_health_states(spark):
    ok, bad, same = ("success", 3), ("failure", None), ("not_modified", None)
    assert state(spark, [ok, bad]).status == "failing" and state(spark, [ok, bad]).etag is None
    q = state(spark, [ok, bad, bad, bad, bad])
    assert (q.status, q.consecutive_failures, q.quarantined_at) == ("quarantined", 4, T0 + timedelta(hours=3))
    healed = state(spark, [bad, bad, bad, ok])
    assert (healed.status, healed.consecutive_failures, healed.quarantined_at, healed.last_error) == ("ok", 0, None, None)
    kept = state(spark, [ok, same])
    assert (kept.etag, kept.last_item_count) == ("e1", 3)
    assert state(spark, [bad, ("disabled", None)]).status == "disabled"


def test_empty_polls_fail_once_in_a_while(spark):
    empty = ("success", 0)
    assert state(spark, [empty] * 2, allowed=3).consecutive_empty == 2
    assert state(spark, [empty] * 3, allowed=3).status == "failing"
    assert state(spark, [empty] * 4, allowed=3).status == "ok"


def test_retries(spark):
    now = lambda h: F.lit(T0 + timedelta(hours=h))
    log = spark.createDataFrame([("a", T0, "x", False), ("b", T0, "x", False), ("b", T0 + timedelta(hours=2), "y", False), ("c", T0, "gone", True), ("d", T0, "x", None), ("d", T0, "x", None), ("d", T0, "x", None)], "id string, ts timestamp, error string, final boolean")
    a = health.fold_attempts(log)
    got = {r["id"]: r for r in a.collect()}
    assert got["a"].next_attempt_at == T0 + timedelta(hours=2) and got["b"].next_attempt_at == T0 + timedelta(hours=10)
    assert got["c"].final and got["d"].final and got["c"].next_attempt_at is None
    ids = spark.createDataFrame([(x,) for x in "abcde"], "id string")
    assert sorted(r["id"] for r in health.due(ids, a, now(3)).collect()) == ["a", "e"]
    assert sorted(r["id"] for r in health.due(ids, a, now(10)).collect()) == ["a", "b", "e"]


def test_streaks(spark):
    rows = [(i, "u", T0 + timedelta(hours=i), k) for i, k in enumerate("eeoeeeo")]
    df = spark.createDataFrame(rows, "n int, u string, ts timestamp, k string")
    got = [r["streak"] for r in health.streaks(df, "u", "ts", F.col("k") == "e", "n").orderBy("n").collect()]
    assert got == [1, 2, 0, 1, 2, 3, 0]


# --- places


def places(spark):
    rows = [("Skelling", 54.0, -2.0, "city", "Norland", "GB"), ("New Tarn", 41.0, -80.0, "city", "Ohio", "US"), ("Tarn", 1.0, 1.0, "country", None, "TN"), ("Norland", 54.5, -2.5, "region", None, "GB")]
    return geo.precedence(spark.createDataFrame(rows, PLACE), F.lower("name"), [F.col("name")])


def test_locate(spark):
    rows = [
        ("a", "Owl seen near New Tarn mill", None), ("b", "Orb over Skelling, Norland baffles all", None), ("c", "Skeptics call Skelling orb a hoax", None), ("d", "Owl seen again", "<p>SKELLING, Norland (Wire) — It came.</p>"),
        ("e", "Nothing here", "plain text"), ("f", None, None), ("g", "Norland's beast heard near Tarn", None),
    ]
    got = {r["id"]: (r["name"], r["provenance"]) for r in geo.locate(spark.createDataFrame(rows, "id string, title string, body string"), places(spark), body="body").collect()}
    assert got == {"a": ("New Tarn", "headline"), "b": ("Skelling", "headline"), "d": ("Skelling", "dateline"), "g": ("Norland", "headline")}


def test_gazetteer(spark):
    countries = spark.createDataFrame([("Tarn", "TN", 1.0, 2.0)], "name string, code string, lat double, lon double")
    cities = spark.createDataFrame([("Big", "US", "Ohio", 20000, 10.0, 10.0), ("Small", "US", "Ohio", 10000, 40.0, 40.0), ("Mid", "FR", "Sud", 20000, 5.0, 5.0), ("Tarn", "US", None, 50000, 9.0, 9.0), ("None", "US", "Void", 0, 1.0, 1.0)], "name string, country string, admin string, population bigint, lat double, lon double")
    curated = spark.createDataFrame([("Big", 0.0, 0.0, "country", None, "XX")], PLACE)
    got = {r["key"]: r for r in geo.gazetteer(countries, cities, curated).collect()}
    assert set(got) == {"tarn", "big", "ohio", "sud"}
    assert got["tarn"].kind == "city" and got["big"].country == "XX" and got["ohio"].lat == pytest.approx(20.0)


def test_pins_spread(spark):
    df = spark.createDataFrame([(i, 1.0, 2.0) for i in range(3)], "i int, lat double, lon double")
    got = geo.spread_pins(df, [F.col("i")]).orderBy("i").collect()
    assert (got[0].pin_lat, got[0].pin_lon) == (1.0, 2.0) and len({(r.pin_lat, r.pin_lon) for r in got}) == 3


# --- robots


def test_robots(spark):
    body = "# x\nUser-agent: a\nUser-agent: *\nDisallow: /p # c\nAllow: /p/ok$\nDisallow:\n\nUser-agent: b\nDisallow: /\n\nUser-agent: *\nDisallow: /*.zip"
    r = robots.parse_robots(spark.createDataFrame([("o", body), ("n", None), ("e", "")], "origin string, body string"))
    assert {(x["allow"], x["pattern"]) for x in r.collect()} == {(False, "/p"), (True, "/p/ok$"), (False, "/*.zip")}
    paths = spark.createDataFrame([("o", p) for p in ("/", "/p/x", "/p/ok", "/p/ok2", "/a/b.zip")] + [("n", "/p")], "origin string, path string")
    got = {(x["origin"], x["path"]): x["allowed"] for x in robots.allowed(paths, r).collect()}
    assert got == {("o", "/"): True, ("o", "/p/x"): False, ("o", "/p/ok"): True, ("o", "/p/ok2"): False, ("o", "/a/b.zip"): False, ("n", "/p"): True}
    df = spark.createDataFrame([(200,), (404,), (503,), (None,)], "s int")
    assert [x[0] for x in df.select(robots.origin_policy(F.col("s"))).collect()] == ["rules", "allow", "deny", "deny"]


# --- extraction


def page(n=12, extra=""):
    body = "".join(f"<p>Paragraph number {i} tells of the mill, the owl, and the keeper who saw it fly past the tower at dusk.</p>" for i in range(n))
    return f"<html lang='en'><head><title>Owl - The Post</title><meta property='og:site_name' content='The Post'><meta property='og:image' content='/lead.jpg'><meta name='author' content='By A B'></head><body><nav><p>Home and more and more and more words here</p></nav><article>{body}<script>x</script><img src='/in.png' width='5'>{extra}</article><footer><p>Terms of this site and other words of it</p></footer></body></html>"


def test_extract():
    got = extract.extract(page(), "https://x.example/a/")
    assert got["title"] == "Owl" and got["byline"] == "A B" and got["lang"] == "en" and got["image"] == "https://x.example/lead.jpg"
    assert got["words"] == 12 * 21 and "Terms" not in got["content"] and "Home" not in got["content"]
    assert extract.extract(page(2), None) is None and extract.extract(None, None) is None and extract.extract("", None) is None
    same = "<p>The very same paragraph, said again and again, of the owl and of the mill and of the keeper.</p>"
    assert extract.extract(f"<div>{same * 20}</div>", None) is None


def test_sanitize():
    html = '<h1 onclick="x">T</h1><p style="a"><a href="/r" onclick="y">l</a><script>bad()</script></p><p> </p><img src="http://i.example/a.png"><img src="/t.gif" width="1"><figure><figcaption>c</figcaption></figure><a href="javascript:x">j</a>'
    got = extract.sanitize(html, "https://s.example/")
    assert got == '<h2>T</h2><p><a href="https://s.example/r" rel="noopener nofollow" target="_blank">l</a></p><img src="https://i.example/a.png" loading="lazy" /><a>j</a>'


def test_charsets():
    assert extract.decode_html("é".encode("latin-1"), "text/html; charset=ISO-8859-1") == "é"
    assert extract.decode_html(b'<meta charset="windows-1252">\x93', None).endswith("“")
    assert extract.decode_html("é".encode(), "text/html; charset=nope") == "é"


def test_extract_over_a_table(spark):
    df = spark.createDataFrame([("a", "https://x.example/", page(), "clash"), ("b", None, None, "clash")], "id string, url string, html string, words string")
    got = extract.extract_articles(df).collect()
    assert [r["id"] for r in got] == ["a"]
    assert extract.extract_articles(df.where("false")).count() == 0
    rep = df.select(extract.repetitive(F.concat(*[F.lit("<p>the same line of twenty letters</p>")] * 7))).first()[0]
    assert rep


# --- feeds

RSS = """<?xml version="1.0"?><rss xmlns:media="http://search.yahoo.com/mrss/" xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel>
<item><title>One</title><link>https://a.example/1</link><pubDate>Mon, 05 Jan 2026 10:00:00 GMT</pubDate><source url="https://p.example">Post</source></item>
<item><title><![CDATA[Two & more]]></title><guid>https://a.example/2</guid><dc:date>2026-01-05</dc:date><content:encoded><![CDATA[<p>x<img src="/i.png"></p>]]></content:encoded><media:content url="s.jpg" width="10" medium="image"/><media:content url="l.jpg" width="90" medium="image"/></item>
<item><title>No link</title></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A</title><link rel="self" href="https://a.example/self"/><link rel="alternate" type="text/html" href="https://a.example/a"/><updated>2026-01-05T00:00:00Z</updated><summary>s</summary></entry></feed>"""


def test_parse_feeds(spark):
    df = spark.createDataFrame([("r", RSS), ("a", ATOM), ("h", "<html></html>"), ("x", "not xml"), ("n", None)], "source_id string, body string")
    parsed = {r["source_id"]: r for r in feeds.parse_feeds(df).collect()}
    one, two = parsed["r"].entries
    assert one.source.name == "Post" and two.link == "https://a.example/2" and two.image == "l.jpg" and two.published == "2026-01-05" and two.title == "Two & more"
    assert parsed["a"].entries[0].link == "https://a.example/a"
    assert parsed["h"].error == "unrecognized feed root" and parsed["x"].error == "not XML" and parsed["n"].error == "not XML"
    assert feeds.entries(feeds.parse_feeds(df)).count() == 3


def test_listings(spark):
    post = {"id": "1", "title": "Strange light over Lake Tarn tonight", "subreddit": "ufo", "permalink": "/r/x", "url": "https://n.example/1", "is_self": False, "score": 30, "created_utc": 1767225600.0, "author": "me", "selftext": "", "domain": "n.example"}
    body = json.dumps({"data": {"children": [{"data": post}, {"data": post | {"title": None}}, {"data": post | {"score": 5}}, {"data": post | {"is_self": True, "score": 300, "selftext": "a  b", "id": "2"}}, None]}})
    posts = feeds.parse_listing(spark.createDataFrame([("s", body), ("t", "junk"), ("u", '{"data":{"children":7}}')], "source_id string, body string"))
    assert posts.count() == 3
    kept = feeds.post_entries(feeds.keep_post(posts)).orderBy("guid").collect()
    assert [(r.source.name, r.link) for r in kept] == [("n.example", "https://n.example/1"), ("r/ufo", "https://www.reddit.com/r/x")] and kept[1].summary == "a b"
    titles = spark.createDataFrame([("What is that thing there",), ("What did Anna Berg see there",), ("too short",)], "x string")
    assert [r[0] for r in titles.select(feeds.carries_story(F.col("x"))).collect()] == [False, True, False]


def test_link_ids():
    url = "https://a.example/" + "x" * 150
    varint = bytes([len(url) & 0x7F | 0x80, len(url) >> 7])
    ident = base64.urlsafe_b64encode(b"\x08\x13\x22" + varint + url.encode() + b"\xd2\x01\x00").decode().rstrip("=")
    assert feeds.embedded_url(feeds.article_id(f"https://n.example/rss/articles/{ident}?oc=5")) == url
    assert feeds.embedded_url("AAAA") is None and feeds.embedded_url(None) is None and feeds.article_id("https://x.example/") is None
    envelope = ")]}'\n\n" + json.dumps([["w", "z", json.dumps(["r", "https://a.example/z"])]])
    assert feeds.parse_envelope(envelope) == "https://a.example/z" and feeds.parse_envelope("x") is None
    assert feeds.decode_params('<a data-n-a-sg="S" data-n-a-ts="7">') == ("S", "7")


def test_registry(spark, tmp_path):
    good = {"id": "a-b", "name": "A", "kind": "google-news", "query": "owl mill", "edition": "GB", "topics": "auto"}
    path = tmp_path / "r.json"
    path.write_text(json.dumps({"sources": [good, {"id": "c", "name": "C", "kind": "rss", "url": "https://c.example/f", "topics": ["ufo"]}]}))
    df = feeds.read_registry(spark, str(path))
    c = F.col
    urls = [r[0] for r in df.select(feeds.source_url(c("kind"), c("url"), c("query"), c("edition"), c("subreddits"))).collect()]
    assert urls == ["https://news.google.com/rss/search?q=owl%20mill%20when%3A7d&hl=en-GB&gl=GB&ceid=GB:en", "https://c.example/f"]
    path.write_text(json.dumps({"sources": [good | {"id": "Bad Id", "query": None}, good, good]}))
    with pytest.raises(ValueError, match="kebab"):
        feeds.read_registry(spark, str(path))
    bad = spark.createDataFrame([("x", "n", "reddit", None, None, "ZZ", ["ok", "a b"], None, None, None, "t", ["nope"], False, None, True, None)], SOURCE)
    assert {r["problem"] for r in feeds.problems(bad).collect()} == {"subreddit has an odd name", "unknown edition", "unknown tier", "unknown topic"}


def fake(url, headers):
    if "down" in url:
        raise OSError("no route")
    if headers.get("If-None-Match") == "E":
        return 304, {}, ""
    return (200, {"etag": "E"}, RSS) if "a.example" in url else (404, {}, "")


def test_polling(spark):
    spark.dataSource.register(feeds.FeedSource)
    sources = [{"id": "new", "url": "https://a.example/f"}, {"id": "old", "url": "https://a.example/g", "etag": "E"}, {"id": "none", "url": "https://b.example/"}, {"id": "down", "url": "https://down.example/"}]
    df = spark.read.format("storyweft_feed").option("sources", json.dumps(sources)).option("transport", f"{__name__}:fake").option("pause", "0").load()
    got = {r["source_id"]: r for r in df.collect()}
    assert got["new"].etag == "E" and got["new"].body == RSS and got["old"].not_modified and got["old"].body is None
    assert got["none"].error == "HTTP 404" and got["down"].error == "no route" and got["down"].status == 0


# --- files


def test_csv(spark):
    df = spark.createDataFrame([('a,"b"', -1.5, "=x"), ("line\nbreak", float("nan"), None), (None, float("inf"), "-")], "t string, n double, f string")
    assert files.to_csv(df) == 't,n,f\r\n"a,""b""",-1.5,\'=x\r\n"line\nbreak",,\r\n,,\'-\r\n'
    assert files.to_csv(df.where("false"), ["t", "n"]) == "t,n\r\n"


def test_json_and_shards(spark, tmp_path):
    from tests.test_store import item

    from storyweft.schema import ITEM

    df = spark.createDataFrame([item("b", 1), item("a", 1)], ITEM)
    assert json.loads(files.json_lines(df).first()[0])["published_at"] == "2026-01-01T00:00:00.000Z"
    path = tmp_path / "shards"
    path.mkdir()
    for day in ("2026-01-01", "2026-01-02"):
        (path / f"{day}.json").write_text("[\n" + ",\n".join(r[0] for r in files.json_lines(df).collect()) + "\n]")
    (path / "other.json").write_text("[]")
    assert files.read_shards(spark, str(path)).count() == 4 and files.read_shards(spark, str(path), "2026-01-02").count() == 2
    assert files.read_state(spark, str(tmp_path / "none"), "health").count() == 0
    files.write_shards(df, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 2


def test_thumbnails(spark):
    df = spark.createDataFrame([(1600, 900), (100, 100), (640, 360)], "w int, h int")
    assert [tuple(r[0]) if r[0] else None for r in df.select(files.thumbnail_size(F.col("w"), F.col("h"))).collect()] == [(800, 450), None, (640, 360)]


def test_reading_minutes(spark):
    assert [r[0] for r in spark.createDataFrame([(0,), (660,)], "w int").select(t.reading_minutes(F.col("w"))).collect()] == [1, 3]


def page_fake(url, limit):
    if "down" in url:
        raise OSError("no route")
    if "big" in url:
        return 200, url, "text/html", b"x" * (limit + 1)
    return (200, url + "final", "text/html; charset=utf-8", b"<p>x</p>") if "ok" in url else (200, url, "image/svg+xml", b"<svg/>") if "svg" in url else (404, url, "", b"")


def test_pages_over_the_network(spark):
    from storyweft.sources.pages import PageSource

    spark.dataSource.register(PageSource)
    targets = [{"id": k, "url": f"https://{k}.example/"} for k in ("ok", "big", "svg", "down", "none")]
    df = spark.read.format("storyweft_page").option("targets", json.dumps(targets)).option("transport", f"{__name__}:page_fake").option("limit", "100").option("pause", "0").load()
    got = {r["id"]: r for r in df.collect()}
    assert bytes(got["ok"].body) == b"<p>x</p>" and got["ok"].url.endswith("final")
    assert {k: r.error for k, r in got.items() if k != "ok"} == {"big": "too large", "svg": "wrong type", "down": "no route", "none": "HTTP 404"}


def test_small_views(spark):
    from storyweft.schema import TOPIC_LABELS, label
    from storyweft.streaming.ingest import guard

    df = spark.createDataFrame([("city",), ("region",), ("country",)], "precision string")
    assert [tuple(r)[1:] for r in geo.pin_style(df).collect()] == [(6, 1.0), (8, 1.0), (10, 0.35)]
    assert files.sitemap(spark.createDataFrame([("/a/",), ("/reader/x.json",)], "path string")).count() == 1
    assert [r[0] for r in spark.createDataFrame([("ufo",), ("odd",)], "t string").select(label(F.col("t"), TOPIC_LABELS)).collect()] == ["UFOs", "odd"]
    years = timeseries.span(spark.createDataFrame([(T0,), (datetime(2024, 5, 1),), (None,)], "at timestamp"), "at").first()
    assert years["years"] == [2024, 2026] and years["rows"] == 2
    ok = spark.createDataFrame([("x",), (None,)], "error string")
    assert guard(ok).count() == 2
    with pytest.raises(RuntimeError):
        guard(ok.where("error is not null"))
