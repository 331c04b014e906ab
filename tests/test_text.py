import pytest
from pyspark.sql import functions as F

from storyweft.functions import text as t


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "s string").select(f(F.col("s")).alias("r")).first()["r"]


CASES = [
    (t.normalize_title, "Crème d’Été: The Owl's 2nd", "creme dete the owls 2nd"),
    (t.normalize_title, "", ""),
    (t.fold_publisher, "The Évening-Post ", "evening post"),
    (t.publisher_key, "www.kptv.com", "kptv"),
    (t.publisher_key, "news.site.co.uk", "news"),
    (t.publisher_key, "The KPTV", "kptv"),
    (t.collapse, " a  \t b﻿", "a b"),
    (t.count_words, "  two  words ", 2),
    (t.count_words, None, 0),
    (t.strip_tags, "<p>a</p><script>var x = '</p>'</script>b", " a  b"),
    (t.strip_section, "Lights seen over old mill | Tonight Show | Watch", "Lights seen over old mill"),
    (t.strip_section, "Too short | Tail", "Too short | Tail"),
    (t.strip_section, "Lights seen over old mill | A whole sentence ends here.", "Lights seen over old mill | A whole sentence ends here."),
    (t.clean_title, "\U0001f3a5 Lights­ &amp; &#8220;owls&#x201D;", 'Lights & "owls"'),
    (t.decode_named, "&amp;lt; &eacute;", "&lt; &eacute;"),
    (t.stem, "stories", "story"),
    (t.stem, "walking", "walk"),
    (t.stem, "glass", "glass"),
    (t.stem, "sing", "sing"),
    (t.slugify, "A B -- C!", "a-b-c"),
    (t.clean_url, "https://a.example/x?utm_source=1&id=2&fbclid=3#top", "https://a.example/x?id=2"),
    (t.clean_url, "https://a.example/x?gclid=3", "https://a.example/x"),
    (t.host_of, "https://www.A.example/x", "a.example"),
    (t.host_of, "not a url", ""),
    (t.url_encoded, "owl's (a b)~", "owl's%20(a%20b)~"),
]


@pytest.mark.parametrize("f,value,expected", CASES)
def test_text_function(spark, f, value, expected):
    assert one(spark, value, f) == expected


def test_tokens_are_distinct_and_in_order(spark):
    assert one(spark, "the owls saw 2 owls at a mill reports", t.tokens) == ["owls", "saw", "2", "mill"]


def test_truncate_cuts_at_a_late_space_only(spark):
    assert one(spark, "aaaa bbbb, cccc", lambda c: t.truncate(c, 11)) == "aaaa bbbb…"
    assert one(spark, "a bbbbbbbbbbbbbb", lambda c: t.truncate(c, 10)) == "a bbbbbbbb…"
    assert one(spark, "short", lambda c: t.truncate(c, 10)) == "short"


def test_publisher_suffix(spark):
    cut = lambda s, p: spark.createDataFrame([(s, p)], "s string, p string").select(t.strip_publisher(F.col("s"), F.col("p"))).first()[0]
    assert cut("Owl seen - The Post - Late News", "Post - Late News") == "Owl seen"
    assert cut("Owl seen - Elsewhere", "Post") == "Owl seen - Elsewhere"
    assert cut("Post", "Post") == "Post"


def test_headline_step_is_as_the_columns(spark):
    raw = "\U0001f3a5 Lights seen over the mill | Watch - The Post"
    assert t.headline_text(raw, "Post", True) == "Lights seen over the mill"
    assert t.headline_text(None, "Post", True) is None
    assert t.headline_text("", None, False) == ""


def test_item_id_is_a_digest_of_both(spark):
    import hashlib

    got = spark.createDataFrame([("a b", "The Post")], "t string, p string").select(t.item_id(F.col("t"), F.col("p"))).first()[0]
    assert got == hashlib.sha1(b"a b|post").hexdigest()[:16]


def test_time_ago(spark):
    rows = spark.sql("select timestamp'2026-01-10 12:00:00' now, explode(array(timestamp'2026-01-10 11:59:40', timestamp'2026-01-10 11:00:01', timestamp'2026-01-09 13:00:00', timestamp'2026-01-01 12:00:00', timestamp'2025-12-01 00:00:00')) at")
    assert [r[0] for r in rows.select(t.time_ago(F.col("at"), F.col("now"))).collect()] == ["just now", "59m ago", "23h ago", "9d ago", "1 Dec 2025"]


def test_snippets(spark):
    body = "Owl seen at the mill. " + "It flew twice around the tower, and people of the village watched it go."
    row = lambda c, search=False: spark.createDataFrame([(c, None, "Owl seen at the mill", "Post")], "c string, s string, t string, p string").select(t.make_snippet(F.col("c"), F.col("s"), F.col("t"), F.col("p"), F.lit(search))).first()[0]
    assert row(f"<p>{body}</p>").startswith("It flew twice")
    assert row("<b>Owl seen at the mill</b>") is None and row("short") is None and row(None) is None and row(body, True) is None


def test_sql_functions(spark):
    t.register(spark)
    assert spark.sql("select sw_normalize_title('Été!') a, sw_publisher_key('kptv.com') b, sw_host('https://www.x.example/') c").first() == ("ete", "kptv", "x.example")
