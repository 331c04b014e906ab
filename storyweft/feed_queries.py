"""Named queries over feeds, ingest, states and stored files; and the SQL that must give the same rows.

Documents that aren't among the tables (feeds, listings, redirects) are written from their rows and read again.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyweft import schema
from storyweft.functions import instants as times
from storyweft.functions import text
from storyweft.operators import cluster, extract, health, normalize, robots, rules, store, timeseries
from storyweft.plans.views import best_tier
from storyweft.queries import _BY, _FOLD, _KEY, _NORM, SQL, _polls, _rule_sql, merged, query
from storyweft.session import cut, shared_folder, table
from storyweft.sources import feeds, files, pages
from storyweft.streaming import ingest

# --- headlines -------------------------------------------------------------------------------------------------


def _entries(spark, sf_dir):
    """Raw entries with kind and publisher of their sources."""
    own = table(spark, sf_dir, "feed_source").select(F.col("id").alias("source_id"), "name", "kind")
    e = table(spark, sf_dir, "raw_entry").join(own, "source_id")
    return e.withColumn("publisher", normalize.published_by(F.col("kind"), F.col("source.name"), F.col("name")))


@query
def clean_headlines(spark, sf_dir):
    """Headlines cleaned in one step, and by the single functions in turn."""
    search = F.col("kind") == "google-news"
    e = cut(_entries(spark, sf_dir).select("entry_id", "kind", "publisher", text.headline(F.col("title"), F.col("publisher"), search).alias("head"), text.clean_title(F.col("title")).alias("clean")))
    composed = text.strip_section(F.when(search, text.strip_publisher(F.col("clean"), F.col("publisher"))).otherwise(F.col("clean")))
    return e.select("entry_id", "publisher", "head", composed.alias("composed"))


def _decoded(c: str) -> str:
    """SQL of a text with named entities, and decimal ones up to two digits, decoded; ``&amp;`` last."""
    for name, char in text.ENTITIES.items():
        if name != "amp":
            c = f"regexp_replace({c}, '&{name};', '{char.replace(chr(39), chr(39) * 2)}', 'gi')"
    for code in (34, 38, 39):
        c = f"replace({c}, '&#{code};', chr({code}))"
    return f"regexp_replace({c}, '&amp;', '&', 'gi')"


_SPACE = r"[\s\p{Z}\x{FEFF}]+"
_FOLDED = lambda c: _FOLD.replace("publisher", c)
_QUOTED = "translate(regexp_replace({0}, '[\\x{{00AD}}\\x{{200B}}-\\x{{200D}}\\x{{FEFF}}\\x{{2060}}]', '', 'g'), '‘’‚′“”„″', '''''''''\"\"\"\"')"
_EMOJI = r"[\x{2600}-\x{27BF}\x{1F000}-\x{1FAFF}\x{2B00}-\x{2BFF}\x{2190}-\x{21FF}\x{2300}-\x{23FF}\x{FE0F}\x{00A9}\x{00AE}\x{203C}\x{2049}\x{2122}\x{2139}]"
_PUBLISHED = "CASE WHEN kind = 'google-news' THEN coalesce(nullif(trim(e.source.name), ''), 'Google News') WHEN kind = 'reddit' THEN coalesce(nullif(trim(e.source.name), ''), f.name) ELSE f.name END"
_WORDS = lambda c: rf"len(list_filter(regexp_split_to_array(trim({c}), '\s+'), lambda w: w <> ''))"
_HEADLINES = rf"""raw AS (SELECT e.*, f.name, kind, f.tier AS own_tier, f.topics AS own_topics, auto, default_topic, {_PUBLISHED} AS publisher FROM raw_entry e JOIN feed_source f ON f.id = e.source_id),
    c1 AS (SELECT *, trim(regexp_replace(trim(regexp_replace({_QUOTED.format(_decoded("title"))}, '{_SPACE}', ' ', 'g')), '^(?:{_EMOJI}|\s)+', '')) AS clean FROM raw),
    c2 AS (SELECT *, string_split(clean, ' - ') AS parts, {_FOLDED("publisher")} AS target FROM c1),
    c3 AS (SELECT *, list_filter(list_reverse(range(1, len(parts))), lambda k: {_FOLDED("array_to_string(parts[k + 1:], ' - ')")} = target)[1] AS k FROM c2),
    c4 AS (SELECT *, CASE WHEN kind = 'google-news' AND k IS NOT NULL AND trim(array_to_string(parts[1:k], ' - ')) <> '' THEN trim(array_to_string(parts[1:k], ' - ')) ELSE clean END AS bare FROM c3),
    c5 AS (SELECT *, string_split(bare, '|') AS seg FROM c4),
    c6 AS (SELECT *, list_filter(range(1, len(seg) + 1), lambda k: len(list_filter(range(k + 1, len(seg) + 1), lambda j: NOT (trim(seg[j]) <> '' AND {_WORDS("seg[j]")} <= 8 AND NOT regexp_matches(trim(seg[j]), '[.!?…]$') AND {_WORDS("array_to_string(seg[1:j - 1], '|')")} >= 4))) = 0)[1] AS kept FROM c5),
    heads AS (SELECT *, CASE WHEN len(seg) > 1 THEN trim(array_to_string(seg[1:kept], '|')) ELSE bare END AS head FROM c6)"""
SQL["clean_headlines"] = f"WITH {_HEADLINES} SELECT entry_id, publisher, head, head AS composed FROM heads"


@query
def entry_snippets(spark, sf_dir):
    e = _entries(spark, sf_dir)
    head = text.headline(F.col("title"), F.col("publisher"), F.col("kind") == "google-news")
    return e.withColumn("head", head).select("entry_id", text.make_snippet(F.col("content"), F.col("summary"), F.col("head"), F.col("publisher"), F.lit(False)).alias("snippet"))


_TRUNCATED = lambda c, n: rf"CASE WHEN length({c}) <= {n} THEN {c} ELSE regexp_replace(CASE WHEN contains(left({c}, {n}), ' ') AND {n} - position(' ' IN reverse(left({c}, {n}))) > 0.6 * {n} THEN left({c}, {n} - position(' ' IN reverse(left({c}, {n})))) ELSE left({c}, {n}) END, '[\s,;:.\-]+$', '') || '…' END"
_SNIPPETS = rf"""s1 AS (SELECT *, coalesce(nullif(content, ''), nullif(summary, '')) AS body_ FROM heads),
    s2 AS (SELECT *, regexp_replace(regexp_replace(body_, '(?is)<script\b.*?</script>|<style\b.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g') AS plain FROM s1),
    s3 AS (SELECT *, trim(regexp_replace(regexp_replace({_decoded("plain")}, '(?i)submitted by\s+/u/\S+.*$|\[link\]|\[comments\]', ' ', 'g'), '{_SPACE}', ' ', 'g')) AS said FROM s2),
    s4 AS (SELECT *, {_NORM.format("said")} AS said_key, {_NORM.format("head")} AS head_key, {_NORM.format("concat_ws(' ', head, publisher)")} AS both_key FROM s3),
    s5 AS (SELECT *, CASE WHEN head_key <> '' AND starts_with(said_key, head_key) THEN array_to_string(string_split(said, ' ')[{_WORDS("head")} + 1:], ' ') ELSE said END AS brief FROM s4),
    snips AS (SELECT *, CASE WHEN body_ IS NULL OR said_key = head_key OR said_key = both_key OR length(brief) < 40 THEN NULL ELSE {_TRUNCATED("brief", 300)} END AS snip FROM s5)"""
SQL["entry_snippets"] = f"WITH {_HEADLINES}, {_SNIPPETS} SELECT entry_id, snip AS snippet FROM snips"


# --- ingest ----------------------------------------------------------------------------------------------------

_SHOWS = (r"\bBulletin\b",)
_TIER_RULES = (rules.Rule("press", r"\bGazette\b"), rules.Rule("official", r"\bUniversity\b"))


@query
def ingest_items(spark, sf_dir):
    """Entries to items, with publishers' tiers and listed publishers as tables; dated by hours about the time they were fetched."""
    entries, sources = table(spark, sf_dir, "raw_entry"), table(spark, sf_dir, "feed_source")
    at = F.when(F.col("entry_id") % 7 > 0, F.unix_micros("fetched_at") + (F.col("entry_id") % 7 - 4) * F.lit(3_600_000_000))
    names = entries.select(F.col("source.name").alias("name")).where("name is not null").distinct()
    tiers = names.where("length(name) % 3 = 0").select(text.publisher_key(F.col("name")).alias("publisher_key"), F.lit("official").alias("tier")).distinct()
    shows = names.where("name like 'The %'").select(text.publisher_key(F.col("name")).alias("publisher_key"))
    items = normalize.normalize_entries(entries.withColumn("utc_us", at), sources, None, F.to_timestamp(F.lit("2026-10-01")), tiers, entertainment=shows, entertainment_patterns=_SHOWS, tier_rules=_TIER_RULES)
    return items.select("id", "title", "title_norm", "url", "url_opaque", "publisher", "publisher_url", "tier", F.array_join("topics", ",").alias("topics"), F.array_join("flags", ",").alias("flags"), "published_at", "first_seen_at", "feed_id", "snippet", "image")


def _keyed(c: str) -> str:
    """SQL of a publisher's identity."""
    return _KEY.replace("WHEN regexp_full_match(c,", "WHEN regexp_full_match({0},").replace("regexp_replace(regexp_replace(c,", "regexp_replace(regexp_replace({0},").replace("ELSE c END", "ELSE {0} END").replace("{2}", "{{2}}").replace("{2,6}", "{{2,6}}").format(rf"regexp_replace(regexp_replace(trim(strip_accents(lower({c}))), '^https?://', ''), '^www\.', '')")


def _flag_tests() -> str:
    any_ = lambda k: " OR ".join(_rule_sql(rules.Rule(k, p), "head") for p in rules.FLAG_RULES[k])
    one = lambda p: _rule_sql(rules.Rule("x", p), "head")
    gathering = f"{one(rules.words('fair', 'festival', 'convention', 'club'))} AND NOT ({one(rules.words('police', 'constable', 'inquest'))} AND NOT {one(rules.words('expo'))})"
    roundup = f"NOT {one(rules.words('confirms', 'reopens'))} AND ({any_('roundup')})"
    tests = [("entertainment", f"{any_('entertainment')} OR listed"), ("offbeat", any_("offbeat")), ("attraction", any_("attraction")), ("gathering", gathering), ("roundup", roundup), ("notice", any_("notice")), ("weak-match", "len(found) = 0")]
    return "array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{k}' END" for k, t in tests) + "], lambda x: x IS NOT NULL)), ',')"


_FOUND = "list_filter([" + ", ".join(f"CASE WHEN {_rule_sql(r, 'head')} THEN '{r.label}' END" for r in rules.TOPIC_RULES) + "], lambda x: x IS NOT NULL)"
_TOPIC_LIST = "[" + ", ".join(f"'{t}'" for t in schema.TOPICS) + "]"
_TIER_SQL = "CASE " + " ".join(f"WHEN {_rule_sql(r, 'publisher')} THEN '{r.label}'" for r in _TIER_RULES) + " ELSE 'genre' END"
SQL["ingest_items"] = rf"""WITH {_HEADLINES}, {_SNIPPETS},
    names AS (SELECT DISTINCT source.name AS nm FROM raw_entry WHERE source.name IS NOT NULL), tiers AS (SELECT DISTINCT {_keyed("nm")} AS k FROM names WHERE length(nm) % 3 = 0), shows AS (SELECT DISTINCT {_keyed("nm")} AS k FROM names WHERE nm LIKE 'The %'),
    t AS (SELECT *, {_keyed("publisher")} AS pk, {_NORM.format("head")} AS tn, {_FOUND} AS found FROM snips),
    u AS (SELECT *, pk IN (SELECT k FROM shows) OR regexp_matches(publisher, '(?i)\bBulletin\b') AS listed, CASE WHEN len(found) > 0 THEN found WHEN coalesce(auto, false) THEN CASE WHEN default_topic IS NULL THEN [] ELSE [default_topic] END ELSE coalesce(own_topics, []) END AS tp,
        CASE WHEN pk IN (SELECT k FROM tiers) THEN 'official' ELSE {_TIER_SQL} END AS looked, fetched_at + INTERVAL 1 HOUR * (entry_id % 7 - 4) AS at_ FROM t)
    SELECT left(sha1(tn || '|' || {_FOLDED("publisher")}), 16) AS id, head AS title, tn AS title_norm, trim(link) AS url, regexp_matches(link, '(?i)^https?://[^/]+/rss/articles/') AS url_opaque, publisher, CASE WHEN kind IN ('google-news', 'reddit') THEN source.url END AS publisher_url,
    CASE WHEN kind IN ('google-news', 'reddit') THEN looked ELSE coalesce(own_tier, looked) END AS tier, array_to_string(list_filter({_TOPIC_LIST}, lambda x: list_contains(tp, x)), ',') AS topics, {_flag_tests()} AS flags,
    CASE WHEN entry_id % 7 = 0 OR entry_id % 7 - 4 > 1 THEN fetched_at ELSE at_ END AS published_at, fetched_at AS first_seen_at, source_id AS feed_id, CASE WHEN kind = 'google-news' THEN NULL ELSE snip END AS snippet, image
    FROM u WHERE length(head) >= 8 AND ({_WORDS("head")} >= 3 OR length(head) >= 20) AND regexp_matches(trim(link), '(?i)^https?://') AND NOT regexp_matches(head, '\([A-Za-z0-9_-]{{10,12}}\)\s*$') AND NOT regexp_matches(head, '(?i){rules.OFF_TOPIC[0]}') AND len(tp) > 0 AND tn <> ''"""


# --- feed documents --------------------------------------------------------------------------------------------


def _xml(c: Column) -> Column:
    """A text for an XML document: marks escaped, without what such documents can't hold."""
    c = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]", "")
    for mark, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(mark), F.lit(code))
    return c


def _element(name: str, c: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"<{name}>"), _xml(c), F.lit(f"</{name}>")), F.lit(""))


def _documents(spark, sf_dir) -> DataFrame:
    """A feed document of each source, of one of the three kinds, with its entries in order."""
    e = table(spark, sf_dir, "raw_entry")
    title, link = _element("title", F.col("title")), F.coalesce(F.col("link"), F.lit(""))
    media = F.coalesce(F.concat(F.lit('<media:content medium="image" width="90" url="'), _xml(F.col("image")), F.lit('"/><media:content type="image/png" width="9" url="https://small.example/"/>')), F.lit(""))
    own = F.when(F.col("source.name").isNotNull(), F.concat(F.lit('<source url="'), _xml(F.coalesce(F.col("source.url"), F.lit(""))), F.lit('">'), _xml(F.col("source.name")), F.lit("</source>"))).otherwise("")
    common = F.concat(title, _element("link", link), _element("description", F.col("summary")), _element("content:encoded", F.col("content")), media)
    rss = F.concat(F.lit("<item>"), common, _element("guid", F.col("guid")), _element("pubDate", F.col("published")), own, F.lit("</item>"))
    rdf = F.concat(F.lit("<item>"), common, _element("dc:date", F.col("published")), F.lit("</item>"))
    atom = F.concat(F.lit('<entry><link rel="self" href="https://self.example/"/><link rel="alternate" href="'), _xml(link), F.lit('"/>'), title, _element("id", F.col("guid")), _element("updated", F.col("published")), _element("summary", F.col("summary")), _element("content", F.col("content")), media, F.lit("</entry>"))
    kind = F.length("source_id") % 3
    each = e.select("source_id", F.struct("entry_id", F.when(kind == 0, rss).when(kind == 1, rdf).otherwise(atom).alias("x")).alias("e"))
    names = 'xmlns:media="http://search.yahoo.com/mrss/" xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:dc="http://purl.org/dc/elements/1.1/"'
    open_ = F.when(kind == 0, F.lit(f'<?xml version="1.0"?><rss version="2.0" {names}><channel><title>t</title>')).when(kind == 1, F.lit(f'<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" {names}>')).otherwise(F.lit(f'<feed xmlns="http://www.w3.org/2005/Atom" {names}>'))
    close = F.when(kind == 0, F.lit("</channel></rss>")).when(kind == 1, F.lit("</rdf:RDF>")).otherwise(F.lit("</feed>"))
    whole = each.groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda x: x["x"]), "").alias("body"))  # a poll's answer
    return whole.select("source_id", F.concat(open_, F.col("body"), close).alias("body"))


@query
def feed_documents(spark, sf_dir):
    """Entries read from feed documents, with those that aren't any and why."""
    bad = spark.createDataFrame([("bad-1", "no feed"), ("bad-2", "<html></html>"), ("bad-3", "<rss><channel>"), ("bad-4", None)], "source_id string, body string")
    parsed = feeds.parse_feeds(_documents(spark, sf_dir).unionByName(bad))
    got = feeds.entries(parsed).select("source_id", "place", "title", "link", "published", "summary", "content", "image", "guid", F.col("source.name").alias("name"), F.lit(None).cast("string").alias("error"))
    faults = parsed.where("error is not null").select("source_id", *(F.lit(None).cast(t).alias(c) for c, t in got.dtypes[1:-1]), F.when(F.col("error").startswith("not XML"), "not XML").otherwise(F.col("error")).alias("error"))
    return got.unionByName(faults)


_CLEAN = lambda c: rf"nullif(trim(regexp_replace(regexp_replace({c}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x{{FFFE}}\x{{FFFF}}]', '', 'g'), '^[\s\x1c-\x1f\x85\p{{Z}}]+|[\s\x1c-\x1f\x85\p{{Z}}]+$', '', 'g')), '')"
_IMG = lambda c: rf"nullif(regexp_extract({c}, '(?i)<img\b[^>]*\bsrc=[''\"]([^''\"]+)', 1), '')"
SQL["feed_documents"] = rf"""WITH e AS (SELECT source_id, entry_id, length(source_id) % 3 AS k, {_CLEAN("title")} AS title, CASE WHEN length(source_id) % 3 = 2 THEN regexp_replace(coalesce(link, ''), '\s', ' ', 'g') ELSE {_CLEAN("coalesce(link, '')")} END AS link_, {_CLEAN("published")} AS published, {_CLEAN("summary")} AS summary, {_CLEAN("content")} AS content, image, CASE WHEN length(source_id) % 3 = 1 THEN NULL ELSE {_CLEAN("guid")} END AS guid,
        CASE WHEN length(source_id) % 3 = 0 THEN {_CLEAN("source.name")} END AS name FROM raw_entry),
    l AS (SELECT *, coalesce(link_, CASE WHEN k = 0 AND regexp_matches(guid, '(?i)^https?://') THEN guid END) AS link FROM e)
    SELECT source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY entry_id) - 1 AS INT) AS place, title, link, published, summary, content, coalesce(image, {_IMG("content")}, {_IMG("summary")}) AS image, guid, name, CAST(NULL AS VARCHAR) AS error FROM l WHERE title IS NOT NULL AND regexp_matches(link, '(?i)^https?://')
    UNION ALL SELECT s, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, x FROM (VALUES ('bad-1', 'not XML'), ('bad-2', 'unrecognized feed root'), ('bad-3', 'not XML'), ('bad-4', 'not XML')) v(s, x)"""


@query
def listing_posts(spark, sf_dir):
    """Entries of listings: posts made of raw entries, in JSON, those that their source keeps."""
    e = table(spark, sf_dir, "raw_entry").where("title is not null")
    n = F.col("entry_id")
    post = F.struct(
        n.cast("string").alias("id"), "title", F.lit("oddities").alias("subreddit"), F.concat(F.lit("/r/oddities/"), n.cast("string")).alias("permalink"), F.col("link").alias("url"), (n % 4 == 0).alias("is_self"), (n % 400).cast("int").alias("score"), F.lit(1).alias("num_comments"),
        (F.unix_seconds("fetched_at")).cast("double").alias("created_utc"), F.when(n % 31 == 0, "AutoModerator").otherwise("somebody").alias("author"), F.col("summary").alias("selftext"), F.when(n % 3 == 0, "My Sighting").alias("link_flair_text"), (n % 37 == 0).alias("over_18"), (n % 41 == 0).alias("stickied"),
        F.col("image").alias("thumbnail"), F.when(n % 5 == 0, "self.oddities").otherwise(text.host_of(F.col("link"))).alias("domain"), F.lit("ignored").alias("extra"),
    )
    each = e.select("source_id", F.struct(n.alias("n"), F.struct(F.lit("t3").alias("kind"), post.alias("data")).alias("x")).alias("c"))
    body = F.to_json(F.struct(F.lit("Listing").alias("kind"), F.struct(F.transform(F.array_sort(F.collect_list("c"), lambda a, b: F.when(a["n"] < b["n"], -1).when(a["n"] > b["n"], 1).otherwise(0)), lambda x: x["x"]).alias("children")).alias("data")))
    bodies = each.groupBy("source_id").agg(body.alias("body"))
    return feeds.listing_entries(bodies, table(spark, sf_dir, "feed_source")).select("source_id", "title", "link", "published", "summary", "image", F.col("source.name").alias("name"), F.col("source.url").alias("site"), "guid")


_HOST = lambda c: rf"coalesce(regexp_replace(lower(regexp_extract({c}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)), '^www\.', ''), '')"
SQL["listing_posts"] = rf"""WITH p AS (SELECT r.*, entry_id % 4 = 0 AS self, entry_id % 400 AS score, coalesce(NOT entry_id % 4 = 0 AND regexp_matches(link, '(?i)^https?://') AND NOT regexp_matches(link, '(?i)^https?://(?:www\.)?reddit\.com'), false) AS away, CASE WHEN entry_id % 5 = 0 THEN 'oddities' ELSE {_HOST("link")} END AS host,
        trim(regexp_replace(coalesce(summary, ''), '\s+', ' ', 'g')) AS said, f.min_score, f.min_self_score, f.flairs FROM raw_entry r JOIN feed_source f ON f.id = source_id WHERE r.title IS NOT NULL),
    w AS (SELECT *, regexp_split_to_array(trim(title), '\s+') AS ws FROM p WHERE entry_id % 31 > 0 AND entry_id % 37 > 0 AND entry_id % 41 > 0)
    SELECT source_id, title, CASE WHEN away THEN link ELSE 'https://www.reddit.com/r/oddities/' || entry_id END AS link, strftime(to_timestamp(epoch_us(fetched_at) // 1000000), '%Y-%m-%dT%H:%M:%SZ') AS published, nullif({_TRUNCATED("said", 400)}, '') AS summary, CASE WHEN regexp_matches(image, '^https?://') THEN image END AS image,
    CASE WHEN away THEN coalesce(nullif(host, ''), 'r/oddities') ELSE 'r/oddities' END AS name, CASE WHEN NOT away THEN 'https://www.reddit.com/r/oddities' END AS site, CAST(entry_id AS VARCHAR) AS guid
    FROM w WHERE len(ws) >= 5 AND (regexp_matches(title, '[0-9]') OR len(list_filter(ws[2:], lambda x: regexp_matches(x, '^[A-Z][a-z]{{2,}}'))) > 0 OR NOT regexp_matches(title, '{feeds.FRAGMENT}'))
    AND (flairs IS NULL OR len(flairs) = 0 OR (entry_id % 3 = 0 AND len(list_filter(flairs, lambda f: contains('my sighting', lower(f)))) > 0)) AND score >= CASE WHEN self THEN coalesce(min_self_score, 250) ELSE coalesce(min_score, 25) END"""


@query
def decoded_links(spark, sf_dir):
    """Links put into redirects of the old kind, and out of them again."""
    e = table(spark, sf_dir, "raw_entry").select("entry_id", "link").where("link is not null")
    raw = F.encode("link", "UTF-8")
    n = F.octet_length("link")
    size = F.when(n < 128, F.unhex(F.lpad(F.hex(n), 2, "0"))).otherwise(F.concat(F.unhex(F.lpad(F.hex(n % 128 + 128), 2, "0")), F.unhex(F.lpad(F.hex(F.floor(n / 128).cast("int")), 2, "0"))))
    packed = F.translate(F.base64(F.concat(F.unhex(F.lit("081322")), size, raw)), "+/=\r\n", "-_")
    return e.select("entry_id", feeds.resolved_link(F.concat(F.lit("https://news.example/rss/articles/"), packed, F.lit("?oc=5"))).alias("url"))


SQL["decoded_links"] = "SELECT entry_id, CASE WHEN regexp_matches(link, '(?i)^https?://') THEN link END AS url FROM raw_entry WHERE link IS NOT NULL"


@query
def source_pages(spark, sf_dir):
    """Where people see what a source polls, and how many sources each host is asked for."""
    c = F.col
    urls = feeds.permitted(feeds.enabled(table(spark, sf_dir, "feed_source")), None).select("id", feeds.source_url(c("kind"), c("url"), c("query"), c("edition"), c("subreddits")).alias("u"))
    hosts = urls.groupBy(text.host_of(c("u")).alias("host")).agg(F.count("*").alias("polls"))
    return urls.select("id", feeds.search_page(c("u")).alias("page"), text.host_of(c("u")).alias("host")).join(hosts, "host")


SQL["source_pages"] = f"""WITH u AS (SELECT s.id, poll_url AS u, {_HOST("poll_url")} AS host FROM ({SQL["source_urls"]}) s JOIN feed_source f ON f.id = s.id WHERE kind <> 'reddit')
    SELECT id, replace(u, '/rss/search?', '/search?') AS page, host, count(*) OVER (PARTITION BY host) AS polls FROM u"""


# --- states ----------------------------------------------------------------------------------------------------


@query
def empty_health(spark, sf_dir):
    """States of polls that are often empty, two in a row of which count as a failure."""
    polls = _polls(spark, sf_dir).withColumn("item_count", F.when(F.col("item_count") % 2 == 0, 0).otherwise(F.col("item_count")))
    return health.fold_health(polls, allowed=2).select("id", "status", "consecutive_failures", "consecutive_empty", "last_item_count")


_POLLED = """e AS (SELECT CAST(user_id AS VARCHAR) AS id, ts, CASE WHEN event_type = 'error' THEN 'failure' WHEN event_type = 'view' THEN 'not_modified' ELSE 'success' END AS kind, CAST(trunc(value) AS INT) AS v, event_id FROM events),
    n AS (SELECT id, kind, CASE WHEN v % 2 = 0 THEN 0 ELSE v END AS items, row_number() OVER (PARTITION BY id ORDER BY ts, kind, CASE WHEN kind = 'failure' THEN 500 ELSE 200 END, CASE WHEN v % 2 = 0 THEN 0 ELSE v END, 'HTTP 500 #' || event_id) AS n FROM e)"""
_FOLDED_HEALTH = f"""{_POLLED}, r AS (SELECT id, CAST(0 AS BIGINT) AS n, 'ok' AS status, 0 AS fails, 0 AS empty, CAST(NULL AS INT) AS items FROM (SELECT DISTINCT id FROM n)
        UNION ALL SELECT id, n, CASE WHEN well THEN 'ok' WHEN status = 'quarantined' AND NOT gone THEN 'quarantined' WHEN f >= 3 THEN 'quarantined' ELSE 'failing' END, f, CASE WHEN well THEN m ELSE 0 END, CASE WHEN kind = 'success' THEN seen ELSE items END
        FROM (SELECT *, CASE WHEN well THEN 0 WHEN gone THEN 1 ELSE fails + 1 END AS f FROM (SELECT *, kind = 'success' AND m >= 2 AS gone, kind IN ('success', 'not_modified') AND NOT (kind = 'success' AND m >= 2) AS well
              FROM (SELECT r.id, n.n, r.status, r.fails, r.items, n.kind, n.items AS seen, CASE WHEN n.kind = 'success' THEN CASE WHEN n.items > 0 THEN 0 ELSE r.empty + 1 END ELSE r.empty END AS m FROM r JOIN n ON n.id = r.id AND n.n = r.n + 1))))"""
SQL["empty_health"] = f"WITH RECURSIVE {_FOLDED_HEALTH} SELECT id, status, fails AS consecutive_failures, empty AS consecutive_empty, items AS last_item_count FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC) = 1"


@query
def skipped_sources(spark, sf_dir):
    """Quarantined sources that were asked within a day of the last event."""
    now = table(spark, sf_dir, "events").agg(F.max("ts").cast("timestamp").alias("now")).first()["now"]  # one row
    return health.skip(health.fold_health(_polls(spark, sf_dir)), F.lit(now))


SQL["skipped_sources"] = f"SELECT id FROM ({SQL['health_states']}) WHERE status = 'quarantined' AND last_checked_at > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR"


@query
def kept_states(spark, sf_dir):
    """States of listed sources, and attempts at items that are kept and still have no article."""
    states = health.fold_health(_polls(spark, sf_dir))
    registry = states.where("id like '%1'").select("id")
    tries = table(spark, sf_dir, "item").select("id").distinct().unionByName(table(spark, sf_dir, "raw_entry").select(F.sha1("title").alias("id"))).where("id is not null")
    open_ = health.open_attempts(tries, table(spark, sf_dir, "item"), table(spark, sf_dir, "article"))
    return health.listed(states, registry).select(F.lit("health").alias("kind"), "id").unionByName(open_.select(F.lit("attempt").alias("kind"), "id"))


SQL["kept_states"] = "SELECT DISTINCT 'health' AS kind, CAST(user_id AS VARCHAR) AS id FROM events WHERE CAST(user_id AS VARCHAR) LIKE '%1' UNION ALL SELECT DISTINCT 'attempt', id FROM item WHERE id NOT IN (SELECT id FROM article)"


@query
def due_items(spark, sf_dir):
    """Items that were never tried or whose next try is due."""
    items = table(spark, sf_dir, "item").select("id").distinct()
    now = F.to_timestamp(F.lit("2026-10-01"))
    days = F.conv(F.substring("id", 1, 1), 16, 10).cast("int") - 8
    tries = items.where("substring(id, 2, 1) < 'c'").select("id", (F.substring("id", 3, 1) == "1").alias("final"), F.when(F.substring("id", 3, 1) != "2", F.timestamp_micros(F.unix_micros(now) + days * F.lit(86_400_000_000))).alias("next_attempt_at"))
    return health.due(items, tries, now)


SQL["due_items"] = "SELECT DISTINCT id FROM item WHERE id[2] >= 'c' OR (id[3] <> '1' AND (id[3] = '2' OR id[1] <= '8'))"


@query
def quarantine_lines(spark, sf_dir):
    """The report on quarantined sources; half of them aren't listed any more."""
    states = health.fold_health(_polls(spark, sf_dir))
    sources = states.where("id % 2 = 0").select("id", F.concat(F.lit("Source "), "id").alias("name"), F.lit("rss").alias("kind"), F.concat(F.lit("https://s"), "id", F.lit(".example/")).alias("url"))
    return files.quarantine_report(states, sources)


SQL["quarantine_lines"] = f"SELECT id, CASE WHEN CAST(id AS INT) % 2 = 0 THEN 'Source ' || id || ' (rss, https://s' || id || '.example/)' ELSE id || ' (unknown, -)' END || ': ' || consecutive_failures || ' failures in a row, last status 500, ' || coalesce(last_error, '-') AS line FROM ({SQL['health_states']}) WHERE status = 'quarantined'"

SQL["robots_verdicts"] = rf"""WITH l AS (SELECT DISTINCT {_HOST("link")} AS origin, regexp_extract(link, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM raw_entry WHERE link IS NOT NULL)
    SELECT origin, path, CASE WHEN length(origin) % 3 = 0 THEN NOT starts_with(path, '/rss/') OR starts_with(path, '/rss/articles/C') ELSE NOT regexp_matches(path, '^/.*/was-$') AND NOT starts_with(path, '/private') END AS allowed FROM l WHERE origin <> ''"""


@query
def origin_policies(spark, sf_dir):
    """What a robots request says by its status."""
    status = F.when(F.col("event_id") % 11 > 0, (F.col("event_id") % 11) * 55)
    return table(spark, sf_dir, "events").select("event_id", robots.origin_policy(status).alias("policy"))


SQL["origin_policies"] = "SELECT event_id, CASE WHEN event_id % 11 = 0 OR event_id % 11 * 55 >= 500 THEN 'deny' WHEN event_id % 11 * 55 BETWEEN 200 AND 299 THEN 'rules' ELSE 'allow' END AS policy FROM events"


# --- stored files and streams ----------------------------------------------------------------------------------

_MERGED = SQL["merged_items"]


def _flat(items: DataFrame) -> DataFrame:
    """Items as the merged query gives them."""
    return items.select("id", "title", "publisher", "published_at", "first_seen_at", "url", "url_opaque", "image", "snippet", F.array_join("topics", ",").alias("topics"), F.array_join("flags", ",").alias("flags"))


@query
def stored_shards(spark, sf_dir):
    """Items written as day shards and read again."""
    path = f"{shared_folder(spark)}/shards-{spark.sparkContext.applicationId}"
    files.write_shards(merged(spark, sf_dir), path)
    return _flat(spark.read.schema(schema.ITEM).json(path))


_MS = "date_trunc('millisecond', {0})"
SQL["stored_shards"] = f"SELECT * REPLACE ({_MS.format('published_at')} AS published_at, {_MS.format('first_seen_at')} AS first_seen_at) FROM ({_MERGED})"


@query
def stored_articles(spark, sf_dir):
    """The latest of each article written and read again, of them the ids with a copy."""
    path = f"{shared_folder(spark)}/articles-{spark.sparkContext.applicationId}"
    files.write_articles(table(spark, sf_dir, "article"), path)
    return files.read_article_lines(spark, path).select("id", "url", "site_name", "words", F.col("image.width").alias("width"), F.md5("content").alias("digest"))


SQL["stored_articles"] = "SELECT id, url, site_name, words, image.width AS width, md5(content) AS digest FROM article QUALIFY row_number() OVER (PARTITION BY id ORDER BY fetched_at DESC) = 1"


@query
def stored_health(spark, sf_dir):
    """States written and read again."""
    path = f"{shared_folder(spark)}/health-{spark.sparkContext.applicationId}"
    files.write_state(health.fold_health(_polls(spark, sf_dir)), path, "health")
    none = files.read_state(spark, path + "-none", "attempt").select("id", F.lit("").alias("status"), F.lit(0).alias("consecutive_failures"))
    return files.read_state(spark, path, "health").select("id", "status", "consecutive_failures").unionByName(none)


SQL["stored_health"] = f"SELECT id, status, consecutive_failures FROM ({SQL['health_states']})"


@query
def streamed_items(spark, sf_dir):
    """Items taken in as a stream into a store by day; those over 45 days older than the newest sighting aren't."""
    root = f"{shared_folder(spark)}/stream-{spark.sparkContext.applicationId}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    source = spark.readStream.schema(table(spark, sf_dir, "item").schema).option("maxFilesPerTrigger", 10_000).parquet(f"{sf_dir}/item*.parquet")
    ingest.stream_items(source, f"{root}/store", f"{root}/state").awaitTermination()
    return _flat(spark.read.parquet(f"{root}/store"))


SQL["streamed_items"] = f"SELECT * FROM ({_MERGED}) WHERE published_at >= (SELECT max(first_seen_at) FROM ({_MERGED})) - INTERVAL 45 DAY"


@query
def streamed_days(spark, sf_dir):
    """Items of each day, counted as they come."""
    name = f"days_{abs(hash(sf_dir))}"
    source = spark.readStream.schema(table(spark, sf_dir, "item").schema).parquet(f"{sf_dir}/item*.parquet")
    ingest.daily_counts(source).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


SQL["streamed_days"] = "SELECT CAST(published_at AS DATE) AS date, count(*) AS count FROM item GROUP BY 1"


@query
def conflict_sides(spark, sf_dir):
    """Patched fields go to the rows of their ids, all else stays."""
    patches = merged(spark, sf_dir).where("id like '%a'").select("id", F.lit("patched").alias("snippet"), F.when(F.col("id").like("%aa"), "https://p.example/").alias("url"))
    return store.patch(merged(spark, sf_dir), patches).select("id", "snippet", "url")


SQL["conflict_sides"] = f"SELECT id, CASE WHEN id LIKE '%a' THEN 'patched' ELSE snippet END AS snippet, CASE WHEN id LIKE '%aa' THEN 'https://p.example/' ELSE url END AS url FROM ({_MERGED})"


@query
def thumbnails(spark, sf_dir):
    size = files.thumbnail_size(F.col("image.width"), F.col("image.height"))
    return table(spark, sf_dir, "article").where("image is not null").select("id", "fetched_at", size["width"].alias("width"), size["height"].alias("height"))


SQL["thumbnails"] = "WITH a AS (SELECT id, fetched_at, image.width AS w, image.height AS h FROM article WHERE image IS NOT NULL) SELECT id, fetched_at, CASE WHEN w >= 320 AND h >= 180 THEN CAST(round(w * least(1.0, 800.0 / greatest(w, h))) AS INT) END AS width, CASE WHEN w >= 320 AND h >= 180 THEN CAST(round(h * least(1.0, 800.0 / greatest(w, h))) AS INT) END AS height FROM a"


@query
def site_titles(spark, sf_dir):
    """Article titles without their site's name."""
    a = table(spark, sf_dir, "article").where("title is not null")
    tailed = F.concat_ws(" | ", "title", "site_name")
    return a.select("id", "fetched_at", text.strip_site(tailed, F.col("site_name"), text.host_of(F.col("url"))).alias("bare"))


SQL["site_titles"] = r"""WITH a AS (SELECT *, concat_ws(' | ', title, site_name) AS t, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)), '^www\.', '') AS host FROM article WHERE title IS NOT NULL),
    b AS (SELECT *, regexp_extract(t, '^(.*\S)\s+[|–—:·-]\s+([^|–—:·]+?)\s*$', 1) AS head, regexp_extract(t, '^(.*\S)\s+[|–—:·-]\s+([^|–—:·]+?)\s*$', 2) AS tail FROM a),
    c AS (SELECT *, """ + _FOLDED("tail") + " AS f FROM b) SELECT id, fetched_at, CASE WHEN tail <> '' AND f <> '' AND (f = " + _FOLDED("coalesce(site_name, '')") + " OR f = " + _FOLDED("host") + " OR f = " + _FOLDED("split_part(host, '.', 1)") + ") THEN head ELSE t END AS bare FROM c"


# --- polls, pages, spans ---------------------------------------------------------------------------------------


@query
def polled_sources(spark, sf_dir):
    """Sources polled over a transport without a network, two thirds of them with the tag that they had."""
    c = F.col
    spark.dataSource.register(feeds.FeedSource)
    urls = feeds.enabled(table(spark, sf_dir, "feed_source")).select("id", feeds.source_url(c("kind"), c("url"), c("query"), c("edition"), c("subreddits")).alias("url"))
    tag = F.when(F.length("id") % 3 > 0, F.concat(F.lit('"'), F.length("url").cast("string"), F.lit('"')))
    asked = urls.select(F.to_json(F.collect_list(F.struct("id", "url", tag.alias("etag")))).alias("j")).first()["j"]  # a registry is small
    answers = spark.read.format("storyweft_feed").option("sources", asked).option("transport", "storyweft.sources.replay:feed").option("pause", "0").option("retry_pause", "0").load()
    found = feeds.entries(feeds.parse_feeds(answers.where("body is not null"))).select("source_id", "title", "link")
    return answers.join(found, "source_id", "left").select("source_id", "status", "not_modified", "etag", "error", "title", "link")


SQL["polled_sources"] = f"""WITH u AS (SELECT id AS source_id, poll_url AS u, length(poll_url) AS n, length(id) % 3 > 0 AS tagged FROM ({SQL["source_urls"]})),
    s AS (SELECT *, CASE WHEN n % 7 = 0 THEN 503 WHEN n % 2 = 0 AND tagged THEN 304 ELSE 200 END AS status FROM u)
    SELECT source_id, CAST(status AS INT) AS status, status = 304 AS not_modified, CASE WHEN status <> 503 THEN '"' || n || '"' END AS etag, CASE WHEN status = 503 THEN 'HTTP 503' END AS error, CASE WHEN status = 200 THEN n || ' letters' END AS title, CASE WHEN status = 200 THEN regexp_replace(u, '&.*$', '') END AS link FROM s"""
# an address with a bare & isn't a document that can be read, so such a feed has no entries
SQL["polled_sources"] = SQL["polled_sources"].replace("CASE WHEN status = 200 THEN n || ' letters' END AS title", "CASE WHEN status = 200 AND NOT contains(u, '&') THEN n || ' letters' END AS title").replace("CASE WHEN status = 200 THEN regexp_replace(u, '&.*$', '') END AS link", "CASE WHEN status = 200 AND NOT contains(u, '&') THEN u END AS link")


@query
def fetched_pages(spark, sf_dir):
    """Images of items fetched over a transport without a network, and what is wrong with each that isn't one."""
    spark.dataSource.register(pages.PageSource)
    wanted = table(spark, sf_dir, "feed_source").select("id", F.concat(F.lit("https://img.example/"), "id").alias("url"))
    asked = wanted.select(F.to_json(F.collect_list(F.struct("id", "url"))).alias("j")).first()["j"]  # a registry is small
    got = spark.read.format("storyweft_page").option("targets", asked).option("kind", "image").option("limit", "36").option("transport", "storyweft.sources.replay:page").option("pause", "0").load()
    return got.select("id", "status", "url", F.length("body").alias("size"), "error")


SQL["fetched_pages"] = """WITH u AS (SELECT id, 'https://img.example/' || id AS url, length('https://img.example/' || id) AS n FROM feed_source),
    e AS (SELECT *, CASE WHEN n % 7 = 0 THEN 'HTTP 503' WHEN n % 3 > 0 THEN 'wrong type' WHEN n > 36 THEN 'too large' END AS error FROM u)
    SELECT id, CAST(CASE WHEN n % 7 = 0 THEN 503 ELSE 200 END AS INT) AS status, url || '?' AS url, CASE WHEN error IS NULL THEN CAST(n AS INT) END AS size, error FROM e"""


@query
def decoded_pages(spark, sf_dir):
    """Page bodies in two encodings, read by the charset that their type names."""
    wide = F.length("id") + F.ascii(F.substring("id", 1, 1))
    wide = wide % 2 == 0
    body = F.when(wide, F.encode("content", "UTF-16BE")).otherwise(F.encode("content", "UTF-8"))
    kind = F.when(wide, "text/html; charset=utf-16be").otherwise("text/html; charset=UTF-8")
    read = F.pandas_udf(lambda b, k: pd.Series([extract.decode_html(*x) for x in zip(b, k)], dtype="object"), "string")
    return table(spark, sf_dir, "article").where("content is not null").select("id", "fetched_at", F.md5(read(body, kind)).alias("digest"), extract.absolute_url(F.concat(F.lit("../img/"), "id"), F.lit("https://a.example/x/y/z.html")).alias("image"))


SQL["decoded_pages"] = "SELECT id, fetched_at, md5(content) AS digest, 'https://a.example/x/img/' || id AS image FROM article WHERE content IS NOT NULL"


@query
def guarded_paths(spark, sf_dir):
    """Stories of chains, each user's events in order, that may span a week: a chain is cut where the span would be longer."""
    e = table(spark, sf_dir, "events").select("user_id", F.format_string("%012d", "event_id").alias("id"), F.col("ts").cast("timestamp").alias("published_at"))
    w = Window.partitionBy("user_id").orderBy("published_at", "id")
    pairs = e.select(F.lag("id").over(w).alias("a"), F.col("id").alias("b"), F.lit(1).alias("phase"), F.lit(0).alias("pos")).where("a is not null")
    return cluster.guarded_components(e, pairs)


SQL["guarded_paths"] = """WITH RECURSIVE e AS (SELECT user_id, printf('%012d', event_id) AS id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    r AS (SELECT user_id, n, id, id AS story, ts AS since FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.n, e.id, CASE WHEN e.ts - since <= INTERVAL 168 HOUR THEN story ELSE e.id END, CASE WHEN e.ts - since <= INTERVAL 168 HOUR THEN since ELSE e.ts END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
    SELECT id, story FROM r"""


@query
def recent_items(spark, sf_dir):
    """Items of the last thirty days, and of the older ones those that were known before July."""
    now = F.to_timestamp(F.lit("2026-10-01"))
    known = table(spark, sf_dir, "item").where("first_seen_at < '2026-07-01'")
    kept = normalize.late(merged(spark, sf_dir), known, now, 45).select("id", F.lit("kept").alias("why"))
    return store.window(merged(spark, sf_dir), now).select("id", F.lit("window").alias("why")).unionByName(kept)


SQL["recent_items"] = f"SELECT id, 'window' AS why FROM ({_MERGED}) WHERE CAST(published_at AS DATE) >= DATE '2026-09-01' UNION ALL SELECT id, 'kept' FROM ({_MERGED}) WHERE published_at >= TIMESTAMP '2026-10-01' - INTERVAL 45 DAY OR id IN (SELECT id FROM item WHERE first_seen_at < TIMESTAMP '2026-07-01')"


@query
def article_span(spark, sf_dir):
    s = timeseries.span(table(spark, sf_dir, "article"), "fetched_at")
    return s.select(F.array_join(F.transform("years", lambda y: y.cast("string")), ",").alias("years"), "first", "last", "rows")


SQL["article_span"] = "SELECT array_to_string(list_sort(list(DISTINCT year(fetched_at))), ',') AS years, CAST(min(fetched_at) AS DATE) AS first, CAST(max(fetched_at) AS DATE) AS last, count(*) AS rows FROM article WHERE fetched_at IS NOT NULL"


@query
def site_pages(spark, sf_dir):
    """Pages of stories, topics and readers' copies that a sitemap lists."""
    s = table(spark, sf_dir, "story")
    paths = s.select(text.path_of("/story/", F.col("id"), "/").alias("path")).unionByName(s.select(text.path_of("/reader/", F.col("id"), "/").alias("path")))
    return files.sitemap(paths)


SQL["site_pages"] = "SELECT '/story/' || id || '/' AS path FROM story"


@query
def source_tiers(spark, sf_dir):
    """Tiers of publishers by exact key, then by pattern, and the best tier of each feed's items."""
    i = table(spark, sf_dir, "item").select("feed_id", "publisher").distinct()
    exact = table(spark, sf_dir, "item").where("length(publisher) % 5 = 0").select(text.publisher_key(F.col("publisher")).alias("publisher_key"), F.lit("official").alias("tier")).distinct()
    graded = rules.publisher_tier(i, "publisher", exact, list(_TIER_RULES))
    return graded.groupBy("feed_id").agg(best_tier(F.col("tier")).alias("best"), F.count("*").alias("names"))


SQL["source_tiers"] = rf"""WITH x AS (SELECT DISTINCT {_keyed("publisher")} AS k FROM item WHERE length(publisher) % 5 = 0), i AS (SELECT DISTINCT feed_id, publisher FROM item),
    g AS (SELECT feed_id, CASE WHEN {_keyed("publisher")} IN (SELECT k FROM x) THEN 'official' ELSE {_TIER_SQL} END AS tier FROM i)
    SELECT feed_id, CASE min(CASE tier WHEN 'official' THEN 0 WHEN 'press' THEN 1 ELSE 2 END) WHEN 0 THEN 'official' WHEN 1 THEN 'press' ELSE 'genre' END AS best, count(*) AS names FROM g GROUP BY feed_id"""


@query
def refreshed_items(spark, sf_dir):
    """Stored items with topics and flags derived anew; feeds that aren't listed any more count by their ids."""
    sources = table(spark, sf_dir, "feed_source").where("length(id) % 2 = 0")
    return normalize.refresh(merged(spark, sf_dir), sources).select("id", "title", F.array_join("topics", ",").alias("topics"), F.array_join("flags", ",").alias("flags"))


SQL["refreshed_items"] = rf"""WITH raw_entry AS (SELECT m.id AS entry_id, feed_id AS source_id, title, CAST({{'name': publisher}} AS STRUCT(name VARCHAR)) AS source FROM (SELECT id, arg_min(feed_id, {_BY}) AS feed_id, arg_min(title, {_BY}) AS title, arg_min(publisher, {_BY}) AS publisher FROM item GROUP BY id) m),
    feed_source AS (SELECT i.source_id AS id, NULL AS name, CASE WHEN f.id IS NOT NULL THEN f.kind WHEN starts_with(i.source_id, 'gn-') THEN 'google-news' ELSE 'rss' END AS kind, NULL AS tier, f.topics, NULL AS auto, NULL AS default_topic FROM (SELECT DISTINCT source_id FROM raw_entry) i LEFT JOIN (SELECT * FROM main.feed_source WHERE length(id) % 2 = 0) f ON f.id = i.source_id),
    {_HEADLINES.replace(_PUBLISHED, "e.source.name")}, old AS (SELECT id, list_filter({_TOPIC_LIST}, lambda x: list_contains(flatten(list(topics)), x)) AS was FROM item GROUP BY id),
    t AS (SELECT heads.*, {_FOUND} AS found, false AS listed FROM heads)
    SELECT entry_id AS id, head AS title, array_to_string(CASE WHEN len(found) > 0 THEN list_filter({_TOPIC_LIST}, lambda x: list_contains(found, x)) ELSE coalesce(was, own_topics) END, ',') AS topics, {_flag_tests()} AS flags FROM t JOIN old ON old.id = entry_id"""


# --- instants --------------------------------------------------------------------------------------------------


def _readings_sql() -> str:
    """SQL of the instant that each raw entry names, by the stated rules one after the other: shape, order of a slash date, clock, zone."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    known = {name: sorted(by.items()) for name, by in times.LETTERS.items()}
    country = "CASE " + " ".join(f"WHEN starts_with(tz, {quoted(z)}) THEN {quoted(c)}" for z, c in times.ZONE_COUNTRY) + " ELSE coalesce(edition, '') END"
    letters = "CASE upper(let) " + " ".join(f"WHEN {quoted(n)} THEN CASE place " + " ".join(f"WHEN {quoted(c)} THEN {o}" for c, o in by if c) + f" ELSE {dict(by).get('', 'NULL')} END" if any(c for c, _ in by) else f"WHEN {quoted(n)} THEN {dict(by)['']}" for n, by in known.items()) + " END"
    months = "[" + ", ".join(quoted(m) for m in times.MONTHS) + "]"
    parts, fields = [], ("y", "m", "d", "b", "a", "c", "h", "mi", "s", "f", "ap", "sign", "oh", "om", "let")
    for place, (name, pattern) in enumerate(times.SHAPES):
        # the one group that is asked for, as groups over nine can't be
        only = lambda field, p=pattern.pattern: quoted("^(?:" + re.sub(r"\(\?P<(\w+)>", lambda m: "(" if m.group(1) == field else "(?:", p) + ")$")
        text_ = only("")
        cells = ", ".join((f"nullif(regexp_extract(t, {only(f)}, 1), '') AS {f}" if f in pattern.groupindex else f"CAST(NULL AS VARCHAR) AS {f}") for f in fields)
        parts.append(f"SELECT entry_id, {place} AS shape, {quoted(name)} AS form, tz, edition, {cells} FROM src WHERE regexp_matches(t, {text_})")
    return rf"""src AS (SELECT entry_id, regexp_replace(published, '^[\s\x1c-\x1f\x85\p{{Z}}]+|[\s\x1c-\x1f\x85\p{{Z}}]+$', '', 'g') AS t, tz, edition FROM raw_entry LEFT JOIN feed_source f ON f.id = source_id WHERE published IS NOT NULL),
    shaped AS ({" UNION ALL ".join(parts)}), one AS (SELECT * FROM shaped QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY shape) = 1),
    cal AS (SELECT *, {country} AS place, CAST(y AS INT) + CASE WHEN length(y) = 2 THEN 2000 ELSE 0 END AS yy, CASE WHEN form = 'slash' THEN CAST(CASE WHEN edition = 'US' THEN a ELSE c END AS INT) WHEN b IS NOT NULL THEN list_position({months}, lower(left(b, 3))) ELSE CAST(m AS INT) END AS mm, CASE WHEN form = 'slash' THEN CAST(CASE WHEN edition = 'US' THEN c ELSE a END AS INT) ELSE CAST(d AS INT) END AS dd,
        CASE WHEN ap IS NULL THEN coalesce(CAST(h AS INT), 0) WHEN CAST(h AS INT) BETWEEN 1 AND 12 THEN CAST(h AS INT) % 12 + CASE WHEN lower(ap) = 'p' THEN 12 ELSE 0 END END AS hh, coalesce(CAST(mi AS INT), 0) AS mn, coalesce(CAST(s AS INT), 0) AS ss, CAST(rpad(left(coalesce(f, '0'), 6), 6, '0') AS INT) AS us FROM one),
    wall AS (SELECT *, try_cast(printf('%04d-%02d-%02d', yy, mm, dd) AS DATE) AS day FROM cal WHERE yy >= 1 AND hh < 24 AND mn < 60 AND ss < 60),
    clock AS (SELECT *, epoch_us(CAST(day AS TIMESTAMP)) + (hh * 3600 + mn * 60 + ss) * CAST(1000000 AS BIGINT) + us AS w FROM wall WHERE day IS NOT NULL),
    off AS (SELECT *, CASE WHEN sign IS NOT NULL THEN CASE WHEN CAST(oh AS INT) <= 15 AND coalesce(CAST(om AS INT), 0) < 60 THEN (CAST(oh AS INT) * 60 + coalesce(CAST(om AS INT), 0)) * CASE WHEN sign = '+' THEN 1 ELSE -1 END END WHEN let IS NOT NULL THEN {letters} END AS minutes, sign IS NOT NULL OR let IS NOT NULL AS named,
        epoch_us(timezone(coalesce(tz, 'UTC'), make_timestamptz(w - 86400000000))) - (w - 86400000000) AS before, epoch_us(timezone(coalesce(tz, 'UTC'), make_timestamptz(w + 86400000000))) - (w + 86400000000) AS after FROM clock),
    inst AS (SELECT entry_id, CASE WHEN named THEN w - minutes * CAST(60000000 AS BIGINT) WHEN before = after OR epoch_us(timezone(tz, make_timestamptz(w - before))) = w THEN w - before WHEN epoch_us(timezone(tz, make_timestamptz(w - after))) = w THEN w - after ELSE w - before END AS utc_us FROM off
        UNION ALL SELECT entry_id, CAST(t AS BIGINT) * CASE WHEN length(t) = 10 THEN 1000000 ELSE 1000 END FROM src WHERE regexp_full_match(t, '[0-9]{{10}}(?:[0-9]{{3}})?'))"""


SQL["p2_found"] = f"""WITH {_readings_sql()}, ok AS (SELECT * FROM inst WHERE utc_us IS NOT NULL),
    named AS (SELECT i.id, min(utc_us) AS lo, max(utc_us) AS hi, bool_or(epoch_us(i.published_at) IS DISTINCT FROM utc_us) AS differs FROM item i JOIN raw_entry r ON r.source_id = i.feed_id AND r.link = i.url JOIN ok USING (entry_id) GROUP BY i.id)
    SELECT DISTINCT 'raw_entry' AS rec, CAST(entry_id AS VARCHAR) AS rec_key, utc_us FROM ok UNION ALL SELECT 'item', id, lo FROM named WHERE lo = hi AND differs"""

_FLAG_LIST = _flag_tests().removeprefix("array_to_string(").removesuffix(", ',')").replace("OR listed", "OR false")
SQL["normalized_entries"] = rf"""WITH {_HEADLINES}, {_SNIPPETS}, {_readings_sql()},
    t AS (SELECT snips.*, {_NORM.format("head")} AS tn, {_FOUND} AS found, utc_us FROM snips LEFT JOIN (SELECT entry_id, min(utc_us) AS utc_us FROM inst GROUP BY entry_id) USING (entry_id)),
    u AS (SELECT *, CASE WHEN len(found) > 0 THEN found WHEN coalesce(auto, false) THEN CASE WHEN default_topic IS NULL THEN [] ELSE [default_topic] END ELSE coalesce(own_topics, []) END AS tp FROM t),
    item AS (SELECT left(sha1(tn || '|' || {_FOLDED("publisher")}), 16) AS id, head AS title, trim(link) AS url, regexp_matches(link, '(?i)^https?://[^/]+/rss/articles/') AS url_opaque, publisher, coalesce(own_tier, 'genre') AS tier, tp AS topics, {_FLAG_LIST} AS flags,
      CASE WHEN utc_us IS NULL OR utc_us > epoch_us(fetched_at) + 3600000000 THEN fetched_at ELSE make_timestamptz(utc_us) END AS published_at, fetched_at AS first_seen_at, CASE WHEN kind = 'google-news' THEN NULL ELSE snip END AS snippet, image
      FROM u WHERE length(head) >= 8 AND ({_WORDS("head")} >= 3 OR length(head) >= 20) AND regexp_matches(trim(link), '(?i)^https?://') AND NOT regexp_matches(head, '\([A-Za-z0-9_-]{{10,12}}\)\s*$') AND NOT regexp_matches(head, '(?i){rules.OFF_TOPIC[0]}') AND len(tp) > 0 AND tn <> '')
    SELECT id, arg_min(title, {_BY}) AS title, arg_min(publisher, {_BY}) AS publisher, coalesce(arg_min(url, {_BY}) FILTER (NOT url_opaque), arg_min(url, {_BY})) AS url, arg_min(tier, {_BY}) AS tier, arg_min(published_at, {_BY}) AS published_at,
    array_to_string(list_filter({_TOPIC_LIST}, lambda x: list_contains(flatten(list(topics)), x)), ',') AS topics, array_to_string(list_sort(list_distinct(flatten(list(flags)))), ',') AS flags, arg_min(snippet, {_BY}) FILTER (snippet IS NOT NULL) AS snippet FROM item GROUP BY id"""
