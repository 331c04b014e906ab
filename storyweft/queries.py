"""Named queries over a data directory, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyweft import schema
from storyweft.functions import text
from storyweft.operators import cluster, extract, geo, health, normalize, rank, robots, rules, similarity, store, timeseries
from storyweft.operators.components import components
from storyweft.operators.instants import misdated, read_instants
from storyweft.plans.views import Views
from storyweft.session import table
from storyweft.sources import feeds, files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "raw_entry").select("entry_id", "source_id", "published", "fetched_at", F.xxhash64("link").alias("link_hash"))
    instants = read_instants(entries, table(spark, sf_dir, "feed_source"), keep=("link_hash",))
    raw = instants.select(F.lit("raw_entry").alias("rec"), F.col("entry_id").cast("string").alias("rec_key"), "utc_us")
    wrong = misdated(table(spark, sf_dir, "item"), instants).select(F.lit("item").alias("rec"), F.col("id").alias("rec_key"), "utc_us")
    return raw.distinct().unionByName(wrong)


# --- text functions over items ---------------------------------------------------------------------------------

_STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(text.STOPWORDS))) + "]"
_NORM = r"trim(regexp_replace(regexp_replace(lower(strip_accents({0})), '[''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"
_STEM = """CASE WHEN length(w) <= 4 THEN w WHEN ends_with(w, 'ies') AND length(w) > 5 THEN left(w, length(w) - 3) || 'y' WHEN ends_with(w, 'ing') AND length(w) > 6 THEN left(w, length(w) - 3)
    WHEN (ends_with(w, 'ed') OR ends_with(w, 'es')) AND length(w) > 5 THEN left(w, length(w) - 2) WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN left(w, length(w) - 1) ELSE w END"""
_MERGED_IDS = "(SELECT id, arg_min(title_norm, (first_seen_at, published_at, url, coalesce(image, ''))) AS title_norm FROM item GROUP BY id)"
_TOKENS = f"""tok AS (SELECT DISTINCT id, {_STEM} AS token FROM (SELECT id, unnest(string_split(title_norm, ' ')) AS w FROM {_MERGED_IDS})
    WHERE w <> '' AND NOT list_contains({_STOP}, w) AND (length(w) > 1 OR regexp_matches(w, '[0-9]')))"""


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.merge_first_wins(table(spark, sf_dir, "item"))


@query
def normalized_titles(spark, sf_dir):
    return table(spark, sf_dir, "item").select("id", "title", text.normalize_title(F.col("title")).alias("norm"), text.slugify(F.col("title")).alias("slug"), text.count_words(F.col("title")).alias("words"))


SQL["normalized_titles"] = f"""SELECT id, title, {_NORM.format('title')} AS norm, regexp_replace(left(replace({_NORM.format('title')}, ' ', '-'), 80), '-+$', '') AS slug,
    CAST(len(list_filter(regexp_split_to_array(title, '[\\s\\p{{Z}}]+'), lambda x: x <> '')) AS INT) AS words FROM item"""


@query
def token_idf(spark, sf_dir):
    items = merged(spark, sf_dir)
    n = items.count()
    return similarity.idf_table(similarity.token_table(items), n).withColumn("idf", F.round("idf", 6))


SQL["token_idf"] = f"WITH {_TOKENS}, n AS (SELECT count(DISTINCT id) AS n FROM item) SELECT token, count(*) AS df, round(ln((n + 1.0) / (count(*) + 1.0)) + 1.0, 6) AS idf FROM tok, n GROUP BY token, n"


@query
def item_identity(spark, sf_dir):
    i = table(spark, sf_dir, "item")
    return i.select("id", "publisher", text.fold_publisher(F.col("publisher")).alias("folded"), text.publisher_key(F.col("publisher")).alias("key"), text.looks_like_domain(F.col("publisher")).alias("is_host"), text.item_id(F.col("title_norm"), F.col("publisher")).alias("digest"))


_FOLD = r"trim(regexp_replace(regexp_replace(strip_accents(lower(publisher)), '^the\s+', ''), '[^a-z0-9]+', ' ', 'g'))"
SQL["item_identity"] = rf"""
    WITH k AS (SELECT *, regexp_replace(regexp_replace(trim(strip_accents(lower(publisher))), '^https?://', ''), '^www\.', '') AS c FROM item),
    b AS (SELECT *, CASE WHEN regexp_full_match(c, '[a-z0-9-]+(\.[a-z0-9-]+)+') THEN regexp_replace(regexp_replace(c, '\.(?:co|com|org|net|ac|gov)\.[a-z]{{2}}$', ''), '\.[a-z]{{2,6}}$', '') ELSE c END AS d FROM k)
    SELECT id, publisher, {_FOLD} AS folded, regexp_replace(regexp_replace(d, '^the\s+', ''), '[^a-z0-9]+', '', 'g') AS key,
    regexp_full_match(trim(publisher), '(?i)(?:www\.)?[a-z0-9-]+(?:\.[a-z0-9-]+)+') AS is_host, left(sha1(title_norm || '|' || {_FOLD}), 16) AS digest FROM b"""


@query
def truncated_snippets(spark, sf_dir):
    return table(spark, sf_dir, "item").where("snippet is not null").select("id", "first_seen_at", text.truncate(F.col("snippet"), 60).alias("brief"))


SQL["truncated_snippets"] = r"""
    WITH h AS (SELECT id, first_seen_at, snippet, left(snippet, 60) AS head FROM item WHERE snippet IS NOT NULL),
    a AS (SELECT *, CASE WHEN contains(head, ' ') THEN 60 - position(' ' IN reverse(head)) ELSE -1 END AS cut FROM h)
    SELECT id, first_seen_at, CASE WHEN length(snippet) <= 60 THEN snippet ELSE regexp_replace(CASE WHEN cut > 36 THEN left(head, cut) ELSE head END, '[\s,;:.\-]+$', '') || '…' END AS brief FROM a"""


@query
def clean_links(spark, sf_dir):
    return table(spark, sf_dir, "raw_entry").select("entry_id", text.clean_url(F.col("link")).alias("url"), text.host_of(F.col("link")).alias("host"), feeds.opaque(F.col("link")).alias("is_opaque"))


SQL["clean_links"] = r"""
    WITH p AS (SELECT entry_id, link, split_part(split_part(link, '#', 1), '?', 1) AS base, list_filter(string_split(regexp_extract(split_part(link, '#', 1), '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(utm_[^=]*|fbclid|gclid|mc_cid|mc_eid)(=|$)')) AS q FROM raw_entry)
    SELECT entry_id, CASE WHEN link IS NULL THEN NULL WHEN len(q) > 0 THEN base || '?' || array_to_string(q, '&') ELSE base END AS url,
    coalesce(regexp_replace(lower(regexp_extract(link, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)), '^www\.', ''), '') AS host, coalesce(regexp_matches(link, '(?i)^https?://[^/]+/rss/articles/'), false) AS is_opaque FROM p"""


@query
def topic_labels(spark, sf_dir):
    i = merged(spark, sf_dir)
    return i.select("id", F.array_join(rules.labels(F.col("title"), rules.TOPIC_RULES), ",").alias("topics"), F.array_join(rules.classify_flags(F.col("title")), ",").alias("flags"))


def _rule_sql(r: rules.Rule, c: str) -> str:
    q = lambda p: "regexp_matches({0}, '{1}')".format(c, rules.ci(p).replace("(?iu)", "(?i)").replace("'", "''"))
    out = q(r.match)
    if r.unless:
        out += f" AND NOT ({q(r.unless)}" + (f" AND NOT {q(r.override)}" if r.override else "") + ")"
    return f"({out})"


def _labels_sql() -> str:
    tests = ", ".join(f"CASE WHEN {_rule_sql(r, 'title')} THEN '{r.label}' END" for r in rules.TOPIC_RULES)
    any_ = lambda k: " OR ".join(_rule_sql(rules.Rule(k, p), "title") for p in rules.FLAG_RULES[k])
    one = lambda p: _rule_sql(rules.Rule("x", p), "title")
    gathering = f"{one(rules.words('fair', 'festival', 'convention', 'club'))} AND NOT ({one(rules.words('police', 'constable', 'inquest'))} AND NOT {one(rules.words('expo'))})"
    roundup = f"NOT {one(rules.words('confirms', 'reopens'))} AND ({any_('roundup')})"
    flags = ", ".join(f"CASE WHEN {test} THEN '{k}' END" for k, test in (("entertainment", any_("entertainment")), ("offbeat", any_("offbeat")), ("attraction", any_("attraction")), ("gathering", gathering), ("roundup", roundup), ("notice", any_("notice"))))
    title = "(SELECT id, arg_min(title, (first_seen_at, published_at, url, coalesce(image, ''))) AS title FROM item GROUP BY id)"
    return f"SELECT id, array_to_string(list_filter([{tests}], lambda x: x IS NOT NULL), ',') AS topics, array_to_string(list_filter([{flags}], lambda x: x IS NOT NULL), ',') AS flags FROM {title}"


SQL["topic_labels"] = _labels_sql()


# --- store -----------------------------------------------------------------------------------------------------


@query
def merged_items(spark, sf_dir):
    m = merged(spark, sf_dir)
    return m.select("id", "title", "publisher", "published_at", "first_seen_at", "url", "url_opaque", "image", "snippet", F.array_join("topics", ",").alias("topics"), F.array_join("flags", ",").alias("flags"))


_BY = "(first_seen_at, published_at, url, coalesce(image, ''))"
_TOPIC_LIST = "[" + ", ".join(f"'{t}'" for t in schema.TOPICS) + "]"
SQL["merged_items"] = f"""
    SELECT id, arg_min(title, {_BY}) AS title, arg_min(publisher, {_BY}) AS publisher, arg_min(published_at, {_BY}) AS published_at, min(first_seen_at) AS first_seen_at,
    coalesce(arg_min(url, {_BY}) FILTER (NOT url_opaque), arg_min(url, {_BY})) AS url, bool_and(url_opaque) AS url_opaque, arg_min(image, {_BY}) FILTER (image IS NOT NULL) AS image, arg_min(snippet, {_BY}) FILTER (snippet IS NOT NULL) AS snippet,
    array_to_string(list_filter({_TOPIC_LIST}, lambda x: list_contains(flatten(list(topics)), x)), ',') AS topics, array_to_string(list_sort(list_distinct(flatten(list(flags)))), ',') AS flags FROM item GROUP BY id"""


def _halves(spark, sf_dir):
    i = table(spark, sf_dir, "item")
    early = F.col("first_seen_at") < F.to_timestamp(F.lit("2026-06-01"))
    return i.where(early), i.where(~early)


@query
def upsert_outcomes(spark, sf_dir):
    old, new = _halves(spark, sf_dir)
    return store.upsert(store.merge_first_wins(old), store.merge_first_wins(new)).groupBy(F.coalesce("outcome", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("ids"))


@query
def conflict_union(spark, sf_dir):
    ours, theirs = _halves(spark, sf_dir)
    return store.conflict_union(store.merge_first_wins(theirs), store.merge_first_wins(ours)).select("id", "first_seen_at", "publisher")


SQL["conflict_union"] = f"SELECT id, min(first_seen_at) AS first_seen_at, arg_min(publisher, {_BY}) AS publisher FROM item GROUP BY id"


# --- similarity and stories ------------------------------------------------------------------------------------


@query
def similar_pairs(spark, sf_dir):
    return similarity.similar_pairs(merged(spark, sf_dir)).select("a", "b", "phase", F.round("similarity", 6).alias("similarity"))


_ITEMS = f"items AS (SELECT id, arg_min(title_norm, {_BY}) AS title_norm, arg_min(published_at, {_BY}) AS published_at FROM item GROUP BY id)"
_PAIRS = f"""{_ITEMS}, {_TOKENS}, n AS (SELECT count(*) AS n FROM items),
    idf AS (SELECT token, count(*) AS df, ln((n + 1.0) / (count(*) + 1.0)) + 1.0 AS idf FROM tok, n GROUP BY token, n),
    total AS (SELECT id, sum(idf) AS s FROM tok JOIN idf USING (token) GROUP BY id),
    rare AS (SELECT id, token, title_norm, published_at FROM tok JOIN idf USING (token) JOIN items USING (id), n WHERE df <= greatest(25, ceil(0.02 * n))),
    cand AS (SELECT DISTINCT a.id AS a, b.id AS b FROM rare a JOIN rare b ON a.token = b.token AND (a.published_at, a.id) < (b.published_at, b.id) AND a.title_norm <> b.title_norm
             AND abs(epoch(a.published_at) - epoch(b.published_at)) < 259201 AND abs(floor(epoch(a.published_at)) - floor(epoch(b.published_at))) <= 259200),
    shared AS (SELECT a, b, count(*) AS k, sum(idf) AS w FROM cand JOIN tok x ON x.id = a JOIN tok y ON y.id = b AND x.token = y.token JOIN idf ON idf.token = x.token GROUP BY a, b),
    one AS (SELECT a, b, 1 AS phase, w / (ta.s + tb.s - w) AS similarity FROM shared JOIN total ta ON ta.id = a JOIN total tb ON tb.id = b WHERE k >= 2 AND w / (ta.s + tb.s - w) >= 0.3 - 1e-12),
    firsts AS (SELECT title_norm, arg_min(id, (published_at, id)) AS a FROM items GROUP BY title_norm),
    zero AS (SELECT a, id AS b, 0 AS phase, 1.0 AS similarity FROM items JOIN firsts USING (title_norm) WHERE id <> a),
    pairs AS (SELECT * FROM zero UNION ALL SELECT * FROM one)"""
SQL["similar_pairs"] = f"WITH {_PAIRS} SELECT a, b, phase, round(CAST(similarity AS DOUBLE), 6) AS similarity FROM pairs"


@query
def story_components(spark, sf_dir):
    return components(similarity.similar_pairs(merged(spark, sf_dir)))


SQL["story_components"] = f"""WITH RECURSIVE {_PAIRS}, e AS MATERIALIZED (SELECT a AS u, b AS v FROM pairs UNION SELECT b, a FROM pairs),
    reach(node, other) AS (SELECT u, u FROM e UNION SELECT r.node, e.v FROM reach r JOIN e ON r.other = e.u) SELECT node, min(other) AS component FROM reach GROUP BY node"""


@query
def story_board(spark, sf_dir):
    """Stories built anew from the items, with headline, members, tier, corroboration and score."""
    now = F.to_timestamp(F.lit("2026-10-01"))
    built = cluster.build_stories(merged(spark, sf_dir), now)
    return built.select("id", "title", "primary_id", F.size("items").alias("members"), F.array_join("publishers", "; ").alias("publishers"), "tier", "corroboration", F.array_join("topics", ",").alias("topics"), F.array_join("flags", ",").alias("flags"), "first_published", "latest_published", F.round("score", 6).alias("score"))


def _story_members(spark, sf_dir):
    return Views.load(spark, sf_dir).members


_MEMBERS = f"""m AS (SELECT id, arg_min(title_norm, {_BY}) AS title_norm, arg_min(publisher, {_BY}) AS publisher, arg_min(tier, {_BY}) AS tier, list_sort(list_distinct(flatten(list(flags)))) AS flags FROM item GROUP BY id),
    mem AS (SELECT DISTINCT s.story, s.id, m.title_norm, m.publisher, m.tier, m.flags FROM (SELECT id AS story, unnest(items) AS id FROM story) s JOIN m USING (id))"""
_KEY = r"""regexp_replace(regexp_replace(CASE WHEN regexp_full_match(c, '[a-z0-9-]+(\.[a-z0-9-]+)+') THEN regexp_replace(regexp_replace(c, '\.(?:co|com|org|net|ac|gov)\.[a-z]{2}$', ''), '\.[a-z]{2,6}$', '') ELSE c END, '^the\s+', ''), '[^a-z0-9]+', '', 'g')"""


@query
def write_ups(spark, sf_dir):
    return cluster.write_ups(_story_members(spark, sf_dir).dropDuplicates(["story", "id"]))


SQL["write_ups"] = rf"""WITH RECURSIVE {_MEMBERS}, k AS (SELECT *, regexp_replace(regexp_replace(trim(strip_accents(lower(publisher))), '^https?://', ''), '^www\.', '') AS c FROM mem), p AS (SELECT story, id, title_norm, {_KEY} AS pk FROM k),
    e AS MATERIALIZED (SELECT DISTINCT a.story, a.id AS u, b.id AS v FROM p a JOIN p b ON a.story = b.story AND (a.title_norm = b.title_norm OR a.pk = b.pk)),
    r(story, u, v) AS (SELECT story, u, v FROM e UNION SELECT r.story, r.u, e.v FROM r JOIN e ON r.story = e.story AND r.v = e.u) SELECT story, u AS id, min(v) AS write_up FROM r GROUP BY story, u"""


@query
def majority_flags(spark, sf_dir):
    m = _story_members(spark, sf_dir).dropDuplicates(["story", "id"])
    return cluster.majority(m.select("story", F.explode("flags").alias("flag")), m).select("story", F.array_join("flags", ",").alias("flags"))


SQL["majority_flags"] = f"WITH {_MEMBERS}, n AS (SELECT story, count(*) AS n FROM mem GROUP BY story), f AS (SELECT story, flag, count(*) AS c FROM (SELECT story, unnest(flags) AS flag FROM mem) GROUP BY story, flag) SELECT story, string_agg(flag, ',' ORDER BY flag) AS flags FROM f JOIN n USING (story) WHERE 2 * c > n GROUP BY story"


# --- views -----------------------------------------------------------------------------------------------------

_HIDDEN = "(" + " OR ".join(f"list_contains(flags, '{f}')" for f in schema.HIDDEN_FLAGS) + ")"
_WINDOW = "latest_published >= TIMESTAMP '2026-10-01' - INTERVAL 30 DAY"


@query
def window_summary(spark, sf_dir):
    return Views.load(spark, sf_dir).summary


SQL["window_summary"] = f"SELECT count(*) AS stories, count(*) FILTER (NOT {_HIDDEN}) AS visible, count(*) FILTER (NOT {_HIDDEN} AND len(items) > 1) AS several, CAST(max(len(items)) AS INT) AS largest, count(*) FILTER ({_HIDDEN}) AS hidden FROM story WHERE {_WINDOW}"


@query
def featured_stories(spark, sf_dir):
    return Views.load(spark, sf_dir).featured.select("id", "title", "score")


SQL["featured_stories"] = f"SELECT id, title, score FROM story WHERE {_WINDOW} AND NOT {_HIDDEN} AND len(list_filter(topics, lambda t: t <> 'science')) > 0"


@query
def front_page(spark, sf_dir):
    return Views.load(spark, sf_dir).top


@query
def section_lists(spark, sf_dir):
    return rank.top_per_topic(Views.load(spark, sf_dir).clusters).select("topic", "place", "id")


SQL["section_lists"] = f"SELECT topic, CAST(place AS INT) AS place, id FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC NULLS LAST, latest_published DESC, id) AS place FROM (SELECT *, unnest(topics) AS topic FROM story WHERE {_WINDOW} AND NOT {_HIDDEN})) WHERE place <= 8"


@query
def scholarly_column(spark, sf_dir):
    return Views.load(spark, sf_dir).scholarly.select("id", "latest_published")


SQL["scholarly_column"] = f"SELECT id, latest_published FROM story WHERE {_WINDOW} AND NOT {_HIDDEN} AND tier = 'official' AND NOT list_contains(flags, 'notice') AND len(list_filter(topics, lambda t: t <> 'science')) > 0 ORDER BY latest_published DESC, score DESC NULLS LAST, id LIMIT 6"
_HELD = "(SELECT DISTINCT s.id FROM (SELECT id, unnest(items) AS item FROM story) s JOIN article a ON a.id = s.item)"


@query
def archived_stories(spark, sf_dir):
    return Views.load(spark, sf_dir).archived.select("id", F.date_format("first_published", "yyyy-MM").alias("month"))


SQL["archived_stories"] = f"SELECT id, strftime(first_published, '%Y-%m') AS month FROM story WHERE NOT {_HIDDEN} AND id IN {_HELD}"


@query
def story_pages(spark, sf_dir):
    return Views.load(spark, sf_dir).story_pages


SQL["story_pages"] = f"SELECT id, false AS archived FROM story WHERE {_WINDOW} AND NOT {_HIDDEN} UNION ALL SELECT id, true FROM story WHERE NOT ({_WINDOW}) AND NOT {_HIDDEN} AND id IN {_HELD}"


@query
def archive_months(spark, sf_dir):
    return Views.load(spark, sf_dir).months


SQL["archive_months"] = f"SELECT strftime(first_published, '%Y-%m') AS month, count(*) AS count FROM story WHERE NOT {_HIDDEN} AND id IN {_HELD} GROUP BY 1"


@query
def reader_copies(spark, sf_dir):
    return Views.load(spark, sf_dir).reader


SQL["reader_copies"] = "WITH m AS (SELECT id, unnest(items) AS item, generate_subscripts(items, 1) AS pos FROM story) SELECT id, arg_min(item, pos) AS item FROM m WHERE item IN (SELECT id FROM article) GROUP BY id"


@query
def primary_items(spark, sf_dir):
    return Views.load(spark, sf_dir).primary


SQL["primary_items"] = "WITH m AS (SELECT id, unnest(items) AS item, generate_subscripts(items, 1) AS pos FROM story), f AS (SELECT id, arg_min(item, pos) AS first FROM m WHERE item IN (SELECT id FROM item) GROUP BY id) SELECT s.id, CASE WHEN s.primary_id IN (SELECT id FROM item) THEN s.primary_id ELSE first END AS item FROM story s LEFT JOIN f USING (id)"


@query
def coverage_lists(spark, sf_dir):
    return Views.load(spark, sf_dir).coverage.select("story", "place", "write_up", "item", "members", F.array_join("also", "; ").alias("also"), "more")


@query
def reader_payloads(spark, sf_dir):
    return Views.load(spark, sf_dir).reader_payload.select("id", "url", "outlet", "lang", "minutes", F.length("content").alias("size"))


@query
def feed_rows(spark, sf_dir):
    v = Views.load(spark, sf_dir)
    return files.feed_items(v.featured, v.items, "https://site.example").select("title", "link", "published", "description")


# --- time ------------------------------------------------------------------------------------------------------


@query
def daily_timeline(spark, sf_dir):
    v = Views.load(spark, sf_dir)
    return v.timeline("ghosts", v.archived.select("id"))


SQL["daily_timeline"] = f"""WITH own AS (SELECT CAST(first_published AS DATE) AS d, id IN {_HELD} AND NOT {_HIDDEN} AS placed FROM story WHERE NOT {_HIDDEN} AND list_contains(topics, 'ghosts') AND first_published IS NOT NULL),
    days AS (SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS date FROM own) SELECT date, count(d) AS count, count(*) FILTER (placed) AS placed FROM days LEFT JOIN own ON d = date GROUP BY date"""


@query
def event_days(spark, sf_dir):
    return timeseries.daily(table(spark, sf_dir, "events"), "ts", F.col("event_type") == "error")


SQL["event_days"] = "WITH d AS (SELECT CAST(ts AS DATE) AS d, event_type FROM events), days AS (SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS date FROM d) SELECT date, count(d) AS count, count(*) FILTER (event_type = 'error') AS placed FROM days LEFT JOIN d ON d.d = date GROUP BY date"


@query
def busiest_day(spark, sf_dir):
    return timeseries.peak(timeseries.daily(table(spark, sf_dir, "item"), "published_at"))


SQL["busiest_day"] = "WITH d AS (SELECT CAST(published_at AS DATE) AS date, count(*) AS c FROM item WHERE published_at IS NOT NULL GROUP BY 1), p AS (SELECT arg_max(date, (c, -epoch(date))) AS date, max(c) AS peak FROM d) SELECT date, peak, CASE WHEN peak <= 5 THEN 1 WHEN peak <= 12 THEN 2 WHEN peak <= 30 THEN 5 ELSE 10 END AS step, CAST(ceil(peak / CAST(CASE WHEN peak <= 5 THEN 1 WHEN peak <= 12 THEN 2 WHEN peak <= 30 THEN 5 ELSE 10 END AS DOUBLE)) * CASE WHEN peak <= 5 THEN 1 WHEN peak <= 12 THEN 2 WHEN peak <= 30 THEN 5 ELSE 10 END AS BIGINT) AS top FROM p"


@query
def brushed_items(spark, sf_dir):
    i = merged(spark, sf_dir).withColumn("date", F.to_date("published_at"))
    return timeseries.brush(i, "date", F.lit("2026-08-31").cast("date"), F.lit("2026-08-01").cast("date")).select("id", "date")


SQL["brushed_items"] = f"WITH {_ITEMS} SELECT id, CAST(published_at AS DATE) AS date FROM items WHERE CAST(published_at AS DATE) BETWEEN DATE '2026-08-01' AND DATE '2026-08-31'"


@query
def item_ages(spark, sf_dir):
    now = F.to_timestamp(F.lit("2026-10-01"))
    return merged(spark, sf_dir).select("id", text.time_ago(F.col("published_at"), now).alias("ago"), text.iso_millis(F.col("published_at")).alias("iso"))


# --- places ----------------------------------------------------------------------------------------------------


def _gazetteer(spark, sf_dir):
    nation, region, customer = (table(spark, sf_dir, x) for x in ("nation", "region", "customer"))
    countries = nation.select(F.initcap(F.lower("n_name")).alias("name"), F.col("n_nationkey").cast("string").alias("code"), (F.col("n_nationkey") * 2.5 - 30).alias("lat"), (F.col("n_nationkey") * 5.0 - 60).alias("lon"))
    cities = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("c_name").alias("name"), F.col("n_nationkey").cast("string").alias("country"), F.initcap(F.lower("r_name")).alias("admin"), F.greatest(F.round(F.col("c_acctbal") * 10), F.lit(0.0)).cast("bigint").alias("population"), (F.col("c_custkey") % 90).cast("double").alias("lat"), (F.col("c_custkey") % 180).cast("double").alias("lon")
    )
    curated = spark.createDataFrame([("Stone Circle", 51.0, -2.0, "landmark", None, "GB")], schema.PLACE)
    return geo.gazetteer(countries, cities, curated)


@query
def gazetteer(spark, sf_dir):
    return _gazetteer(spark, sf_dir).select("key", "kind", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query
def region_centroids(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    people = F.greatest(F.col("c_acctbal"), F.lit(0.0))
    return c.groupBy("n_regionkey").agg(F.sum(people).alias("w"), F.sum((F.col("c_custkey") % 90) * people).alias("la"), F.sum((F.col("c_custkey") % 180) * people).alias("lo")).where("w > 0").select("n_regionkey", F.round(F.col("la") / F.col("w"), 6).alias("lat"), F.round(F.col("lo") / F.col("w"), 6).alias("lon"))


SQL["region_centroids"] = "SELECT n_regionkey, round(sum((c_custkey % 90) * greatest(c_acctbal, 0)) / sum(greatest(c_acctbal, 0)), 6) AS lat, round(sum((c_custkey % 180) * greatest(c_acctbal, 0)) / sum(greatest(c_acctbal, 0)), 6) AS lon FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey HAVING sum(greatest(c_acctbal, 0)) > 0"


@query
def pin_offsets(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 90).cast("double").alias("lat"), (F.col("c_custkey") % 60).cast("double").alias("lon"))
    return geo.spread_pins(c, [F.col("c_custkey")]).select("c_custkey", "pin_lat", "pin_lon")


SQL["pin_offsets"] = "WITH p AS (SELECT c_custkey, CAST(c_custkey % 90 AS DOUBLE) AS lat, CAST(c_custkey % 60 AS DOUBLE) AS lon FROM customer), n AS (SELECT *, row_number() OVER (PARTITION BY round(lat, 3), round(lon, 3) ORDER BY c_custkey) - 1 AS n FROM p) SELECT c_custkey, round(CASE WHEN n = 0 THEN lat ELSE lat + (0.05 + 0.012 * n) * sin(fmod(n * 2.4, 6.283185307179586)) END, 6) AS pin_lat, round(CASE WHEN n = 0 THEN lon ELSE lon + (0.05 + 0.012 * n) * cos(fmod(n * 2.4, 6.283185307179586)) END, 6) AS pin_lon FROM n"


# --- sources, health, retries ----------------------------------------------------------------------------------


def _as_read(df):
    """Times without a zone again, as the events table has them."""
    return df.select(*(F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes))


def _polls(spark, sf_dir):
    kind = F.when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "view", "not_modified").otherwise("success")
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("source_id"), "ts", kind.alias("kind"), F.when(kind == "failure", 500).otherwise(200).alias("status"), F.col("value").cast("int").alias("item_count"), F.lit(None).cast("string").alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.when(kind == "failure", F.concat(F.lit("HTTP 500 #"), F.col("event_id"))).alias("error"))


@query
def health_states(spark, sf_dir):
    return _as_read(health.fold_health(_polls(spark, sf_dir)).select("id", "status", "consecutive_failures", "last_ok_at", "last_checked_at", "quarantined_at", "last_error"))


@query
def failure_streaks(spark, sf_dir):
    return health.streaks(table(spark, sf_dir, "events"), "user_id", "ts", F.col("event_type") == "error", "event_id").select("event_id", F.coalesce("streak", F.lit(0)).cast("int").alias("streak"))


SQL["failure_streaks"] = "WITH g AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM events) SELECT event_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, k ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS INT) AS streak FROM g"


@query
def retry_states(spark, sf_dir):
    tries = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("string").alias("error"), (F.col("value") > 190).alias("final"))
    return _as_read(health.fold_attempts(tries))


SQL["retry_states"] = "WITH g AS (SELECT CAST(user_id AS VARCHAR) AS id, CAST(count(*) AS INT) AS attempts, max(ts) AS last_attempt_at, arg_max(CAST(event_id AS VARCHAR), (ts, CAST(event_id AS VARCHAR))) AS error, bool_or(value > 190) OR count(*) >= 3 AS final FROM events WHERE event_type = 'error' GROUP BY user_id) SELECT id, attempts, last_attempt_at, CASE WHEN NOT final THEN last_attempt_at + CASE WHEN attempts = 1 THEN INTERVAL 2 HOUR ELSE INTERVAL 8 HOUR END END AS next_attempt_at, error, final FROM g"


@query
def registry_problems(spark, sf_dir):
    return feeds.problems(table(spark, sf_dir, "feed_source"))


@query
def source_urls(spark, sf_dir):
    c = F.col
    return feeds.enabled(table(spark, sf_dir, "feed_source")).select("id", feeds.source_url(c("kind"), c("url"), c("query"), c("edition"), c("subreddits")).alias("poll_url"))


@query
def source_yield(spark, sf_dir):
    e, i = table(spark, sf_dir, "raw_entry").groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("entries"), F.countDistinct("link").alias("links")), table(spark, sf_dir, "item").groupBy(F.col("feed_id").alias("id")).agg(F.countDistinct("id").alias("items"))
    return table(spark, sf_dir, "feed_source").select("id", "enabled").join(e, "id", "left").join(i, "id", "left").na.fill(0)


SQL["source_yield"] = "SELECT f.id, f.enabled, coalesce(entries, 0) AS entries, coalesce(links, 0) AS links, coalesce(items, 0) AS items FROM feed_source f LEFT JOIN (SELECT source_id AS id, count(*) AS entries, count(DISTINCT link) AS links FROM raw_entry GROUP BY 1) e USING (id) LEFT JOIN (SELECT feed_id AS id, count(DISTINCT item.id) AS items FROM item GROUP BY 1) i USING (id)"


@query
def normalized_entries(spark, sf_dir):
    entries, sources = table(spark, sf_dir, "raw_entry"), table(spark, sf_dir, "feed_source")
    instants = read_instants(entries, sources).select("entry_id", "utc_us")
    items = normalize.normalize_entries(entries, sources, instants, F.to_timestamp(F.lit("2026-10-01")))
    return store.merge_first_wins(items).select("id", "title", "publisher", "url", "tier", "published_at", F.array_join("topics", ",").alias("topics"), F.array_join("flags", ",").alias("flags"), "snippet")


# --- documents and files ---------------------------------------------------------------------------------------


@query
def article_text(spark, sf_dir):
    a = table(spark, sf_dir, "article")
    plain = text.collapse(text.strip_tags(F.col("content")))
    return a.select("id", "fetched_at", F.length(plain).alias("size"), text.count_words(plain).alias("words"), F.md5(plain).alias("digest"), text.reading_minutes(F.col("words")).alias("minutes"))


@query
def repetitive_articles(spark, sf_dir):
    a = table(spark, sf_dir, "article")
    return a.select("id", "fetched_at", F.size(extract.paragraphs(F.col("content"))).alias("paragraphs"), extract.repetitive(F.col("content")).alias("repetitive"))


@query
def readable_articles(spark, sf_dir):
    page = table(spark, sf_dir, "article").withColumn("html", F.concat(F.lit("<html lang='"), F.coalesce("lang", F.lit("")), F.lit("'><head><title>"), F.coalesce("title", F.lit("")), F.lit("</title></head><body><main>"), F.col("content"), F.lit("</main></body></html>")))
    return extract.extract_articles(page).select("id", "title", "lang", "words", F.length("content").alias("size"))


@query
def safe_markup(spark, sf_dir):
    a = table(spark, sf_dir, "article")
    return a.select("id", "fetched_at", F.md5(extract.sanitized(F.col("content"), F.col("url"))).alias("digest"))


@query
def csv_rows(spark, sf_dir):
    return files.csv_lines(table(spark, sf_dir, "item").select("id", "title", "publisher", "snippet"))


_CELL = "CASE WHEN regexp_matches(g, '[\"\\n\\r,]') THEN '\"' || replace(g, '\"', '\"\"') || '\"' ELSE g END"
SQL["csv_rows"] = "SELECT " + " || ',' || ".join(f"(SELECT {_CELL} FROM (SELECT CASE WHEN regexp_matches(coalesce({c}, ''), '^[=+\\-@\\t\\r]') THEN '''' || {c} ELSE coalesce({c}, '') END AS g))" for c in ("id", "title", "publisher", "snippet")) + " AS line FROM item"


@query
def json_rows(spark, sf_dir):
    return files.json_lines(table(spark, sf_dir, "story").select("id", "title", "publishers", "first_published", "snippet"))


@query
def event_properties(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


SQL["event_properties"] = "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"


@query
def robots_verdicts(spark, sf_dir):
    """Links of entries against a rule file of each host, made from its length."""
    links = table(spark, sf_dir, "raw_entry").select(text.host_of(F.col("link")).alias("origin"), F.try_parse_url("link", F.lit("PATH")).alias("path")).where("origin != '' and path is not null").distinct()
    body = F.when(F.length("origin") % 3 == 0, F.lit("User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /rss/\nAllow: /rss/articles/C*\n")).otherwise(F.lit("User-agent: *\nDisallow: /*/was-$\nDisallow: /private # none\n"))
    rules_ = robots.parse_robots(links.select("origin").distinct().withColumn("body", body))
    return robots.allowed(links, rules_)


# --- more SQL --------------------------------------------------------------------------------------------------

_HALF = "SELECT id, arg_min(image, {by}) FILTER (image IS NOT NULL) AS image, arg_min(snippet, {by}) FILTER (snippet IS NOT NULL) AS snippet, arg_min(publisher_url, {by}) FILTER (publisher_url IS NOT NULL) AS pu, bool_and(url_opaque) AS op, list_sort(list_distinct(flatten(list(topics)))) AS t, list_sort(list_distinct(flatten(list(flags)))) AS f FROM item WHERE {when} GROUP BY id"
SQL["upsert_outcomes"] = f"""WITH o AS ({_HALF.format(by=_BY, when="first_seen_at < TIMESTAMP '2026-06-01'")}), n AS ({_HALF.format(by=_BY, when="NOT first_seen_at < TIMESTAMP '2026-06-01'")})
    SELECT CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'kept' WHEN (o.image IS NULL AND n.image IS NOT NULL) OR (o.snippet IS NULL AND n.snippet IS NOT NULL) OR (o.pu IS NULL AND n.pu IS NOT NULL) OR (o.op AND NOT n.op)
    OR len(list_distinct(list_concat(o.t, n.t))) > len(o.t) OR len(list_distinct(list_concat(o.f, n.f))) > len(o.f) THEN 'updated' ELSE 'unchanged' END AS outcome, count(*) AS ids FROM o FULL JOIN n ON o.id = n.id GROUP BY 1"""
SQL["item_ages"] = f"""WITH {_ITEMS}, a AS (SELECT id, published_at, CAST(floor((epoch_ms(TIMESTAMP '2026-10-01') - epoch_us(published_at) // 1000) / 60000.0) AS BIGINT) AS m FROM items)
    SELECT id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || 'm ago' WHEN m < 2160 THEN CAST(floor(m / 60.0 + 0.5) AS BIGINT) || 'h ago' WHEN m < 20160 THEN CAST(floor(m / 1440.0 + 0.5) AS BIGINT) || 'd ago' ELSE strftime(published_at, '%-d %b %Y') END AS ago,
    strftime(published_at, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST((epoch_us(published_at) // 1000) % 1000 AS VARCHAR), 3, '0') || 'Z' AS iso FROM a"""
SQL["reader_payloads"] = f"""WITH i AS (SELECT id, arg_min(publisher, {_BY}) AS publisher, coalesce(arg_min(url, {_BY}) FILTER (NOT url_opaque), arg_min(url, {_BY})) AS item_url FROM item GROUP BY id), a AS (SELECT id, arg_max({{'url': url, 'site': site_name, 'lang': lang, 'words': words, 'content': content}}, fetched_at) AS x FROM article GROUP BY id)
    SELECT id, coalesce(item_url, x.url) AS url, coalesce(publisher, x.site) AS outlet, x.lang AS lang, greatest(1, CAST(round(x.words / 220.0) AS INT)) AS minutes, CAST(length(x.content) AS INT) AS size FROM a LEFT JOIN i USING (id)"""
SQL["feed_rows"] = f"""SELECT title, 'https://site.example/story/' || id || '/' AS link, latest_published AS published, concat_ws(' ', snippet, CASE WHEN len(publishers) > 1 THEN 'Carried by ' || array_to_string(publishers[1:6], ', ') ELSE 'From ' || publishers[1] END) AS description
    FROM story WHERE {_WINDOW} AND NOT {_HIDDEN} AND len(list_filter(topics, lambda t: t <> 'science')) > 0"""
SQL["gazetteer"] = """WITH city AS (SELECT c_name AS name, CAST(n_nationkey AS VARCHAR) AS country, upper(r_name[1]) || lower(r_name[2:]) AS admin, CAST(greatest(round(c_acctbal * 10), 0) AS BIGINT) AS p, CAST(c_custkey % 90 AS DOUBLE) AS lat, CAST(c_custkey % 180 AS DOUBLE) AS lon FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    region_ AS (SELECT admin AS name, sum(lat * p) / sum(p) AS lat, sum(lon * p) / sum(p) AS lon, country FROM city GROUP BY country, admin HAVING sum(p) > 0),
    u AS (SELECT 0 AS own, 0 AS k, -1 AS seq, 'GB' AS country, 51.0 AS lat, -2.0 AS lon, 'Stone Circle' AS name, 'landmark' AS kind UNION ALL SELECT 1, 1, -p, country, lat, lon, name, 'city' FROM city WHERE p >= 40000
        UNION ALL SELECT 1, 2, 0, country, lat, lon, name, 'region' FROM region_ UNION ALL SELECT 1, 3, 0, CAST(n_nationkey AS VARCHAR), n_nationkey * 2.5 - 30, n_nationkey * 5.0 - 60, n_name, 'country' FROM nation)
    SELECT key, kind, round(CAST(lat AS DOUBLE), 6) AS lat, round(CAST(lon AS DOUBLE), 6) AS lon FROM (SELECT lower(name) AS key, *, row_number() OVER (PARTITION BY lower(name) ORDER BY own, k, seq, country, lat) AS rn FROM u) WHERE rn = 1"""
SQL["registry_problems"] = """WITH p AS (SELECT id, 'unknown edition' AS problem FROM feed_source WHERE edition IS NOT NULL AND edition NOT IN ('US', 'GB', 'AU', 'CA', 'IE', 'NZ', 'IN', 'ZA') UNION ALL SELECT id, 'query is over 190 characters' FROM feed_source WHERE length(query) > 190
    UNION ALL SELECT id, 'id isn''t kebab-case' FROM feed_source WHERE NOT regexp_full_match(id, '[a-z0-9]+(-[a-z0-9]+)*') UNION ALL SELECT id, 'id isn''t unique' FROM feed_source GROUP BY id HAVING count(*) > 1) SELECT id, problem FROM p"""
_SPACE = r"[\s\p{Z}\x{FEFF}]+"
SQL["article_text"] = rf"""WITH p AS (SELECT id, fetched_at, words AS w, trim(regexp_replace(regexp_replace(regexp_replace(content, '(?is)<script\b.*?</script>|<style\b.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '{_SPACE}', ' ', 'g')) AS t FROM article)
    SELECT id, fetched_at, CAST(length(t) AS INT) AS size, CAST(CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS INT) AS words, md5(t) AS digest, greatest(1, CAST(round(w / 220.0) AS INT)) AS minutes FROM p"""
SQL["repetitive_articles"] = r"""WITH p AS (SELECT id, fetched_at, list_filter(list_transform(regexp_extract_all(content, '(?is)<p\b[^>]*>(.*?)</p>', 1), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'))), lambda x: length(x) > 20) AS l FROM article)
    SELECT id, fetched_at, CAST(len(l) AS INT) AS paragraphs, len(l) >= 6 AND len(list_distinct(l)) < 0.6 * len(l) AS repetitive FROM p"""
SQL["health_states"] = """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS id, ts, event_id, event_type = 'error' AS bad, 'HTTP 500 #' || event_id AS error, row_number() OVER (PARTITION BY user_id ORDER BY ts, CASE WHEN event_type = 'error' THEN 'failure' WHEN event_type = 'view' THEN 'not_modified' ELSE 'success' END) AS n FROM events),
    g AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY n) AS k FROM e), s AS (SELECT *, row_number() OVER (PARTITION BY id, k ORDER BY n) - CASE WHEN k > 0 THEN 1 ELSE 0 END AS fails FROM g),
    l AS (SELECT id, arg_max(fails, n) AS fails, max(k) AS k, max(ts) AS checked, arg_max(error, n) AS error, max(ts) FILTER (NOT bad) AS ok FROM s GROUP BY id)
    SELECT l.id, CASE WHEN l.fails = 0 THEN 'ok' WHEN l.fails >= 3 THEN 'quarantined' ELSE 'failing' END AS status, CAST(l.fails AS INT) AS consecutive_failures, ok AS last_ok_at, checked AS last_checked_at, q.ts AS quarantined_at, CASE WHEN l.fails > 0 THEN l.error END AS last_error
    FROM l LEFT JOIN s q ON q.id = l.id AND q.k = l.k AND q.fails = 3 AND q.bad"""
SQL["json_rows"] = r"""SELECT '{' || array_to_string(list_filter(['"id":' || to_json(id), '"title":' || to_json(title), '"publishers":' || to_json(publishers), '"first_published":"' || strftime(first_published, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST((epoch_us(first_published) // 1000) % 1000 AS VARCHAR), 3, '0') || 'Z"', '"snippet":' || to_json(snippet)], lambda x: x IS NOT NULL), ',') || '}' AS json FROM story"""
_ENCODED = "replace(replace(replace(replace(replace(url_encode(query || ' when:7d'), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*')"
SQL["source_urls"] = f"""SELECT id, CASE kind WHEN 'google-news' THEN 'https://news.google.com/rss/search?q=' || {_ENCODED} || '&hl=en-' || coalesce(edition, 'US') || '&gl=' || coalesce(edition, 'US') || '&ceid=' || coalesce(edition, 'US') || ':en'
    WHEN 'reddit' THEN 'https://oauth.reddit.com/r/' || array_to_string(subreddits, '+') || '/new?limit=50&raw_json=1' ELSE url END AS poll_url FROM feed_source WHERE enabled"""

from storyweft import feed_queries, view_queries  # noqa: E402, F401 - they register their queries here
