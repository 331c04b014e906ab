"""Named queries over the views: lists of pages, coverage, sources, places; and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyweft import schema
from storyweft.operators import cluster, geo, rank, store
from storyweft.plans.views import SKIPPED_HOSTS, Views, sort_sightings
from storyweft.queries import _BY, _HELD, _HIDDEN, _KEY, _MERGED_IDS, _PAIRS, _STEM, _STOP, _TOKENS, _WINDOW, SQL, _halves, _polls, query
from storyweft.sources import files

_NOW = "TIMESTAMP '2026-10-01'"
_FEATURED = "len(list_filter(topics, lambda t: t <> 'science')) > 0"
_ORDER = "score DESC NULLS LAST, latest_published DESC, id"

SQL["front_page"] = f"""
    WITH RECURSIVE best AS (SELECT id, title, coalesce(topics[1], '') AS topic, score, latest_published FROM story WHERE {_WINDOW} AND NOT {_HIDDEN} AND {_FEATURED} AND latest_published >= {_NOW} - INTERVAL 7 DAY ORDER BY {_ORDER} LIMIT 36),
    ranked AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS rank FROM best),
    r AS (SELECT 0 AS place, list({{'rank': rank, 'topic': topic}} ORDER BY rank) AS rest, CAST(NULL AS VARCHAR) AS one, CAST(NULL AS VARCHAR) AS two, CAST(NULL AS BIGINT) AS picked FROM ranked
          UNION ALL SELECT place + 1, list_filter(rest, lambda x: x.rank <> pick.rank), two, pick.topic, pick.rank
          FROM (SELECT *, coalesce(list_filter(rest, lambda x: one IS NULL OR one <> two OR x.topic <> two)[1], rest[1]) AS pick FROM r WHERE len(rest) > 0))
    SELECT CAST(place AS INT) AS place, id, title, topic, score FROM r JOIN ranked ON picked = rank WHERE place <= 12"""


@query
def topic_sections(spark, sf_dir):
    """Eight stories of each topic that the front page doesn't show."""
    return Views.load(spark, sf_dir).sections.select("topic", "place", "id")


SQL["topic_sections"] = SQL["front_page"].replace("SELECT CAST(place AS INT) AS place, id, title, topic, score FROM r JOIN ranked ON picked = rank WHERE place <= 12", "") + f""", top AS (SELECT id FROM r JOIN ranked ON picked = rank WHERE place <= 12)
    SELECT topic, CAST(place AS INT) AS place, id FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY {_ORDER}) AS place FROM (SELECT *, unnest(topics) AS topic FROM story WHERE {_WINDOW} AND NOT {_HIDDEN} AND id NOT IN (SELECT id FROM top))) WHERE place <= 8"""


@query
def all_stories(spark, sf_dir):
    return rank.by_score(Views.load(spark, sf_dir).all_clusters).select("id", "title", "score")


SQL["all_stories"] = f"SELECT id, title, score FROM story WHERE NOT {_HIDDEN}"


@query
def hidden_stories(spark, sf_dir):
    return Views.load(spark, sf_dir).hidden.select("id", F.array_join("flags", ",").alias("flags"))


SQL["hidden_stories"] = f"SELECT id, array_to_string(flags, ',') AS flags FROM story WHERE {_WINDOW} AND {_HIDDEN}"


@query
def topic_page(spark, sf_dir):
    return Views.load(spark, sf_dir).by_topic("cryptids").select("id", "score", F.lit("cryptids").alias("topic"), schema.label(F.lit("cryptids"), schema.TOPIC_LABELS).alias("label"), schema.label(F.col("tier"), schema.TIER_LABELS).alias("tier"))


SQL["topic_page"] = f"SELECT id, score, 'cryptids' AS topic, 'Cryptids' AS label, upper(tier[1]) || tier[2:] AS tier FROM story WHERE {_WINDOW} AND NOT {_HIDDEN} AND list_contains(topics, 'cryptids')"


@query
def topic_counts(spark, sf_dir):
    return Views.load(spark, sf_dir).topic_counts()


SQL["topic_counts"] = f"SELECT topic, count(*) FILTER (recent) AS stories, count(*) AS all_time FROM (SELECT unnest(topics) AS topic, {_WINDOW} AS recent FROM story WHERE NOT {_HIDDEN}) GROUP BY topic"


@query
def archive_order(spark, sf_dir):
    return Views.load(spark, sf_dir).archive.select("month", "place", "id")


SQL["archive_order"] = f"SELECT strftime(first_published, '%Y-%m') AS month, CAST(row_number() OVER (PARTITION BY strftime(first_published, '%Y-%m') ORDER BY first_published DESC, id) AS INT) AS place, id FROM story WHERE NOT {_HIDDEN} AND id IN {_HELD} AND first_published IS NOT NULL"


@query
def inspected_stories(spark, sf_dir):
    return Views.load(spark, sf_dir).inspect().select("id", "title", "tier", "score", "members", F.array_join("heads", " / ").alias("heads"))


_HEADS = f"(SELECT id, arg_min(title, {_BY}) AS head FROM item GROUP BY id)"
SQL["inspected_stories"] = f"""WITH t AS (SELECT * FROM story ORDER BY {_ORDER} LIMIT 20), m AS (SELECT id AS story, unnest(items[1:6]) AS item, generate_subscripts(items[1:6], 1) AS pos FROM t),
    h AS (SELECT story, string_agg(head, ' / ' ORDER BY pos) AS heads FROM m JOIN {_HEADS} i ON i.id = item GROUP BY story)
    SELECT t.id, title, tier, score, CAST(len(items) AS INT) AS members, heads FROM t LEFT JOIN h ON story = t.id"""


@query
def story_snippets(spark, sf_dir):
    return Views.load(spark, sf_dir).snippets


SQL["story_snippets"] = """WITH m AS (SELECT id, unnest(items) AS item, generate_subscripts(items, 1) AS pos FROM story), r AS (SELECT id, arg_min(item, pos) AS item FROM m WHERE item IN (SELECT id FROM article) GROUP BY id),
    e AS (SELECT id AS item, max(excerpt) AS excerpt FROM article GROUP BY id) SELECT s.id, coalesce(s.snippet, e.excerpt) AS snippet FROM story s LEFT JOIN r USING (id) LEFT JOIN e USING (item)"""


# --- coverage --------------------------------------------------------------------------------------------------

_UGLY = r"regexp_matches(title, '(?i)^(?:raw|watch|video|photos?|live|update|breaking)\s*:') OR NOT regexp_matches(title, '[a-z]')"
_IS_HOST = r"regexp_full_match(trim(publisher), '(?i)(?:www\.)?[a-z0-9-]+(?:\.[a-z0-9-]+)+')"
_TIER_AT = "CASE tier WHEN 'official' THEN 0 WHEN 'press' THEN 1 WHEN 'genre' THEN 2 WHEN 'unverified' THEN 3 ELSE 4 END"
_ALL_MEMBERS = f"""i AS (SELECT id, arg_min(title, {_BY}) AS title, arg_min(title_norm, {_BY}) AS title_norm, arg_min(publisher, {_BY}) AS publisher, arg_min(tier, {_BY}) AS tier, arg_min(published_at, {_BY}) AS published_at, bool_and(url_opaque) AS op,
          coalesce(arg_min(url, {_BY}) FILTER (NOT url_opaque), arg_min(url, {_BY})) AS url FROM item GROUP BY id),
    c AS (SELECT s.story, s.pos, i.*, regexp_replace(regexp_replace(trim(strip_accents(lower(publisher))), '^https?://', ''), '^www\\.', '') AS c FROM (SELECT id AS story, unnest(items) AS id, generate_subscripts(items, 1) AS pos FROM story) s JOIN i USING (id)),
    p AS (SELECT *, {_KEY} AS pk FROM c)"""
_COVERAGE = f"""WITH RECURSIVE {_ALL_MEMBERS},
    e AS MATERIALIZED (SELECT DISTINCT a.story, a.id AS u, b.id AS v FROM p a JOIN p b ON a.story = b.story AND (a.title_norm = b.title_norm OR a.pk = b.pk)),
    r(story, u, v) AS (SELECT story, u, v FROM e UNION SELECT r.story, r.u, e.v FROM r JOIN e ON r.story = e.story AND r.v = e.u),
    ups AS (SELECT story, u AS id, min(v) AS write_up FROM r GROUP BY story, u),
    o AS (SELECT p.*, write_up, row_number() OVER (PARTITION BY story ORDER BY {_TIER_AT}, op, CASE WHEN {_UGLY} THEN 1 ELSE 0 END, {_IS_HOST}, published_at DESC, id) AS rank FROM p JOIN ups USING (story, id)),
    n AS (SELECT *, row_number() OVER (PARTITION BY story, write_up, pk ORDER BY rank) AS nth FROM o),
    g AS (SELECT story, write_up, min(rank) AS best, arg_min(id, rank) AS item, arg_min(title, rank) AS head, count(*) AS members, list(id) AS ids, (list(publisher ORDER BY rank) FILTER (nth = 1))[2:] AS others FROM n GROUP BY story, write_up),
    f AS (SELECT story, arg_min(id, pos) AS first FROM p GROUP BY story),
    main AS (SELECT s.id AS story, s.title, CASE WHEN s.primary_id IN (SELECT id FROM item) THEN s.primary_id ELSE first END AS item FROM story s LEFT JOIN f ON f.story = s.id),
    k AS (SELECT g.*, row_number() OVER (PARTITION BY g.story ORDER BY best) AS place FROM g JOIN main ON main.story = g.story WHERE NOT list_contains(ids, coalesce(main.item, '')) AND head IS DISTINCT FROM main.title)"""


SQL["coverage_lists"] = _COVERAGE + " SELECT story, CAST(place AS INT) AS place, write_up, item, members, array_to_string(others[1:6], '; ') AS also, CAST(greatest(len(others) - 6, 0) AS INT) AS more FROM k"


@query
def coverage_shown(spark, sf_dir):
    return Views.load(spark, sf_dir).coverage_shown().select("story", F.array_join("shown", ",").alias("shown"), "hidden")


SQL["coverage_shown"] = _COVERAGE + " SELECT story, string_agg(item, ',' ORDER BY place) FILTER (place <= 5) AS shown, greatest(count(*) - 5, 0) AS hidden FROM k GROUP BY story"


# --- jobs ------------------------------------------------------------------------------------------------------


def _attempts(spark, sf_dir):
    """A log of tries at items, by the digits of their ids."""
    i = Views.load(spark, sf_dir).items
    last = F.timestamp_micros(F.unix_micros(F.to_timestamp(F.lit("2026-10-01"))) - F.lit(3_600_000_000))
    due = F.when(F.substring("id", 2, 1) < "8", F.timestamp_micros(F.unix_micros(last) - F.lit(60_000_000))).otherwise(F.timestamp_micros(F.unix_micros(last) + F.lit(7_200_000_000)))
    final = F.substring("id", 3, 1) == "0"
    return i.where(F.substring("id", 1, 1) < "8").select("id", F.lit(1).alias("attempts"), last.alias("last_attempt_at"), F.when(~final, due).alias("next_attempt_at"), F.lit("HTTP 500").alias("error"), final.alias("final"))


@query
def job_queue(spark, sf_dir):
    v = Views.load(spark, sf_dir)
    return v.job_queue(_attempts(spark, sf_dir))


_SKIP = " OR ".join(f"host = '{h}' OR ends_with(host, '.{h}')" for h in SKIPPED_HOSTS)
SQL["job_queue"] = f"""WITH {_ALL_MEMBERS}, s AS (SELECT id, latest_published FROM story WHERE {_WINDOW} AND NOT {_HIDDEN}), done AS (SELECT DISTINCT story FROM (SELECT id AS story, unnest(items) AS item FROM story) WHERE item IN (SELECT id FROM article)),
    d AS (SELECT *, row_number() OVER (PARTITION BY story, pk, title_norm ORDER BY pos) AS nth FROM p WHERE story IN (SELECT id FROM s) AND story NOT IN (SELECT story FROM done)),
    h AS (SELECT *, coalesce(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)), '^www\\.', ''), '') AS host FROM d WHERE nth = 1),
    f AS (SELECT * FROM h WHERE NOT regexp_full_match(trim(publisher), '(?i)(?:youtube|youtu\\.be|t\\.co|x\\.com|twitter|x|reddit|r/\\S+|facebook|instagram|tiktok|threads|bluesky|spotify|apple podcasts)')
        AND CASE WHEN op THEN regexp_matches(url, '(?i)^https?://[^/]+/(?:rss/)?(?:articles|read)/[A-Za-z0-9_-]+') ELSE regexp_matches(url, '(?i)^https?://') AND host <> '' AND NOT ({_SKIP}) AND NOT regexp_matches(url, '(?i)^[a-z][a-z0-9+.-]*://[^/?#]*[^?#]*/(?:picture-gallery|gallery|galleries|slideshow|photos|video|videos|watch)/') END
        AND (NOT id[1] < '8' OR (NOT id[3] = '0' AND id[2] < '8')))
    SELECT story, arg_min(f.id, pos) AS id, arg_min(url, pos) AS url, max(latest_published) AS latest_published FROM f JOIN s ON s.id = story GROUP BY story ORDER BY latest_published DESC, story LIMIT 40"""


# --- sources ---------------------------------------------------------------------------------------------------


def _named_health(spark, sf_dir):
    """States of the polls that the events make, under the ids of the registry in their order."""
    from storyweft.operators import health
    from storyweft.session import table

    number = F.row_number().over(Window.orderBy("id"))  # a registry is small
    states = health.fold_health(_polls(spark, sf_dir)).withColumnRenamed("id", "number")
    return states.join(table(spark, sf_dir, "feed_source").select("id", number.cast("string").alias("number")), "number").drop("number")


@query
def status_board(spark, sf_dir):
    return Views.load(spark, sf_dir).status_board(_named_health(spark, sf_dir)).select("id", "name", "status", "consecutive_failures", "place")


@query
def status_counts(spark, sf_dir):
    return Views.load(spark, sf_dir).status_counts(_named_health(spark, sf_dir))


_STATES = f"""WITH hs AS ({SQL["health_states"]}), src AS (SELECT *, CAST(row_number() OVER (ORDER BY id) AS VARCHAR) AS number FROM feed_source),
    b AS (SELECT src.id, src.name, CASE WHEN NOT coalesce(enabled, true) THEN 'disabled' ELSE coalesce(status, 'ok') END AS status, coalesce(consecutive_failures, 0) AS consecutive_failures FROM src LEFT JOIN hs ON hs.id = number)"""
_PLACE = "CASE status WHEN 'quarantined' THEN 0 WHEN 'failing' THEN 1 WHEN 'ok' THEN 2 ELSE 3 END"
SQL["status_board"] = f"{_STATES} SELECT *, CAST({_PLACE} AS INT) AS place FROM b"
SQL["status_counts"] = f"{_STATES} SELECT s AS status, count(b.id) AS sources FROM (SELECT unnest(['quarantined', 'failing', 'ok', 'disabled']) AS s) LEFT JOIN b ON b.status = s GROUP BY s"


# --- places ----------------------------------------------------------------------------------------------------


def _places(spark, sf_dir):
    """A gazetteer of names that headlines have after a preposition, and of towns that publishers are named after; where they lie and what they are is made from their letters."""
    from storyweft.session import table

    town = F.regexp_extract("publisher", r"^([A-Z][a-z]+) (?:Chronicle|Mercury|Standard|Examiner|Observer|Courier|Gazette)\b", 1)
    item = table(spark, sf_dir, "item")
    near = F.regexp_extract_all("title", F.lit(r"\b(?:at|of|near|in|to)\s+([A-Z][a-z]+)"), 1)
    often = item.select(F.explode(near).alias("name")).groupBy("name").count().where("count >= 20").select("name")
    named = item.select(town.alias("name")).where("name != ''").union(often).distinct()
    n, a = F.length("name"), F.ascii("name")
    kind = F.when(n % 5 == 0, "country").when(n % 5 == 1, "region").when(n % 5 == 2, "landmark").otherwise("city")
    rows = named.select("name", (a * 1.5 - 90).alias("lat"), (n * 7.25 - a).alias("lon"), kind.alias("kind"), F.when(n % 2 == 0, F.substring("name", 1, 3)).alias("admin"), F.lit("XX").alias("country"))
    return geo.precedence(rows, F.lower("name"), [F.col("name")])


_MADE_PLACES = r"""named AS (SELECT regexp_extract(publisher, '^([A-Z][a-z]+) (?:Chronicle|Mercury|Standard|Examiner|Observer|Courier|Gazette)\b', 1) AS name FROM item WHERE name <> ''
      UNION SELECT name FROM (SELECT unnest(regexp_extract_all(title, '\b(?:at|of|near|in|to)\s+([A-Z][a-z]+)', 1)) AS name FROM item) GROUP BY name HAVING count(*) >= 20),
    place AS (SELECT lower(name) AS key, min(name) AS name FROM named GROUP BY 1),
    pl AS (SELECT key, name, ascii(name) * 1.5 - 90 AS lat, length(name) * 7.25 - ascii(name) AS lon, CASE length(name) % 5 WHEN 0 THEN 'country' WHEN 1 THEN 'region' WHEN 2 THEN 'landmark' ELSE 'city' END AS kind, CASE WHEN length(name) % 2 = 0 THEN name[1:3] END AS admin FROM place)"""


def _extracted(source: str) -> str:
    """SQL of located headlines: ``source`` has id, title and body."""
    q = lambda p: p.replace("'", "''")
    runs = " UNION ALL ".join(
        f"SELECT id, {k} AS extractor, unnest(regexp_extract_all(title, '{q(p)}', 1)) AS run, unnest({f'''regexp_extract_all(title, '{q(p)}', 2)''' if k == geo.PAIR else f'''list_transform(regexp_extract_all(title, '{q(p)}', 1), lambda x: CAST(NULL AS VARCHAR))'''}) AS beside, unnest(range(len(regexp_extract_all(title, '{q(p)}', 1)))) AS nth FROM ev"
        for k, p in enumerate(geo.EXTRACTORS)
    )
    words = lambda c: rf"regexp_split_to_array(regexp_replace({c}, '[\s,;:.!?''’-]+$', ''), '\s+')"
    misleading = "(" + ", ".join(f"'{m}'" for m in geo.MISLEADING) + ")"
    resolved = lambda c, keys: f"(SELECT {keys}, arg_max({{'name': name, 'admin': admin, 'lat': lat, 'lon': lon, 'kind': kind, 'matched': matched}}, n) AS x FROM (SELECT *, array_to_string({words(c)}[1:n], ' ') AS matched FROM (SELECT *, unnest(range(1, least(4, len({words(c)})) + 1)) AS n FROM runs WHERE {c} IS NOT NULL)) JOIN pl ON pl.key = lower(matched) WHERE lower(matched) NOT IN {misleading} GROUP BY {keys})"
    kind = "CASE x.kind WHEN 'landmark' THEN 0 WHEN 'city' THEN 1 WHEN 'region' THEN 2 ELSE 3 END"
    dateline = r"^\s*([A-Z][A-Z .''-]+)(?:,\s+([A-Z][\w .]+?))?\s*(?:\([A-Z][\w ./]*\))?\s*[—–-]\s"
    cap = lambda c: f"array_to_string(list_transform(string_split(lower(trim({c})), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
    return rf"""src AS ({source}), base AS (SELECT * FROM src WHERE NOT coalesce(regexp_matches(title, '{q(geo.CRITICISM)}'), false)),
    ev AS (SELECT * FROM base WHERE coalesce(regexp_matches(title, '{q(geo.EVENT)}'), false) AND NOT regexp_matches(title, '{q(geo.BODY)}')), runs AS ({runs}),
    met AS {resolved("run", "id, extractor, nth")}, other AS {resolved("beside", "id, extractor, nth")},
    head AS (SELECT id, arg_min(x, ({kind}, extractor, nth)) AS x FROM (SELECT met.*, other.x IS NOT NULL AS paired FROM met LEFT JOIN other USING (id, extractor, nth)) WHERE extractor <> {geo.PAIR} OR (paired AND x.kind <> 'country') GROUP BY id),
    opening AS (SELECT id, left(regexp_replace(body, '<[^>]+>', ' ', 'g'), 160) AS o FROM base), dl AS (SELECT id, [{cap(f"regexp_extract(o, '{dateline}', 1)")}, trim(regexp_extract(o, '{dateline}', 2))] AS names FROM opening WHERE o IS NOT NULL),
    said AS (SELECT id, arg_min({{'name': name, 'admin': admin, 'lat': lat, 'lon': lon, 'kind': kind, 'matched': name}}, k) AS x FROM (SELECT id, unnest(names) AS nm, generate_subscripts(names, 1) AS k FROM dl) JOIN pl ON pl.key = lower(nm) WHERE nm <> '' GROUP BY id),
    located AS (SELECT id, x, 'headline' AS provenance FROM head UNION ALL SELECT id, x, 'dateline' FROM said WHERE id NOT IN (SELECT id FROM head))"""


@query
def headline_places(spark, sf_dir):
    """Items located by their headlines."""
    items = Views.load(spark, sf_dir).items
    return geo.locate(items, _places(spark, sf_dir)).select("id", "name", "matched", "provenance", F.round("lat", 4).alias("lat"), "kind")


SQL["headline_places"] = f"WITH {_MADE_PLACES}, {_extracted(f'SELECT id, arg_min(title, {_BY}) AS title, CAST(NULL AS VARCHAR) AS body FROM item GROUP BY id')} SELECT id, x.name AS name, x.matched AS matched, provenance, round(CAST(x.lat AS DOUBLE), 4) AS lat, x.kind AS kind FROM located"


def _sightings(spark, sf_dir):
    return Views.load(spark, sf_dir).sightings("ufo", _places(spark, sf_dir))


@query
def sighting_rows(spark, sf_dir):
    """Located reports of a topic with their pins' look, the most outlets first."""
    pins = geo.pin_style(sort_sightings(_sightings(spark, sf_dir), "outlets"))
    return pins.select("id", "date", "place", "admin", "lat", "lon", "precision", "provenance", "publisher", "tier", "outlets", "radius", "heat")


_DEMOTED = "list_has_any(flags, ['attraction', 'gathering', 'roundup', 'notice'])"
_OF_PRIMARY = f"""f AS (SELECT story, arg_min(id, pos) AS first FROM (SELECT id AS story, unnest(items) AS id, generate_subscripts(items, 1) AS pos FROM story) WHERE id IN (SELECT id FROM item) GROUP BY story),
    main AS (SELECT s.id, CASE WHEN s.primary_id IN (SELECT id FROM item) THEN s.primary_id ELSE first END AS item FROM story s LEFT JOIN f ON f.story = s.id), pub AS (SELECT id, arg_min(publisher, {_BY}) AS publisher FROM item GROUP BY id),
    text_ AS (SELECT id, arg_max(concat_ws(' ', excerpt, content), fetched_at) AS body FROM article GROUP BY id)"""
_SIGHTED = f"""WITH {_MADE_PLACES}, {_OF_PRIMARY}, {_extracted(rf"SELECT s.id, s.title, text_.body FROM story s LEFT JOIN main ON main.id = s.id LEFT JOIN text_ ON text_.id = main.item WHERE NOT {_HIDDEN} AND list_contains(topics, 'ufo') AND NOT {_DEMOTED} AND NOT coalesce(regexp_matches(s.title, '(?i){geo.words('letters', 'museum', 'inquest', 'council', 'exhibition', 'anniversary')}'), false)")},
    sight AS (SELECT s.id, s.title, s.first_published AS date, x.name AS place, x.admin AS admin, round(CAST(x.lat AS DOUBLE), 5) AS lat, round(CAST(x.lon AS DOUBLE), 5) AS lon, x.kind AS precision, provenance, coalesce(pub.publisher, s.publishers[1], '') AS publisher, s.tier, CAST(len(s.publishers) AS INT) AS outlets
      FROM located JOIN story s ON s.id = located.id LEFT JOIN main ON main.id = s.id LEFT JOIN pub ON pub.id = main.item)"""
SQL["sighting_rows"] = _SIGHTED + " SELECT id, date, place, admin, lat, lon, precision, provenance, publisher, tier, outlets, CAST(CASE WHEN precision IN ('landmark', 'city') THEN 6 WHEN precision = 'region' THEN 8 ELSE 10 END AS INT) AS radius, CASE WHEN precision = 'country' THEN 0.35 ELSE 1.0 END AS heat FROM sight"


@query
def sighting_table(spark, sf_dir):
    """The twelve columns of the download."""
    return files.sighting_table(_sightings(spark, sf_dir), "https://site.example")


SQL["sighting_table"] = _SIGHTED + " SELECT strftime(date, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST((epoch_us(date) // 1000) % 1000 AS VARCHAR), 3, '0') || 'Z' AS date, place, admin AS region, lat AS latitude, lon AS longitude, precision, provenance AS located_by, title, publisher, tier, outlets, 'https://site.example/story/' || id || '/' AS story_url FROM sight"


@query
def frequency_table(spark, sf_dir):
    """The three columns of the download of daily counts, with how many are on the map."""
    v = Views.load(spark, sf_dir)
    return files.frequency_table(v.timeline("ufo", _sightings(spark, sf_dir)))


SQL["frequency_table"] = f"{_SIGHTED}, own AS (SELECT CAST(first_published AS DATE) AS d, id IN (SELECT id FROM sight) AS placed FROM story WHERE NOT {_HIDDEN} AND list_contains(topics, 'ufo') AND first_published IS NOT NULL), days AS (SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS date FROM own) SELECT strftime(date, '%Y-%m-%d') AS date, count(d) AS reports, count(*) FILTER (placed) AS placed_on_map FROM days LEFT JOIN own ON d = date GROUP BY date"


@query
def frequency_csv(spark, sf_dir):
    """The same as lines of CSV."""
    return files.csv_lines(frequency_table(spark, sf_dir))


SQL["frequency_csv"] = f"SELECT date || ',' || reports || ',' || placed_on_map AS line FROM ({SQL['frequency_table']})"


# --- roll-up ---------------------------------------------------------------------------------------------------


@query
def rolled_up_stories(spark, sf_dir):
    """The stored stories made anew from their members: headline by consensus, outlets, tier, corroboration, flags, score."""
    v = Views.load(spark, sf_dir)
    story = v.everything.select(F.col("id").alias("story"), F.explode("items").alias("id")).distinct()
    built = cluster.roll_up(v.items, story, v.now)
    return built.select("id", "title", "primary_id", F.array_join("items", ",").alias("items"), F.array_join("publishers", "; ").alias("publishers"), "tier", "corroboration", F.array_join("topics", ",").alias("topics"), F.array_join("flags", ",").alias("flags"), "first_published", "latest_published", "snippet", "image", F.round("score", 6).alias("score"))


_WEIGHT = "CASE tier_at WHEN 0 THEN 6.0 WHEN 1 THEN 4.0 WHEN 2 THEN 2.0 ELSE 0.5 END"
_PENALTY = "CASE f " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in schema.FLAG_PENALTY.items()) + " ELSE 1.0 END"
SQL["rolled_up_stories"] = rf"""WITH RECURSIVE {_ALL_MEMBERS}, {_TOKENS},
    e AS MATERIALIZED (SELECT DISTINCT a.story, a.id AS u, b.id AS v FROM p a JOIN p b ON a.story = b.story AND (a.title_norm = b.title_norm OR a.pk = b.pk)),
    r(story, u, v) AS (SELECT story, u, v FROM e UNION SELECT r.story, r.u, e.v FROM r JOIN e ON r.story = e.story AND r.v = e.u), ups AS (SELECT story, u AS id, min(v) AS write_up FROM r GROUP BY story, u),
    more AS (SELECT id, flatten(list(topics)) AS topics, list_sort(list_distinct(flatten(list(flags)))) AS flags, arg_min(snippet, {_BY}) FILTER (snippet IS NOT NULL) AS snippet, arg_min(image, {_BY}) FILTER (image IS NOT NULL) AS image FROM item GROUP BY id),
    q AS (SELECT DISTINCT story, id, title, title_norm, publisher, tier, published_at, op, pk, {_TIER_AT} AS tier_at, CASE WHEN {_UGLY} THEN 1 ELSE 0 END AS bad, {_IS_HOST} AS host FROM p),
    o AS (SELECT q.*, write_up, m.topics, m.flags, m.snippet, m.image, row_number() OVER (PARTITION BY story ORDER BY tier_at, op, bad, host, published_at DESC, id) AS rank FROM q JOIN ups USING (story, id) JOIN more m USING (id)),
    o2 AS (SELECT *, row_number() OVER (PARTITION BY story, write_up ORDER BY rank) AS in_up FROM o),
    g AS (SELECT story, write_up, min(tier_at) AS tier_at FROM o GROUP BY story, write_up), s AS (SELECT story, count(*) AS groups, sum({_WEIGHT}) AS weight, count(*) FILTER (tier_at <= 1) AS corroboration, min(tier_at) AS top FROM g GROUP BY story),
    sp AS (SELECT o2.*, groups, top, (SELECT count(*) FROM tok WHERE tok.id = o2.id) AS n FROM o2 JOIN s USING (story) WHERE in_up = 1 AND groups >= 3), st AS (SELECT sp.story, sp.id, groups, n, token FROM sp JOIN tok USING (id)), df AS (SELECT story, token, count(*) AS df FROM st GROUP BY 1, 2),
    ag AS (SELECT story, id, sum((df - 1) / (groups - 1) / n) AS agreement FROM st JOIN df USING (story, token) GROUP BY story, id),
    pick AS (SELECT sp.story, rank, tier_at = top AND NOT op AND n >= 4 AND bad = 0 AND NOT regexp_matches(title, '(?i)\s[-–—]\s(?:video|watch|photos?|listen|podcast|opinion|analysis)$') AND NOT list_has_any(flags, ['roundup', 'notice']) AS usable, round(coalesce(agreement, 0.0), 9) AS agreement FROM sp LEFT JOIN ag USING (story, id)),
    h AS (SELECT story, arg_min(rank, (CASE WHEN usable THEN 0 ELSE 1 END, -agreement, rank)) AS headline FROM pick GROUP BY story), w AS (SELECT o.*, coalesce(headline, 1) AS headline FROM o LEFT JOIN h USING (story)),
    names AS (SELECT story, string_agg(name, '; ' ORDER BY first) AS publishers FROM (SELECT story, pk, min(rank) AS first, arg_min(publisher, (host, rank)) AS name FROM o GROUP BY story, pk) GROUP BY story),
    fl AS (SELECT story, list_sort(list(flag)) AS flags FROM (SELECT story, flag, count(*) AS c FROM (SELECT story, unnest(flags) AS flag FROM o) GROUP BY 1, 2) JOIN (SELECT story, count(*) AS n FROM o GROUP BY story) USING (story) WHERE 2 * c > n GROUP BY story),
    b AS (SELECT story, arg_min(id, (published_at, id)) AS id, max(title) FILTER (rank = headline) AS title, coalesce(max(id) FILTER (rank = headline AND NOT op), arg_min(id, rank) FILTER (NOT op), arg_min(id, rank)) AS primary_id, string_agg(id, ',' ORDER BY rank) AS items,
          array_to_string(list_filter([{", ".join(f"'{t}'" for t in schema.TOPICS)}], lambda x: list_contains(flatten(list(topics)), x)), ',') AS topics, min(published_at) AS first_published, max(published_at) AS latest_published, arg_min(snippet, rank) FILTER (snippet IS NOT NULL) AS snippet, arg_min(image, rank) FILTER (image IS NOT NULL) AS image FROM w GROUP BY story)
    SELECT b.id, title, primary_id, items, publishers, CASE top WHEN 0 THEN 'official' WHEN 1 THEN 'press' WHEN 2 THEN 'genre' ELSE 'unverified' END AS tier, CAST(corroboration AS INT) AS corroboration, topics, array_to_string(coalesce(fl.flags, []), ',') AS flags, first_published, latest_published, snippet, image,
    round(CAST(weight * (1 + ln(groups)) / (greatest(0, (epoch_ms({_NOW}) - epoch_us(latest_published) // 1000) / 3600000.0) + 6.0) * coalesce(list_aggregate(list_transform(fl.flags, lambda f: CAST({_PENALTY} AS DOUBLE)), 'product'), 1.0) AS DOUBLE), 6) AS score
    FROM b JOIN s USING (story) JOIN names USING (story) LEFT JOIN fl USING (story)"""


# Stories built anew: the links of similar headlines in their order, one after the other, each uniting two stories if they stay within a week.
_BUILT = f"""{_PAIRS},
    words AS (SELECT id, unnest(list_filter(string_split(title_norm, ' '), lambda w: w <> '' AND NOT list_contains({_STOP}, w) AND (length(w) > 1 OR regexp_matches(w, '[0-9]')))) AS w, generate_subscripts(list_filter(string_split(title_norm, ' '), lambda w: w <> '' AND NOT list_contains({_STOP}, w) AND (length(w) > 1 OR regexp_matches(w, '[0-9]'))), 1) AS at_ FROM {_MERGED_IDS}),
    placed AS (SELECT id, token, row_number() OVER (PARTITION BY id ORDER BY min(at_)) - 1 AS pos FROM (SELECT id, at_, {_STEM} AS token FROM words) GROUP BY id, token),
    first_shared AS (SELECT p.a, p.b, min(x.pos) AS pos FROM pairs p JOIN placed x ON x.id = p.a JOIN tok y ON y.id = p.b AND y.token = x.token JOIN idf ON idf.token = x.token, n WHERE p.phase = 1 AND idf.df <= greatest(25, ceil(0.02 * n)) GROUP BY p.a, p.b),
    num AS (SELECT id, published_at, row_number() OVER (ORDER BY id) AS i FROM items),
    link AS (SELECT x.i AS ai, y.i AS bi, row_number() OVER (ORDER BY phase, x.published_at, p.a, coalesce(f.pos, 0), y.published_at, p.b) AS step FROM pairs p LEFT JOIN first_shared f ON f.a = p.a AND f.b = p.b JOIN num x ON x.id = p.a JOIN num y ON y.id = p.b),
    every AS MATERIALIZED (SELECT list(epoch_us(published_at) ORDER BY i) AS ts FROM num), links AS MATERIALIZED (SELECT list(ai ORDER BY step) AS ais, list(bi ORDER BY step) AS bis FROM link),
    fold(step, labels) AS (SELECT CAST(0 AS BIGINT), (SELECT list(i ORDER BY i) FROM num)
        UNION ALL SELECT step + 1, CASE WHEN la <> lb AND list_max(span) - list_min(span) <= 604800000000 THEN list_transform(labels, lambda l: CASE WHEN l = lb THEN la ELSE l END) ELSE labels END
        FROM (SELECT step, labels, la, lb, list_transform(list_filter(list_zip(labels, ts), lambda z: z[1] = la OR z[1] = lb), lambda z: z[2]) AS span FROM (SELECT step, labels, ts, labels[ais[step + 1]] AS la, labels[bis[step + 1]] AS lb FROM fold, every, links WHERE step < len(ais)))),
    final AS (SELECT unnest(labels) AS label, generate_subscripts(labels, 1) AS i FROM (SELECT labels FROM fold ORDER BY step DESC LIMIT 1)),
    story AS (SELECT arg_min(id, (published_at, id)) AS id, list(id) AS items FROM final JOIN num USING (i) GROUP BY label)"""
_ROLLED = SQL["rolled_up_stories"].removeprefix(f"WITH RECURSIVE {_ALL_MEMBERS}, {_TOKENS},")
SQL["story_board"] = f"SELECT id, title, primary_id, CAST(len(string_split(items, ',')) AS INT) AS members, publishers, tier, corroboration, topics, flags, first_published, latest_published, score FROM (WITH RECURSIVE {_BUILT}, {_ALL_MEMBERS}, {_ROLLED})"


# --- documents of views ----------------------------------------------------------------------------------------


@query
def topic_feed(spark, sf_dir):
    """The fifty best stories of a topic as its feed has them."""
    v = Views.load(spark, sf_dir)
    return files.first_of_feed(files.feed_items(v.all_clusters.where(F.array_contains("topics", "fortean")), v.items, "https://site.example")).select("title", "link", "published", "description")


_OWN_TOPIC = f"(SELECT * FROM story WHERE NOT {_HIDDEN} AND list_contains(topics, 'fortean') ORDER BY score DESC NULLS LAST, latest_published DESC, id LIMIT 50)"
SQL["topic_feed"] = f"SELECT title, 'https://site.example/story/' || id || '/' AS link, latest_published AS published, concat_ws(' ', snippet, CASE WHEN len(publishers) > 1 THEN 'Carried by ' || array_to_string(publishers[1:6], ', ') ELSE 'From ' || publishers[1] END) AS description FROM {_OWN_TOPIC}"


@query
def sighting_json(spark, sf_dir):
    """Sightings as lines of JSON."""
    return files.json_lines(_sightings(spark, sf_dir).select("id", "date", "place", "admin", "precision", "outlets"))


SQL["sighting_json"] = _SIGHTED + """ SELECT '{' || array_to_string(list_filter(['"id":' || to_json(id), '"date":"' || strftime(date, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST((epoch_us(date) // 1000) % 1000 AS VARCHAR), 3, '0') || 'Z"', '"place":' || to_json(place), '"admin":' || to_json(admin), '"precision":' || to_json(precision), '"outlets":' || outlets], lambda x: x IS NOT NULL), ',') || '}' AS json FROM sight"""


@query
def frequency_json(spark, sf_dir):
    """Daily counts as lines of JSON."""
    return files.json_lines(frequency_table(spark, sf_dir))


SQL["frequency_json"] = f"""SELECT '{{"date":"' || date || '","reports":' || reports || ',"placed_on_map":' || placed_on_map || '}}' AS json FROM ({SQL["frequency_table"]})"""


@query
def run_totals(spark, sf_dir):
    """What a run that brings the later half of the items adds, and what is kept then."""
    old, new = _halves(spark, sf_dir)
    return store.run_totals(store.upsert(store.merge_first_wins(old), store.merge_first_wins(new)), F.to_timestamp(F.lit("2026-10-01")))


SQL["run_totals"] = f"""WITH o AS ({SQL["upsert_outcomes"]}), m AS (SELECT id, arg_min(published_at, (CASE WHEN first_seen_at < TIMESTAMP '2026-06-01' THEN 0 ELSE 1 END, first_seen_at, published_at, url, coalesce(image, ''))) AS published_at FROM item GROUP BY id)
    SELECT coalesce((SELECT ids FROM o WHERE outcome = 'added'), 0) AS added, coalesce((SELECT ids FROM o WHERE outcome = 'updated'), 0) AS updated, count(*) AS kept, count(*) FILTER (published_at >= TIMESTAMP '2026-09-01') AS recent FROM m"""


@query
def built_sections(spark, sf_dir):
    """Views over stories built from the items: the best three visible stories of each topic, with their members."""
    stored = Views.load(spark, sf_dir)
    v = Views.build(stored.items, stored.articles, stored.sources, stored.now)
    return rank.top_per_topic(v.all_clusters, 3).select("topic", "place", "id", F.size("items").alias("members"))


SQL["built_sections"] = f"""SELECT topic, CAST(place AS INT) AS place, id, members FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC NULLS LAST, latest_published DESC, id) AS place
    FROM (SELECT *, unnest(string_split(topics, ',')) AS topic FROM ({SQL["story_board"]}) WHERE topics <> '' AND NOT list_has_any(string_split(flags, ','), {schema.HIDDEN_FLAGS}))) WHERE place <= 3"""
