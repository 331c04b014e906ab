"""Feed documents and listings to entries; the registry of sources; links of search feeds."""

from __future__ import annotations

import base64
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from storyweft.functions.text import truncate, url_encoded
from storyweft.schema import EDITIONS, SOURCE, TIERS, TOPICS

ENTRY = "title string, link string, published string, summary string, content string, image string, source struct<name:string,url:string>, guid string"
FEED_PARSED = f"source_id string, error string, entries array<struct<{', '.join(f'{x.split()[0]}:{x.split(None, 1)[1]}' for x in re.split(r', (?=[a-z]+ )', ENTRY))}>>"


# --- registry -------------------------------------------------------------------------------------------------


def problems(sources: DataFrame) -> DataFrame:
    """Columns ``id, problem``: every fault of a registry; none for a valid one."""
    kind, missing = F.col("kind"), lambda c: F.col(c).isNull() | (F.col(c) == "")
    checks = {
        "id isn't kebab-case": ~F.coalesce(F.col("id").rlike(r"^[a-z0-9]+(-[a-z0-9]+)*\z"), F.lit(False)),
        "unknown kind": ~F.coalesce(kind.isin("rss", "google-news", "reddit"), F.lit(False)),
        "rss needs a url": (kind == "rss") & ~F.coalesce(F.col("url").rlike("^https?://"), F.lit(False)),
        "search needs a query": (kind == "google-news") & missing("query"),
        "query is over 190 characters": F.length("query") > 190,
        "reddit needs subreddits": (kind == "reddit") & (F.coalesce(F.size("subreddits"), F.lit(0)) <= 0),
        "subreddit has an odd name": F.exists("subreddits", lambda s: ~s.rlike(r"^\w{2,21}\z")),
        "unknown edition": F.col("edition").isNotNull() & ~F.col("edition").isin(*EDITIONS),
        "unknown tier": F.col("tier").isNotNull() & ~F.col("tier").isin(*TIERS),
        "unknown topic": F.exists("topics", lambda t: ~t.isin(*TOPICS)) | (F.col("default_topic").isNotNull() & ~F.col("default_topic").isin(*TOPICS)),
        "no topics and not automatic": ~F.coalesce(F.col("auto"), F.lit(False)) & (F.coalesce(F.size("topics"), F.lit(0)) <= 0),
    }
    found = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(p)) for p, c in checks.items())))
    single = sources.select("id", F.explode(found).alias("problem"))
    return single.unionByName(sources.groupBy("id").count().where("count > 1").select("id", F.lit("id isn't unique").alias("problem")))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """A registry file (JSON, or YAML where a parser is installed) as SOURCE rows; raises if it has faults. Registries are small files."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        data = json.loads(text)
    else:
        import yaml

        data = yaml.safe_load(text)
    names = [x.strip().split()[0] for x in re.split(r", (?=[a-z_]+ )", SOURCE)]
    rows = []
    for s in data["sources"]:
        topics = s.get("topics")
        rows.append({n: s.get(n) for n in names} | {"auto": topics == "auto" or bool(s.get("auto")), "topics": None if topics == "auto" else topics, "enabled": s.get("enabled", True)})
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SOURCE)
    faults = problems(df).limit(20).collect()
    if faults:
        raise ValueError("; ".join(f"{r['id']}: {r['problem']}" for r in faults))
    return df


def enabled(sources: DataFrame) -> DataFrame:
    return sources.where("enabled")


def source_url(kind: Column, url: Column, query: Column, edition: Column, subreddits: Column) -> Column:
    """The address that a source is polled at."""
    ed = F.coalesce(edition, F.lit("US"))
    search = F.concat(F.lit("https://news.google.com/rss/search?q="), url_encoded(F.concat(query, F.lit(" when:7d"))), F.lit("&hl=en-"), ed, F.lit("&gl="), ed, F.lit("&ceid="), ed, F.lit(":en"))
    listing = F.concat(F.lit("https://oauth.reddit.com/r/"), F.array_join(subreddits, "+"), F.lit("/new?limit=50&raw_json=1"))
    return F.when(kind == "google-news", search).when(kind == "reddit", listing).otherwise(url)


def search_page(url: Column) -> Column:
    """The page for people of a search feed."""
    return F.replace(url, F.lit("/rss/search?"), F.lit("/search?"))


def opaque(url: Column) -> Column:
    """Whether a link is a search feed's redirect, which doesn't say where it leads."""
    return F.coalesce(url.rlike(r"(?i)^https?://[^/]+/rss/articles/"), F.lit(False))


# --- RSS and Atom ---------------------------------------------------------------------------------------------


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _kids(node, *names: str) -> list:
    return [c for c in node if _local(c.tag) in names]


def _text(node, *names: str) -> str | None:
    for name in names:
        for c in _kids(node, name):
            t = "".join(c.itertext()).strip()
            if t:
                return t
    return None


def _first_image(html: str | None) -> str | None:
    m = re.search(r"""<img\b[^>]*\bsrc=["']([^"']+)""", html or "", re.I)
    return m.group(1) if m else None


def _http(s: str | None) -> bool:
    return bool(s and re.match(r"https?://", s, re.I))


def _media(node) -> str | None:
    found = [m for m in node.iter() if _local(m.tag) == "content" and m.get("url") and "medium" not in m.attrib or _local(m.tag) == "content" and m.get("medium") == "image"]
    pictures = [m for m in found if (m.get("type") or "image").startswith("image") and m.get("url")]
    if pictures:  # the widest, the first of equal ones
        return max(pictures, key=lambda m: int(m.get("width") or 0) if (m.get("width") or "0").isdigit() else 0).get("url")
    thumbs = [m for m in node.iter() if _local(m.tag) == "thumbnail" and m.get("url")]
    return thumbs[0].get("url") if thumbs else None


def _rss_entry(node) -> dict:
    link, guid = _text(node, "link"), _text(node, "guid")
    for c in _kids(node, "link"):
        link = link or c.get("href")
    full = next(("".join(c.itertext()).strip() for c in node if c.tag.endswith("}encoded")), None)
    summary = _text(node, "description")
    enclosure = next((c.get("url") for c in _kids(node, "enclosure") if (c.get("type") or "").startswith("image")), None)
    own = next(iter(_kids(node, "source")), None)
    return {
        "title": _text(node, "title"), "link": link or (guid if _http(guid) else None), "published": _text(node, "pubDate", "date", "published"), "summary": summary, "content": full,
        "image": _media(node) or enclosure or _first_image(full) or _first_image(summary), "source": None if own is None else {"name": ("".join(own.itertext()).strip() or None), "url": own.get("url")}, "guid": guid,
    }


def _atom_entry(node) -> dict:
    links = [c for c in _kids(node, "link") if c.get("href")]
    order = [lambda c: c.get("rel") == "alternate" and "html" in (c.get("type") or "html"), lambda c: c.get("rel") == "alternate", lambda c: c.get("rel") is None, lambda c: True]
    link = next((c.get("href") for test in order for c in links if test(c)), None)
    body, summary = _text(node, "content"), _text(node, "summary")
    own = next(iter(_kids(node, "source")), None)
    return {
        "title": _text(node, "title"), "link": link, "published": _text(node, "published", "updated"), "summary": summary, "content": body, "image": _media(node) or _first_image(body) or _first_image(summary),
        "source": None if own is None or not _text(own, "title") else {"name": _text(own, "title"), "url": None}, "guid": _text(node, "id"),
    }


def parse_feed(body: str | None) -> list[dict]:
    """Entries with title and web link of an RSS, RDF or Atom document; ValueError for anything else."""
    text = (body or "").lstrip("﻿ \r\n\t")
    if not text.startswith("<"):
        raise ValueError("not XML")
    try:
        root = ET.fromstring(text)
    except ET.ParseError as e:
        raise ValueError(f"not XML: {e}") from None
    kind = _local(root.tag)
    if kind == "rss":
        found = [_rss_entry(n) for c in _kids(root, "channel") for n in _kids(c, "item")]
    elif kind == "RDF":
        found = [_rss_entry(n) for n in _kids(root, "item")]
    elif kind == "feed":
        found = [_atom_entry(n) for n in _kids(root, "entry")]
    else:
        raise ValueError("unrecognized feed root")
    return [e for e in found if e["title"] and _http(e["link"])]


def parse_feeds(bodies: DataFrame, key: str = "source_id", body: str = "body") -> DataFrame:
    """FEED_PARSED rows of feed documents: entries, or why there are none."""
    source = bodies.select(F.col(key).alias("source_id"), F.col(body).alias("body"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, b in zip(pdf["source_id"], pdf["body"]):
                try:
                    rows.append((k, None, parse_feed(b)))
                except ValueError as e:
                    rows.append((k, str(e), []))
            yield pd.DataFrame(rows, columns=["source_id", "error", "entries"])

    return source.mapInPandas(run, FEED_PARSED)


def entries(parsed: DataFrame) -> DataFrame:
    """A row for each entry, with its place in the feed."""
    return parsed.select("source_id", F.posexplode("entries").alias("place", "e")).select("source_id", "place", "e.*")


# --- listings -------------------------------------------------------------------------------------------------

POST = "id STRING, title STRING, subreddit STRING, permalink STRING, url STRING, is_self BOOLEAN, score INT, num_comments INT, created_utc DOUBLE, author STRING, selftext STRING, link_flair_text STRING, over_18 BOOLEAN, stickied BOOLEAN, thumbnail STRING, domain STRING"


def parse_listing(bodies: DataFrame, key: str = "source_id", body: str = "body") -> DataFrame:
    """A row for each post with title and permalink of JSON listings; whatever else is in them is passed over."""
    shape = f"data STRUCT<children:ARRAY<STRUCT<data:STRUCT<{', '.join(':'.join(x.split()) for x in POST.split(', '))}>>>>"
    parsed = bodies.select(F.col(key).alias("source_id"), F.from_json(body, shape).alias("x"))
    return parsed.select("source_id", F.explode("x.data.children.data").alias("p")).where("p is not null").select("source_id", "p.*").where("title is not null and permalink is not null")


# How a title begins that only asks.
FRAGMENT = r"(?i)^(?:what|who|why|how|where|when|is|are|was|does|did|can|could|has|have|anyone|any|thoughts|help|need help|looking for|does anyone|can anyone)\b"
MIN_SCORE, MIN_SELF_SCORE = 25, 250


def carries_story(title: Column) -> Column:
    """Whether a post's title has five words, and a number, a later capitalised word, or no opening that only asks."""
    words = F.split(F.trim(title), r"\s+")
    named = title.rlike("[0-9]") | F.exists(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda w: w.rlike("^[A-Z][a-z]{2,}"))
    return F.coalesce((F.size(words) >= 5) & (named | ~title.rlike(FRAGMENT)), F.lit(False))


def keep_post(p: DataFrame, gates: DataFrame | None = None) -> DataFrame:
    """Posts that carry a story, aren't pinned, adult, deleted or automatic, have a wanted flair, and a score that links or texts need.

    ``gates`` has ``id, min_score, min_self_score, flairs`` of sources; null is the default, a post of an unknown source has the defaults.
    """
    if gates is None:
        p = p.withColumns({"__link": F.lit(None).cast("int"), "__self": F.lit(None).cast("int"), "__flairs": F.array().cast("array<string>")})
    else:
        p = p.join(gates.select(F.col("id").alias("source_id"), F.col("min_score").alias("__link"), F.col("min_self_score").alias("__self"), F.col("flairs").alias("__flairs")), "source_id", "left")
    ok = ~F.coalesce("stickied", F.lit(False)) & ~F.coalesce("over_18", F.lit(False)) & ~F.coalesce(F.col("author").isin("AutoModerator", "[deleted]"), F.lit(False))
    flair = F.lower(F.coalesce("link_flair_text", F.lit("")))
    wanted = (F.coalesce(F.size("__flairs"), F.lit(0)) <= 0) | F.exists("__flairs", lambda f: flair.contains(F.lower(f)))
    least = F.when(F.coalesce("is_self", F.lit(False)), F.coalesce("__self", F.lit(MIN_SELF_SCORE))).otherwise(F.coalesce("__link", F.lit(MIN_SCORE)))
    return p.where(ok & carries_story(F.col("title")) & F.coalesce(wanted, F.lit(True)) & (F.coalesce("score", F.lit(0)) >= least)).drop("__link", "__self", "__flairs")


def post_entries(p: DataFrame) -> DataFrame:
    """Posts as entries: links elsewhere under their host's name, all others under their subreddit's."""
    away = ~F.coalesce("is_self", F.lit(False)) & F.coalesce(F.col("url").rlike("(?i)^https?://") & ~F.col("url").rlike(r"(?i)^https?://(?:www\.)?reddit\.com"), F.lit(False))
    here = F.when(F.col("permalink").startswith("/"), F.concat(F.lit("https://www.reddit.com"), F.col("permalink"))).otherwise(F.col("permalink"))
    board = F.concat(F.lit("r/"), F.col("subreddit"))
    host = F.nullif(F.regexp_replace(F.coalesce("domain", F.lit("")), r"^self\.", ""), F.lit(""))
    text = truncate(F.trim(F.regexp_replace(F.coalesce("selftext", F.lit("")), r"\s+", " ")), 400)
    return p.select(
        "source_id", "title", F.when(away, F.col("url")).otherwise(here).alias("link"), F.date_format(F.timestamp_seconds(F.col("created_utc").cast("long")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published"), F.nullif(text, F.lit("")).alias("summary"), F.lit(None).cast("string").alias("content"),
        F.when(F.col("thumbnail").rlike("^https?://"), F.col("thumbnail")).alias("image"), F.struct(F.when(away, F.coalesce(host, board)).otherwise(board).alias("name"), F.when(~away, F.concat(F.lit("https://www.reddit.com/"), board)).alias("url")).alias("source"), F.col("id").alias("guid"),
    )


def permitted(sources: DataFrame, credentials: dict[str, str] | None) -> DataFrame:
    """Sources that may be polled: listings need credentials (``client_id``, ``client_secret``); without them they are left out, which is no failure."""
    given = bool(credentials and (credentials.get("client_id") or "").strip() and (credentials.get("client_secret") or "").strip())
    return sources if given else sources.where("kind != 'reddit'")


class TokenCache:
    """A bearer token of the client-credentials kind, used until a minute before it ends; ``forget`` after a refusal.

    ``ask`` takes address, headers and body and gives status and text. One cache serves one partition's requests.
    """

    def __init__(self, client_id: str, client_secret: str, agent: str, ask: Callable[[str, dict, str], tuple[int, str]], address: str = "https://www.reddit.com/api/v1/access_token", margin: float = 60.0):
        self.basic = base64.b64encode(f"{client_id}:{client_secret}".encode()).decode()
        self.agent, self.ask, self.address, self.margin = agent, ask, address, margin
        self.value, self.until = None, 0.0

    def forget(self) -> None:
        self.value = None

    def token(self, now: float) -> str:
        if self.value is None or self.until <= now:
            status, text = self.ask(self.address, {"Authorization": f"Basic {self.basic}", "Content-Type": "application/x-www-form-urlencoded", "User-Agent": self.agent}, "grant_type=client_credentials")
            if not 200 <= status < 300:
                raise OSError(f"token HTTP {status}")
            body = json.loads(text)
            if not body.get("access_token"):
                raise OSError("no access_token")
            self.value, self.until = body["access_token"], now + body.get("expires_in", 3600) - self.margin
        return self.value


def fetch_listing(url: str, tokens: TokenCache, get: Callable[[str, dict], tuple[int, dict, str]], now: float) -> tuple[int, str | None, str | None]:
    """Status, body and error of one listing; a refused token is forgotten, and errors are returned, not raised."""
    try:
        status, _, body = get(url, {"Authorization": f"bearer {tokens.token(now)}", "User-Agent": tokens.agent, "Accept": "application/json"})
    except (OSError, ValueError) as e:
        return 0, None, str(e)
    if 200 <= status < 300:
        return status, body, None
    if status == 401:
        tokens.forget()
    return status, None, f"HTTP {status}"


def listing_entries(bodies: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Entries of listing bodies (``source_id, body``): parsed, the wanted posts of each source, as entries."""
    return post_entries(keep_post(parse_listing(bodies), sources))


# --- links of search feeds ------------------------------------------------------------------------------------


def article_id(url: str | None) -> str | None:
    """The id in a search feed's redirect."""
    m = re.match(r"https?://[^/]+/(?:rss/)?(?:articles|read)/([A-Za-z0-9_-]+)", url or "")
    return m.group(1) if m else None


def embedded_url(ident: str | None) -> str | None:
    """The address that an old-style id holds: bytes 08 13 22, its length as a varint, the address itself."""
    if not ident:
        return None
    try:
        raw = base64.urlsafe_b64decode(ident + "=" * (-len(ident) % 4))
    except ValueError:
        return None
    if raw[:3] != b"\x08\x13\x22":
        return None
    size, shift, at = 0, 0, 3
    while at < len(raw):
        size |= (raw[at] & 0x7F) << shift
        shift += 7
        at += 1
        if not raw[at - 1] & 0x80:
            break
    url = raw[at : at + size].decode("utf-8", "replace")
    return url if len(raw) >= at + size and _http(url) else None


def decode_params(html: str | None) -> tuple[str, str] | None:
    """Signature and time of an interstitial page."""
    sg, ts = re.search(r'data-n-a-sg="([^"]+)"', html or ""), re.search(r'data-n-a-ts="([^"]+)"', html or "")
    return (sg.group(1), ts.group(1)) if sg and ts else None


def parse_envelope(text: str | None) -> str | None:
    """The first web address, at any depth, in a guarded JSON answer whose strings may be JSON again."""

    def search(node) -> str | None:
        if isinstance(node, str):
            if _http(node):
                return node
            if node[:1] in "[{":
                try:
                    return search(json.loads(node))
                except ValueError:
                    return None
            return None
        items = node.values() if isinstance(node, dict) else node if isinstance(node, list) else ()
        return next((u for x in items if (u := search(x))), None)

    for line in (text or "").splitlines():
        if line.strip().startswith("["):
            try:
                found = search(json.loads(line))
            except ValueError:
                continue
            if found:
                return found
    return None


@F.pandas_udf(T.StringType())
def resolved_link(url: pd.Series) -> pd.Series:
    """Where redirects with old-style ids lead; null for all others."""
    return url.map(lambda u: embedded_url(article_id(u)))


# --- polling --------------------------------------------------------------------------------------------------

Transport = Callable[[str, dict], tuple[int, dict, str]]


class FeedSource(DataSource):
    """``spark.read.format("storyweft_feed")``: polls addresses, one partition a host, with conditional requests.

    Options: ``sources`` (JSON list of {id, url, etag, last_modified}), ``transport`` (``module:function`` that takes address
    and headers and gives status, headers and body; the default uses urllib), ``timeout`` in seconds, ``pause`` between polls of a host.
    """

    @classmethod
    def name(cls) -> str:
        return "storyweft_feed"

    def schema(self) -> str:
        return "source_id string, status int, not_modified boolean, etag string, last_modified string, body string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _FeedReader(dict(self.options))


class _HostPart(InputPartition):
    def __init__(self, sources: list[dict]):
        super().__init__(0)
        self.sources = sources


def fetch(url: str, headers: dict, timeout: float = 25.0) -> tuple[int, dict, str]:
    import urllib.error
    import urllib.request

    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as r:
            return r.status, {k.lower(): v for k, v in r.headers.items()}, r.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, {}, ""


class _FeedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        hosts: dict[str, list[dict]] = {}
        for s in json.loads(self.options.get("sources", "[]")):
            hosts.setdefault(re.sub(r"^https?://([^/]+).*", r"\1", s["url"]), []).append(s)
        return [_HostPart(h) for h in hosts.values()]

    def read(self, partition) -> Iterator[tuple]:
        import importlib
        import time

        get: Transport = fetch
        if self.options.get("transport"):
            module, _, name = self.options["transport"].partition(":")
            get = getattr(importlib.import_module(module), name)
        pause = float(self.options.get("pause", 0.8))
        for i, s in enumerate(partition.sources):
            if i:
                time.sleep(pause)
            headers = {k: v for k, v in (("If-None-Match", s.get("etag")), ("If-Modified-Since", s.get("last_modified"))) if v}
            for attempt in (0, 1):  # once more after an error of network or server
                try:
                    status, found, body = get(s["url"], headers)
                    error = None if status in range(200, 300) or status == 304 else f"HTTP {status}"
                except OSError as e:
                    status, found, body, error = 0, {}, None, str(e)
                if error is None or 0 < status < 500 or attempt:
                    break
                time.sleep(float(self.options.get("retry_pause", 2.0)))
            yield s["id"], status, status == 304, found.get("etag"), found.get("last-modified"), body if error is None and status != 304 else None, error
