"""Text functions as columns: they stay in the JVM, but for those that say otherwise."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Named entities that are decoded, and what they stand for.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’",
    "ldquo": "“", "rdquo": "”", "hellip": "…", "copy": "©", "reg": "®", "trade": "™", "deg": "°", "pound": "£", "euro": "€",
}
# Words that carry no content in a headline.
STOPWORDS = (
    "a an the and or but if then else of in on at to for from by with without about into onto over under "
    "is are was were be been being am do does did done has have had having will would shall should can could "
    "may might must this that these those it its it's he she they them his her their we you your our i me my "
    "as than so such not no nor only own same too very just also more most much many some any all both each "
    "few other another again further once here there when where why how what which who whom whose while "
    "after before during until up down out off above below between through against says say said saying "
    "new report reports reported reportedly claims claim claimed video watch photo photos pictures see "
    "amid after latest news update updates breaking exclusive revealed reveals reveal inside"
).split()
# Second-level and top domains that a name loses, query parameters that only track, what listings add to a text.
SECOND_LEVEL = r"\.(?:co|com|org|net|ac|gov)\.[a-z]{2}\z"
TOP_DOMAIN = r"\.[a-z]{2,6}\z"
TRACKING = r"(?i)^(utm_[^=]*|fbclid|gclid|mc_cid|mc_eid)(=|\z)"
ADDED = r"(?i)submitted by\s+/u/\S+.*\z|\[link\]|\[comments\]"
ELLIPSIS = "…"
SPACES = r"(?U)[\s\x{FEFF}]+"


def _latin() -> tuple[str, str]:
    """Latin letters with marks and the plain letters that they decompose to, by rule."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _PLAIN = _latin()
_TO_PLAIN = str.maketrans(_MARKED, _PLAIN)


def plain_letters(c: Column) -> Column:
    """Latin letters without their marks, combining marks out; letters of other scripts stay as they are."""
    return F.regexp_replace(F.translate(c, _MARKED, _PLAIN), r"[\x{0300}-\x{036F}]", "")


@F.pandas_udf(T.StringType())
def nfkd(s: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks, for all scripts (Arrow, for where Latin isn't enough)."""
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not 0x300 <= ord(c) <= 0x36F))


_ENTITY = re.compile(r"&(#x[0-9a-f]+|#\d+|[a-z]+);", re.I)


def decode_text(s: str | None) -> str | None:
    """A text with numeric and the named entities decoded; unknown ones stay."""

    def one(m: re.Match) -> str:
        body = m.group(1)
        if body[0] != "#":
            return ENTITIES.get(body.lower(), m.group(0))
        code = int(body[2:], 16) if body[1] in "xX" else int(body[1:])
        return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else m.group(0)

    return None if s is None else _ENTITY.sub(one, s)


@F.pandas_udf(T.StringType())
def decode_entities(s: pd.Series) -> pd.Series:
    """Numeric and named entities decoded (Arrow: each match has its own replacement)."""
    return s.map(decode_text)


def decode_named(c: Column) -> Column:
    """Named entities only, in the JVM; ``&amp;`` last so that nothing is decoded twice."""
    for name, char in [*((n, ch) for n, ch in ENTITIES.items() if n != "amp"), ("amp", "&")]:
        c = F.regexp_replace(c, f"(?i)&{name};", char.replace("\\", "\\\\").replace("$", "\\$"))
    return c


def headline_text(raw: str | None, publisher: str | None, search: bool | None, most: int = 8, least: int = 4) -> str | None:
    """A raw headline cleaned, of a search feed without its publisher, without what is bolted on after a bar."""
    if raw is None:
        return None
    text = re.sub("[\u00ad\u200b-\u200d\ufeff\u2060]", "", decode_text(raw)).translate(_QUOTES)
    text = _LEADING.sub("", " ".join(text.split())).strip()
    if search and publisher:
        target, parts = fold_text(publisher), text.split(" - ")
        for k in range(len(parts) - 1, 0, -1):
            if fold_text(" - ".join(parts[k:])) == target and " - ".join(parts[:k]).strip():
                text = " - ".join(parts[:k]).strip()
                break
    while "|" in text:
        head, _, tail = text.rpartition("|")
        tail = tail.strip()
        if not tail or len(tail.split()) > most or tail[-1] in ".!?…" or len(head.split()) < least:
            break
        text = head.strip()
    return text


def fold_text(name: str) -> str:
    """:func:`fold_publisher` of one name."""
    plain = re.sub("[\u0300-\u036f]", "", name.lower().translate(_TO_PLAIN))
    return re.sub("[^a-z0-9]+", " ", re.sub(r"^the\s+", "", plain)).strip()


_QUOTES = str.maketrans({**dict.fromkeys("‘’‚′", "'"), **dict.fromkeys("“”„″", '"')})
_LEADING = re.compile("^[\u2600-\u27bf\U0001f000-\U0001faff\u2b00-\u2bff\u2190-\u21ff\u2300-\u23ff\ufe0f\u00a9\u00ae\u203c\u2049\u2122\u2139\\s]+")


@F.pandas_udf(T.StringType())
def headline(raw: pd.Series, publisher: pd.Series, search: pd.Series) -> pd.Series:
    """:func:`headline_text` over Arrow batches: one step, so that what builds on it isn't expanded again and again."""
    return pd.Series([headline_text(*x) for x in zip(raw, publisher, search)], dtype="object")


def strip_tags(html: Column) -> Column:
    """Markup to spaces: scripts and styles with their content, block ends, all other tags."""
    c = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    return F.regexp_replace(c, "<[^>]+>", " ")


def collapse(c: Column) -> Column:
    """White space of any kind single and trimmed."""
    return F.trim(F.regexp_replace(c, SPACES, " "))


def count_words(c: Column) -> Column:
    """Runs of characters between white space; 0 for null."""
    trimmed = collapse(F.coalesce(c, F.lit("")))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, " ")))


def strip_section(title: Column, most: int = 8, least: int = 4) -> Column:
    """A headline without what is bolted on after a bar: from the right, segments of at most ``most`` words without an end mark, while ``least`` words remain."""
    parts = F.split(title, r"\|")
    trimmed = F.transform(parts, F.trim)
    joined = lambda k: F.trim(F.array_join(F.slice(parts, 1, k), "|"))
    n = F.size(parts)
    # how many segments stay: from the right, drop while the tail may go and the head stands
    keep = F.aggregate(
        F.when(n > 1, F.reverse(F.sequence(F.lit(2), n))).otherwise(F.array().cast("array<int>")),
        F.struct(n.alias("k"), F.lit(True).alias("on")),
        lambda acc, i: F.when(
            acc["on"] & (F.element_at(trimmed, i) != "") & (count_words(F.element_at(trimmed, i)) <= most) & ~F.element_at(trimmed, i).rlike(r"[.!?…]\z") & (count_words(joined(i - 1)) >= least),
            F.struct((i - 1).alias("k"), F.lit(True).alias("on")),
        ).otherwise(F.struct(acc["k"].alias("k"), F.lit(False).alias("on"))),
    )["k"]
    return F.when(n > 1, joined(keep)).otherwise(title)


EMOJI = r"[\x{2600}-\x{27BF}\x{1F000}-\x{1FAFF}\x{2B00}-\x{2BFF}\x{2190}-\x{21FF}\x{2300}-\x{23FF}\x{FE0F}\x{00A9}\x{00AE}\x{203C}\x{2049}\x{2122}\x{2139}]"


def clean_title(raw: Column) -> Column:
    """A headline with entities decoded, invisible characters out, quotes alike, space single, without leading emoji."""
    c = F.regexp_replace(decode_entities(raw), r"[\x{00AD}\x{200B}-\x{200D}\x{FEFF}\x{2060}]", "")
    c = F.translate(c, "‘’‚′“”„″", "''''" + '""""')
    return F.trim(F.regexp_replace(collapse(c), rf"^(?:{EMOJI}|\s)+", ""))


def fold_publisher(name: Column) -> Column:
    """Lower case without marks, leading article and punctuation."""
    c = F.regexp_replace(plain_letters(F.lower(name)), r"^the\s+", "")
    return F.trim(F.regexp_replace(c, "[^a-z0-9]+", " "))


def looks_like_domain(name: Column) -> Column:
    """Whether a name is a host name."""
    return F.trim(name).rlike(r"(?i)^(?:www\.)?[a-z0-9-]+(?:\.[a-z0-9-]+)+\z")


def publisher_key(name: Column) -> Column:
    """Identity of a publisher: folded, of a host name without scheme, www and top domain, letters and digits only."""
    c = F.trim(plain_letters(F.lower(name)))
    c = F.regexp_replace(F.regexp_replace(c, "^https?://", ""), r"^www\.", "")
    bare = F.regexp_replace(F.regexp_replace(c, SECOND_LEVEL, ""), TOP_DOMAIN, "")
    c = F.when(c.rlike(r"^[a-z0-9-]+(\.[a-z0-9-]+)+\z"), bare).otherwise(c)
    return F.regexp_replace(F.regexp_replace(c, r"^the\s+", ""), "[^a-z0-9]+", "")


def strip_publisher(title: Column, publisher: Column) -> Column:
    """A headline without " - Publisher": the rightmost " - " after which the publisher's name stands alone is cut."""
    parts = F.split(title, " - ")
    n = F.size(parts)
    target = fold_publisher(publisher)
    cut = F.filter(F.when(n > 1, F.reverse(F.sequence(F.lit(1), n - 1))).otherwise(F.array().cast("array<int>")), lambda k: fold_publisher(F.array_join(F.slice(parts, k + 1, F.size(parts)), " - ")) == target)
    head = F.trim(F.array_join(F.slice(parts, 1, F.coalesce(F.get(cut, F.lit(0)), n)), " - "))
    return F.when((F.size(cut) > 0) & (head != ""), head).otherwise(title)


def normalize_title(title: Column) -> Column:
    """Lower case without marks and apostrophes; all but letters and digits of ASCII as single spaces."""
    c = F.regexp_replace(plain_letters(F.lower(title)), "['’]", "")
    return F.trim(F.regexp_replace(c, "[^a-z0-9]+", " "))


def stem(w: Column) -> Column:
    """A word without a common English ending; the first ending that fits goes."""
    n = F.length(w)
    return (
        F.when(n <= 4, w)
        .when(w.endswith("ies") & (n > 5), F.concat(F.left(w, n - 3), F.lit("y")))
        .when(w.endswith("ing") & (n > 6), F.left(w, n - 3))
        .when((w.endswith("ed") | w.endswith("es")) & (n > 5), F.left(w, n - 2))
        .when(w.endswith("s") & ~w.endswith("ss"), F.left(w, n - 1))
        .otherwise(w)
    )


def tokens(title_norm: Column) -> Column:
    """Content words of a normalised headline, stemmed, distinct, in order of first occurrence."""
    stop = F.lit(sorted(set(STOPWORDS)))
    kept = F.filter(F.split(title_norm, " "), lambda w: (w != "") & ~F.array_contains(stop, w) & ((F.length(w) > 1) | w.rlike("[0-9]")))
    return F.array_distinct(F.transform(kept, stem))


def item_id(title_norm: Column, publisher: Column) -> Column:
    """Identity of an item: 16 hex digits of the digest of its normalised headline and folded publisher."""
    return F.substring(F.sha1(F.concat(title_norm, F.lit("|"), fold_publisher(publisher))), 1, 16)


def truncate(c: Column, most: int) -> Column:
    """At most ``most`` characters, cut at the last space if that keeps more than 0.6 of them, and an ellipsis."""
    head = F.left(c, F.lit(most))
    at = F.lit(most) - F.locate(" ", F.reverse(head))  # place of the last space, from 0
    cut = F.when((F.locate(" ", F.reverse(head)) > 0) & (at > most * 0.6), F.left(head, at)).otherwise(head)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.regexp_replace(cut, r"[\s,;:.\-]+\z", ""), F.lit(ELLIPSIS)))


def slugify(c: Column) -> Column:
    """Normalised, joined by hyphens, at most 80 characters."""
    return F.regexp_replace(F.left(F.replace(normalize_title(c), F.lit(" "), F.lit("-")), F.lit(80)), r"-+\z", "")


def clean_url(url: Column) -> Column:
    """A web address without tracking parameters and fragment."""
    bare = F.split_part(url, F.lit("#"), F.lit(1))
    query = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)\z", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    base = F.split_part(bare, F.lit("?"), F.lit(1))
    return F.when(F.size(query) > 0, F.concat(base, F.lit("?"), F.array_join(query, "&"))).otherwise(base)


def host_of(url: Column) -> Column:
    """Host of a web address without www; empty for what is none."""
    return F.coalesce(F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", ""), F.lit(""))


def is_http(url: Column) -> Column:
    """Whether an address is of the web."""
    return F.coalesce(url.rlike("(?i)^https?://"), F.lit(False))


def strip_site(title: Column, site: Column, host: Column) -> Column:
    """A headline without " <mark> Site" where the tail is the site's name, its host or the host's first label."""
    tail = F.regexp_extract(title, r"^(.*\S)\s+[|–—:·-]\s+([^|–—:·]+?)\s*\z", 2)
    head = F.regexp_extract(title, r"^(.*\S)\s+[|–—:·-]\s+([^|–—:·]+?)\s*\z", 1)
    folded = fold_publisher(tail)
    own = (folded == fold_publisher(F.coalesce(site, F.lit("")))) | (folded == fold_publisher(host)) | (folded == fold_publisher(F.split_part(host, F.lit("."), F.lit(1))))
    return F.when((tail != "") & (folded != "") & own, head).otherwise(title)


def reading_minutes(words: Column) -> Column:
    """Minutes to read so many words, at least one."""
    return F.greatest(F.lit(1), F.round(words / 220).cast("int"))


def time_ago(at: Column, now: Column) -> Column:
    """How long ago in words: minutes, hours to 36, days to 14, else the date."""
    m = F.floor((F.unix_millis(now) - F.unix_millis(at)) / 60000)
    h, d = F.round(m / 60).cast("long"), F.round(m / 1440).cast("long")
    return (
        F.when(m < 1, F.lit("just now"))
        .when(m < 60, F.concat(m.cast("string"), F.lit("m ago")))
        .when(m < 36 * 60, F.concat(h.cast("string"), F.lit("h ago")))
        .when(m < 14 * 1440, F.concat(d.cast("string"), F.lit("d ago")))
        .otherwise(format_date(at))
    )


def format_date(at: Column) -> Column:
    """Day, short month and year."""
    return F.date_format(at, "d MMM yyyy")


def iso_millis(at: Column) -> Column:
    """ISO 8601 in UTC with milliseconds, as stored in files."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def url_encoded(c: Column) -> Column:
    """Percent-encoded as a query component: spaces as %20, the marks ! ' ( ) ~ * bare."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def path_of(*parts: str | Column, base: str = "") -> Column:
    """A page path under ``base``."""
    return F.concat(F.lit(base), *(F.lit(p) if isinstance(p, str) else p for p in parts))


def make_snippet(content: Column, summary: Column, title: Column, publisher: Column, search: Column, most: int = 300) -> Column:
    """Opening of an entry's text: null for search feeds, for a text that only echoes the headline, and under 40 characters."""
    raw = F.coalesce(F.nullif(content, F.lit("")), F.nullif(summary, F.lit("")))
    text = collapse(F.regexp_replace(decode_entities(strip_tags(raw)), ADDED, " "))
    text_key, title_key = normalize_title(text), normalize_title(title)
    both = normalize_title(F.concat_ws(" ", title, publisher))
    words = F.split(text, " ")
    rest = F.array_join(F.slice(words, count_words(title) + 1, F.greatest(F.size(words), F.lit(1))), " ")
    body = F.when((title_key != "") & text_key.startswith(title_key), rest).otherwise(text)
    return F.when(search | raw.isNull() | (text_key == title_key) | (text_key == both) | (F.length(body) < 40), F.lit(None)).otherwise(truncate(body, most))


def register(spark) -> None:
    """The functions that take one text, for SQL: ``sw_tokens(title_norm)`` and so on."""
    expressions = {
        "sw_normalize_title": normalize_title, "sw_publisher_key": publisher_key, "sw_fold_publisher": fold_publisher,
        "sw_slug": slugify, "sw_clean_url": clean_url, "sw_host": host_of,
    }
    for name, f in expressions.items():
        rule = _python(f)
        spark.udf.register(name, F.pandas_udf(rule, T.StringType()))
    spark.udf.register("sw_decode_entities", decode_entities)


def _python(f):
    """Row-wise twins of the column functions for SQL registration, run over Arrow batches, by the same table of letters and the same patterns."""
    py = lambda pattern: re.compile(pattern.replace(r"\z", r"\Z"))
    second, top, tracking = py(SECOND_LEVEL), py(TOP_DOMAIN), py(TRACKING)

    def fold(x: str) -> str:
        return re.sub("[\u0300-\u036f]", "", x.lower().translate(_TO_PLAIN))

    def key(x: str) -> str:
        c = re.sub(r"^www\.", "", re.sub(r"^https?://", "", fold(x).strip()))
        if re.fullmatch(r"[a-z0-9-]+(\.[a-z0-9-]+)+", c):
            c = top.sub("", second.sub("", c))
        return re.sub(r"[^a-z0-9]+", "", re.sub(r"^the\s+", "", c))

    def title(x: str) -> str:
        return re.sub(r"[^a-z0-9]+", " ", re.sub(r"['’]", "", fold(x))).strip()

    def url(x: str) -> str:
        base, _, query = x.partition("#")[0].partition("?")
        kept = [p for p in query.split("&") if p and not tracking.match(p)]
        return base + ("?" + "&".join(kept) if kept else "")

    def host(x: str) -> str:
        m = re.match(r"[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", x, re.I)
        return re.sub(r"^www\.", "", m.group(1).lower()) if m else ""

    rules = {normalize_title: title, publisher_key: key, fold_publisher: lambda x: re.sub(r"[^a-z0-9]+", " ", re.sub(r"^the\s+", "", fold(x))).strip(), slugify: lambda x: re.sub(r"-+$", "", title(x).replace(" ", "-")[:80]), clean_url: url, host_of: host}
    rule = rules[f]

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else rule(x))

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return run
