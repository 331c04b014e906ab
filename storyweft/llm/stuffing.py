"""Keyword-stuffed and link-list pages, by the shape of their rank-frequency curve and their distance from prose."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from heapq import nlargest

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyweft.session import cut

PROSE_SHARE = 0.10  # a word is prose in a language if that share of its pages holds it, so a page's words times 1/0.10 bounds their number
TAG_SHARE, TAG_PAGES = 0.001, 11  # of all tagged pages a language has at least these, so a thousand languages at most
SURPLUS, SPARE = 3.0, 2.0  # of a prose word counts at most SURPLUS times what is usual, and SPARE occurrences
HALF, EXTREME = 1 / 2, 1 / 3  # share of the usual prose under which a page is suspect, and under which it is extreme
CERTAIN = 6.0  # deviations of slope, residual or prose that are extreme by themselves
STEEP, ODD, FLOOR = 1.0, 1.0, 0.05  # deviations of slope and residual that confirm a suspect page; least deviation, as short pages have few slopes
FEW = 12  # pages of a language and length that make a baseline of their own
HEAD, HEAD_SHARE, GROWTH = 5, 0.33, 0.8  # a page whose HEAD commonest words repeat for more than that share of it, or with fewer words than n ** GROWTH, teaches no prose

CAMEL = re.compile(r"(?<=[a-zß-öø-ÿ])(?=[A-ZÀ-ÖØ-Þ])")
LINK = re.compile(r"</?a\b", re.I)
WORDS = re.compile(r"[^\W_]+").findall


class PageWords:
    """Words of pages in lower case with their counts: runs of letters and digits, CamelCase apart, without the names of link tags."""

    def __init__(self):
        self.known: dict[str, list[str]] = {}

    def __call__(self, text: str) -> dict[str, int]:
        known, out = self.known, {}
        if len(known) > 500_000:
            known.clear()
        for w, c in Counter(WORDS(LINK.sub(" ", text) if "<" in text else text)).items():
            parts = known.get(w)
            if parts is None:
                parts = known[w] = WORDS(CAMEL.sub(" ", w).lower())
            for p in parts:
                out[p] = out.get(p, 0) + c
        return out


def uneven(counts: dict[str, int], n: int) -> bool:
    """Whether a page's own rank-frequency curve has too heavy a head, or too few words, to learn prose from it."""
    return sum(nlargest(HEAD, counts.values())) - min(HEAD, len(counts)) > HEAD_SHARE * n or n > 1 and math.log(len(counts)) < GROWTH * math.log(n)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each language tag and word the pages that hold it and its occurrences; of the empty word pages and tokens; apart for pages that are ``uneven``."""
    held: dict[tuple[str, bool], Counter] = {}
    times: dict[tuple[str, bool], Counter] = {}

    def out() -> pa.RecordBatch:
        rows = [(*t, w, n, times[t][w]) for t, c in held.items() for w, n in c.items()]
        held.clear()
        times.clear()
        cols = list(zip(*rows)) or [(), (), (), (), ()]
        kinds = (pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["tag", "uneven", "word", "held", "times"])

    words = PageWords()
    for batch in batches:
        for tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            c = words(text)
            n = sum(c.values())
            at = tag, uneven(c, n)
            held.setdefault(at, Counter()).update(c.keys())
            times.setdefault(at, Counter()).update(c)
            held[at][""] += 1
            times[at][""] += n
        if sum(map(len, held.values())) > 400_000:  # added up in the shuffle
            yield out()
    yield out()


def prose_words(documents: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, dict[str, float]]:
    """Of each language its prose words with their usual share of tokens, learnt by their tags from all pages that aren't ``uneven``.

    Each distinct text counts once, so that neither copies nor pages of one keyword set are prose for being many. A language with fewer
    than TAG_PAGES even pages is learnt from all of its pages. Tags are in lower case, null, empty and ``und`` aside; wrong ones among
    many right ones do no harm.
    """
    tag = F.lower(F.trim(F.col(lang)))
    source = documents.select(tag.alias("tag"), F.col(text).alias("text")).where("tag is not null and tag not in ('', 'und') and text is not null")
    source = source.withColumn("print", F.xxhash64("text")).dropDuplicates(["tag", "print"]).select("tag", "text")
    even = lambda c: F.coalesce(F.sum(F.when(~F.col("uneven"), F.col(c))), F.lit(0)).alias(f"even_{c}")
    summed = source.mapInArrow(_counts, "tag string, uneven boolean, word string, held bigint, times bigint").groupBy("tag", "word").agg(F.sum("held").alias("held"), F.sum("times").alias("times"), even("held"), even("times"))
    # a tenth of eleven pages is more than one; read several times, so cut
    summed = cut(summed.where("held > 1 or word = ''"))
    whole = summed.where("word = ''").select("tag", F.col("held").alias("pages"), F.col("times").alias("tokens"), F.col("even_held").alias("even_pages"), F.col("even_times").alias("even_tokens"))
    total = whole.agg(F.coalesce(F.sum("pages"), F.lit(0)).alias("all")).first()["all"]
    known = whole.where((F.col("pages") >= TAG_PAGES) & (F.col("pages") >= TAG_SHARE * total))
    of = lambda c: F.when(F.col("even_pages") >= TAG_PAGES, F.col(f"even_{c}")).otherwise(F.col(c))
    common = summed.where("word != ''").join(known, "tag").where(of("held") >= PROSE_SHARE * of("pages")).select("tag", "word", (of("times") / of("tokens")).alias("q"))
    out: dict[str, dict[str, float]] = {}
    for r in common.collect():  # bounded, see PROSE_SHARE and TAG_SHARE
        out.setdefault(r["tag"], {})[r["word"]] = r["q"]
    return dict(sorted(out.items()))


def curves(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Columns ``doc, n, slope, residual, prose, language, uneven, print``: a row for each page that has words.

    A page's frequencies, each with the number of words that have it, are ranked by a window over the page; words of one frequency share
    the middle of their ranks. ``slope`` and ``residual`` are those of the line through log frequency by log rank, each
    frequency counting as often as it has words. ``prose`` is the share of the page's words that are prose words of any
    language, each capped by its usual share; ``language`` is the one whose prose words cover most of the page.
    """
    usual = prose_words(documents, text, lang)
    names = sorted(usual)
    known: dict[str, tuple[float, tuple[int, ...]]] = {}
    for i, name in enumerate(names):
        for w, q in usual[name].items():
            best, of = known.get(w, (0.0, ()))
            known[w] = max(q, best), (*of, i)
    shared = documents.sparkSession.sparkContext.broadcast((names, known))
    source = documents.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc"), F.col(text).alias("text")).where("doc is not null and text is not null")
    kind = source.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, known = shared.value
        words = PageWords()
        for batch in batches:
            at, n_, prose_, language_, c_, m_, uneven_, print_ = [], [], [], [], [], [], [], []
            for i, t in enumerate(batch.column("text").to_pylist()):
                counts = words(t)
                n = sum(counts.values())
                if not n:
                    continue
                prose, cover = 0.0, [0.0] * len(names)
                for w in counts.keys() & known.keys():
                    q, of = known[w]
                    v = min(counts[w], SPARE + SURPLUS * q * n)
                    prose += v
                    for k in of:
                        cover[k] += v
                at.append(i)
                n_.append(n)
                prose_.append(prose / n)
                language_.append(names[cover.index(max(cover))] if names else None)
                uneven_.append(uneven(counts, n))
                print_.append(xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) - 2**63)
                spectrum = Counter(counts.values())
                c_.append(list(spectrum.keys()))
                m_.append(list(spectrum.values()))
            take = pa.array(at, pa.int64())
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(take), batch.column("doc").take(take), pa.array(n_, pa.int64()), pa.array(prose_, pa.float64()), pa.array(language_, pa.string()), pa.array(c_, lists), pa.array(m_, lists), pa.array(uneven_, pa.bool_()), pa.array(print_, pa.int64())],
                names=["row", "doc", "n", "prose", "language", "cs", "ms", "uneven", "print"],
            )

    page = source.mapInArrow(run, f"row bigint, doc {kind}, n bigint, prose double, language string, cs array<bigint>, ms array<bigint>, uneven boolean, print bigint")
    spectrum = page.select("row", "doc", "n", "prose", "language", "uneven", "print", F.explode(F.arrays_zip("cs", "ms")).alias("x")).select("*", F.col("x.cs").alias("c"), F.col("x.ms").alias("m")).drop("x")
    w = Window.partitionBy("row").orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, 0)
    middle = F.sum("m").over(w) - (F.col("m") - 1) / 2.0
    ranked = spectrum.withColumn("x", F.log(middle)).withColumn("y", F.log(F.col("c").cast("double")))
    m, x, y = F.col("m"), F.col("x"), F.col("y")
    sums = ranked.groupBy("row").agg(
        *(F.first(c).alias(c) for c in ("doc", "n", "prose", "language", "uneven", "print")), F.sum("m").alias("k"), F.sum(m * x).alias("sx"), F.sum(m * y).alias("sy"), F.sum(m * x * x).alias("sxx"), F.sum(m * x * y).alias("sxy"), F.sum(m * y * y).alias("syy")
    )
    vx, vy, vxy = (F.col(a) / F.col("k") - F.col(b) * F.col(c) / F.col("k") / F.col("k") for a, b, c in (("sxx", "sx", "sx"), ("syy", "sy", "sy"), ("sxy", "sx", "sy")))
    slope = F.when(vx > 1e-12, -vxy / vx).otherwise(F.when(F.col("k") == 1, F.col("n").cast("double")).otherwise(0.0))
    residual = F.sqrt(F.greatest(F.lit(0.0), vy - F.when(vx > 1e-12, vxy * vxy / vx).otherwise(0.0)))
    return sums.select("doc", "n", slope.alias("slope"), residual.alias("residual"), "prose", "language", "uneven", "print")


def stuffed(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", certain: float = CERTAIN, curve: bool = True) -> DataFrame:
    """Columns ``key, slope, residual, prose`` of the pages that are stuffed keywords, link or tag lists for the most part.

    Each page is compared with pages of its language and of about its length (powers of two): the median of their
    prose share, median and deviation of slope and residual, over distinct texts that aren't ``uneven``, or all where a language has fewer
    than FEW of them. Any of three signs flags a page by itself: a curve steeper than theirs by ``certain`` deviations, one further from a
    line by as many, or less than EXTREME of their prose, if that is ``certain`` binomial deviations off (so a few words are never enough).
    A page with less than HALF of the usual prose is flagged as well if its curve is somewhat steeper or further from a line.
    ``curve`` false leaves out what slope and residual tell.

    Null, empty and wordless texts, and null keys, are not flagged; rows with one key are judged each.
    Other columns are not read; an empty table gives an empty result.
    """
    page = cut(curves(documents, key, text, lang).withColumn("size", F.floor(F.log2(F.col("n").cast("double")))))

    once = page.dropDuplicates(["language", "print"])
    few = once.groupBy("language").agg(F.sum((~F.col("uneven")).cast("int")).alias("even"))
    learnt = once.join(F.broadcast(few), "language").where(~F.col("uneven") | (F.col("even") < FEW))

    def middle(by: list[str], prefix: str) -> DataFrame:
        return learnt.groupBy(*by).agg(F.count("*").alias(f"{prefix}many"), *(F.percentile_approx(c, [0.5, 0.84], 2000).alias(f"{prefix}{c}") for c in ("slope", "residual", "prose")))

    fine, wide = middle(["language", "size"], "a_"), middle(["language"], "b_")
    both = page.join(F.broadcast(fine), ["language", "size"], "left").join(F.broadcast(wide), "language", "left")  # a row for each known language and power of two
    pick = lambda c, i: F.when(F.col("a_many") >= FEW, F.col(f"a_{c}")[i]).otherwise(F.col(f"b_{c}")[i])
    deviation = lambda c: (F.col(c) - pick(c, 0)) / (F.greatest(pick(c, 1) - pick(c, 0), F.lit(0.0)) + FLOOR)
    usual = pick("prose", 0)
    off = (usual - F.col("prose")) / F.sqrt(F.greatest(usual * (1 - usual), F.lit(0.1)) / F.col("n"))
    steep, odd = (deviation("slope"), deviation("residual")) if curve else (F.lit(0.0), F.lit(0.0))
    flagged = (steep > certain) | (odd > certain) | ((F.col("prose") < EXTREME * usual) & (off > certain)) | ((F.col("prose") < HALF * usual) & ((steep > STEEP) | (odd > ODD)))
    return both.where(flagged).select(F.col("doc").alias(key), "slope", "residual", "prose")
