"""Evaluation passages inside training texts: winnowed fingerprints, met in a join and extended from where they lie."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyweft.llm.shingles import WORDS, Hasher, inside, runs
from storyweft.operators.skew import HOT, salted_join
from storyweft.session import cut

SPAN = 13  # words that make a leak
GRAM = 9  # words of a fingerprint; windows of SPAN - GRAM + 1 fingerprints keep their least, so no span is missed
BITS = 1 << 24  # of the filter that drops fingerprints of the documents which no item has; a fixed size


def winnow(hashes: np.ndarray, ends: np.ndarray, gram: int, span: int) -> np.ndarray:
    """Places of the kept fingerprints: the least of each window, the last of equal ones, windows inside a text."""
    grams = runs(hashes, gram)
    wide = span - gram + 1
    if len(grams) < wide:
        return np.empty(0, np.int64)
    least, at = grams[wide - 1 :].copy(), np.arange(wide - 1, len(grams))
    for back in range(1, wide):  # from the last run of each window to its first
        before = grams[wide - 1 - back : len(grams) - back]
        less = before < least
        least[less] = before[less]
        at[less] = np.flatnonzero(less) + (wide - 1 - back)
    return np.unique(at[inside(ends, len(at), span)])


def _prints(hashes: np.ndarray, ends: np.ndarray, gram: int, span: int, short: list[int], every: bool) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Places and fingerprints with their number of words; every: of the evaluation side, whole short texts instead of all runs of their lengths."""
    at = winnow(hashes, ends, gram, span)
    yield at, runs(hashes, gram)[at] if len(at) else np.empty(0, np.uint64), 0
    size = np.diff(ends)
    for n in short:
        grams = runs(hashes, n) + np.uint64(n)  # lengths apart from one another
        start = ends[:-1][size == n] if every else np.flatnonzero(inside(ends, len(grams), n))
        yield start, grams[start] if len(start) else np.empty(0, np.uint64), n


def _print_table(df: DataFrame, gram: int, span: int, short: list[int], every: bool, bits: int, wanted=None) -> DataFrame:
    """A row for each fingerprint: key, print, the words around it that a span with it can have, and where it begins among them."""
    name, kind = df.columns[0], df.schema[0].dataType.simpleString()
    room = span - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        keep = None if wanted is None else np.frombuffer(wanted.value, np.uint8)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                words = [WORDS(t.lower()) if t else [] for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, words)])
                hashes = np.array([h for w in words for h in hasher(w)], np.uint64)
                rows, prints, around, offsets = [], [], [], []
                for at, found, n in _prints(hashes, ends, gram, span, short, every):
                    if keep is not None and len(found):
                        spot = (found % np.uint64(bits)).astype(np.int64)
                        ok = (keep[spot >> 3] >> (spot & 7).astype(np.uint8) & 1).astype(bool)
                        at, found = at[ok], found[ok]
                    row = np.searchsorted(ends, at, side="right") - 1
                    for a, r in zip((at - ends[row]).tolist(), row.tolist()):
                        low = a if n else max(0, a - room)
                        around.append(words[r][low : a + (n or gram + room)])
                        offsets.append(a - low)
                    rows.append(row)
                    prints.append(found)
                at = np.concatenate(rows)
                if len(at):
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), pa.array(np.concatenate(prints).view(np.int64)), pa.array(around, pa.list_(pa.string())), pa.array(offsets, pa.int32())], names=[name, "print", "around", "at"])

    return df.mapInArrow(run, f"`{name}` {kind}, print bigint, around array<string>, at int")


def _filter(prints: DataFrame, bits: int) -> bytes:
    """A bit for each fingerprint's lower digits, put together by the workers in words of 32 bits: bits / 32 rows at most come to the driver."""
    spot = F.col("print").bitwiseAND(bits - 1)
    words = prints.select(spot.alias("spot")).groupBy(F.shiftright("spot", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 31 as int))")).alias("b")).toPandas()
    out = np.zeros(bits // 32, "<u4")
    out[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).astype(np.uint32)
    return out.tobytes()


def _extended(span: int) -> Column:
    """Whether the words shared to the left of a fingerprint, and from it to the right, are ``span``, or all of a shorter item."""
    left = "if(least(d_at, i_at) > 0, aggregate(sequence(1, least(d_at, i_at)), 0, (n, j) -> if(n = j - 1 and d_around[d_at - j] = i_around[i_at - j], j, n)), 0)"
    right = "aggregate(sequence(1, least(size(d_around) - d_at, size(i_around) - i_at)), 0, (n, j) -> if(n = j - 1 and d_around[d_at + j - 1] = i_around[i_at + j - 1], j, n))"
    return F.expr(f"{left} + {right} >= least({span}, size(i_around))")


def leaks(documents: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text", span: int = SPAN, gram: int = GRAM, bits: int = BITS, hot: int = HOT) -> DataFrame:
    """Columns ``doc, item``: documents that hold ``span`` consecutive words of an item's text, or all of a shorter one.

    Words are maximal runs of letters and digits in lower case. Of both sides every window of ``span - gram + 1``
    runs of ``gram`` words keeps its least hash, so any shared span gives a shared fingerprint. Items shorter
    than ``span`` are looked for whole, by runs of just their lengths. Each fingerprint carries the words around it that a span
    may have; where two meet they are compared word by word to the left and right. Texts are read once and never shuffled.

    A filter of ``bits`` bits (a power of two, the same however many items there are) drops fingerprints that no item has before the
    shuffle; what it lets through wrongly meets nothing in the join. A fingerprint in more than ``hot`` places of documents is joined in
    parts. Rows with a null key, null and wordless texts give nothing; repeated rows give one row. Other columns are not read.
    """
    docs = documents.select(F.col(doc).alias("d"), F.col(text).alias("t")).dropna()
    tests = items.select(F.col(item).alias("i"), F.col(text).alias("u")).dropna().distinct()

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(WORDS(t.lower())) for t in batch.column(0).to_pylist()], pa.int64())], names=["n"])

    short = sorted(r.n for r in tests.select("u").mapInArrow(sizes, "n bigint").where(f"n between 1 and {span - 1}").distinct().collect())  # fewer than span numbers
    asked = cut(_print_table(tests, gram, span, short, True, bits).withColumnsRenamed({"around": "i_around", "at": "i_at"}).distinct())
    wanted = documents.sparkSession.sparkContext.broadcast(_filter(asked, bits))
    held = cut(_print_table(docs, gram, span, short, False, bits, wanted).withColumnsRenamed({"around": "d_around", "at": "d_at"}))
    counted = cut(asked.join(held.groupBy("print").agg(F.count("*").alias("places")), "print"))
    met = salted_join(held, counted, ["print"], "places", ["d", "d_at"], hot=hot)
    return met.where(_extended(span)).select(F.col("d").alias(doc), F.col("i").alias(item)).distinct()
