"""How distinctive a term is of a record: divergence from randomness, geometric model with Laplace after-effect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyweft.operators.skew import HOT, salted_join
from storyweft.session import cut


def words(text: Column) -> Column:
    """Words of a normalised text, split at single spaces; empty strings are no words."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def information(rate: Column, tfn: Column | float = 1.0) -> Column:
    """Bits of ``tfn`` occurrences of a term that has ``rate`` occurrences a record, under the geometric model; falls as the rate grows, for one occurrence."""
    tfn = F.lit(tfn) if isinstance(tfn, float) else tfn
    return F.log2(1 + rate) + tfn * F.log2((1 + rate) / rate)


def _postings(df: DataFrame, key: str, text: str, hashed: bool = False) -> DataFrame:
    """A row for each record and word: ``k, term, tf, len``; with the key as a number where only words are counted."""
    source = df.where(F.col(key).isNotNull()).select((F.xxhash64(key) if hashed else F.col(key)).alias("k"), words(F.col(text)).alias("ws"), F.monotonically_increasing_id().alias("row"))
    # one shuffle serves both sums
    each = source.select("k", F.size("ws").alias("len"), F.explode("ws").alias("term"), "row").repartition("k", "term")
    return each.groupBy("k", "term", "row").agg(F.count("*").alias("tf"), F.first("len").alias("len")).groupBy("k", "term").agg(F.max("tf").alias("tf"), F.max("len").alias("len"))


def _word_stats(df: DataFrame, key: str, text: str) -> DataFrame:
    """Columns ``term, df, total``: records that hold a word, and its occurrences in them."""
    return cut(_postings(df, key, text, True).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")))


def _totals(df: DataFrame, key: str, text: str) -> tuple[Column, Column]:
    """Number and average length of the records."""
    lengths = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.greatest(F.coalesce(F.size(words(F.col(text))), F.lit(0)), F.lit(0))).alias("len"))
    row = lengths.agg(F.count("*").alias("n"), F.avg("len").alias("avg")).first()
    return F.lit(float(max(row["n"], 1))), F.lit(float(row["avg"] or 0.0))


def _scored(rows: DataFrame, records: Column, average: Column, c: float, key: str) -> DataFrame:
    tfn = F.col("tf") * F.log2(1 + c * average / F.col("len"))
    return rows.select(F.col("k").alias(key), "term", "tf", "df", (information(F.col("total") / records, tfn) / (tfn + 1)).alias("score"))


def distinctiveness(df: DataFrame, key: str = "id", text: str = "title_norm", c: float = 1.0, hot: int = HOT) -> DataFrame:
    """Columns ``key, term, tf, df, score``: one row for each record and distinct word of it.

    The score is ``gain * information``: with F the term's occurrences, N the records, λ = F/N and the length-normalised
    frequency tfn = tf·log2(1 + c·average length/length), information = log2(1 + λ) + tfn·log2((1 + λ)/λ) (geometric
    model) and gain = 1/(tfn + 1) (Laplace). Common words get little, rare ones much; ``df`` counts distinct records.

    Records stored several times count once, each word with its largest frequency. Null and empty texts have no words
    but count as records of length 0 in N; rows with a null key are left out. An empty table gives an
    empty result. Other columns are not read.

    Frequencies come from map-side combined sums. The statistics of words go to the rows by a join that cuts words of more
    than ``hot`` records into parts, since one word may be in a third of all.
    """
    records, average = _totals(df, key, text)
    posting = _postings(df, key, text)
    stats = _word_stats(df, key, text)
    return _scored(salted_join(posting, stats, ["term"], "df", ["k"], hot=hot), records, average, c, key)


def distinctive(df: DataFrame, key: str = "id", text: str = "title_norm", least: int = 2, most: int = 40, c: float = 1.0, hot: int = HOT) -> DataFrame:
    """The scored words that are shared yet rare: one occurrence of them tells at least as much as of a word in ``most`` records, at most as much as of one in ``least``.

    What one occurrence tells is its information under the geometric model with λ = df/N, by which words are cut before the
    others' rows are read; rows, null and empty texts as in :func:`distinctiveness`. Words of more than ``hot`` records
    are taken out before the shuffle, so that no task gets all rows of one.
    """
    records, average = _totals(df, key, text)
    posting = _postings(df, key, text)
    stats = _word_stats(df, key, text)
    told = information(F.col("df") / records)
    near = 1e-12  # the same sums, so equal but for rounding
    kept = stats.where((told >= information(F.lit(float(most)) / records) - near) & (told <= information(F.lit(float(least)) / records) + near))
    common = F.broadcast(stats.where(F.col("df") > max(hot, most)).select("term"))  # at most rows / hot
    return _scored(posting.join(common, "term", "left_anti").join(kept, "term"), records, average, c, key)
