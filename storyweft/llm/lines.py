"""Lines that one site repeats: log-likelihood ratio against all other sites, with false-discovery control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyweft.operators.skew import HOT, salted_join
from storyweft.session import cut

FDR = 0.05
BINS_PER_UNIT = 20  # resolution of the ratio in the false-discovery table
TOP = 2000.0  # larger ratios share the last bin; the table has at most TOP * BINS_PER_UNIT rows


def compared(line: Column) -> Column:
    """A line as it is compared: tags out, white space single, trimmed, lower case, digit runs as ``#``."""
    visible = F.regexp_replace(line, "<[^>]*>", " ")
    single = F.trim(F.regexp_replace(visible, r"(?U)[\s\x1c-\x1f]+", " "))
    return F.regexp_replace(F.lower(single), "[0-9]+", "#")


def split_lines(content: Column) -> Column:
    """The compared form of each line."""
    return F.transform(F.split(content, "\n"), compared)


def _ratio(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Log-likelihood ratio of k1 of n1 against k2 of n2; 0 unless the first rate is the larger."""

    def part(k, n, p):
        return F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(n > k, (n - k) * F.log(1 - p)).otherwise(0.0)

    p1, p2, p = k1 / n1, k2 / n2, (k1 + k2) / (n1 + n2)
    return F.when(p1 > p2, 2 * (part(k1, n1, p1) + part(k2, n2, p2) - part(k1, n1, p) - part(k2, n2, p))).otherwise(0.0)


def upper_tail(x: float) -> float:
    """Chance that a chi-squared variable with one degree of freedom is beyond ``x``."""
    import math

    return math.erfc(math.sqrt(max(x, 0.0) / 2))


def repeated_lines(articles: DataFrame, key: str = "id", site: str = "site_name", content: str = "content", least: int = 5, share: float = 0.1, fdr: float = FDR, hot: int = HOT) -> DataFrame:
    """Columns ``site, line_hash, articles, site_articles, outside, ratio``: lines with significant excess in a site.

    For each site and compared line the number of the site's distinct articles that hold it is tested against its frequency in all other
    sites, plus a prior of half an article in as many as there are in all, since most lines occur in one article only. So a line that is
    as frequent everywhere isn't its site's own and stays, however often it is repeated. The ratios' p-values are held against a
    Benjamini-Hochberg bound at ``fdr`` over the lines tested, those that a site holds more than once; counts by ratio are kept in a table of bounded size, never sorted as rows.
    Returned are the significant lines with at least ``least`` articles and ``share`` of the site; ``fdr`` 1 takes all of these.

    Articles stored several times count once; null ids, sites and contents are left out, empty lines are no lines.
    An empty table gives an empty result; other columns are not read.
    """
    source = articles.select(F.col(key).alias("k"), F.col(site).alias("site"), F.col(content).alias("content")).dropna()
    row = source.select("site", F.xxhash64("k").alias("kh"), F.explode(F.array_distinct(F.transform(F.filter(split_lines(F.col("content")), lambda x: x != ""), lambda x: F.xxhash64(x)))).alias("line_hash"))
    sites = source.groupBy("site").agg(F.countDistinct(F.xxhash64("k")).alias("n1"))
    # the pair is unique after the inner aggregation, which spreads a large site by article as well
    inside = row.groupBy("site", "line_hash", "kh").agg(F.lit(1).alias("one")).groupBy("site", "line_hash").agg(F.count("*").alias("k1"))
    n = F.lit(sites.agg(F.coalesce(F.sum("n1"), F.lit(0)).alias("n")).first()["n"])
    counted = cut(salted_join(inside, cut(sites.withColumn("lines", 10 * F.col("n1"))), ["site"], "lines", ["line_hash"], hot=hot).drop("lines"))  # an article has some ten lines of its own
    excess = (F.col("k1") >= least) & (F.col("k1") >= share * F.col("n1"))
    total = counted.groupBy("line_hash").agg(F.sum("k1").alias("held"))
    tested = counted.where("k1 > 1")  # a line held once repeats nothing, so there is nothing to test
    held_outside, outside_articles = F.col("held") - F.col("k1"), n - F.col("n1")
    scored = tested.join(total, "line_hash").select(
        "site", "line_hash", F.col("k1").alias("articles"), F.col("n1").alias("site_articles"), held_outside.alias("outside"), excess.alias("excess"),
        _ratio(F.col("k1").cast("double"), F.col("n1").cast("double"), held_outside + F.lit(0.5), (outside_articles + n).cast("double")).alias("ratio"),
    )
    scored = cut(scored)
    at = F.floor(F.least("ratio", F.lit(TOP)) * BINS_PER_UNIT)
    bins = {r["bin"]: r["lines"] for r in scored.groupBy(at.alias("bin")).agg(F.count("*").alias("lines")).collect()}  # a table of bounded size
    return scored.where("excess").where(at >= _bound(bins, fdr)).drop("excess")


def _bound(bins: dict[int, int], fdr: float) -> int:
    """The least bin whose p-value is within Benjamini-Hochberg's bound at its rank, over all tested lines; beyond all bins if there is none."""
    total, rank, least = sum(bins.values()), 0, int(TOP * BINS_PER_UNIT) + 1
    for b in sorted(bins, reverse=True):
        rank += bins[b]
        if upper_tail(b / BINS_PER_UNIT) <= fdr * rank / total:
            least = b
    return least


def found_lines(articles: DataFrame, least: int = 5, share: float = 0.1, fdr: float = FDR, hot: int = HOT, **columns: str) -> DataFrame:
    """Columns ``site_name, line``: :func:`repeated_lines` with the lines' text in compared form.

    A line in more than ``hot`` articles of a site is joined in parts.
    """
    site, content, key = columns.get("site", "site_name"), columns.get("content", "content"), columns.get("key", "id")
    hits = cut(repeated_lines(articles, least=least, share=share, fdr=fdr, **columns).select("site", "line_hash", "articles"))
    text = articles.select(F.col(site).alias("site"), F.xxhash64(key).alias("kh"), F.explode(F.array_distinct(split_lines(F.col(content)))).alias("line")).where("site is not null and line != ''")
    return salted_join(text.withColumn("line_hash", F.xxhash64("line")), hits, ["site", "line_hash"], "articles", ["kh"], "left_semi", hot).select(F.col("site").alias("site_name"), "line").distinct()


def without_repeated_lines(articles: DataFrame, key: str = "id", site: str = "site_name", content: str = "content", hot: int = HOT) -> DataFrame:
    """Columns ``key, content``: each article (of copies that differ the greatest content) freed of its site's repeated lines.

    Lines are anti-joined with the significant ones and put together again by position. An article of which nothing
    is left, or without content, has an empty content; articles without a site keep all lines.
    """
    hits = cut(repeated_lines(articles, key, site, content).select(F.col("site").alias("s"), F.col("line_hash").alias("h"), "articles"))
    one = articles.select(F.col(key).alias("k"), F.col(site).alias("s"), F.col(content).alias("c")).where("k is not null")
    one = one.groupBy("k").agg(F.max(F.struct("c", "s")).alias("x")).select("k", "x.c", "x.s")
    lines = one.select("k", "s", F.posexplode(F.split("c", "\n")).alias("pos", "line")).withColumn("h", F.xxhash64(compared(F.col("line"))))
    kept = salted_join(lines, hits, ["s", "h"], "articles", ["k"], "left_anti", hot)
    body = kept.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return one.select("k").join(body, "k", "left").select(F.col("k").alias(key), F.coalesce("body", F.lit("")).alias(content))
