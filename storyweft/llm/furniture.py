"""Page furniture apart from the report, by the template that a page's lines are classes of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyweft.llm.pages import OUTSIDE, classified, vocabulary
from storyweft.llm.residue import residue, told


def furniture(articles: DataFrame, key: str = "id", site: str = "site_name", content: str = "content", excerpt: str = "excerpt", title: str = "title") -> DataFrame:
    """Columns ``key, line_no``: lines with visible text that are the page's template and not its report; -1 for such an excerpt.

    See ``pages``: a line belongs to the template if its class nests outside the main slot on most pages. Records that are
    residue are left out. Lines count from 0, empty ones included. Null contents and excerpts have no lines; rows with
    one key give the lines of any of them, each once; null keys are left out, other columns are not read, an empty table gives an empty result.
    """
    words = vocabulary(articles, content)
    judged = classified(articles, key=key, site=site, content=content, excerpt=excerpt, words=words, title=title, told=told)
    broken = residue(articles, key, title, content, site, lines=judged, words=words).select(F.col(key).alias("k"))
    return judged.where(F.col("template") >= OUTSIDE).join(broken, "k", "left_anti").select(F.col("k").alias(key), F.col("no").alias("line_no")).distinct()


def main_text(articles: DataFrame, key: str = "id", site: str = "site_name", content: str = "content", excerpt: str = "excerpt", title: str = "title") -> DataFrame:
    """Columns ``key, content``: the main body of each article, its own lines in order; records that are residue are left out."""
    words = vocabulary(articles, content)
    judged = classified(articles, key=key, site=site, content=content, excerpt=excerpt, words=words, title=title, told=told)
    broken = residue(articles, key, title, content, site, lines=judged, words=words).select(F.col(key).alias("k"))
    off = judged.where((F.col("template") >= OUTSIDE) & (F.col("no") >= 0)).groupBy("k").agg(F.collect_set("no").alias("off"))  # a page's own lines
    one = articles.select(F.col(key).alias("k"), F.col(content).alias("content")).where("k is not null").dropDuplicates(["k"])
    body = F.array_join(F.filter(F.split("content", "\n"), lambda x, i: ~F.array_contains(F.coalesce("off", F.array().cast("array<bigint>")), i.cast("bigint"))), "\n")
    return one.join(off, "k", "left").join(broken, "k", "left_anti").select(F.col("k").alias(key), F.coalesce(body, F.lit("")).alias(content))
