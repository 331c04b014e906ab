"""Robots rules: groups for all agents, longest match, origin policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def parse_robots(files: DataFrame, key: str = "origin", body: str = "body") -> DataFrame:
    """Columns ``key, allow, pattern``: rules of the groups of agent ``*``.

    Lines are numbered; a run of agent lines is one group head, and a rule belongs to the last head before it.
    """
    line = files.select(F.col(key), F.posexplode(F.split(F.col(body), r"\r?\n")).alias("no", "raw")).withColumn("text", F.trim(F.regexp_replace("raw", r"#.*\z", "")))
    pair = line.where(F.col("text").contains(":")).select(key, "no", F.lower(F.trim(F.split_part("text", F.lit(":"), F.lit(1)))).alias("field"), F.trim(F.regexp_extract("text", r"^[^:]*:(.*)\z", 1)).alias("value"))
    w = Window.partitionBy(key).orderBy("no")
    agent = F.col("field") == "user-agent"
    head = pair.withColumn("starts", (agent & ~F.coalesce(F.lag(agent).over(w), F.lit(False))).cast("int")).withColumn("head", F.sum("starts").over(w))
    applies = F.max((agent & (F.col("value") == "*")).cast("int")).over(Window.partitionBy(key, "head"))
    rules = head.withColumn("applies", applies).where("applies = 1 and head > 0 and value != '' and field in ('allow', 'disallow')")
    return rules.select(key, (F.col("field") == "allow").alias("allow"), F.col("value").alias("pattern"))


def pattern_regex(pattern: Column) -> Column:
    """A rule as a regular expression: ``*`` any run, a final ``$`` the end, all else as it stands."""
    anchored = pattern.endswith("$")
    body = F.when(anchored, F.left(pattern, F.length(pattern) - 1)).otherwise(pattern)
    quoted = F.regexp_replace(body, r"([.+?^${}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(quoted, F.lit("*"), F.lit(".*")), F.when(anchored, F.lit(r"\z")).otherwise(F.lit("")))


def allowed(paths: DataFrame, rules: DataFrame, key: str = "origin", path: str = "path") -> DataFrame:
    """``paths`` (distinct) with ``allowed``: the longest rule that matches decides, allow on a tie, and no rule allows."""
    one = paths.distinct()
    met = one.join(rules.withColumn("regex", pattern_regex(F.col("pattern"))), key).where(F.expr(f"`{path}` rlike regex"))
    best = met.groupBy(key, path).agg(F.max(F.struct(F.length("pattern").alias("n"), "allow"))["allow"].alias("allowed"))
    return one.join(best, [key, path], "left").withColumn("allowed", F.coalesce("allowed", F.lit(True)))


def origin_policy(status: Column) -> Column:
    """What a robots request says by itself: ``deny`` for errors of server or network, ``rules`` for a file, else ``allow``."""
    return F.when(status.isNull() | (status >= 500) | (status == 0), "deny").when(status.between(200, 299), "rules").otherwise("allow")
