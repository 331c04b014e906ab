"""Stories: components of similar headlines under a cap on their time span, and what a story is made of."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyweft.functions.text import looks_like_domain, publisher_key, tokens
from storyweft.operators.components import components
from storyweft.operators.similarity import similar_pairs
from storyweft.schema import AGE_OFFSET_HOURS, FLAG_PENALTY, TIER_WEIGHT, TIERS, TOPICS, ordinal, weight
from storyweft.session import cut

# The span cap; headlines that are broadcast slugs, and those with a label at the end.
SPAN_HOURS = 7 * 24
SLUG = r"(?i)^(?:raw|watch|video|photos?|live|update|breaking)\s*:"
LABELLED = r"(?i)\s[-–—]\s(?:video|watch|photos?|listen|podcast|opinion|analysis)\z"


def guarded_components(items: DataFrame, pairs: DataFrame, span_hours: int = SPAN_HOURS) -> DataFrame:
    """Columns ``id, story``: every item with the first (by order) item of its story.

    Links are united in a fixed order (equal titles first; then by the earlier item, the place of the first shared word,
    the later item) and only if the union's span stays within the cap, so the result depends on that order. Links of
    different components never meet: components that fit the cap need no replay; the others are replayed each by itself, which
    gives just what one pass over all would.
    """
    base = items.select("id", "published_at").where("published_at is not null")
    found = components(pairs)
    placed = cut(base.join(found.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id")))
    spans = placed.groupBy("component").agg(F.min("published_at").alias("lo"), F.max("published_at").alias("hi"), F.min(F.struct("published_at", "id")).alias("first"))
    wide = (F.unix_seconds("hi") - F.unix_seconds("lo")) > span_hours * 3600
    calm = placed.join(spans.where(~wide), "component").select("id", F.col("first.id").alias("story"))
    rest = cut(placed.join(spans.where(wide).select("component"), "component", "left_semi"))
    when = rest.select("component", "id", F.unix_micros("published_at").alias("t"))
    left, right = when.select(F.col("id").alias("a"), "component", F.col("t").alias("ta")), when.select(F.col("id").alias("b"), F.col("t").alias("tb"))
    links = pairs.join(left, "a").join(right, "b").select("component", "a", "b", "ta", "tb", "phase", "pos")
    loners = when.join(links.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_anti").select("id", F.col("id").alias("story"))
    cap = span_hours * 3_600_000_000

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["phase", "ta", "a", "pos", "tb", "b"], kind="stable")
        time = dict(zip(pdf["a"], pdf["ta"])) | dict(zip(pdf["b"], pdf["tb"]))
        root = {i: i for i in time}
        lo, hi = dict(time), dict(time)

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for a, b in zip(pdf["a"], pdf["b"]):
            x, y = find(a), find(b)
            if x != y and max(hi[x], hi[y]) - min(lo[x], lo[y]) <= cap:
                root[y] = x
                lo[x], hi[x] = min(lo[x], lo[y]), max(hi[x], hi[y])
        best: dict = {}
        for i in time:
            r = find(i)
            if r not in best or (time[i], i) < (time[best[r]], best[r]):
                best[r] = i
        return pd.DataFrame({"id": list(time), "story": [best[find(i)] for i in time]})

    replayed = links.groupBy("component").applyInPandas(replay, "id string, story string")
    return calm.unionByName(loners).unionByName(replayed)


def write_ups(members: DataFrame) -> DataFrame:
    """Columns ``story, id, write_up``: members of a story that share a headline or a publisher, transitively, are one write-up.

    Least labels are exchanged over the two kinds of groups until none changes; every exchange is a window over
    (story, headline) and (story, publisher). Each further round lowers a label, so it ends, without a bound on its rounds.
    """
    state = cut(members.select("story", "id", "title_norm", publisher_key(F.col("publisher")).alias("pk"), F.col("id").alias("label")))
    while True:
        by_title, by_publisher = Window.partitionBy("story", "title_norm"), Window.partitionBy("story", "pk")
        after = state.withColumn("next", F.min("label").over(by_title)).withColumn("next", F.min("next").over(by_publisher)).withColumn("next", F.min("next").over(by_title))
        after = cut(after)
        changed = after.where("next != label").limit(1).count()
        state = after.drop("label").withColumnRenamed("next", "label")
        if not changed:
            return state.select("story", "id", F.col("label").alias("write_up"))


def ugly(title: Column) -> Column:
    """Whether a headline is a broadcast slug or has no lower-case letter."""
    return title.rlike(SLUG) | ~title.rlike("[a-z]")


def member_order(prefix: str = "") -> list[Column]:
    """Best member first: tier, resolvable link, readable headline, a name and no host, latest, id."""
    c = lambda n: F.col(prefix + n)
    return [ordinal(c("tier"), TIERS), c("url_opaque").cast("int"), ugly(c("title")).cast("int"), looks_like_domain(c("publisher")).cast("int"), F.desc(prefix + "published_at"), c("id")]


def majority(flags: DataFrame, members: DataFrame) -> DataFrame:
    """Columns ``story, flags``: the flags (story, flag) that more than half of a story's members have, sorted."""
    size = members.groupBy("story").agg(F.count("*").alias("n"))
    held = flags.groupBy("story", "flag").agg(F.count("*").alias("c"))
    return held.join(size, "story").where("2 * c > n").groupBy("story").agg(F.array_sort(F.collect_list("flag")).alias("flags"))


def score(weight_sum: Column, groups: Column, latest: Column, flags: Column, now: Column) -> Column:
    """Weight times (1 + ln write-ups), over age in hours and an offset, times the penalties of the flags."""
    age = F.greatest(F.lit(0.0), (F.unix_millis(now) - F.unix_millis(latest)) / 3_600_000.0)
    penalty = F.aggregate(flags, F.lit(1.0), lambda acc, f: acc * weight(f, FLAG_PENALTY, 1.0))
    return weight_sum * (1 + F.log(groups.cast("double"))) / (age + AGE_OFFSET_HOURS) * penalty


def roll_up(items: DataFrame, story: DataFrame, now: Column) -> DataFrame:
    """A row for each story (schema STORY): headline by consensus, members in order, publishers, tier, corroboration, flags, score.

    ``items`` has one row for each id. All is joins, windows by story and sums combined before the shuffle.
    """
    members = cut(items.join(story, "id"))
    ups = cut(write_ups(members))
    ranked = members.join(ups, ["story", "id"]).withColumn("rank", F.row_number().over(Window.partitionBy("story").orderBy(*member_order())))
    ranked = cut(ranked.withColumn("in_up", F.row_number().over(Window.partitionBy("story", "write_up").orderBy("rank"))).withColumn("tier_at", ordinal(F.col("tier"), TIERS)))
    groups = ranked.groupBy("story", "write_up").agg(F.min("tier_at").alias("tier_at"))
    tier_weight = weight(F.element_at(F.lit(TIERS), F.least(F.col("tier_at") + 1, F.lit(len(TIERS)))), TIER_WEIGHT, 0.0)
    per_story = groups.groupBy("story").agg(F.count("*").alias("groups"), F.sum(tier_weight).alias("weight"), F.sum((F.col("tier_at") <= 1).cast("int")).alias("corroboration"), F.min("tier_at").alias("top"))
    # consensus: the best member of each write-up stands for it
    heads = ranked.where("in_up = 1").join(per_story.select("story", "groups", "top"), "story")
    spoken = heads.where("groups >= 3").withColumn("toks", tokens(F.col("title_norm")))
    tok = spoken.select("story", "id", "groups", F.size("toks").alias("n"), F.explode("toks").alias("token"))
    df = tok.groupBy("story", "token").agg(F.count("*").alias("df"))
    agreement = tok.join(df, ["story", "token"]).groupBy("story", "id").agg(F.sum((F.col("df") - 1) / (F.col("groups") - 1) / F.col("n")).alias("agreement"))
    tagged = F.col("title").rlike(LABELLED)
    speaks = ~ugly(F.col("title")) & ~tagged & ~F.arrays_overlap("flags", F.lit(["roundup", "notice"]))
    usable = (F.col("tier_at") == F.col("top")) & ~F.col("url_opaque") & (F.size("toks") >= 4) & speaks
    pick = spoken.join(agreement, ["story", "id"], "left").select("story", "id", "rank", F.coalesce(usable, F.lit(False)).alias("usable"), F.round(F.coalesce("agreement", F.lit(0.0)), 9).alias("agreement"))
    headline = pick.groupBy("story").agg(F.min_by("rank", F.struct((~F.col("usable")).cast("int").alias("u"), (-F.col("agreement")).alias("a"), "rank")).alias("headline"))
    named = ranked.withColumn("pk", publisher_key(F.col("publisher")))
    shown = named.groupBy("story", "pk").agg(F.min("rank").alias("first"), F.min_by("publisher", F.struct(looks_like_domain(F.col("publisher")).cast("int").alias("d"), "rank")).alias("name"))
    publishers = shown.groupBy("story").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "name"))), lambda x: x["name"]).alias("publishers"))
    flags = majority(ranked.select("story", F.explode("flags").alias("flag")), ranked)
    r = F.col("rank")
    known = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), r)).alias(c)
    with_head = ranked.join(headline, "story", "left").withColumn("headline", F.coalesce("headline", F.lit(1)))
    body = with_head.groupBy("story").agg(
        F.min_by("id", F.struct("published_at", "id")).alias("seed"),
        F.max(F.when(r == F.col("headline"), F.col("title"))).alias("title"),
        F.coalesce(F.max(F.when((r == F.col("headline")) & ~F.col("url_opaque"), F.col("id"))), F.min_by("id", F.when(~F.col("url_opaque"), r)), F.min_by("id", r)).alias("primary_id"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("items"),
        F.array_intersect(F.lit(TOPICS), F.array_distinct(F.flatten(F.collect_set("topics")))).alias("topics"),
        F.min("published_at").alias("first_published"), F.max("published_at").alias("latest_published"), known("snippet"), known("image"),
    )
    full = body.join(per_story, "story").join(publishers, "story").join(flags, "story", "left").withColumn("flags", F.coalesce("flags", F.array().cast("array<string>")))
    return full.select(
        F.col("seed").alias("id"), "title", "primary_id", "items", "publishers", F.element_at(F.lit(TIERS), F.least(F.col("top") + 1, F.lit(len(TIERS)))).alias("tier"), F.col("corroboration").cast("int").alias("corroboration"),
        "topics", "flags", "first_published", "latest_published", "snippet", "image", score(F.col("weight"), F.col("groups"), F.col("latest_published"), F.col("flags"), now).alias("score"),
    )


def build_stories(items: DataFrame, now: Column, threshold: float = 0.3, window_hours: int = 72, span_hours: int = SPAN_HOURS) -> DataFrame:
    """Stories over merged items (one row for each id): pairs, guarded components, roll-up."""
    base = cut(items.where("id is not null and title_norm is not null and published_at is not null"))
    pairs = cut(similar_pairs(base, threshold, window_hours))
    return roll_up(base, cut(guarded_components(base, pairs, span_hours)), now)
