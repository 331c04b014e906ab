"""Similar headlines: a blocking join on seldom words with a time window, and weighted Jaccard over the shared words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyweft.functions.text import tokens
from storyweft.session import cut


def token_table(items: DataFrame) -> DataFrame:
    """Columns ``id, pos, token``: content words of each item's headline with their places from 0."""
    return items.select("id", F.posexplode(tokens(F.col("title_norm"))).alias("pos", "token"))


def idf_table(token: DataFrame, n: int) -> DataFrame:
    """Columns ``token, df, idf``: document frequency and ln((n + 1)/(df + 1)) + 1."""
    return token.groupBy("token").agg(F.count("*").alias("df")).withColumn("idf", F.log((F.lit(n) + 1.0) / (F.col("df") + 1.0)) + 1.0)


def similar_pairs(items: DataFrame, threshold: float = 0.3, window_hours: int = 72, least_df: int = 25, df_share: float = 0.02) -> DataFrame:
    """Columns ``a, b, similarity, phase, pos``: pairs of one title, and pairs of similar headlines close in time.

    ``items`` has ``id`` (unique), ``title_norm``, ``published_at``. Pairs of phase 1 share a word with df at most
    max(least_df, ceil(df_share · n)), at least two words, lie within the window and reach the threshold of idf-weighted Jaccard.
    Pairs of phase 0 have equal titles: each title's first item by (published_at, id) with every other, a star, so no group gives
    all its pairs. ``a`` is the earlier in order; ``pos`` the place in ``a`` of the first seldom word that both have.

    Only words of an item's prefix are joined: the most telling ones, up to where what is left weighs less than the threshold's share
    of the whole, so the frequent words of a headline, which would meet the most others, mostly aren't. The time window is an equality on its number and the next one, so a word used daily for years is many small groups.
    Titles are joined once for each distinct title and window, then given back to their items by the star.
    """
    base = items.select("id", "title_norm", "published_at").where("title_norm is not null and published_at is not null")
    base = cut(base.withColumn("order", F.struct("published_at", "id")))
    n = base.count()
    words = cut(token_table(base))
    idf = cut(idf_table(words, n))
    most = max(least_df, -(-int(round(df_share * n * 1e6)) // 1_000_000))
    first = base.groupBy("title_norm").agg(F.min("order").alias("first"))
    zero = base.join(first, "title_norm").where(F.col("order") > F.col("first")).select(F.col("first.id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"), F.lit(0).alias("phase"), F.lit(0).alias("pos"))
    told = F.struct((-F.col("idf")).alias("w"), "token", "pos", (F.col("df") <= most).alias("seldom"))
    vector = words.join(idf, "token").groupBy("id").agg(F.array_sort(F.collect_list(told)).alias("ws"), F.sum("idf").alias("total"))
    as_map = F.map_from_entries(F.transform("ws", lambda x: F.struct(x["token"], F.struct((-x["w"]).alias("idf"), x["pos"].alias("pos"), x["seldom"].alias("seldom")))))
    # a pair whose first shared word, the most telling first, is so far back that what is left can't reach the threshold is none
    rest = lambda i: F.aggregate(F.slice("ws", i + 1, F.size("ws")), F.lit(0.0), lambda acc, x: acc - x["w"])
    prefix = F.filter(F.transform("ws", lambda x, i: F.when(x["seldom"] & (rest(i) >= threshold * F.col("total") - 1e-9), x["token"])), lambda x: x.isNotNull())
    vector = cut(vector.select("id", as_map.alias("v"), "total", prefix.alias("prefix")).join(base.select("id", "published_at", "title_norm"), "id"))
    width = window_hours * 3600
    slot = F.floor(F.unix_seconds("published_at") / width)
    each = vector.select("id", "published_at", F.xxhash64("title_norm").alias("t"), F.explode("prefix").alias("token"))
    left = each.select("token", F.col("id").alias("a"), F.col("published_at").alias("ta"), F.col("t").alias("na"), slot.alias("slot"))
    right = each.select("token", F.col("id").alias("b"), F.col("published_at").alias("tb"), F.col("t").alias("nb"), F.explode(F.array(slot - 1, slot, slot + 1)).alias("slot"))
    close = F.abs(F.unix_seconds("ta") - F.unix_seconds("tb")) <= width
    # words of a slot have at most its items, and AQE cuts those of one that is large
    candidates = left.join(right, ["token", "slot"]).where(close & (F.struct("ta", "a") < F.struct("tb", "b")) & (F.col("na") != F.col("nb"))).select("a", "b").distinct()
    both = candidates.join(vector.select(F.col("id").alias("a"), F.col("v").alias("va"), F.col("total").alias("sa")), "a").join(vector.select(F.col("id").alias("b"), F.col("v").alias("vb"), F.col("total").alias("sb")), "b")
    shared = F.array_intersect(F.map_keys("va"), F.map_keys("vb"))
    weight = F.aggregate(shared, F.lit(0.0), lambda acc, w: acc + F.element_at("va", w)["idf"])
    place = F.array_min(F.transform(F.filter(shared, lambda w: F.element_at("va", w)["seldom"]), lambda w: F.element_at("va", w)["pos"]))
    scored = both.select("a", "b", place.alias("pos"), F.size(shared).alias("k"), weight.alias("w"), (F.col("sa") + F.col("sb")).alias("s"))
    similarity = F.col("w") / (F.col("s") - F.col("w"))
    one = scored.where("k >= 2").select("a", "b", similarity.alias("similarity"), F.lit(1).alias("phase"), "pos").where(F.col("similarity") >= threshold - 1e-12)
    return zero.unionByName(one)
