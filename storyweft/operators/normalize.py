"""Raw entries to items: cleaning, gates, labels, dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyweft.functions import text as t
from storyweft.operators.rules import OFF_TOPIC, TOPIC_RULES, Rule, any_of, compute_flags, labels, publisher_in, publisher_tier
from storyweft.schema import TOPICS
from storyweft.sources.feeds import opaque

ITEM_COLUMNS = "id title title_norm url url_opaque publisher publisher_url tier topics flags published_at first_seen_at feed_id snippet image".split()


# What a search feed's entries without a source are published by; the ending of a mirrored video's title.
UNNAMED = "Google News"
JUNK = r"\([A-Za-z0-9_-]{10,12}\)\s*\z"


def published_by(kind: Column, named: Column, source: Column) -> Column:
    """Who published an entry: search and listing feeds say so themselves, all others are their source."""
    own = F.nullif(F.trim(named), F.lit(""))
    return F.when(kind == "google-news", F.coalesce(own, F.lit(UNNAMED))).when(kind == "reddit", F.coalesce(own, source)).otherwise(source)


def usable(head: Column, link: Column, off_topic: list[str] = OFF_TOPIC) -> Column:
    """Whether a headline may be one at all: eight characters, three words or twenty characters, a web link, no junk ending, nothing off topic."""
    gate = (F.length(head) >= 8) & ((t.count_words(head) >= 3) | (F.length(head) >= 20)) & t.is_http(F.trim(link)) & ~head.rlike(JUNK) & ~any_of(head, off_topic)
    return F.coalesce(gate, F.lit(False))


def normalize_entries(
    entries: DataFrame, sources: DataFrame, instants: DataFrame | None, now: Column, tiers: DataFrame | None = None, rules: list[Rule] = TOPIC_RULES,
    entertainment: DataFrame | None = None, entertainment_patterns: tuple[str, ...] = (), tier_rules: tuple[Rule, ...] = (), off_topic: list[str] = OFF_TOPIC,
) -> DataFrame:
    """ITEM rows of raw entries (with ``entry_id``) that pass the gates.

    ``instants`` has ``entry_id, utc_us``; None if the entries have ``utc_us`` themselves. Entries without one, or more than an hour ahead of ``fetched_at``,
    are dated when they were fetched. A headline must be :func:`usable` and needs a topic: by the rules, else the source's own, else its default. One
    that names no beat by the rules gets the weak-match flag, whatever feed it is of. ``entertainment`` has ``publisher_key`` of publishers
    whose items get that flag, as do those that a pattern names. Search and listing entries have their publisher's tier
    (``tiers`` by key, then ``tier_rules``), others their source's.
    """
    own = sources.select(F.col("id").alias("source_id"), "name", "kind", F.col("tier").alias("own_tier"), F.col("topics").alias("own_topics"), "auto", "default_topic")
    e = entries.join(own, "source_id")
    if instants is not None:
        e = e.join(instants.groupBy("entry_id").agg(F.min("utc_us").alias("utc_us")), "entry_id", "left")
    search, told = F.col("kind") == "google-news", F.col("kind").isin("google-news", "reddit")
    e = e.withColumn("publisher", published_by(F.col("kind"), F.col("source.name"), F.col("name"))).withColumn("head", t.headline(F.col("title"), F.col("publisher"), search))
    e = e.withColumn("title_norm", t.normalize_title(F.col("head"))).withColumn("found", labels(F.col("head"), rules))
    auto = F.coalesce("auto", F.lit(False))
    fallback = F.when(auto, F.when(F.col("default_topic").isNotNull(), F.array("default_topic")).otherwise(F.array().cast("array<string>"))).otherwise(F.coalesce("own_topics", F.array().cast("array<string>")))
    e = e.withColumn("topics", F.when(F.size("found") > 0, F.col("found")).otherwise(fallback))
    e = e.where(usable(F.col("head"), F.col("link"), off_topic) & (F.size("topics") > 0) & (F.col("title_norm") != ""))
    at = F.timestamp_micros("utc_us")
    fetched = F.coalesce("fetched_at", now)
    dated = F.when(at.isNull() | (F.unix_micros(at) > F.unix_micros(fetched) + 3_600_000_000), fetched).otherwise(at)
    e = publisher_in(e, "publisher", entertainment, entertainment_patterns, "show")
    e = e.withColumn("published_at", dated).withColumn("first_seen_at", fetched).withColumn("flags", compute_flags(F.col("head"), F.col("show"), F.size("found") == 0))
    if tiers is not None:
        e = publisher_tier(e, "publisher", tiers, list(tier_rules), out="looked_up")
        tier = F.when(told, F.col("looked_up")).otherwise(F.coalesce("own_tier", "looked_up"))
    else:
        tier = F.coalesce("own_tier", F.lit("genre"))
    out = e.select(
        t.item_id(F.col("title_norm"), F.col("publisher")).alias("id"), F.col("head").alias("title"), "title_norm", F.trim("link").alias("url"), opaque(F.col("link")).alias("url_opaque"), "publisher", F.when(told, F.col("source.url")).alias("publisher_url"),
        tier.alias("tier"), F.array_intersect(F.lit(TOPICS), "topics").alias("topics"), "flags", "published_at", "first_seen_at", F.col("source_id").alias("feed_id"),
        t.make_snippet(F.col("content"), F.col("summary"), F.col("head"), F.col("publisher"), search).alias("snippet"), "image",
    )
    return out.select(*ITEM_COLUMNS)


def late(items: DataFrame, known: DataFrame, now: Column, days: int = 45) -> DataFrame:
    """Items without those older than ``days`` whose id isn't known."""
    old = F.col("published_at") < F.timestamp_micros(F.unix_micros(now) - days * 86_400_000_000)
    k = known.select("id").distinct().withColumn("__known", F.lit(True))
    return items.join(k, "id", "left").where(~old | F.coalesce("__known", F.lit(False))).drop("__known")


def refresh(items: DataFrame, sources: DataFrame, rules: list[Rule] = TOPIC_RULES, entertainment: DataFrame | None = None, entertainment_patterns: tuple[str, ...] = ()) -> DataFrame:
    """Stored items with title, topics and flags derived anew from what ingest saw; ids stay. A feed no longer listed counts as a
    search if its id begins with ``gn-``, else as a feed."""
    kinds = sources.select(F.col("id").alias("feed_id"), "kind", F.col("topics").alias("own_topics"))
    e = items.join(kinds, "feed_id", "left")
    kind = F.coalesce("kind", F.when(F.col("feed_id").startswith("gn-"), "google-news").otherwise("rss"))
    e = publisher_in(e, "publisher", entertainment, entertainment_patterns, "show")
    e = e.withColumn("title", t.headline(F.col("title"), F.col("publisher"), kind == "google-news")).withColumn("title_norm", t.normalize_title(F.col("title"))).withColumn("found", labels(F.col("title"), rules))
    e = e.withColumn("topics", F.when(F.size("found") > 0, F.array_intersect(F.lit(TOPICS), "found")).otherwise(F.coalesce("topics", "own_topics")))
    e = e.withColumn("flags", compute_flags(F.col("title"), F.col("show"), F.size("found") == 0))
    return e.select(*ITEM_COLUMNS)
