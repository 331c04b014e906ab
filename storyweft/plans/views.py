"""The catalogue of views over stories, items, articles and sources: lazy DataFrames with names, for code and for SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyweft.functions import text as t
from storyweft.operators import geo, rank, timeseries
from storyweft.operators.cluster import build_stories, member_order, write_ups
from storyweft.operators.health import due
from storyweft.operators.robots import origin_policy  # noqa: F401 (part of the planning surface)
from storyweft.operators.store import merge_first_wins
from storyweft.schema import TIERS, ordinal
from storyweft.session import cut, table
from storyweft.sources.feeds import enabled

# Platforms whose pages have nothing to read: hosts (with all below them), the names they go by, paths.
SKIPPED_HOSTS = [
    "reddit.com", "youtube.com", "youtu.be", "x.com", "twitter.com", "t.co", "facebook.com", "instagram.com", "tiktok.com", "threads.net", "bsky.app", "podcasts.apple.com", "open.spotify.com",
]
SKIPPED_PUBLISHERS = r"(?i)^(?:youtube|youtu\.be|t\.co|x\.com|twitter|x|reddit|r/\S+|facebook|instagram|tiktok|threads|bluesky|spotify|apple podcasts)\z"
SKIPPED_PATHS = r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*[^?#]*/(?:picture-gallery|gallery|galleries|slideshow|photos|video|videos|watch)/"
OPAQUE_ID = r"(?i)^https?://[^/]+/(?:rss/)?(?:articles|read)/[A-Za-z0-9_-]+"
STATUSES = ["quarantined", "failing", "ok", "disabled"]


class Views:
    """Views at a time ``now``; ``stories`` are given, or built from the items by ``cluster.build_stories``."""

    def __init__(self, items: DataFrame, stories: DataFrame, articles: DataFrame, sources: DataFrame, now: Column, window_days: int = 30):
        self.items, self.everything, self.articles, self.sources, self.now, self.window_days = items, stories, articles, sources, now, window_days

    @classmethod
    def load(cls, spark: SparkSession, sf_dir: str, now: str = "2026-10-01 00:00:00") -> Views:
        """Views over the stored tables of a data directory."""
        items = merge_first_wins(table(spark, sf_dir, "item"))
        return cls(items, table(spark, sf_dir, "story"), table(spark, sf_dir, "article"), table(spark, sf_dir, "feed_source"), F.to_timestamp(F.lit(now)))

    @classmethod
    def build(cls, items: DataFrame, articles: DataFrame, sources: DataFrame, now: Column, window_days: int = 30) -> Views:
        """Views over stories built anew from merged items (one row for each id)."""
        return cls(items, cut(build_stories(items, now)), articles, sources, now, window_days)

    def since(self, days: int) -> Column:
        return F.timestamp_micros(F.unix_micros(self.now) - days * 86_400_000_000)

    @cached_property
    def in_window(self) -> DataFrame:
        return self.everything.where(F.col("latest_published") >= self.since(self.window_days))

    @cached_property
    def clusters(self) -> DataFrame:
        """Visible stories of the window."""
        return self.in_window.where(rank.visible(F.col("flags")))

    @cached_property
    def hidden(self) -> DataFrame:
        return self.in_window.where(~rank.visible(F.col("flags")))

    @cached_property
    def featured(self) -> DataFrame:
        return self.clusters.where(rank.featured(F.col("topics")))

    def by_topic(self, topic: str) -> DataFrame:
        return self.clusters.where(F.array_contains("topics", topic))

    @cached_property
    def top(self) -> DataFrame:
        """The front page: the best 36 of the last week, interleaved, the first twelve."""
        week = self.featured.where(F.col("latest_published") >= self.since(7))
        ranked = week.orderBy(F.desc_nulls_last("score"), F.desc("latest_published"), "id").limit(36).select("id", "title", F.coalesce(F.get("topics", F.lit(0)), F.lit("")).alias("topic"), "score", "latest_published")
        ranked = ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("score"), F.desc("latest_published"), "id")))  # over the limit's 36 rows
        return rank.interleave(ranked).where("place <= 12").select("place", "id", "title", "topic", "score")

    @cached_property
    def scholarly(self) -> DataFrame:
        own = self.featured.where((F.col("tier") == "official") & ~F.array_contains("flags", "notice"))
        return own.orderBy(F.desc("latest_published"), F.desc("score"), "id").limit(6)

    @cached_property
    def sections(self) -> DataFrame:
        """Eight stories of each topic, without those of the front page."""
        return rank.top_per_topic(self.clusters.join(self.top.select("id"), "id", "left_anti"))

    @cached_property
    def members(self) -> DataFrame:
        """Columns ``story, pos`` and the item's, for every member that is stored."""
        each = self.everything.select(F.col("id").alias("story"), F.posexplode("items").alias("pos", "id"))
        return each.join(self.items, "id")

    @cached_property
    def archived(self) -> DataFrame:
        """Visible stories of which an article is stored."""
        held = self.everything.select("id", F.explode("items").alias("item")).join(self.articles.select(F.col("id").alias("item")), "item", "left_semi").select("id").distinct()
        return self.everything.where(rank.visible(F.col("flags"))).join(held, "id", "left_semi")

    @cached_property
    def all_clusters(self) -> DataFrame:
        """Visible stories of all time."""
        return self.everything.where(rank.visible(F.col("flags")))

    @cached_property
    def story_pages(self) -> DataFrame:
        """Stories that have a page: visible ones of the window, and archived ones that aren't among them."""
        return self.clusters.select("id", F.lit(False).alias("archived")).unionByName(self.archived.join(self.clusters, "id", "left_anti").select("id", F.lit(True).alias("archived")))

    @cached_property
    def months(self) -> DataFrame:
        return timeseries.months(self.archived, "first_published")

    @cached_property
    def archive(self) -> DataFrame:
        """Columns ``month, place, id, first_published``: archived stories, the latest month and in it the latest story first."""
        own = self.archived.where("first_published is not null").select(F.date_format("first_published", "yyyy-MM").alias("month"), "id", "first_published")
        w = Window.partitionBy("month").orderBy(F.desc("first_published"), "id")
        return own.withColumn("place", F.row_number().over(w)).select("month", "place", "id", "first_published").orderBy(F.desc("month"), "place")

    @cached_property
    def reader(self) -> DataFrame:
        """Of each story the first member, in order, of which an article is stored."""
        held = self.articles.select(F.col("id").alias("item")).distinct()
        each = self.everything.select("id", F.posexplode("items").alias("pos", "item")).join(held, "item")
        return each.groupBy("id").agg(F.min_by("item", "pos").alias("item"))

    @cached_property
    def primary(self) -> DataFrame:
        """Of each story the item that its headline is of: the primary, else the first member that is stored."""
        named = self.everything.select("id", F.col("primary_id").alias("item")).join(self.items.select(F.col("id").alias("item")), "item", "left_semi").select("id", F.col("item").alias("own"))
        first = self.members.groupBy("story").agg(F.min_by("id", "pos").alias("first"))
        return self.everything.select("id").join(named, "id", "left").join(first, F.col("id") == F.col("story"), "left").select("id", F.coalesce("own", "first").alias("item"))

    @cached_property
    def coverage(self) -> DataFrame:
        """Columns ``story, place, write_up, item, members, also, more``: independent write-ups, the best first, and who else carries each.

        Left out are the write-up that holds the primary and those whose best headline is the story's. ``also`` has up to six outlets
        besides that of the best item, by their identity.
        """
        m = cut(self.members)
        ups = write_ups(m)
        each = m.join(ups, ["story", "id"]).withColumn("pk", t.publisher_key(F.col("publisher")))
        each = each.withColumn("rank", F.row_number().over(Window.partitionBy("story").orderBy(*member_order())))
        each = each.withColumn("nth", F.row_number().over(Window.partitionBy("story", "write_up", "pk").orderBy("rank")))
        group = each.groupBy("story", "write_up").agg(
            F.min("rank").alias("best"), F.min_by("id", "rank").alias("item"), F.min_by("title", "rank").alias("head"), F.count("*").alias("members"), F.collect_set("id").alias("ids"),
            F.transform(F.array_sort(F.collect_list(F.when(F.col("nth") == 1, F.struct("rank", "publisher")))), lambda x: x["publisher"]).alias("names"),
        )
        own = self.primary.join(self.everything.select("id", F.col("title").alias("story_title")), "id").select(F.col("id").alias("story"), F.col("item").alias("main"), "story_title")
        others = F.slice("names", 2, F.greatest(F.size("names"), F.lit(1)))
        kept = group.join(own, "story").where(~F.array_contains("ids", F.coalesce("main", F.lit(""))) & ~F.col("head").eqNullSafe(F.col("story_title")))
        placed = kept.withColumn("place", F.row_number().over(Window.partitionBy("story").orderBy("best")))
        return placed.select("story", "place", "write_up", "item", "members", F.slice(others, 1, 6).alias("also"), F.greatest(F.size(others) - 6, F.lit(0)).alias("more"))

    def coverage_shown(self, most: int = 5) -> DataFrame:
        """Columns ``story, shown, hidden``: the items of the first write-ups of each story's coverage, and how many more there are."""
        each = self.coverage.groupBy("story").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= most, F.struct("place", "item")))), lambda x: x["item"]).alias("shown"), F.count("*").alias("n"))
        return each.select("story", "shown", F.greatest(F.col("n") - most, F.lit(0)).alias("hidden"))

    @cached_property
    def snippets(self) -> DataFrame:
        """Of each story its snippet, else its article's excerpt."""
        brief = self.reader.join(self.articles.groupBy(F.col("id").alias("item")).agg(F.max("excerpt").alias("excerpt")), "item").select("id", "excerpt")
        return self.everything.join(brief, "id", "left").select("id", F.coalesce("snippet", "excerpt").alias("snippet"))

    def sightings(self, topic: str, places: DataFrame, implied: list | None = None) -> DataFrame:
        """Located reports of a topic, oldest first by their date; a body's dateline counts where the headline names no place."""
        own = self.all_clusters.where(F.array_contains("topics", topic) & geo.sighting_report(F.col("title"), F.col("flags"))).drop("primary_id")
        main = self.primary.select("id", F.col("item").alias("primary_id")).join(self.items.select(F.col("id").alias("primary_id"), "publisher"), "primary_id", "left")
        body = self.articles.groupBy(F.col("id").alias("primary_id")).agg(F.max_by(F.struct(F.concat_ws(" ", "excerpt", "content").alias("body")), F.struct("fetched_at"))["body"].alias("body"))
        full = own.join(main, "id", "left").join(body, "primary_id", "left")
        found = geo.locate(full, places, "id", "title", "body", implied)
        named = F.coalesce("publisher", F.get("publishers", F.lit(0)), F.lit(""))
        return full.join(found.withColumnRenamed("kind", "precision"), "id").select(
            "id", "title", F.col("first_published").alias("date"), F.col("name").alias("place"), "admin", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"), "precision", "provenance", named.alias("publisher"), "tier",
            F.size("publishers").alias("outlets"), "topics",
        ).orderBy("date", "id")

    def timeline(self, topic: str, placed: DataFrame | None = None) -> DataFrame:
        """Stories of a topic by day without gaps, and how many are placed."""
        own = self.everything.where(rank.visible(F.col("flags")) & F.array_contains("topics", topic))
        if placed is None:
            return timeseries.daily(own, "first_published")
        marked = own.join(placed.select("id").distinct().withColumn("__placed", F.lit(True)), "id", "left")
        return timeseries.daily(marked, "first_published", F.coalesce("__placed", F.lit(False)))

    def status_board(self, health: DataFrame) -> DataFrame:
        """Sources with their state, worst first."""
        joined = self.sources.join(health.select("id", "status", "consecutive_failures", "last_ok_at", "last_error"), "id", "left")
        status = F.when(~F.coalesce("enabled", F.lit(True)), "disabled").otherwise(F.coalesce("status", F.lit("ok")))
        board = joined.select("id", "name", "kind", status.alias("status"), F.coalesce("consecutive_failures", F.lit(0)).alias("consecutive_failures"), "last_ok_at", "last_error")
        return board.withColumn("place", ordinal(F.col("status"), STATUSES)).orderBy("place", "name", "id")

    def status_counts(self, health: DataFrame) -> DataFrame:
        """Columns ``status, sources``: how many sources are in each state, those without any included."""
        every = self.sources.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
        return every.join(self.status_board(health).groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("sources"))

    def topic_counts(self) -> DataFrame:
        """Columns ``topic, stories, all_time``: visible stories of the window and of all time, of each topic that has any."""
        mark = self.all_clusters.select(F.explode("topics").alias("topic"), (F.col("latest_published") >= self.since(self.window_days)).alias("recent"))
        return mark.groupBy("topic").agg(F.count_if(F.col("recent")).alias("stories"), F.count("*").alias("all_time"))

    def inspect(self, most: int = 20, members: int = 6) -> DataFrame:
        """The best stories with the titles of their first members, for a look at what was built."""
        top = self.everything.orderBy(F.desc_nulls_last("score"), F.desc("latest_published"), "id").limit(most)
        each = top.select(F.col("id").alias("story"), F.posexplode(F.slice("items", 1, members)).alias("pos", "id")).join(self.items.select("id", F.col("title").alias("head")), "id")
        heads = each.groupBy("story").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "head"))), lambda x: x["head"]).alias("heads"))
        return top.select("id", "title", "tier", "score", F.size("items").alias("members")).join(heads, F.col("id") == F.col("story"), "left").drop("story")

    def job_queue(self, attempts: DataFrame, most: int = 40) -> DataFrame:
        """Of each visible story of the window without an article the first fetchable member that is due; the latest stories first."""
        held = self.articles.select("id").distinct()
        open_ = self.clusters.select(F.col("id").alias("story"), "latest_published", F.posexplode("items").alias("pos", "id"))
        done = open_.join(held, "id", "left_semi").select("story").distinct()
        columns = ["publisher", "title_norm", "url", "url_opaque"]
        member = open_.join(done, "story", "left_anti").join(self.items.select("id", *columns), "id")
        # of a story's members with one outlet and headline the first stands for all
        single = dedupe_members(member)
        host = t.host_of(F.col("url"))
        skipped = F.exists(F.lit(SKIPPED_HOSTS), lambda h: (host == h) | host.endswith(F.concat(F.lit("."), h)))
        plain = t.is_http(F.col("url")) & (host != "") & ~skipped & ~F.col("url").rlike(SKIPPED_PATHS)
        fetchable = ~F.trim("publisher").rlike(SKIPPED_PUBLISHERS) & F.when(F.col("url_opaque"), F.col("url").rlike(OPAQUE_ID)).otherwise(plain)
        first = due(single.where(F.coalesce(fetchable, F.lit(False))), attempts, self.now).groupBy("story").agg(F.max("latest_published").alias("latest_published"), F.min_by(F.struct("id", "url"), "pos").alias("x"))
        return first.select("story", F.col("x.id").alias("id"), t.clean_url(F.col("x.url")).alias("url"), "latest_published").orderBy(F.desc("latest_published"), "story").limit(most)

    @cached_property
    def reader_payload(self) -> DataFrame:
        """Article records with what their items add."""
        extra = self.items.select("id", F.col("publisher"), F.col("published_at"), F.col("url").alias("item_url"))
        latest = self.articles.groupBy("id").agg(F.max_by(F.struct("url", "title", "byline", "site_name", "lang", "words", "content"), "fetched_at").alias("a")).select("id", "a.*")
        return latest.join(extra, "id", "left").select("id", F.coalesce("item_url", "url").alias("url"), "title", "byline", F.coalesce("publisher", "site_name").alias("outlet"), "lang", "published_at", t.reading_minutes(F.col("words")).alias("minutes"), "content")

    @cached_property
    def summary(self) -> DataFrame:
        """One row: stories of the window, visible, of several members, the largest, hidden."""
        v = rank.visible(F.col("flags"))
        n = F.size("items")
        return self.in_window.agg(F.count("*").alias("stories"), F.count_if(v).alias("visible"), F.count_if(v & (n > 1)).alias("several"), F.max(n).alias("largest"), F.count_if(~v).alias("hidden"))

    def register(self, spark: SparkSession) -> None:
        """The views as temporary views, with the SQL functions of ``functions.text``."""
        t.register(spark)
        for name in ("items", "everything", "clusters", "hidden", "featured", "scholarly", "archived", "all_clusters", "story_pages", "months", "reader", "primary", "snippets", "reader_payload", "summary"):
            getattr(self, name).createOrReplaceTempView(f"sw_{name}")
        enabled(self.sources).createOrReplaceTempView("sw_sources")


def dedupe_members(members: DataFrame) -> DataFrame:
    """Of each story's members (``story, pos, publisher, title_norm``) the first of each outlet and headline, combined before the shuffle."""
    columns = members.columns
    best = members.withColumn("pk", t.publisher_key(F.col("publisher"))).groupBy("story", "pk", "title_norm").agg(F.min_by(F.struct(*columns), "pos").alias("x"))
    return best.select("x.*")


def sort_sightings(sightings: DataFrame, by: str = "date", descending: bool | None = None) -> DataFrame:
    """Sightings by ``date``, ``place`` or ``outlets``; unless said otherwise the most outlets first, all else ascending; then by date and id."""
    if by not in ("date", "place", "outlets"):
        raise ValueError(f"no such order: {by}")
    down = by == "outlets" if descending is None else descending
    return sightings.orderBy(F.desc(by) if down else F.asc(by), "date", "id")


def best_tier(tier: Column) -> Column:
    """The best of a group's tiers, as an aggregate."""
    return F.element_at(F.lit(TIERS), F.least(F.min(ordinal(tier, TIERS)) + 1, F.lit(len(TIERS))))
