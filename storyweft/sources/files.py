"""Stored files: day shards of items, article records, state files; and what is written: CSV, JSON, feeds, reports."""

from __future__ import annotations

import re
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyweft.functions.text import iso_millis
from storyweft.schema import ARTICLE, ATTEMPT, HEALTH, ITEM


def read_shards(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Items of day shards (``YYYY-MM-DD.json``, an array each); ``since`` reads the files of that day and later only."""
    df = spark.read.schema(ITEM).option("multiLine", True).option("pathGlobFilter", "[0-9][0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9].json").json(path)
    if since:
        df = df.where(F.regexp_extract(F.col("_metadata.file_name"), r"^(\d{4}-\d{2}-\d{2})\.json\z", 1) >= since)
    return df


def read_days(spark: SparkSession, path: str, since: Column | None = None) -> DataFrame:
    """The Parquet store, one folder a day; ``since`` prunes folders."""
    df = spark.read.parquet(path)
    return df if since is None else df.where(F.col("pub_date") >= since)


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Article records, one file for each 16-digit id."""
    return spark.read.schema(ARTICLE).option("multiLine", True).option("pathGlobFilter", "[0-9a-f]" * 16 + ".json").json(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, on whatever file system the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_state(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Health or attempt rows (``kind``) of a folder of JSON lines; no rows where there is no folder."""
    schema = {"health": HEALTH, "attempt": ATTEMPT}[kind]
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def read_conflict(spark: SparkSession, ours: str, theirs: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of day shards that two writers changed, each a folder of shards; a side without its folder has no items."""
    side = lambda path: read_shards(spark, path) if exists(spark, path) else spark.createDataFrame([], ITEM)
    return side(ours), side(theirs)


def _names(schema: str) -> list[str]:
    """Column names of a schema text."""
    return [x.split()[0] for x in re.split(r", (?=[a-z_]+ )", schema)]


def write_state(rows: DataFrame, path: str, kind: str) -> None:
    """Health or attempt rows as JSON lines, keys in the order of the schema, sorted by id over all parts."""
    names = _names({"health": HEALTH, "attempt": ATTEMPT}[kind])
    rows.orderBy("id").select(json_lines_column(rows, names)).write.mode("overwrite").text(path)


def write_articles(articles: DataFrame, path: str) -> None:
    """Article records as JSON lines, keys in the order of the schema, a folder for each first digit of the id, sorted by id within; the latest of each id."""
    names = _names(ARTICLE)
    latest = articles.where("id is not null").groupBy("id").agg(F.max_by(F.struct(*(n for n in names if n != "id")), "fetched_at").alias("x")).select("id", "x.*")
    out = latest.select(F.left("id", F.lit(1)).alias("shard"), "id", json_lines_column(latest, names))
    out.repartition("shard", F.substring("id", 2, 2)).sortWithinPartitions("shard", "id").drop("id").write.mode("overwrite").partitionBy("shard").text(path)


def read_article_lines(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`write_articles` wrote."""
    return spark.read.schema(ARTICLE).json(path).select(*_names(ARTICLE))


def write_images(images: DataFrame, path: str) -> None:
    """Image bytes (``id, data``) by id in Parquet, a folder for each first digit."""
    images.select(F.left("id", F.lit(1)).alias("shard"), "id", "data").repartition("shard", F.substring("id", 2, 2)).sortWithinPartitions("shard", "id").write.mode("overwrite").partitionBy("shard").parquet(path)


def csv_cell(value: Column, number: bool = False) -> Column:
    """A cell by RFC 4180. Text that a spreadsheet would take for a formula gets an apostrophe; numbers don't. Null, NaN and infinite are empty."""
    if number:
        bad = F.isnan(value.cast("double")) | F.abs(value.cast("double")).eqNullSafe(F.lit(float("inf")))
        text = F.when(value.isNull() | F.coalesce(bad, F.lit(False)), "").otherwise(value.cast("string"))
    else:
        plain = F.coalesce(value.cast("string"), F.lit(""))
        text = F.when(plain.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), plain)).otherwise(plain)
    return F.when(text.rlike('["\\n\\r,]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


NUMBERS = {"tinyint", "smallint", "int", "bigint", "float", "double"}


def csv_lines(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Column ``line``: rows as CSV without line ends."""
    columns = columns or df.columns
    kinds = dict(df.dtypes)
    return df.select(F.concat_ws(",", *(csv_cell(F.col(c), kinds[c] in NUMBERS or kinds[c].startswith("decimal")) for c in columns)).alias("line"))


def to_csv(df: DataFrame, columns: list[str] | None = None) -> str:
    """A small table (a download of a page) as one text with header and CRLF; the header is there even without rows."""
    columns = columns or df.columns
    head = ",".join('"' + c.replace('"', '""') + '"' if re.search(r'["\n\r,]', c) else c for c in columns)
    return "".join(f"{x}\r\n" for x in [head, *(r["line"] for r in csv_lines(df, columns).toLocalIterator())])


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """A large table as CSV parts, each line ended by CRLF."""
    csv_lines(df, columns).write.mode("overwrite").option("lineSep", "\r\n").text(path)


def json_lines(df: DataFrame) -> DataFrame:
    """Column ``json``: each row as an object with its columns in order, nulls left out, times in ISO 8601."""
    fixed = [iso_millis(F.col(c)).alias(c) if t.startswith("timestamp") else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*fixed)).alias("json"))


def write_shards(items: DataFrame, path: str) -> None:
    """JSON lines of items, a folder for each day, sorted by id, keys in the order of the schema."""
    names = _names(ITEM)
    dated = items.withColumn("day", F.date_format("published_at", "yyyy-MM-dd")).select("day", "id", json_lines_column(items, names))
    dated.repartition("day").sortWithinPartitions("day", "id").drop("id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").text(path)


def json_lines_column(df: DataFrame, names: list[str]) -> Column:
    kinds = dict(df.dtypes)
    return F.to_json(F.struct(*(iso_millis(F.col(c)).alias(c) if kinds[c].startswith("timestamp") else F.col(c) for c in names))).alias("json")


def feed_items(stories: DataFrame, items: DataFrame, base: str = "") -> DataFrame:
    """Columns ``title, link, guid, published, description`` of the stories' feed; a description is the snippet and who carries it."""
    first = items.select(F.col("id").alias("primary_id"), "url")
    carried = F.when(F.size("publishers") > 1, F.concat(F.lit("Carried by "), F.array_join(F.slice("publishers", 1, 6), ", "))).otherwise(F.concat(F.lit("From "), F.element_at("publishers", 1)))
    return stories.join(first, "primary_id", "left").select(
        "title", F.concat(F.lit(f"{base}/story/"), F.col("id"), F.lit("/")).alias("link"), F.col("id").alias("guid"), F.col("latest_published").alias("published"),
        F.concat_ws(" ", F.col("snippet"), carried).alias("description"), "score",
    )


def first_of_feed(feed: DataFrame, most: int = 50) -> DataFrame:
    """The first ``most`` rows of a feed, best score first: what a feed document holds."""
    return feed.orderBy(F.desc_nulls_last("score"), F.desc("published"), "guid").limit(most)


def rss(feed: DataFrame, title: str, link: str, most: int = 50) -> str:
    """An RSS document of the first ``most`` rows of a feed."""
    rows = first_of_feed(feed, most).withColumn("pub", F.date_format("published", "dd MMM yyyy HH:mm:ss '+0000'")).collect()
    body = "".join(f"<item><title>{escape(r['title'] or '')}</title><link>{escape(r['link'])}</link><guid isPermaLink=\"false\">{escape(r['guid'])}</guid><pubDate>{r['pub']}</pubDate><description>{escape(r['description'] or '')}</description></item>" for r in rows)
    return f'<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>{escape(title)}</title><link>{escape(link)}</link><description>{escape(title)}</description>{body}</channel></rss>'


def quarantine_report(health: DataFrame, sources: DataFrame) -> DataFrame:
    """Columns ``id, line``: quarantined sources with what is known of each."""
    q = health.where("status = 'quarantined'").join(sources.select("id", "name", "kind", "url"), "id", "left")
    line = F.format_string("%s (%s, %s): %d failures in a row, last status %s, %s", F.coalesce("name", "id"), F.coalesce("kind", F.lit("unknown")), F.coalesce("url", F.lit("-")), F.col("consecutive_failures"), F.coalesce(F.col("last_http_status").cast("string"), F.lit("-")), F.coalesce("last_error", F.lit("-")))
    return q.select("id", line.alias("line"))


def sighting_table(sightings: DataFrame, base: str = "") -> DataFrame:
    """The twelve columns of the download of sightings, oldest first."""
    c = F.col
    return sightings.orderBy("date", "id").select(
        iso_millis(c("date")).alias("date"), "place", c("admin").alias("region"), c("lat").alias("latitude"), c("lon").alias("longitude"), "precision", c("provenance").alias("located_by"), "title", "publisher", "tier", "outlets",
        F.concat(F.lit(f"{base}/story/"), c("id"), F.lit("/")).alias("story_url"),
    )


def frequency_table(days: DataFrame) -> DataFrame:
    """The three columns of the download of daily counts."""
    return days.orderBy("date").select(F.date_format("date", "yyyy-MM-dd").alias("date"), F.col("count").alias("reports"), F.col("placed").alias("placed_on_map"))


def thumbnail_size(width: Column, height: Column, most: int = 800, least_w: int = 320, least_h: int = 180) -> Column:
    """Width and height of an image fitted into a square; null for one that is too small."""
    scale = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(width, height))
    return F.when((width >= least_w) & (height >= least_h), F.struct(F.round(width * scale).cast("int").alias("width"), F.round(height * scale).cast("int").alias("height")))


def sitemap(pages: DataFrame, path: str = "path") -> DataFrame:
    """Pages that a sitemap lists: all but readers' copies."""
    return pages.where(~F.col(path).contains("/reader/"))
