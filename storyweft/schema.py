"""Schemas of the stored tables and the orders that their enumerations carry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Enumerations in their order; a tier's first is its best, a topic's place is its display order.
TOPICS = ["ufo", "ghosts", "cryptids", "fortean", "temporal", "archaeology", "exoarchaeology", "ooparts", "science"]
TIERS = ["official", "press", "genre", "unverified"]
FLAGS = ["entertainment", "attraction", "gathering", "weak-match", "offbeat", "roundup", "notice"]
HIDDEN_FLAGS = ["entertainment", "offbeat", "weak-match", "gathering"]
EDITIONS = ["US", "GB", "AU", "CA", "IE", "NZ", "IN", "ZA"]
PLACE_KINDS = ["landmark", "city", "region", "country"]
TOPIC_LABELS = {t: t.capitalize() for t in TOPICS} | {"ufo": "UFOs", "ooparts": "Out-of-place artefacts"}
TIER_LABELS = {t: t.capitalize() for t in TIERS}
# Weight of a write-up by its best tier, what each flag takes of a score, hours added to an age.
TIER_WEIGHT = {"official": 6.0, "press": 4.0, "genre": 2.0, "unverified": 0.5}
FLAG_PENALTY = {"entertainment": 0.25, "attraction": 0.5, "gathering": 0.3, "weak-match": 0.4, "offbeat": 0.25, "roundup": 0.3, "notice": 0.3}
AGE_OFFSET_HOURS = 6.0

SOURCE = "id STRING, name STRING, kind STRING, url STRING, query STRING, edition STRING, subreddits ARRAY<STRING>, min_score INT, min_self_score INT, flairs ARRAY<STRING>, tier STRING, topics ARRAY<STRING>, auto BOOLEAN, default_topic STRING, enabled BOOLEAN, note STRING"
RAW_ENTRY = "source_id STRING, title STRING, link STRING, published STRING, summary STRING, content STRING, image STRING, source STRUCT<name:STRING,url:STRING>, guid STRING, fetched_at TIMESTAMP"
ITEM = "id STRING, title STRING, title_norm STRING, url STRING, url_opaque BOOLEAN, publisher STRING, publisher_url STRING, tier STRING, topics ARRAY<STRING>, flags ARRAY<STRING>, published_at TIMESTAMP, first_seen_at TIMESTAMP, feed_id STRING, snippet STRING, image STRING"
STORY = "id STRING, title STRING, primary_id STRING, items ARRAY<STRING>, publishers ARRAY<STRING>, tier STRING, corroboration INT, topics ARRAY<STRING>, flags ARRAY<STRING>, first_published TIMESTAMP, latest_published TIMESTAMP, snippet STRING, image STRING, score DOUBLE"
HEALTH = "id STRING, status STRING, consecutive_failures INT, consecutive_empty INT, last_ok_at TIMESTAMP, last_checked_at TIMESTAMP, last_error STRING, last_http_status INT, last_item_count INT, quarantined_at TIMESTAMP, etag STRING, last_modified STRING"
ARTICLE = "id STRING, url STRING, fetched_at TIMESTAMP, title STRING, byline STRING, site_name STRING, excerpt STRING, lang STRING, words INT, image STRUCT<width:INT,height:INT,source:STRING>, content STRING"
ATTEMPT = "id STRING, attempts INT, last_attempt_at TIMESTAMP, next_attempt_at TIMESTAMP, error STRING, final BOOLEAN"
PLACE = "name STRING, lat DOUBLE, lon DOUBLE, kind STRING, admin STRING, country STRING"


def ordinal(value: Column, order: list[str]) -> Column:
    """Place of a value in an enumeration, from 0; the enumeration's length if it isn't in it."""
    place = F.array_position(F.lit(order), value)
    return F.when(value.isNull() | (place == 0), len(order)).otherwise(place - 1).cast("int")


def label(value: Column, of: dict[str, str]) -> Column:
    """What an enumerated value is called; itself if it has no name."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in of.items() for x in kv)), value), value)


def member(value: Column, order: list[str]) -> Column:
    """Whether a value is of an enumeration."""
    return F.coalesce(value.isin(*order), F.lit(False))


def weight(value: Column, of: dict[str, float], default: float) -> Column:
    """A value's number in a small table."""
    out = F.lit(default)
    for k, v in of.items():
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out
