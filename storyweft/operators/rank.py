"""Order of stories, and what is taken from it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyweft.schema import HIDDEN_FLAGS, TOPICS

def by_score(df: DataFrame) -> DataFrame:
    """Best score first, then latest, then id."""
    return df.orderBy(F.desc_nulls_last("score"), F.desc("latest_published"), "id")


def visible(flags: Column) -> Column:
    """Whether a story has none of the flags that hide it."""
    return ~F.coalesce(F.arrays_overlap(flags, F.lit(HIDDEN_FLAGS)), F.lit(False))


def featured(topics: Column) -> Column:
    """Whether a story has a topic besides science."""
    return F.exists(topics, lambda t: t != "science")


def interleave(stories: DataFrame, topic: str = "topic", rank: str = "rank", run: int = 2, pool: int = 36) -> DataFrame:
    """The first ``pool`` stories by rank with ``place``: never more than ``run`` of one topic in a row while another is left.

    Greedy over a list that the pool bounds, so one group is no burden.
    """

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        left = pdf.sort_values(rank).to_dict("records")
        out: list[dict] = []
        while left:
            last = [x[topic] for x in out[-run:]]
            stop = last[0] if len(last) == run and len(set(last)) == 1 else None
            k = next((i for i, x in enumerate(left) if stop is None or x[topic] != stop), 0)
            out.append(left.pop(k))
        return pd.DataFrame(out, columns=pdf.columns).assign(place=range(1, len(out) + 1))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stories.schema)
    top = stories.orderBy(rank).limit(pool)
    return top.groupBy().applyInPandas(order, f"{fields}, place int")


def top_per_topic(stories: DataFrame, k: int = 8) -> DataFrame:
    """Columns ``topic, place`` and the story's: the best ``k`` of each topic."""
    each = stories.withColumn("topic", F.explode("topics"))
    w = Window.partitionBy("topic").orderBy(F.desc_nulls_last("score"), F.desc("latest_published"), "id")
    return each.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def topic_order(topic: Column) -> Column:
    """Display place of a topic."""
    return F.array_position(F.lit(TOPICS), topic)
