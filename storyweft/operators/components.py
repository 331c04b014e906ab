"""Connected components by rounds of least-label exchange with pointer jumping, cut to shared storage each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyweft.session import cut

ROUNDS = 60  # each round at least halves the longest path of labels; 60 rounds are beyond any data


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Columns ``node, component``: every node of an edge with the least node of its component.

    Large-star and small-star rounds: neighbours beyond a node go to its least neighbour, then each node's smaller
    neighbours too. A star centre of a third of all nodes stays pre-aggregated, since only least labels are exchanged
    by map-side combined sums. Null ends are left out, loops and repeated edges change nothing.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    both = cut(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    label = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("component")))
    for _ in range(ROUNDS):
        # least label among the neighbours, for the node and for the label that it had
        near = both.join(label.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("component").alias("m"))
        met = label.join(near, label["node"] == near["u"]).select("node", "component", F.least("component", "m").alias("m"))
        hook = met.groupBy("component").agg(F.min("m").alias("h"))
        moved = met.join(hook, "component").select("node", "component", F.least("m", "h").alias("new"))
        jump = moved.select(F.col("node").alias("new"), F.col("new").alias("up"))
        after = cut(moved.join(jump, "new", "left").select("node", F.col("component").alias("old"), F.least("new", F.coalesce("up", "new")).alias("component")))
        changed = after.where("old != component").limit(1).count()
        label = after.select("node", "component")
        if not changed:
            return label
    raise RuntimeError("components did not settle")
