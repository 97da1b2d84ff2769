"""Connected components of a distributed edge table.

Labels move by minima over neighbours with pointer jumping: in each round every node takes the
smallest label among itself and its neighbours, then the label of its label. Minima are
aggregations (combined before the shuffle), so a hub with millions of edges costs no task more
than its share; the joins that bring labels to edges may be split on hot keys. Each round is written to the
shared folder, which cuts lineage. The number of rounds grows with the logarithm of the longest
chain; the driver sees one number per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import materialize


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) undirected → (node, root) for every node that has an edge; root: the smallest node reachable."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.where("a <> b").distinct())
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                         .select("node", F.least("node", "m").alias("root")))
    for _ in range(max_rounds):
        # Hook: a node's root learns of the smallest root among the node's neighbours.
        seen = both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("far")), "b").groupBy(
            F.col("a").alias("node")
        ).agg(F.min("far").alias("far"))
        own = labels.join(seen, "node").select("node", "root", F.least("root", "far").alias("best"))
        told = own.groupBy(F.col("root").alias("__at")).agg(F.min("best").alias("__hook"))
        hooked = own.join(told, own["root"] == told["__at"]).select("node", "root", F.least("best", "__hook").alias("next"))
        # Jump: take the label's own label.
        up = hooked.select(F.col("node").alias("__up"), F.col("next").alias("__top"))
        moved = hooked.join(up, hooked["next"] == up["__up"], "left").select(
            "node", F.col("root").alias("was"), F.least("next", F.coalesce("__top", "next")).alias("root")
        )
        moved = materialize(moved)
        labels = moved.select("node", "root")
        if moved.where("was <> root").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
