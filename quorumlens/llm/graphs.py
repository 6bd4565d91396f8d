"""Connected components by label propagation with pointer jumping, in tables of the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """For each end of edges (a, b: long): node and the smallest node reachable, as label.

    Each round takes the smallest label among a node's neighbours, then that label's own label. Rounds grow with
    the logarithm of a component's diameter for most graphs. A node with very many edges costs no single task:
    minima are combined before the shuffle and joins are one row a label on their other side.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"), F.lit(True).alias("changed")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        lower = labels.select("node", "label").join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        stepped = materialize(lower, "stepped")
        onward = stepped.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = stepped.join(onward, "label").select("node", F.col("next").alias("label"), (F.col("next") < F.col("old")).alias("changed"))
        labels = materialize(jumped, "labels")
        if not labels.where("changed").limit(1).count():
            return labels.select("node", "label")
    raise RuntimeError("the components did not settle")
