"""Connected components by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varietas.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of 64-bit nodes to ``(node, label)``: the smallest node reachable.

    Each round takes the smallest label among neighbours (partial
    aggregation), then the label's own label, and is written to the shared
    folder; the rounds end when no label moves.  Edges are never rewritten, so the
    degree of a node stays what the caller made it.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                 .select("node", F.least("node", "m").alias("label")))
    while True:
        near = (both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("n"))
                .agg(F.min("label").alias("m")))
        step = labels.join(near, F.col("node") == F.col("n")).select(
            "node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        step = cut(step)
        own = step.select(F.col("node").alias("p"), F.col("label").alias("up"))
        jump = cut(step.join(own, F.col("label") == F.col("p")).select("node", "old", F.least("label", "up").alias("label")))
        moved = jump.where(F.col("old") != F.col("label")).limit(1).count()
        labels = jump.select("node", "label")
        if not moved:
            return labels
