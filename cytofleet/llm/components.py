"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cytofleet.llm.common import stage


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """(node, root) for every node on an edge; root is the smallest node that can be reached.

    Every round takes the minimum label among the neighbours and then the label of that label; both steps are
    aggregations with map-side minima and equi-joins. Rounds stop when nothing changes; labels only sink, and a
    run that has not settled after ``max_rounds`` raises instead of returning unfinished labels. Hot nodes are
    left to the skew handling of the joins.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    both = stage(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = stage(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select(
        "node", F.least("node", "m").alias("root")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("v"), "root"), "v").groupBy(F.col("u").alias("node")).agg(
            F.min("root").alias("near"))
        low = labels.join(near, "node").select(
            "node", F.col("root").alias("was"), F.least("root", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("root").alias("far"))
        step = stage(low.join(jump, "low").select("node", "was", F.least("low", "far").alias("root")), "labels")
        labels = step.select("node", "root")
        if step.filter("root <> was").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
