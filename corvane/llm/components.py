"""Connected components by smallest labels: neighbours' labels, then the label's own label, until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import stored


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, label) for all nodes of ``edges`` (a, b: bigint); the label is the smallest node that links reach.

    Every step joins two stored tables, so that a node with very many links is split by adaptive execution, and reduces
    by an aggregate with map-side combine. A component of diameter d takes about log2(d) rounds.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    both = stored(both.distinct(), f"{folder}/edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), f"{folder}/labels-0")
    before, turn = None, 0
    while True:
        total = labels.agg(F.sum(F.col("label").cast("decimal(38,0)")), F.count(F.lit(1))).first()
        if total[0] is None or total[0] == before:
            return labels
        before, turn = total[0], turn + 1
        heard = both.join(labels.toDF("b", "l"), "b").groupBy(F.col("a").alias("node")).agg(F.min("l").alias("l"))
        heard = stored(heard, f"{folder}/heard-{turn}")
        near = labels.join(heard, "node").select("node", F.least("label", "l").alias("label"))
        near = stored(near, f"{folder}/near-{turn}")
        jumped = near.join(near.toDF("label", "far"), "label").select("node", F.least("label", "far").alias("label"))
        labels = stored(jumped, f"{folder}/labels-{turn}")
