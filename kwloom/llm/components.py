"""Connected components of an edge table, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kwloom.llm.base import stored


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(id, label): the smallest id each vertex of ``edges`` is linked to, directly or not.

    Every round takes the least label among a vertex and its neighbours and then the label of
    that label, so that long chains halve. Labels are written to the shared folder each round;
    only the count of changes comes to the driver. Null ends and loops are left out.
    """
    a, b = F.col(left), F.col(right)
    pairs = edges.where(a.isNotNull() & b.isNotNull() & (a != b))
    both = stored(
        pairs.select(a.alias("id"), b.alias("to")).union(pairs.select(b.alias("id"), a.alias("to"))).distinct()
    )
    labels = stored(both.groupBy("id").agg(F.least(F.min("to"), F.col("id")).alias("label")))
    while True:
        near = (
            both.join(labels.select(F.col("id").alias("to"), "label"), "to")
            .groupBy("id").agg(F.min("label").alias("near"))
        )
        step = labels.join(near, "id").select("id", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        up = labels.select(F.col("id").alias("label"), F.col("label").alias("up"))
        now = stored(
            step.join(up, "label", "left")
            .select("id", F.least("label", F.coalesce("up", "label")).alias("label"), "old")
        )
        changed = now.where("label <> old").limit(1).count()
        labels = now.select("id", "label")
        if not changed:
            return labels
