"""Connected components by minimum label and pointer jumping, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (id, component): the smallest id reachable, for every id with a link.

    Each round takes the least label among neighbours and then the label's own label, so paths
    halve; every round is written to the shared folder, which also cuts lineage.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = stored(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("u"), F.min("v")).alias("component")), "labels")
    while True:
        near = both.join(labels, both.v == labels.id).groupBy("u").agg(F.min("component").alias("near"))
        step = labels.join(near, labels.id == near.u).select("id", F.col("component").alias("old"), F.least("component", "near").alias("mid"))
        up = labels.select(F.col("id").alias("up"), F.col("component").alias("top"))
        new = stored(step.join(up, step.mid == up.up).select("id", "old", F.least("mid", "top").alias("component")), "labels")
        labels = new.select("id", "component")
        if new.filter("old <> component").isEmpty():
            return labels
