"""Connected components by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsheaf.session import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node that has an edge: the least node of its component. edges: a, b.

    Each round a node takes over the least label among its neighbours and then that label's own label, so the distance
    covered grows with every round; each is a written table.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("comp")))
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        met = labels.join(seen, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        new = stored(met.join(jump, "comp", "left").select("node", "old", F.least("comp", F.coalesce("far", "comp")).alias("comp")))
        labels = new.select("node", "comp")
        if new.filter("comp <> old").isEmpty():
            return labels
