"""Connected components of a table of edges, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.runtime import cut

ROUNDS = 60


def connected_components(links: DataFrame) -> DataFrame:
    """v and component (the smallest vertex reachable) of every vertex of links (a, b).

    Each round takes the least label among the neighbours and then the label of that label, so chains halve; every
    round is written to the shared folder. Neighbours are grouped with partial minima.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a IS NOT NULL AND b IS NOT NULL").distinct())
    labels = cut(both.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("component")))
    for _ in range(ROUNDS):
        around = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("component").alias("near"))
        lower = labels.join(around, "v").select("v", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        above = labels.select(F.col("v").alias("component"), F.col("component").alias("top"))
        labels = cut(lower.join(above, "component").select("v", "old", F.least("component", "top").alias("component")))
        if labels.where("component <> old").isEmpty():
            return labels.select("v", "component")
        labels = labels.select("v", "component")
    raise RuntimeError("the labels did not settle")
