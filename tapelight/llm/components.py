"""Connected components by label propagation with pointer jumping, DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import table


def components(edges: DataFrame) -> DataFrame:
    """id, component for every id in `edges` (a, b): the smallest id that can be reached. Any number of rounds, until nothing changes.

    Every round takes the least label among the neighbours and then the label's own label, so that paths shrink by
    half; messages are pre-aggregated before they are shuffled. Each round's labels are written to the shared folder.
    """
    both = table(edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct())
    labels = table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).withColumnRenamed("a", "id"))
    while True:
        heard = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("component").alias("heard"))
        nearer = labels.join(heard, labels.id == heard.a).select("id", F.col("component").alias("before"), F.least("component", "heard").alias("near"))
        jump = labels.select(F.col("id").alias("near"), F.col("component").alias("beyond"))
        after = table(nearer.join(jump, "near", "left").select("id", "before", F.least("near", F.coalesce("beyond", "near")).alias("component")))
        labels = after.select("id", "component")
        if after.where("component != before").isEmpty():
            return labels
