"""Connected components by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacegrid.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for all nodes of ``edges`` (a, b): comp is the smallest node that can be reached.

    Every round takes the least label among neighbours, then the label of that label; each round
    is written to the shared folder. Only the count of changed labels comes to the driver.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("comp", "near").alias("comp"), F.col("comp").alias("was"))
        above = lower.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        moved = cut(lower.join(above, "comp").select("node", F.col("top").alias("comp"), (F.col("top") < F.col("was")).alias("moved")))
        labels = moved.select("node", "comp")
        if not moved.where("moved").limit(1).count():
            return labels
