"""Connected components of a graph given as edges, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm.rows import landed


def components(edges: DataFrame) -> DataFrame:
    """(v, c): the smallest vertex ``c`` that each vertex of the edges (a, b) reaches.

    Each round takes the smallest label next door and then the label of the label, so paths shorten by halves. The
    labels are written to the shared folder every round; only the number of changes reaches the driver.
    """
    both = landed(edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = landed(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("c")).withColumnRenamed("a", "v"), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "v"), "v").select("v", "c", F.least("c", "near").alias("low"))
        step = landed(step, "labels")
        above = step.select(F.col("v").alias("low"), F.col("low").alias("lower"))
        moved = landed(step.join(above, "low").select("v", F.col("lower").alias("c"), (F.col("lower") != F.col("c")).alias("changed")), "labels")
        labels = moved.select("v", "c")
        if moved.where("changed").isEmpty():
            return labels
