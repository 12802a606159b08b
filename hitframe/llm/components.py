"""Connected components of an edge table, by labels that shrink: no edge or label leaves the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitframe.session import written


def components(edges: DataFrame) -> DataFrame:
    """``node, comp`` for all nodes of ``edges`` (a, b): ``comp`` is the smallest node that can be reached.

    Each round takes the smallest label among the neighbours and then the label of that label, so long chains halve; rounds
    are written to the shared folder. A node with very many edges is one row after the partial minimum of each task.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("m"))
        hooked = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        above = labels.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        made = written(hooked.join(above, "comp").select("node", "old", F.least("comp", "further").alias("comp")), "labels")
        labels = made.select("node", "comp")
        if made.where("comp != old").isEmpty():
            return labels
