"""Connected components of a table of links, by smallest labels and pointer jumping; nothing comes to the driver but a count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.shared import written


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of the links (a, b): the smallest node that it reaches.

    Each round takes the smallest label among neighbours and then that label's own, so labels travel ever further;
    a round's table is written, which ends its lineage.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("next")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("next")))
    edges = written(both.distinct(), "edges")
    labels = written(edges.groupBy("node").agg(F.min("next").alias("least")).select("node", F.least("node", "least").alias("label")), "labels")
    while True:
        reached = edges.join(labels.select(F.col("node").alias("next"), "label"), "next").groupBy("node").agg(F.min("label").alias("least"))
        lower = labels.join(reached, "node").select("node", "label", F.least("label", "least").alias("least"))
        jump = labels.select(F.col("node").alias("least"), F.col("label").alias("further"))
        new = written(lower.join(jump, "least").select("node", F.least("least", "further").alias("label"), (F.least("least", "further") < F.col("label")).alias("moved")), "labels")
        labels = new.select("node", "label")
        if new.where("moved").isEmpty():
            return labels
