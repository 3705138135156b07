"""Connected components of a link table, as DataFrame rounds of minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washline.llm import common as C


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links(a, b)`` -> ``(node, label)``: the smallest node id reachable from each linked node.

    Every round takes the smallest label among a node and its neighbours, then the
    label of that label; labels are written to the shared folder after each round.
    Raises if the rounds do not suffice (they grow with the logarithm of the longest path).
    """
    both = C.store(links.select("a", "b").where("a <> b").distinct(), "links")
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = C.store(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                     .select("node", F.least("node", "m").alias("label")), "labels")
    for _ in range(max_rounds):
        near = (both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"))
                .agg(F.min("label").alias("near")))
        new = labels.join(near, "node", "left").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("to"))
        new = C.store(new.join(jump, "label", "left").select(
            "node", F.coalesce(F.least("label", "to"), "label").alias("label"),
            (F.coalesce(F.least("label", "to"), "label") != F.col("old")).alias("moved")), "labels")
        labels = new.select("node", "label")
        if not new.where("moved").limit(1).collect():
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
