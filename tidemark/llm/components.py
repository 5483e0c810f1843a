"""Connected components of a table of links, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import common as C


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, label) for each end of a link (columns a, b): label is the least id that links reach.

    A round takes the least label of all neighbours, then the label's own label; each round's table
    is written to the shared folder, so lineage stays short.  Only a count goes to the driver."""
    both = C.materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = C.materialise(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels0")
    for k in range(1, rounds + 1):
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("label").alias("far"))
        new = C.materialise(lower.join(jump, "low").select("id", "old", F.least("low", "far").alias("label")), f"labels{k}")
        labels = new.select("id", "label")
        if new.where("old <> label").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
