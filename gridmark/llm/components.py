"""Connected components of a table of links, by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridmark.llm.common import Scratch


def connected_components(links: DataFrame, scratch: Scratch, name: str, files: int | None = None) -> DataFrame:
    """node, label (the least node reachable) for every node in links (a, b); nothing of it goes to the driver but a count.

    Each pass takes the least label among a node and its neighbours, then the label of that label, so that
    long chains need a number of passes that grows with the logarithm of their length. Passes are written.
    """
    both = scratch.put(links.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(links.select(F.col("b").alias("src"), F.col("a").alias("dst"))), f"{name}-edges", files)
    labels = scratch.put(both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("label")).select(F.col("src").alias("node"), "label"), f"{name}-0", files)
    k = 0
    while True:
        k += 1
        near = both.join(labels, F.col("dst") == F.col("node")).groupBy("src").agg(F.min("label").alias("near"))
        least = labels.join(near, F.col("node") == F.col("src")).select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("to"))
        new = scratch.put(least.join(jump, F.col("low") == F.col("at")).select("node", F.least("low", "to").alias("label"), (F.least("low", "to") < F.col("label")).alias("moved")), f"{name}-{k}", files)
        done = new.filter("moved").isEmpty()
        scratch.drop(f"{name}-{k - 1}")
        labels = new.select("node", "label")
        if done:
            scratch.drop(f"{name}-edges")
            return labels
