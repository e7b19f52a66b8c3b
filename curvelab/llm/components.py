"""Connected components of links held in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvelab.llm.common import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of the links: the smallest node of its component.

    Every round takes the smallest label among neighbours (combined before the shuffle, so
    a hub costs one row per task) and then the label's own label, which halves the length of
    chains.  Labels are written after each round, so lineage stays short and a lost
    executor costs one round.
    """
    both = links.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = written(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "links")
    labels = written(both.groupBy("node").agg(F.min("other").alias("_m")).select("node", F.least("node", "_m").alias("label")), "labels")
    while True:
        known = labels.select(F.col("node").alias("other"), F.col("label").alias("_theirs"))
        near = both.join(known, "other").groupBy("node").agg(F.min("_theirs").alias("_near"))
        low = labels.join(near, "node").select("node", F.col("label").alias("_before"), F.least("label", "_near").alias("_low"))
        jump = labels.select(F.col("node").alias("_low"), F.col("label").alias("_far"))
        after = low.join(jump, "_low", "left").select(
            "node", F.least("_low", "_far").alias("label"), (F.least("_low", "_far") < F.col("_before")).alias("_changed")
        )
        after = written(after, "labels")
        if after.filter("_changed").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")
