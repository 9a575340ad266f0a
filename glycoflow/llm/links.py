"""Connected components of a link table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glycoflow.llm import base


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for all nodes of the links (a, b).

    Every round, a node takes the smallest label next to it, hands it to the node its old label names, and then follows
    the labels one step further, which halves the distances. Labels are a table in the shared folder after each
    round; the driver only learns whether any has changed.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = base.kept_table(both)
    labels = base.kept_table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")))
    for _ in range(rounds):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        taken = labels.join(near, F.col("a") == F.col("node")).select("node", "label", F.least("label", "near").alias("taken"))
        told = taken.groupBy(F.col("label").alias("root")).agg(F.min("taken").alias("told"))
        hooked = taken.join(told, F.col("root") == F.col("node"), "left").select(
            "node", "label", F.least("taken", F.coalesce("told", "taken")).alias("hooked")
        )
        further = hooked.select(F.col("node").alias("next"), F.col("hooked").alias("beyond"))
        jumped = hooked.join(further, F.col("hooked") == F.col("next")).select(
            "node", "label", F.least("hooked", "beyond").alias("new")
        )
        new = base.kept_table(jumped)
        changed = new.where("label <> new").limit(1).count()
        labels = new.select("node", F.col("new").alias("label"))
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError("components did not settle")
