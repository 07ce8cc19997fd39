"""The order in which rows that refer to each other are saved."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.sources.staging import settled


def save_levels(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """(node, level) of nodes: a node comes after all that it refers to (``refs``: node, needs; what isn't among the nodes is saved already). A round of
    anti-joins for each level; ValueError where references go in a circle. A null node, and references of or to null, take no part."""
    left = settled(nodes.select("node").where("node IS NOT NULL").distinct(), "unsaved")
    refs = settled(refs.select("node", "needs").distinct().join(left, "node", "left_semi").join(left.withColumnRenamed("node", "needs"), "needs", "left_semi"), "references")
    done, level = [], 0
    while left.head(1):
        ready = settled(left.join(refs.select("node"), "node", "left_anti").withColumn("level", F.lit(level)), "level")
        if not ready.head(1):
            raise ValueError("references go in a circle")
        done.append(ready)
        left = settled(left.join(ready, "node", "left_anti"), "unsaved")
        refs = settled(refs.join(ready.select(F.col("node").alias("needs")), "needs", "left_anti"), "references")
        level += 1
    return functools.reduce(DataFrame.unionByName, done) if done else left.withColumn("level", F.lit(0))
