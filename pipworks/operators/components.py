"""Connected components of links between rows, by minimum-label propagation with pointer jumping.

Each round is three joins and an aggregation with map-side combine; labels are written to the shared folder between
rounds, so the plan stays short and the loss of an executor costs one round. The number of rounds grows with the
logarithm of the longest chain. Links, labels and components stay distributed; the driver sees one count per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipworks.storage import Scratch


def components(spark: SparkSession, links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that occurs in `links`; root is the least node of its component.

    Self-links and repeated links do no harm; links with a null end are ignored; without links the result is empty.
    """
    scratch = Scratch(spark, "components")
    pair = links.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("u"), F.col(b).alias("v"))
    edges = scratch.save(pair.union(pair.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("root"))
    for k in range(1, max_rounds + 1):
        near = edges.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("root").alias("near"))
        step = labels.join(near, "u").select("u", F.least("root", "near").alias("new"), "root")
        for _ in range(2):  # jump along the pointers of the round before
            far = labels.select(F.col("u").alias("new"), F.col("root").alias("far"))
            step = step.join(far, "new", "left").select("u", F.least("new", "far").alias("new"), "root")
        step = scratch.save(step, f"round{k}")
        changed = not step.filter("new < root").isEmpty()
        if k > 1:
            scratch.drop(f"round{k - 1}")
        labels = step.select("u", F.col("new").alias("root"))
        if not changed:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    scratch.drop("edges")
    return labels.select(F.col("u").alias("node"), "root")


def group_pairs(members: DataFrame, group: str, key: str) -> DataFrame:
    """All pairs (key_a < key_b) of rows in the same group. Its size is that of the result asked for; groups of one are dropped before the join."""
    sized = members.groupBy(group).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(group)
    inside = members.join(sized, group)
    left, right = inside.select(group, F.col(key).alias("key_a")), inside.select(group, F.col(key).alias("key_b"))
    return left.join(right, group).filter("key_a < key_b")
