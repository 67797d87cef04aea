"""Second-order transition counts over sequences and trees, and what they predict."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.scans import lagged

#: Observations below which nothing is pruned.
LEAST = 3


def transitions(events: DataFrame, key: str, order: tuple[str, ...], state: str) -> DataFrame:
    """parent, current, next and cnt: how often next followed parent and current in a key's sequence, however long."""
    each = lagged(events.select(key, *order, state), (key,), order, state, ("current", "parent")).withColumnRenamed(state, "next")
    return each.filter("parent is not null").groupBy("parent", "current", "next").agg(F.count("next").alias("cnt"))


def totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("parent", "current").agg(F.sum("cnt").alias("total"))


def predictions(counts: DataFrame, threshold: float) -> DataFrame:
    """parent, current, next and prob of the transitions that are likely enough, likeliest first."""
    w = Window.partitionBy("parent", "current")
    p = counts.withColumn("prob", F.col("cnt") / F.sum("cnt").over(w))
    return p.filter(F.col("prob") >= threshold).select("parent", "current", "next", "prob").orderBy("parent", "current", F.desc("prob"), "next")


def prunable(counts: DataFrame, descendants: DataFrame, targets: tuple[str, ...], threshold: float, least: int = LEAST) -> DataFrame:
    """parent, current and prune: whether targets are too rare below a node to look for; never with few observations.

    descendants has parent, current, node and cnt.
    """
    found = descendants.filter(F.col("node").isin(*targets)).groupBy("parent", "current").agg(F.sum("cnt").alias("hits"))
    t = totals(counts).join(found, ["parent", "current"], "left")
    return t.select("parent", "current", "total", ((F.col("total") >= least) & (F.coalesce("hits", F.lit(0)) / F.col("total") < threshold)).alias("prune"))


def tree_counts(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """transitions and descendants of trees: nodes has tree, id, parent_id, pos (among siblings) and kind.

    Children and next siblings both count as what follows; a node is among its own descendants.
    """
    up = nodes.select("tree", F.col("id").alias("parent_id"), F.col("kind").alias("parent"))
    own = nodes.join(up, ["tree", "parent_id"], "left").withColumn("parent", F.coalesce("parent", F.lit("")))
    kids = own.select("tree", F.col("id"), F.col("parent").alias("grand"), F.col("kind").alias("mid"))
    child = nodes.join(kids.withColumnRenamed("id", "parent_id"), ["tree", "parent_id"]).select(F.col("grand").alias("parent"), F.col("mid").alias("current"), F.col("kind").alias("next"))
    w = Window.partitionBy("tree", "parent_id").orderBy("pos")
    near = own.withColumn("before", F.lag("kind").over(w)).filter("before is not null").select("parent", F.col("before").alias("current"), F.col("kind").alias("next"))
    trans = child.unionByName(near).groupBy("parent", "current", "next").agg(F.count("next").alias("cnt"))
    desc = own.select("parent", F.col("kind").alias("current"), F.col("kind").alias("node"))
    level = own.select("tree", "id", "parent", F.col("kind").alias("current"))
    below = level
    for _ in range(64):
        below = below.join(nodes.select("tree", F.col("parent_id").alias("id"), F.col("id").alias("child"), F.col("kind").alias("node")), ["tree", "id"])
        if below.limit(1).count() == 0:
            break
        desc = desc.unionByName(below.select("parent", "current", "node"))
        below = below.select("tree", F.col("child").alias("id"), "parent", "current")
    return trans, desc.groupBy("parent", "current", "node").agg(F.count("node").alias("cnt"))
