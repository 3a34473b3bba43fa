"""Connected components of links, by minimum labels with shortcuts; every step is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node in `links` (a, b); root is the smallest node that can be reached.

    Each round a node takes the smallest label among its own and its neighbours', then the label of that label, so
    labels travel over paths of doubling length. Sums over neighbours combine before the shuffle.
    """
    both = stage(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .where("a <> b").distinct(), "links")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(
            F.min("root").alias("_near"))
        taken = labels.join(near, "node", "left").select(
            "node", F.col("root").alias("_old"), F.least("root", F.coalesce("_near", "root")).alias("_via"))
        jump = labels.select(F.col("node").alias("_via"), F.col("root").alias("_far"))
        moved = stage(
            taken.join(jump, "_via", "left")
            .select("node", "_old", F.least("_via", F.coalesce("_far", "_via")).alias("root")), "labels")
        labels = moved.select("node", "root")
        if moved.where("root <> _old").isEmpty():
            return labels


def extended(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The components of earlier links, given as (node, root), and of more `links` (a, b) together.

    Links are taken between whole components first, so only those that join two of them are walked, however many links
    the earlier ones have.
    """
    of = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"_{side}"))
    between = (
        links.join(of("a"), "a", "left").join(of("b"), "b", "left")
        .select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).where("a <> b").distinct()
    )
    top = components(between)
    moved = roots.join(top.select(F.col("node").alias("root"), F.col("root").alias("_top")), "root", "left").select(
        "node", F.coalesce("_top", "root").alias("root"))
    return stage(moved.unionByName(top.join(roots.select("node"), "node", "left_anti")), "labels")
