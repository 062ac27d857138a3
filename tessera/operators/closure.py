"""Reachability over edges, level by level; every node is visited once, so cycles end.

A level is one join of the frontier with the edges and one anti-join with what was visited. Recursive SQL is no way here: Spark's
expands visited nodes again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.claims import truthy
from tessera.plans.lineage import checkpointed


class LimitExceeded(ValueError):
    """A result has more rows than the run may have."""


def closure(seeds: DataFrame, edges: DataFrame, depth: int | None = None, most: int | None = None) -> DataFrame:
    """seeds (node), edges (src, dst) -> (node, level): nodes reachable in up to `depth` steps, seeds at level 0.

    most: raise LimitExceeded beyond so many nodes.
    """
    edges = checkpointed(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    visited = checkpointed(seeds.select("node").distinct().withColumn("level", F.lit(0)))
    frontier, level, total = visited, 0, visited.count()
    while depth is None or level < depth:
        if most is not None and total > most:
            raise LimitExceeded(f"more than {most} nodes")
        level += 1
        step = frontier.join(edges, frontier.node == edges.src).select(F.col("dst").alias("node")).distinct()
        frontier = checkpointed(step.join(visited, "node", "left_anti").withColumn("level", F.lit(level)))
        new = frontier.count()
        if not new:
            break
        total += new
        visited = visited.union(frontier)
    if most is not None and total > most:
        raise LimitExceeded(f"more than {most} nodes")
    return visited


def category_members(seeds: DataFrame, links: DataFrame, depth: int, most_pages: int | None = None, most_categories: int | None = 20_000) -> DataFrame:
    """Pages (page_id) in categories up to `depth` levels below; depth 0 is the categories themselves. links: parent, child, kind, page_id."""
    below = links.where("kind = 'subcat'").select(F.col("parent").alias("src"), F.col("child").alias("dst"))
    reached = closure(seeds, below, depth, most_categories)
    pages = links.where("kind = 'page'").join(reached, F.col("parent") == F.col("node"), "left_semi").select("page_id").distinct()
    if most_pages is not None and pages.limit(most_pages + 1).count() > most_pages:
        raise LimitExceeded(f"more than {most_pages} pages")
    return pages


def reached(groups: list[list[str]], edges: DataFrame) -> DataFrame:
    """(node, groups): nodes that can be reached from the nodes of each of several groups, as a bit mask of the groups' numbers; one walk for all of them.

    A level joins the nodes that new groups have reached with the edges, and merges the masks of all nodes in one aggregation. A node is passed on once for each
    time that its mask grows, so cycles end.
    """
    if len(groups) > 62:
        raise ValueError("62 groups at most")
    spark = edges.sparkSession
    edges = checkpointed(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    seeds: dict[str, int] = {}
    for i, nodes in enumerate(groups):
        for node in nodes:
            seeds[node] = seeds.get(node, 0) | 1 << i
    state = spark.createDataFrame([(n, m, m) for n, m in sorted(seeds.items())], "node string, groups long, fresh long")
    while not state.where("fresh <> 0").isEmpty():
        step = state.where("fresh <> 0").join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.lit(0).cast("long").alias("groups"), F.col("fresh").alias("came"))
        both = state.select("node", "groups", F.lit(0).cast("long").alias("came")).union(step).groupBy("node").agg(F.bit_or("groups").alias("had"), F.bit_or("came").alias("came"))
        state = checkpointed(both.select("node", F.col("had").bitwiseOR(F.col("came")).alias("groups"), F.col("came").bitwiseAND(F.bitwise_not("had")).alias("fresh")))
    return state.select("node", "groups")


def members(items: DataFrame, claims: DataFrame, classes: DataFrame, relation: tuple[str, ...] = ("P31",)) -> DataFrame:
    """items (item) that are, by a relation, in one of classes (node). Only statements of the best rank of their item and property count."""
    typed = claims.where(F.col("property").isin(*relation)).join(items.select("item").distinct(), "item", "left_semi")
    typed = truthy(typed).join(classes.select("node"), F.col("item_value") == F.col("node"), "left_semi")
    return items.join(typed, "item", "left_semi")


def in_classes(items: DataFrame, claims: DataFrame, subclass: DataFrame, classes: list[str], relation: tuple[str, ...] = ("P31",)) -> DataFrame:
    """items (item) that are, by a relation, in one of the classes or a subclass of theirs. claims: item, property, item_value, rank."""
    seeds = items.sparkSession.createDataFrame([(c,) for c in classes], "node string")
    return members(items, claims, closure(seeds, subclass.select(F.col("parent").alias("src"), F.col("child").alias("dst"))), relation)
