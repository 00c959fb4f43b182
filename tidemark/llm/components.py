"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import discard, written


def connected(links: DataFrame) -> DataFrame:
    """id and component (smallest id reachable) of every id in links (a, b).

    Each round every node points at its least neighbour. Pointers run in trees but for one pair of nodes in
    each that point at each other, of which the smaller becomes the root; each tree is then contracted to its
    root. Every node joins at least one other, so a round halves the nodes at least, and a tree's depth halves
    with each jump: n nodes need at most log2(n) rounds of log2(n) jumps. Tables are written between steps;
    nothing but whether any are left reaches the driver.
    """
    edges = written(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "edges")
    nodes = edges.select(F.col("a").alias("id")).distinct()
    roots = None
    while edges.limit(1).count():
        trees = _trees(edges)
        known, roots = roots, _followed(roots, trees) if roots is not None else trees
        if known is not None:
            discard(known)
        up = lambda c: trees.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root"))
        apart = edges.join(up("a"), "a").join(up("b"), "b").where("a_root <> b_root")
        after = written(apart.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct(), "edges")
        discard(edges)
        edges = after
        if trees is not roots:
            discard(trees)
    if roots is None:
        return nodes.withColumn("component", F.col("id"))
    least = roots.groupBy("root").agg(F.min("id").alias("component"))
    return written(roots.join(least, "root").select("id", "component"), "labels")


def _trees(edges: DataFrame) -> DataFrame:
    """id and root of every node, the trees being those of pointers at the least neighbour."""
    points = written(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("root")), "points")
    back = points.select(F.col("id").alias("root"), F.col("root").alias("back"))
    mutual = (F.col("back") == F.col("id")) & (F.col("id") < F.col("root"))
    trees = written(points.join(back, "root").select("id", F.when(mutual, F.col("id")).otherwise(F.col("root")).alias("root")), "trees")
    discard(points)
    while True:
        up = trees.select(F.col("id").alias("root"), F.col("root").alias("up"))
        after = written(trees.join(up, "root").select("id", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved")), "trees")
        discard(trees)
        trees = after.select("id", "root")
        if not after.where("moved").limit(1).count():
            return trees


def _followed(roots: DataFrame, trees: DataFrame) -> DataFrame:
    """roots with each root replaced by its own; roots that no tree holds have no links left."""
    up = trees.select(F.col("id").alias("root"), F.col("root").alias("up"))
    return written(roots.join(up, "root", "left").select("id", F.coalesce("up", "root").alias("root")), "roots")
