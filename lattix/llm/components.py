"""Connected components by distributed union-find."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store, tidy

MAX_ROUNDS = 200


@tidy
def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (columns a, b); a component's name is its smallest node.

    Each round hooks every tree to the smallest tree it has an edge to, lets each node point to its
    root, and replaces the edges by those that are left between roots. Trees at least halve in
    number, so rounds grow with the logarithm of the input. Nothing is gathered on the driver.
    Null ends and edges from a node to itself are ignored.
    """
    edges = store(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    ends = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    roots = ends.select("node", F.col("node").alias("component"))
    for _ in range(MAX_ROUNDS):
        if edges.isEmpty():
            return roots
        hooks = store(edges.select(F.col("b").alias("node"), F.col("a").alias("parent")).groupBy("node").agg(F.min("parent").alias("parent")))
        while True:  # path halving: hooks always lead to smaller nodes, so there are no cycles
            up = hooks.alias("h").join(hooks.alias("u"), F.col("h.parent") == F.col("u.node"), "left")
            jumped = store(up.select("h.node", F.coalesce("u.parent", "h.parent").alias("parent"), F.col("u.parent").isNotNull().alias("moved")))
            hooks = jumped.select("node", "parent")
            if jumped.where("moved").isEmpty():
                break
        up = hooks.select(F.col("node").alias("_from"), F.col("parent").alias("_to"))
        roots = store(roots.join(up, roots["component"] == up["_from"], "left").select("node", F.coalesce("_to", "component").alias("component")))
        for end in ("a", "b"):
            edges = edges.join(up, edges[end] == up["_from"], "left").withColumn(end, F.coalesce("_to", end)).select("a", "b")
        edges = store(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    raise RuntimeError("components did not settle")
