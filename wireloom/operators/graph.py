"""Connected components over (node, key) star edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage

AT_ONCE = 200_000  # nodes up to which what a round knows of them is broadcast


def _lookup(df: DataFrame, col: str, table: DataFrame, small: bool, how: str = "inner") -> DataFrame:
    """``df`` with the column ``up`` that ``table`` (node, up) holds for the node in ``col``."""
    side = table.select(F.col("node").alias("_node"), "up")
    return df.join(F.broadcast(side) if small else side, F.col(col) == F.col("_node"), how).drop("_node")


def labels_of(links: DataFrame) -> DataFrame:
    """(node, label) of every node of ``links`` (a, b): the smallest node it is linked with over any number of links.

    A round lets every node pick its smallest neighbour, which is a partial minimum, so a hub is no hot task. Picks end in pairs that
    pick each other; the smaller node of such a pair is a root. Pointer jumping takes the others to their root, and only links
    between roots go on. A node with a link meets at least one other, so a round at least halves the nodes, whatever their order.
    """
    turned = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    edges = cut_lineage(links.select("a", "b").unionByName(turned).filter("a <> b").distinct())
    roots = cut_lineage(links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("root", F.col("node")))
    few = roots.count() <= AT_ONCE
    while True:
        picks = cut_lineage(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")))
        n = picks.count()
        if not n:
            break
        small = n <= AT_ONCE
        back = _lookup(picks.withColumnRenamed("up", "pick"), "pick", picks, small)
        tree = cut_lineage(back.select("node", F.when((F.col("up") == F.col("node")) & (F.col("node") < F.col("pick")), F.col("node")).otherwise(F.col("pick")).alias("up")))
        while True:
            step = cut_lineage(_lookup(tree.withColumnRenamed("up", "old"), "old", tree, small).select("node", "up", "old"))
            tree = step.select("node", "up")
            if step.filter("up <> old").isEmpty():
                break
        roots = cut_lineage(_lookup(roots, "root", tree, small, "left").select("node", F.coalesce("up", "root").alias("root")))
        left = _lookup(edges, "a", tree, small).select(F.col("up").alias("a"), "b")
        left = _lookup(left, "b", tree, small).select("a", F.col("up").alias("b"))
        edges = cut_lineage(left.filter("a <> b").distinct())
    least = roots.groupBy(F.col("root").alias("node")).agg(F.min("node").alias("up"))
    return cut_lineage(_lookup(roots, "root", least, few).select("node", F.col("up").alias("label")))


def components(edges: DataFrame, node: str = "node", key: str = "key") -> DataFrame:
    """Smallest node reachable through shared keys, for every node: columns ``node``, ``label``. Pairs of a key are never built.

    The members of a key are linked with its smallest member only, which ties the same nodes together; :func:`labels_of` does the rest.
    """
    e = cut_lineage(edges.select(F.col(node).alias("node"), F.col(key).alias("key")).distinct())
    hubs = e.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("_last")).filter("b <> _last").select("key", "b")
    links = cut_lineage(e.join(hubs, "key").filter("node <> b").select(F.col("node").alias("a"), "b").distinct())
    labels = labels_of(links).withColumnRenamed("node", "_of")
    nodes = e.select("node").distinct()
    return nodes.join(labels, F.col("node") == F.col("_of"), "left").select("node", F.coalesce("label", "node").alias("label"))
