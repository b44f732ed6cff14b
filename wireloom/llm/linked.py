"""Connected components of confirmed links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .store import stored

LABELS_AT_ONCE = 200_000  # nodes up to which what is known of them is broadcast in each round


def _lookup(df: DataFrame, key: str, table: DataFrame, small: bool, how: str = "inner") -> DataFrame:
    """``df`` with the column ``up`` that ``table`` (node, up) holds for the node in ``key``."""
    side = table.select(F.col("node").alias("_node"), "up")
    return df.join(F.broadcast(side) if small else side, F.col(key) == F.col("_node"), how).drop("_node")


def labels_of(links: DataFrame) -> DataFrame:
    """(node, label) of every node of ``links`` (a, b): the smallest node it is linked with over any number of links.

    A round lets every node pick its smallest neighbour (a partial minimum, so a hub is no hot task). Picks end in pairs that pick each
    other, whose smaller node is the root; pointer jumping takes all others to their root, and only links between roots go on. Every node
    with a link meets at least one other, so a round at least halves the nodes, whatever their order, and the rounds end when no link is left.
    """
    turned = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    both = stored(links.select("a", "b").unionByName(turned), "links")
    roots = stored(both.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node")), "labels")
    few = roots.count() <= LABELS_AT_ONCE
    edges = both.filter("a <> b")
    while True:
        picks = stored(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")), "picks")
        n = picks.count()
        if not n:
            break
        small = n <= LABELS_AT_ONCE
        back = _lookup(picks.withColumnRenamed("up", "pick"), "pick", picks, small)
        tree = stored(back.select("node", F.when((F.col("up") == F.col("node")) & (F.col("node") < F.col("pick")), F.col("node")).otherwise(F.col("pick")).alias("up")), "trees")
        while True:
            step = stored(_lookup(tree.withColumnRenamed("up", "old"), "old", tree, small).select("node", "up", "old"), "trees")
            tree = step.select("node", "up")
            if step.filter("up <> old").isEmpty():
                break
        roots = stored(_lookup(roots, "root", tree, small, "left").select("node", F.coalesce("up", "root").alias("root")), "labels")
        left = _lookup(edges, "a", tree, small).select(F.col("up").alias("a"), "b")
        left = _lookup(left, "b", tree, small).select("a", F.col("up").alias("b"))
        edges = stored(left.filter("a <> b").distinct(), "links")
    least = roots.groupBy(F.col("root").alias("node")).agg(F.min("node").alias("up"))
    return stored(_lookup(roots, "root", least, few).select("node", F.col("up").alias("label")), "labels")
