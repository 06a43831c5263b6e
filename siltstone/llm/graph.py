"""Connected components of links between long ids, by rounds of hooking and pointer jumping.

Each round hooks every node on its smallest neighbour, jumps to the roots, and contracts the links to roots: links shrink
geometrically, and a star, however large, is done in one round. Every round ends in shared storage, so lineage stays
short and a lost executor repeats one round at most. Nothing is collected but counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b): root is the smallest node of its component."""
    links = common.stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    nodes = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
        parent = common.stored(parent.select("node", F.least("node", "near").alias("root")), "parents")
        while True:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
            higher = common.stored(parent.join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), "parents")
            parent = higher.select("node", "root")
            if higher.where("moved").isEmpty():
                break
        if nodes is None:
            nodes = parent
        else:
            top = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
            nodes = common.stored(nodes.join(top, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "roots")
        a = parent.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = parent.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        links = links.join(a, "a").join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        links = common.stored(links, "links")
    if nodes is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes
