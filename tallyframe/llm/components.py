"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import staged


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``links``: rows (a, b) of long node ids. Returns (node, root) for every node
    that has a link to another: ``root`` is the smallest node it reaches.

    Each round hangs the larger neighbours of every node on its smallest neighbour,
    then the smaller ones (large star, small star), until every link points at a
    root; that takes about the logarithm of the largest component in rounds. A node
    with very many links costs one row per task in the minimum and is split by AQE in
    the join. Rounds are written to the shared folder, so the lineage stays short.
    """
    links = (links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    links = staged(links, "links")
    for _ in range(rounds):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written first, so that both sides of the join are shuffled tables that AQE can split
        low = staged(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m")),
                     "least")
        large = (both.where("v > u").join(low, F.col("u") == F.col("c"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        large = staged(large, "links")
        low = staged(large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m"), "least")
        small = (large.join(low, F.col("u") == F.col("c"))
                 .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                         F.col("m").alias("v")).distinct())
        links = staged(small, "links")
        # done when no node is both a parent and a child and none has two parents
        roots = links.select(F.col("v").alias("x")).distinct()
        twice = links.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select(F.col("u").alias("x"))
        if twice.union(links.select(F.col("u").alias("x")).join(roots, "x", "left_semi")).isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return (links.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .union(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))


class Forest:
    """Union-find over the rows of one block (numpy positions)."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        """True if the two were apart."""
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True
