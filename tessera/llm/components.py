"""Connected components of an edge table by alternating large-star and small-star steps.

The steps are joins and grouped minima over narrow rows; every step writes its minima and its edges to the shared
folder. A lost executor costs one step at most, and the joins have plain exchanges on both sides, so that the edges of a
node that holds much of a component can be split. The number of rounds grows with the logarithm of the
longest path. Nothing but one count per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import release, staged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = staged(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("of"), F.least("a", "least").alias("least")), "least")
    return both.where("b > a").join(least, F.col("a") == F.col("of")).select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = staged(down.groupBy("a").agg(F.min("b").alias("least")).withColumnRenamed("a", "of"), "least")
    joined = down.join(least, F.col("a") == F.col("of"))
    moved = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).union(joined.select("a", F.col("least").alias("b")))
    return moved.where("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Rows (node, root): each node of ``edges`` (a, b) that isn't a root itself, with the least node it can reach.

    Self-loops and repeated edges are ignored; no edges give no rows.
    """
    now = staged(edges.select("a", "b").where("a <> b").distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).head()
        if state[0] == 0 or state == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = state
        large = staged(_large_star(now), "edges")
        after = staged(_small_star(large), "edges")
        release(large)
        release(now)
        now = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
