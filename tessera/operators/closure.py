r"""Closures over dependency edges to a fixpoint, and lookups along ancestors.

Each round joins only what the last round found with the edges, keeps what is new, and writes it to the
shared folder, so a lost executor costs a round at most and plans don't grow. Rounds stop when one finds
nothing new; if ``max_rounds`` don't get there that is an error, never a partial result. Joins are on node keys; AQE splits hot ones.

Defined cases: null nodes are not followed; cycles end, as a pair is kept once, at its least depth; repeated
edges and seeds count once; no edges leave the seeds at depth zero.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.staging import shared_path, written

MAX_ROUNDS = 100


def closure(edges: DataFrame, seeds: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(root, node, depth): all nodes reachable from each seed (column ``node``) over ``edges`` (parent, child)."""
    spark = edges.sparkSession
    links = edges.select("parent", "child").where("parent IS NOT NULL AND child IS NOT NULL").distinct()
    start = seeds.select(F.col("node").alias("root"), "node").where("node IS NOT NULL").distinct().withColumn("depth", F.lit(0))
    folder = shared_path(spark, "closure")
    start.write.parquet(f"{folder}/0")
    rounds = lambda first, last: spark.read.schema(start.schema).parquet(*[f"{folder}/{n}" for n in range(first, last + 1)])
    for depth in range(1, max_rounds + 1):  # all earlier rounds are one scan, so the plan stays as it is
        following = rounds(depth - 1, depth - 1).join(links, F.col("node") == F.col("parent")).select("root", F.col("child").alias("node")).distinct()
        following.join(rounds(0, depth - 1), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)).write.parquet(f"{folder}/{depth}")
        if rounds(depth, depth).isEmpty():
            return rounds(0, depth - 1)
    raise RuntimeError(f"the closure goes on past {max_rounds} rounds")


def distinct_dependencies(refs: DataFrame, column: str = "ref") -> DataFrame:
    """Each different reference once."""
    return refs.where(F.col(column).isNotNull()).select(column).distinct()


def scan_until_stable(scan, seeds: DataFrame, max_rounds: int = MAX_ROUNDS) -> tuple[DataFrame, int]:
    """Call ``scan`` (references in, references out) until it finds no new ones; the references, and the rounds it took.

    The set is compared, not its size.
    """
    known = written(distinct_dependencies(seeds), "refs")
    for n in range(1, max_rounds + 1):
        after = written(distinct_dependencies(scan(known).unionByName(known)), "refs")
        if after.join(known, "ref", "left_anti").isEmpty():
            return after, n
        known = after
    raise RuntimeError(f"the scan found new references for {max_rounds} rounds")


def nearest_ancestor_value(wanted: DataFrame, parents: DataFrame, values: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """``wanted`` (node, key) with ``value`` and ``depth``: the value that the nearest ancestor (or the node itself) gives the key.

    ``parents``: (node, parent); ``values``: (node, key, value). Of several values of one node the least counts.
    """
    lines = closure(parents.select(F.col("node").alias("parent"), F.col("parent").alias("child")), wanted.select("node"), max_rounds)
    given = values.groupBy("node", "key").agg(F.min("value").alias("value"))
    near = lines.join(given, "node").groupBy("root", "key").agg(F.min_by(F.struct("depth", "value"), "depth").alias("near"))
    near = near.select(F.col("root").alias("of_node"), F.col("key").alias("of_key"), "near.depth", "near.value")
    return wanted.join(near, (F.col("node") == F.col("of_node")) & (F.col("key") == F.col("of_key")), "left").select("node", "key", "value", "depth")
