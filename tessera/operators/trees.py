"""Operations on trees whose nodes carry an interval: their place, and the last place below them.

A table of ``operators.nodes`` has such intervals: a node's lines, ``node_id`` to ``last_line``, hold those of all nodes
below it and of no other. "Below" is then a range condition. Joins on it go by dyadic blocks: an interval
is cut into at most two blocks of each power of two, a place lies in one block of each size, and both meet in an
equi-join on (tree, size, block), so one large tree is dealt by block and no pair is looked at in vain. Sizes go up to that of the
longest interval only. Whether something
lies below a node at all is one window over the tree: the next node of the kind comes before the node's last place.

Defined cases: null kinds are no kind; a node is not below itself; trees are told apart by ``keys`` (several columns may
be given); places that repeat within a tree are not allowed; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sizes of blocks: places are below two to this power.
SIZES = 31


def _blocks_of_interval(first: Column, last: Column, sizes: int = SIZES) -> Column:
    """The dyadic blocks (size, block) that together are the places ``first`` to ``last``, and no more; ``sizes`` is the largest that such an interval holds."""
    a, b = first.cast("long"), last.cast("long")

    def at(size: Column) -> Column:
        low = F.call_function("shiftright", a + F.call_function("shiftleft", F.lit(1).cast("long"), size) - 1, size)
        high = F.call_function("shiftright", b + 1, size) - 1
        some = low <= high
        return F.array(F.when(some & (low % 2 == 1), F.struct(size.alias("size"), low.alias("block"))), F.when(some & (high % 2 == 0), F.struct(size.alias("size"), high.alias("block"))))

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(sizes)), at)), lambda x: x.isNotNull())


def _blocks_of_place(place: Column, sizes: int = SIZES) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(sizes)), lambda s: F.struct(s.alias("size"), F.call_function("shiftright", place.cast("long"), s).alias("block")))


def pairs_below(outer: DataFrame, inner: DataFrame, keys: list[str], place: str = "node_id", last: str = "last_line") -> DataFrame:
    """(keys, outer_id, inner_id): each node of ``inner`` with each node of ``outer`` that it lies below."""
    around = outer.where(F.col(last) > F.col(place))
    longest = around.agg(F.max(F.col(last).cast("long") - F.col(place))).first()[0] or 1
    sizes = longest.bit_length() - 1  # a block of the next size doesn't lie within any interval
    around = around.select(*keys, F.col(place).alias("outer_id"), F.explode(_blocks_of_interval(F.col(place) + 1, F.col(last), sizes)).alias("at"))
    points = inner.select(*keys, F.col(place).alias("inner_id"), F.explode(_blocks_of_place(F.col(place), sizes)).alias("at"))
    flat = lambda df, name: df.select(*keys, name, F.col("at.size").alias("size"), F.col("at.block").alias("block"))
    return flat(around, "outer_id").join(flat(points, "inner_id"), [*keys, "size", "block"]).select(*keys, "outer_id", "inner_id")


def kinds_of(nodes: DataFrame, keys: list[str], place: str = "node_id") -> DataFrame:
    """(keys, kind, ids): the nodes of each kind of a tree, in order."""
    return nodes.where(F.col("kind").isNotNull()).groupBy(*keys, "kind").agg(F.sort_array(F.collect_list(place)).alias("ids"))


def with_contains(nodes: DataFrame, keys: list[str], kinds: list[str], as_column: str, place: str = "node_id", last: str = "last_line") -> DataFrame:
    """``nodes`` with a boolean: whether a node of one of ``kinds`` lies below."""
    behind = Window.partitionBy(*keys).orderBy(place).rowsBetween(1, Window.unboundedFollowing)
    upcoming = F.min(F.when(F.col("kind").isin(*kinds), F.col(place))).over(behind)
    return nodes.withColumn(as_column, F.coalesce(upcoming <= F.col(last), F.lit(False)))


def with_nearest_above(nodes: DataFrame, keys: list[str], holds: Column, as_column: str, place: str = "node_id", last: str = "last_line") -> DataFrame:
    """``nodes`` with the place of the nearest node above of which ``holds`` is true (null without one)."""
    found = pairs_below(nodes.where(holds), nodes, keys, place, last).groupBy(*keys, "inner_id").agg(F.max("outer_id").alias(as_column))
    return nodes.join(found.withColumnRenamed("inner_id", place), [*keys, place], "left")


def below(nodes: DataFrame, keys: list[str], within: list[str], kinds: list[str], stop: list[str] = [], first_only: bool = False, place: str = "node_id", last: str = "last_line") -> DataFrame:  # noqa: B006
    """(keys, root_id, node_id, kind): the nodes of ``kinds`` below each node of kind ``within``.

    Nothing below a node of a ``stop`` kind counts, though the node itself does if it is of ``kinds``; with ``first_only``
    nodes of ``kinds`` stop as well. The node of ``within`` itself never stops.
    """
    kind = F.col("kind")
    stopping = kind.isin(*stop, *(kinds if first_only else []))
    own = with_nearest_above(nodes, keys, stopping, "stopped_by", place, last) if stop or first_only else nodes.withColumn("stopped_by", F.lit(None).cast("int"))
    wanted = own.where(kind.isin(*kinds))
    pairs = pairs_below(nodes.where(kind.isin(*within)), wanted, keys, place, last).withColumnRenamed("inner_id", place)
    found = pairs.join(wanted.select(*keys, place, "kind", "stopped_by"), [*keys, place])
    return found.where(F.coalesce(F.col("stopped_by") <= F.col("outer_id"), F.lit(True))).select(*keys, F.col("outer_id").alias("root_id"), F.col(place).alias("node_id"), "kind")


def subtrees(nodes: DataFrame, keys: list[str], roots: Column, place: str = "node_id", last: str = "last_line") -> DataFrame:
    """The columns of ``nodes`` and root_id: each node of which ``roots`` is true with itself and all nodes below it."""
    pairs = pairs_below(nodes.where(roots), nodes, keys, place, last).select(*keys, F.col("outer_id").alias("root_id"), F.col("inner_id").alias(place))
    every = pairs.unionByName(nodes.where(roots).select(*keys, F.col(place).alias("root_id"), place))
    return nodes.join(every, [*keys, place])


def clones(nodes: DataFrame, keys: list[str], roots: Column) -> DataFrame:
    """Subtrees as trees of their own: (keys, root_id) tells them apart, places begin at 1, and the root has no parent and no nesting."""
    found = subtrees(nodes, keys, roots)
    top = found.where(F.col("node_id") == F.col("root_id")).select(*keys, "root_id", F.col("depth").alias("top_depth"), F.col("nesting").alias("top_nesting"))
    moved = lambda c: (F.col(c) - F.col("root_id") + 1).alias(c)
    parent = F.when(F.col("node_id") > F.col("root_id"), F.col("parent_id") - F.col("root_id") + 1).alias("parent_id")
    rest = [c for c in nodes.columns if c not in {*keys, "node_id", "parent_id", "last_line", "depth", "nesting"}]
    lower = [(F.col(c) - F.col(f"top_{c}")).alias(c) for c in ("depth", "nesting")]
    return found.join(top, [*keys, "root_id"]).select(*keys, "root_id", moved("node_id"), parent, moved("last_line"), *lower, *rest)


def visited(nodes: DataFrame, keys: list[str], skip: Column, stop: Column, place: str = "node_id", last: str = "last_line") -> DataFrame:
    """The nodes that a walk in order sees: it doesn't go below a node of which ``skip`` is true, and ends with the first of which ``stop`` is."""
    marked = nodes.withColumn("skip", F.coalesce(skip, F.lit(False))).withColumn("stop", F.coalesce(stop, F.lit(False)))
    seen = with_nearest_above(marked, keys, F.col("skip"), "skipped_by", place, last).where("skipped_by IS NULL").drop("skipped_by")
    end = F.min(F.when(F.col("stop"), F.col(place))).over(Window.partitionBy(*keys))
    return seen.withColumn("end", end).where("end IS NULL OR {0} <= end".format(f"`{place}`")).drop("end", "skip", "stop")
