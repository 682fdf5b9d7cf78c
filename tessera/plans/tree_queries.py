"""Tree operations over nested sources that are made of a part's orders, and the same in SQL by recursion.

A part's source has a line for each of its order lines; how deep it stands and what it opens come from that line's numbers, so
all sources differ. The SQL takes depths and kinds from the numbers, not from a text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import nodes as N
from tessera.operators import trees as Tr

#: What a line of each kind says ({n} is its order's key), by its number modulo their number.
OPENERS = [("class", "class K{n}:"), ("function", "def f{n}(a, b):"), ("if", "if x{n}:"), ("for", "for i in y{n}:"), ("try", "try:"), (None, "z{n} = 1  # if not:"), ("if", "if a or b:  # class C:"), ("function", "async def g(self):")]
KEYS = ["l_partkey", "part"]


def nested_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_partkey, text)."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"), "l_suppkey")
    own = F.lit("")
    for k, (_, says) in enumerate(OPENERS):
        own = F.when((F.col("l_suppkey") + F.col("l_linenumber")) % len(OPENERS) == k, F.replace(F.lit(says), F.lit("{n}"), F.col("l_orderkey").cast("string"))).otherwise(own)
    line = F.concat(F.repeat(F.lit("  "), F.col("q") % 6), own)
    rows = lines.groupBy("l_partkey").agg(F.sort_array(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_suppkey", "q", line.alias("line")))).alias("x"))
    return rows.select("l_partkey", F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("text"))


def made_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.nodes(nested_sources(spark, sf_dir), "Python", "l_partkey")


_KINDS = ", ".join("NULL" if k is None else f"'{k}'" for k, _ in OPENERS)
_NODES = f"""
l AS (SELECT l_partkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity::INT) AS n, l_quantity::INT % 6 AS d, ([{_KINDS}])[(l_suppkey + l_linenumber) % {len(OPENERS)} + 1] AS kind FROM lineitem),
e AS (SELECT a.l_partkey, a.n, any_value(a.d) AS d, any_value(a.kind) AS kind, coalesce(min(b.n) FILTER (b.d <= a.d) - 1, greatest(max(b.n), a.n), a.n) AS last FROM l AS a LEFT JOIN l AS b ON b.l_partkey = a.l_partkey AND b.n > a.n WHERE a.kind IS NOT NULL GROUP BY a.l_partkey, a.n),
t AS (SELECT a.l_partkey, a.n, any_value(a.d) AS d, any_value(a.kind) AS kind, any_value(a.last) AS last, max(b.n) AS parent, count(b.n) AS nesting FROM e AS a LEFT JOIN e AS b ON b.l_partkey = a.l_partkey AND b.n < a.n AND b.last >= a.n GROUP BY a.l_partkey, a.n)"""


def q43_below_not_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ifs and fors below each function, but for those below a class inside it."""
    return Tr.below(made_nodes(spark, sf_dir), KEYS, ["function"], ["if", "for"], stop=["class"]).drop("part")


Q43 = f"""
WITH RECURSIVE {_NODES},
w AS (
  SELECT l_partkey, n AS root, n AS node, kind, false AS blocked FROM t WHERE kind = 'function'
  UNION ALL SELECT t.l_partkey, root, t.n, t.kind, t.kind = 'class' FROM w JOIN t ON t.l_partkey = w.l_partkey AND t.parent = w.node WHERE NOT blocked
)
SELECT l_partkey, root::INT AS root_id, node::INT AS node_id, kind FROM w WHERE node <> root AND kind IN ('if', 'for')
"""


def q43b_first_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outermost functions below each class, and how many nodes of each kind a tree has."""
    own = made_nodes(spark, sf_dir)
    first = Tr.below(own, KEYS, ["class"], ["function"], first_only=True).groupBy("l_partkey").agg(F.count("*").alias("methods"))
    kinds = Tr.kinds_of(own, KEYS).groupBy("l_partkey").agg(F.max(F.when(F.col("kind") == "class", F.array_join("ids", ","))).alias("classes"), F.count("*").alias("kinds"))
    return kinds.join(first, "l_partkey", "left").select("l_partkey", "classes", "kinds", F.coalesce("methods", F.lit(0)).alias("methods"))


Q43B = f"""
WITH RECURSIVE {_NODES},
w AS (
  SELECT l_partkey, n AS root, n AS node, 'class' AS kind FROM t WHERE kind = 'class'
  UNION ALL SELECT t.l_partkey, root, t.n, t.kind FROM w JOIN t ON t.l_partkey = w.l_partkey AND t.parent = w.node WHERE w.node = root OR w.kind <> 'function'
), m AS (SELECT l_partkey, count(*) AS methods FROM w WHERE node <> root AND kind = 'function' GROUP BY l_partkey)
SELECT l_partkey, string_agg(n::VARCHAR, ',' ORDER BY n) FILTER (kind = 'class') AS classes, count(DISTINCT kind) AS kinds, coalesce(any_value(methods), 0) AS methods FROM t LEFT JOIN m USING (l_partkey) GROUP BY l_partkey
"""


def q43c_contains_and_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each node whether a try lies below, and whether a walk sees it that skips what is below classes and ends with the first try inside something."""
    own = Tr.with_contains(made_nodes(spark, sf_dir), KEYS, ["try"], "has_try")
    seen = Tr.visited(own, KEYS, F.col("kind") == "class", (F.col("kind") == "try") & (F.col("nesting") > 0)).select(*KEYS, "node_id", F.lit(True).alias("seen"))
    return own.join(seen, [*KEYS, "node_id"], "left").select("l_partkey", "node_id", "has_try", F.coalesce("seen", F.lit(False)).alias("seen"))


Q43C = f"""
WITH RECURSIVE {_NODES},
u AS (SELECT l_partkey, n, n AS at, parent, false AS cut FROM t UNION ALL SELECT u.l_partkey, u.n, t.n, t.parent, t.kind = 'class' FROM u JOIN t ON t.l_partkey = u.l_partkey AND t.n = u.parent),
h AS (SELECT DISTINCT u.l_partkey, u.at FROM u JOIN t ON t.l_partkey = u.l_partkey AND t.n = u.n WHERE t.kind = 'try' AND u.at <> u.n),
c AS (SELECT l_partkey, n, bool_or(cut) AS cut FROM u GROUP BY ALL),
v AS (SELECT t.*, cut, min(CASE WHEN kind = 'try' AND nesting > 0 AND NOT cut THEN n END) OVER (PARTITION BY l_partkey) AS stop FROM t JOIN c USING (l_partkey, n))
SELECT v.l_partkey, v.n::INT AS node_id, h.at IS NOT NULL AS has_try, NOT cut AND (stop IS NULL OR v.n <= stop) AS seen FROM v LEFT JOIN h ON h.l_partkey = v.l_partkey AND h.at = v.n
"""


def q43d_clones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subtrees of classes as trees of their own."""
    return Tr.clones(made_nodes(spark, sf_dir), KEYS, F.col("kind") == "class").select("l_partkey", "root_id", "node_id", "parent_id", "last_line", "nesting", "kind")


Q43D = f"""
WITH RECURSIVE {_NODES},
w AS (SELECT l_partkey, n AS root, n AS node FROM t WHERE kind = 'class' UNION ALL SELECT t.l_partkey, root, t.n FROM w JOIN t ON t.l_partkey = w.l_partkey AND t.parent = w.node)
SELECT w.l_partkey, root::INT AS root_id, (node - root + 1)::INT AS node_id, CASE WHEN node > root THEN (t.parent - root + 1)::INT END AS parent_id, (t.last - root + 1)::INT AS last_line, (t.nesting - r.nesting)::INT AS nesting, t.kind
FROM w JOIN t ON t.l_partkey = w.l_partkey AND t.n = node JOIN t AS r ON r.l_partkey = w.l_partkey AND r.n = root
"""

_QUERIES = {
    "q43_below_not_below": (q43_below_not_below, Q43),
    "q43b_first_below": (q43b_first_below, Q43B),
    "q43c_contains_and_walk": (q43c_contains_and_walk, Q43C),
    "q43d_clones": (q43d_clones, Q43D),
}


def queries() -> dict:
    return {name: run for name, (run, _) in _QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _QUERIES.items()}
