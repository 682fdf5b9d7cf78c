"""Conditional compilation of sources made of the customers' numbers, and the same in SQL by recursion over lines.

The SQL knows what each line does from the numbers that chose it, and parses no text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.prepro import preprocessed
from tessera.staging import dealt

#: What a line may be; {s} stands for a name, {n} for a number.
LINES = ["#define {s} {n}", "#ifdef {s}", "  # ifndef {s}", "#if {s}", "#if !{s}", "#elif {s}", "#else", "#endif", "x = {n}; /* {s} */", "#undef {s}", "#endif", "y({s});", "#if ( {s} )", "#define {s}", "#endif", "z[{n}] = {s};"]
#: Lines of a source, and names.
LENGTH, NAMES = 24, 4


def prepro_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, text)."""
    seed = F.col("c_custkey") * 7919 + F.floor("c_acctbal").cast("long") % 1000 + 5000
    lines = F.array(*[F.lit(x) for x in LINES])

    def one(i):
        h = F.pmod((seed + i * 104729) * (seed % 97 + i * 31 + 11), F.lit(1_000_003))
        line = F.get(lines, (h % len(LINES)).cast("int"))
        return F.replace(F.replace(line, F.lit("{s}"), F.concat(F.lit("S"), (F.floor(h / 16) % NAMES).cast("string"))), F.lit("{n}"), (F.floor(h / 64) % 3).cast("string"))

    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(LENGTH - 1)), lambda i: one(i.cast("long"))), "\n")
    return dealt(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_acctbal")).select("c_custkey", text.alias("text"))


def q45_preprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the conditions of made sources leave, and how many lines they exclude."""
    return prepro_sources(spark, sf_dir).select("c_custkey", preprocessed(F.col("text")).alias("p")).select("c_custkey", "p.prepro", "p.removed")


_DOES = "['define', 'ifdef', 'ifndef', 'if', 'ifnot', 'elif', 'else', 'endif', 'code', 'undef', 'endif', 'code', 'if', 'set', 'endif', 'code']"
_SAYS = "[" + ", ".join("'" + x + "'" if "#" not in x else "''" for x in LINES) + "]"
Q45 = f"""
WITH RECURSIVE s AS (SELECT c_custkey, c_custkey * 7919 + floor(c_acctbal)::BIGINT % 1000 + 5000 AS seed FROM customer),
l AS (
  SELECT c_custkey, i + 1 AS i, ({_DOES})[h % 16 + 1] AS does, h // 16 % {NAMES} + 1 AS k, (h // 64 % 3)::INT AS n, replace(replace(({_SAYS})[h % 16 + 1], '{{s}}', 'S' || (h // 16 % {NAMES})), '{{n}}', (h // 64 % 3)::VARCHAR) AS says
  FROM (SELECT c_custkey, i, ((seed + i * 104729) * (seed % 97 + i * 31 + 11)) % 1000003 AS h FROM s, range(0, {LENGTH}) r(i))
),
-- st: a letter for each open condition (T taken, O open, X over), ty: what opened it (r, i, e); d: for each name 1 true, 0 false, -1 undefined
w AS (
  SELECT c_custkey, 0 AS i, 'T' AS st, 'r' AS ty, [NULL, NULL, NULL, NULL]::INT[] AS d, '' AS says, false AS code, false AS bad FROM s
  UNION ALL
  SELECT c_custkey, i, CASE
      WHEN does IN ('ifdef', 'ifndef', 'if', 'ifnot') THEN st || CASE WHEN top <> 'T' THEN 'X' WHEN yes THEN 'T' ELSE 'O' END
      WHEN does IN ('elif', 'else') THEN left(st, len(st) - 1) || CASE WHEN top <> 'O' THEN 'X' WHEN does = 'else' OR yes THEN 'T' ELSE 'O' END
      WHEN does = 'endif' AND len(st) > 1 THEN left(st, len(st) - 1) ELSE st END,
    CASE WHEN does IN ('ifdef', 'ifndef', 'if', 'ifnot') THEN ty || 'i' WHEN does = 'else' THEN left(ty, len(ty) - 1) || 'e' WHEN does = 'endif' AND len(ty) > 1 THEN left(ty, len(ty) - 1) ELSE ty END,
    CASE WHEN (top = 'T' AND does NOT IN ('elif', 'else', 'endif', 'code')) OR (top = 'O' AND does = 'elif')
      THEN list_transform([1, 2, 3, 4], lambda x: CASE WHEN x <> k THEN d[x] WHEN does = 'define' THEN n WHEN does = 'set' THEN 1 WHEN does = 'undef' THEN -1 WHEN now IS NULL THEN CASE WHEN does = 'ifndef' THEN -1 ELSE 1 END ELSE now END) ELSE d END,
    says, does = 'code' AND top = 'T', bad OR (does IN ('elif', 'else') AND right(ty, 1) <> 'i')
  FROM (SELECT w.c_custkey, l.i, st, ty, d, l.says, bad, does, k, n, right(st, 1) AS top, d[k] AS now,
      CASE does WHEN 'ifdef' THEN coalesce(d[k], 1) >= 0 WHEN 'ifndef' THEN coalesce(d[k], -1) < 0 WHEN 'ifnot' THEN coalesce(d[k], 1) <= 0 ELSE coalesce(d[k], 1) > 0 END AS yes
    FROM w JOIN l ON l.c_custkey = w.c_custkey AND l.i = w.i + 1)
)
SELECT c_custkey, CASE WHEN NOT bool_or(bad) THEN string_agg(CASE WHEN code THEN says ELSE '' END, chr(10) ORDER BY i) END AS prepro,
  CASE WHEN bool_or(bad) THEN 0 ELSE count(*) FILTER (says <> '' AND NOT code) END AS removed
FROM w WHERE i > 0 GROUP BY c_custkey
"""


def queries() -> dict:
    return {"q45_preprocessed": q45_preprocessed}


def oracle_sql() -> dict:
    return {"q45_preprocessed": Q45}
