"""R scripts made of the customers' numbers, and the packages they load in SQL, by recursion over lines with the variables' values.

The SQL knows what each line does from the numbers that chose it, and parses no text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.r_packages import r_packages
from tessera.staging import dealt

#: What a line may be; {i} and {j} stand for the numbers of variables, {a} and {b} for those of packages.
LINES = [
    "v{i} <- c(\"pk{a}\", 'pk{b}')",
    "v{i} = \"one{a}\"",
    "v{i} <- v{j}",
    "for (w{i} in v{j}) library(w{i}, character.only = TRUE)",
    "lapply(v{j}, require, character.only = TRUE)",
    "library(lit{a})",
    "# library(no{a}); v{i} <- \"no\"",
    "for (x in c(\"in{a}\", 'in{b}')) { require(x) }",
    "suppressWarnings(library(\"quiet{a}\", lib.loc = \"no\"))",
    "library(v{i}, character.only = TRUE)",
    "v{i} <- 5 * f(y)",
    "pacman::p_load(pac{a}, \"man{b}\")",
]
LENGTH = 14


def r_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, path, text)."""
    seed = F.col("c_custkey") * 6007 + F.floor("c_acctbal").cast("long") % 1000 + 3000
    lines = F.array(*[F.lit(x) for x in LINES])

    def one(i):
        h = F.pmod((seed + i * 15485863) * (seed % 89 + i * 17 + 7), F.lit(1_000_003))
        out = F.get(lines, (h % len(LINES)).cast("int"))
        for mark, value in (("{i}", F.floor(h / 12) % 4), ("{j}", F.floor(h / 48) % 4), ("{a}", F.floor(h / 192) % 50), ("{b}", h % 37)):
            out = F.replace(out, F.lit(mark), value.cast("string"))
        return out

    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(LENGTH - 1)), lambda i: one(i.cast("long"))), "\n")
    return dealt(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_acctbal")).select(F.concat(F.lit("/c"), F.col("c_custkey").cast("string"), F.lit(".R")).alias("path"), text.alias("text"))


def q47_r_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages of made scripts."""
    return r_packages(r_sources(spark, sf_dir))


Q47 = f"""
WITH RECURSIVE s AS (SELECT c_custkey, c_custkey * 6007 + floor(c_acctbal)::BIGINT % 1000 + 3000 AS seed FROM customer),
l AS (SELECT c_custkey, n + 1 AS n, h % 12 AS does, h // 12 % 4 + 1 AS i, h // 48 % 4 + 1 AS j, (h // 192 % 50)::VARCHAR AS a, (h % 37)::VARCHAR AS b
  FROM (SELECT c_custkey, n, ((seed + n * 15485863) * (seed % 89 + n * 17 + 7)) % 1000003 AS h FROM s, range(0, {LENGTH}) r(n))),
w AS (
  SELECT c_custkey, 0 AS n, [NULL, NULL, NULL, NULL]::VARCHAR[][] AS v, []::VARCHAR[] AS found FROM s
  UNION ALL
  SELECT w.c_custkey, l.n, list_transform([1, 2, 3, 4], lambda x: CASE WHEN x <> i OR does NOT IN (0, 1, 2) THEN v[x] WHEN does = 0 THEN ['pk' || a, 'pk' || b] WHEN does = 1 THEN ['one' || a] ELSE v[j] END),
    CASE does WHEN 3 THEN coalesce(v[j], []) WHEN 4 THEN coalesce(v[j], []) WHEN 5 THEN ['lit' || a] WHEN 7 THEN ['in' || a, 'in' || b] WHEN 8 THEN ['quiet' || a] WHEN 9 THEN coalesce(v[i], []) WHEN 11 THEN ['pac' || a, 'man' || b] ELSE [] END
  FROM w JOIN l ON l.c_custkey = w.c_custkey AND l.n = w.n + 1
)
SELECT DISTINCT '/c' || c_custkey || '.R' AS path, unnest(found) AS package FROM w
"""


def queries() -> dict:
    return {"q47_r_packages": q47_r_packages}


def oracle_sql() -> dict:
    return {"q47_r_packages": Q47}
