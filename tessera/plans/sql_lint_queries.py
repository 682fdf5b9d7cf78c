"""Lint rules of SQL queries that are made of the customers' numbers; the SQL counts with the numbers, and parses no text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.sql_clauses import lint
from tessera.staging import dealt

#: What the numbers say: columns, listed tables, joins, ties in where, a query in the columns, in from, in where, whether aliases are left out, and whether all columns are meant.
_FIELDS = {"cols": (1, 14), "lists": (3, 4), "joins": (5, 3), "ties": (7, 3), "sub": (11, 4), "bare": (13, 2), "star": (17, 5), "fn": (19, 2)}


def _numbers() -> dict:
    seed = F.col("c_custkey") * 131 + F.floor("c_acctbal").cast("long") % 1000 + 2000
    return {k: F.pmod(seed * m + F.floor(seed / m), F.lit(n)).cast("int") for k, (m, n) in _FIELDS.items()}


def made_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, text)."""
    n = _numbers()
    key = F.col("c_custkey").cast("string")
    each = lambda count, one: F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), one)).otherwise(F.array().cast("array<string>"))
    column = lambda i: F.when(n["fn"] == 1, F.concat(F.lit("coalesce(a.c"), i.cast("string"), F.lit(", 'x, y', "), key, F.lit(")"))).otherwise(F.concat(F.lit("a.c"), i.cast("string"), F.lit(" as n"), key))
    columns = F.when(n["star"] == 0, F.lit("distinct *")).otherwise(F.concat(F.array_join(each(n["cols"] + 1, column), ", "), F.when(n["sub"] == 1, F.lit(", (select max(x), y from u) as s")).otherwise(F.lit(""))))
    table = lambda i: F.concat(F.lit("\n  t"), i.cast("string"), F.when((n["bare"] == 1) & (i == 2), F.lit("")).when(i % 2 == 0, F.concat(F.lit(" AS a"), i.cast("string"))).otherwise(F.concat(F.lit(" b"), i.cast("string"))))
    listed = F.concat(each(n["lists"] + 1, table), F.when(n["sub"] == 2, F.array(F.lit("(select * from v, w) d"))).otherwise(F.array().cast("array<string>")))
    joined = F.array_join(each(n["joins"], lambda i: F.concat(F.lit("\n  left outer join j"), i.cast("string"), F.lit(" q on q.id = a.id, "))), "")
    joined = F.regexp_replace(joined, ", ", " ")
    tied = F.array_join(F.concat(F.array(F.lit("a.x > 5"), F.lit("b.k = 7")), each(n["ties"], lambda i: F.concat(F.lit("a.id"), i.cast("string"), F.lit(" = b.id"), i.cast("string"))), F.when(n["sub"] == 3, F.array(F.lit("a.z in (select z from y where y.i = a.i and exists ((select 1 from r)))"))).otherwise(F.array().cast("array<string>"))), "\n  and ")
    text = F.concat(F.lit("-- select no, body from x, y\nSELECT "), columns, F.lit("\nFROM "), F.array_join(listed, ", "), joined, F.lit("\nWHERE "), tied, F.lit("\nORDER BY 1, 2;\nselect 1, 2;"))
    return dealt(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_acctbal")).select("c_custkey", text.alias("text"))


def q48_sql_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lint rules of made statements."""
    return lint(made_statements(spark, sf_dir), "c_custkey")


_N = ", ".join(f"(seed * {m} + seed // {m}) % {n} AS {k}" for k, (m, n) in _FIELDS.items())
Q48 = f"""
WITH s AS (SELECT c_custkey, c_custkey * 131 + floor(c_acctbal)::BIGINT % 1000 + 2000 AS seed FROM customer),
n AS (SELECT c_custkey, {_N} FROM s),
m AS (SELECT *, lists + 1 + (sub = 2)::INT AS listed, star > 0 AND sub = 1 AS in_columns FROM n)
SELECT c_custkey,
  2 + CASE WHEN in_columns THEN 1 WHEN sub = 2 THEN 1 WHEN sub = 3 THEN 2 ELSE 0 END AS "Select",
  (listed > 1)::BIGINT + (sub = 2)::BIGINT AS "NotANSI_Joins",
  (listed > 1 AND bare = 1 AND lists >= 1)::BIGINT + (sub = 2)::BIGINT AS "MissingTableAlias",
  CASE WHEN in_columns OR sub = 2 THEN 1 WHEN sub = 3 THEN 2 ELSE 0 END::BIGINT AS "SubQueries",
  CASE WHEN star = 0 THEN 1 ELSE (cols + 1 + in_columns::INT > 9)::BIGINT END + (sub = 2)::BIGINT AS "ComplexQueries",
  (listed + joins > 4)::BIGINT AS "OnToManyTablesQueries",
  ties + CASE WHEN sub = 3 THEN 1 ELSE 0 END AS "JoinsOutsideOn"
FROM m
"""


def queries() -> dict:
    return {"q48_sql_lint": q48_sql_lint}


def oracle_sql() -> dict:
    return {"q48_sql_lint": Q48}
