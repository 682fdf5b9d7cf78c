"""Secrets in literals of sources made of the customers' numbers, and the same in SQL by recursion over literals with a state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.secrets import secrets
from tessera.staging import dealt

#: What a line may be, and what it does to the state: {n} stands for a number.
LINES = [
    ('x{n} = "-----BEGIN RSA PRIVATE KEY-----";', "begin"),
    ('y = "MIIEow{n}IBAAKC";', "body"),
    ('"";', "blank"),
    ('z = "-----END RSA PRIVATE KEY-----";', "end"),
    ('k = "-----BEGIN CERTIFICATE-----\\nMII{n}\\n-----END CERTIFICATE-----";', "whole"),
    ('k = "-----BEGIN PRIVATE KEY-----   -----END PRIVATE KEY-----";', "hollow"),
    ('dbPassword = "p{n}";', "variable"),
    ('c = "server={n};pwd=\'s{n}\'";', "credential"),
    ('"plain {n}";', "body"),
    ('// pwd = "no{n}"', "none"),
    ('user_name = "";', "blank"),
    ('w = "more{n}" + "of it";', "two"),
]
LENGTH = 12


def secret_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, text)."""
    seed = F.col("c_custkey") * 2741 + F.floor("c_acctbal").cast("long") % 1000 + 4000
    lines = F.array(*[F.lit(x) for x, _ in LINES])

    def one(i):
        h = F.pmod((seed + i * 7368787) * (seed % 83 + i * 13 + 5), F.lit(1_000_003))
        return F.replace(F.get(lines, (h % len(LINES)).cast("int")), F.lit("{n}"), (h % 1009).cast("string"))

    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(LENGTH - 1)), lambda i: one(i.cast("long"))), "\n")
    return dealt(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_acctbal")).select("c_custkey", text.alias("text"))


def q49_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many keys, variables and credentials made sources have."""
    return secrets(secret_sources(spark, sf_dir), "Java", "c_custkey").groupBy("c_custkey", "kind").agg(F.count("*").alias("n"), F.min("place").alias("first"))


_DOES = "[" + ", ".join(f"'{d}'" for _, d in LINES) + "]"
Q49 = f"""
WITH RECURSIVE s AS (SELECT c_custkey, c_custkey * 2741 + floor(c_acctbal)::BIGINT % 1000 + 4000 AS seed FROM customer),
h AS (SELECT c_custkey, i, ({_DOES})[((seed + i * 7368787) * (seed % 83 + i * 13 + 5)) % 1000003 % {len(LINES)} + 1] AS does FROM s, range(0, {LENGTH}) r(i)),
l AS (SELECT c_custkey, row_number() OVER (PARTITION BY c_custkey ORDER BY i, j) AS n, CASE does WHEN 'two' THEN 'body' ELSE does END AS does FROM h, range(0, 2) t(j) WHERE does <> 'none' AND (j = 0 OR does = 'two')),
-- state: 0 outside, 1 behind a begin, 2 in a key; begun: the place of the begin
w AS (
  SELECT c_custkey, 0 AS n, 0 AS state, NULL::BIGINT AS begun, NULL::VARCHAR AS kind, NULL::BIGINT AS place FROM s
  UNION ALL
  SELECT w.c_custkey, l.n, CASE WHEN does = 'begin' THEN 1 WHEN does IN ('whole', 'hollow') THEN 0 WHEN state = 0 THEN 0 WHEN does = 'end' THEN 0 WHEN state = 1 AND does = 'blank' THEN 0 ELSE 2 END,
    CASE WHEN does = 'begin' THEN l.n - 1 ELSE w.begun END,
    CASE WHEN does = 'whole' OR (does = 'end' AND state = 2) THEN 'key' WHEN state > 0 OR does = 'begin' THEN NULL WHEN does IN ('variable', 'credential') THEN does END,
    CASE WHEN does = 'end' THEN w.begun ELSE l.n - 1 END
  FROM w JOIN l ON l.c_custkey = w.c_custkey AND l.n = w.n + 1
)
SELECT c_custkey, kind, count(*) AS n, min(place)::INT AS first FROM w WHERE kind IS NOT NULL GROUP BY c_custkey, kind
"""


def queries() -> dict:
    return {"q49_secrets": q49_secrets}


def oracle_sql() -> dict:
    return {"q49_secrets": Q49}
