"""Encodings of contents that are made of the customers' numbers, byte by byte, and the same in SQL over lists of bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.files import encoding_of
from tessera.staging import dealt

#: Pieces of a content in hexadecimal, by the kind of content: ASCII, UTF-8, Latin letters with signs of the euro, letters of DOS, double bytes of two kinds, and controls.
PIECES = [
    ["6162630A", "20", "7B7D", "2F2F20646F", "0D0A", "78203D2031"],
    ["C3A9", "61", "E282AC", "F09F9880", "20C3A0", "0A"],
    ["E9", "6361666520", "E0", "80", "A4", "E861"],
    ["82", "6C", "85", "8261", "206120", "E9"],
    ["A4A2", "A4A4", "8EB1", "61", "8FB0A1", "20"],
    ["82A0", "B1", "61", "8341", "E040", "20"],
    ["0001", "61626364", "02", "65666768696A6B6C6D", "1F1E", "20"],
]
#: What may stand before a content.
MARKS = ["", "", "", "", "", "EFBBBF", "FFFE", "FEFF", "", "DD736673", "", ""]
_PICKS = ((1, 0), (3, 5), (7, 2), (5, 11), (11, 3), (13, 1), (17, 4))


def made_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, content)."""
    a, b = F.col("c_custkey"), F.floor("c_acctbal").cast("long") % 1000 + 1000
    kind = F.get(F.array(*[F.array(*[F.lit(x) for x in own]) for own in PIECES]), (a % len(PIECES)).cast("int"))
    picked = [F.get(kind, ((a * m + b * (k + 1) + o) % 6).cast("int")) for k, (m, o) in enumerate(_PICKS)]
    mark = F.get(F.array(*[F.lit(x) for x in MARKS]), (b % len(MARKS)).cast("int"))
    return dealt(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_acctbal")).select("c_custkey", F.unhex(F.concat(mark, *picked)).alias("content"))


def q46_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encodings of made contents, by the usual trials and with Shift_JIS for EUC-JP."""
    content = F.col("content")
    return made_contents(spark, sf_dir).select("c_custkey", encoding_of(content).alias("encoding"), encoding_of(content, ("US-ASCII", "UTF-8", "Shift_JIS")).alias("encoding_by_other_trials"))


_LISTS = "[" + ", ".join("[" + ", ".join(f"'{x}'" for x in own) + "]" for own in PIECES) + "]"
_MARKS = "[" + ", ".join(f"'{x}'" for x in MARKS) + "]"
_HEX = " || ".join(f"({_LISTS})[a % {len(PIECES)} + 1][(a * {m} + b * {k + 1} + {o}) % 6 + 1]" for k, (m, o) in enumerate(_PICKS))


def _fold(step: str) -> str:
    """0 where the bytes can be read: a state before each byte, -1 where they can't."""
    return f"list_reduce(list_prepend(0, b), lambda s, x: CASE WHEN s < 0 THEN -1 {step} ELSE -1 END) = 0"


Q46 = f"""
WITH r AS (SELECT c_custkey, c_custkey AS a, floor(c_acctbal)::BIGINT % 1000 + 1000 AS b FROM customer),
h AS (SELECT c_custkey, ({_MARKS})[b % {len(MARKS)} + 1] || {_HEX} AS h FROM r),
s AS (SELECT c_custkey, h, list_transform(range(1, len(h), 2), lambda i: (instr('0123456789ABCDEF', substr(h, i, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(h, i + 1, 1)) - 1) AS b FROM h),
c AS (SELECT *, list_transform(b, lambda x: (x < 32 AND x NOT IN (9, 10, 11, 12, 13, 27))::INT) AS k FROM s),
n AS (SELECT *, len(list_filter(b, lambda x: x IN (224, 232, 233))) AS latin, len(list_filter(b, lambda x: x IN (130, 133))) AS dos, len(list_filter(b, lambda x: x = 128)) AS win, len(list_filter(b, lambda x: x = 164)) AS euro,
  CASE WHEN h LIKE 'EFBBBF%' THEN 'UTF-8' WHEN h LIKE 'FFFE%' THEN 'UTF-16LE' WHEN h LIKE 'FEFF%' THEN 'UTF-16BE' WHEN h LIKE 'DD736673%' THEN 'UTF-EBCDIC'
    WHEN list_sum(k) > 0.04 * len(b) AND list_max(list_transform(range(1, len(b)), lambda i: k[i] + k[i + 1])) = 2 THEN 'binary' WHEN list_max(b) < 128 THEN 'US-ASCII'
    WHEN {_fold("WHEN s = 0 AND x < 128 THEN 0 WHEN s = 0 AND x BETWEEN 194 AND 223 THEN 1 WHEN s = 0 AND x BETWEEN 224 AND 239 THEN 2 WHEN s = 0 AND x BETWEEN 240 AND 244 THEN 3 WHEN s > 0 AND x BETWEEN 128 AND 191 THEN s - 1")} THEN 'UTF-8' END AS sure,
  {_fold("WHEN s = 0 AND x < 128 THEN 0 WHEN s = 0 AND x = 142 THEN 9 WHEN s = 9 AND x BETWEEN 161 AND 223 THEN 0 WHEN s = 0 AND x = 143 THEN 2 WHEN s = 0 AND x BETWEEN 161 AND 254 THEN 1 WHEN s IN (1, 2) AND x BETWEEN 161 AND 254 THEN s - 1")} AS euc,
  {_fold("WHEN s = 0 AND (x < 128 OR x BETWEEN 161 AND 223) THEN 0 WHEN s = 0 AND (x BETWEEN 129 AND 159 OR x BETWEEN 224 AND 252) THEN 1 WHEN s = 1 AND (x BETWEEN 64 AND 126 OR x BETWEEN 128 AND 252) THEN 0")} AS sjis
  FROM c),
f AS (SELECT *, CASE WHEN latin + dos = 0 THEN 'IBM850' WHEN dos > latin THEN 'IBM850' WHEN win > euro THEN CASE WHEN list_has_any(b, [129, 141, 143, 144, 157]) THEN 'IBM850' ELSE 'windows-1252' END WHEN win + euro > 0 THEN 'ISO-8859-15' ELSE 'ISO-8859-1' END AS guess FROM n)
SELECT c_custkey, coalesce(sure, CASE WHEN euc THEN 'EUC-JP' ELSE guess END) AS encoding, coalesce(sure, CASE WHEN sjis THEN 'Shift_JIS' ELSE guess END) AS encoding_by_other_trials FROM f
"""


def queries() -> dict:
    return {"q46_encodings": q46_encodings}


def oracle_sql() -> dict:
    return {"q46_encodings": Q46}
