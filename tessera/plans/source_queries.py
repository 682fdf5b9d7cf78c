"""The sectioned data source, progress events and rules that go on, over the tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.rules import all_matches
from tessera.sources.progress import Progress
from tessera.sources.sectioned import sectioned_source
from tessera.staging import shared_path

#: Sections of a written folder: table and columns.
SECTIONS = {"regions": ("region", ["r_regionkey", "r_name"]), "nations": ("nation", ["n_nationkey", "n_name", "n_regionkey"]), "suppliers": ("supplier", ["s_suppkey", "s_nationkey"])}


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(section, header, values) of all sections."""
    out = None
    for section, (table, columns) in SECTIONS.items():
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        one = rows.select(F.lit(section).alias("section"), F.array(*[F.lit(c) for c in columns]).alias("header"), F.lit(0).cast("long").alias("place"), F.array(*[F.col(c).cast("string") for c in columns]).alias("values"))
        out = one if out is None else out.union(one)
    return out


def q50_sectioned_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three kinds of rows written to sectioned files and read back."""
    spark.dataSource.register(sectioned_source())
    path = shared_path(spark, "sectioned")
    _sections(spark, sf_dir).write.format("sectioned").mode("append").save(path)
    found = spark.read.format("sectioned").load(path)
    return found.select("section", F.array_join("header", ";").alias("header"), F.array_join("values", ";").alias("line"))


Q50 = " UNION ALL ".join(f"SELECT '{section}' AS section, '{';'.join(columns)}' AS header, {' || chr(59) || '.join(f'{c}::VARCHAR' for c in columns)} AS line FROM {table}" for section, (table, columns) in SECTIONS.items())


def q51_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the events of a run of three stages say of their rows."""
    run = Progress(spark)
    docs = run.stage(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "n_chars"), "read", chars=F.sum("n_chars"))
    kept = run.stage(docs.where("n_chars >= 500"), "filtered", languages=F.count_if(F.col("lang") == "en"))
    run.stage(kept.groupBy("source").agg(F.count("*").alias("n")), "counted", most=F.max("n"))
    return run.events().where("kind = 'count'").select("step", "key", "value")


Q51 = """
WITH k AS (SELECT * FROM documents WHERE n_chars >= 500), g AS (SELECT source, count(*) AS n FROM k GROUP BY source)
SELECT 'read' AS step, 'rows' AS key, count(*) AS value FROM documents UNION ALL SELECT 'read', 'chars', coalesce(sum(n_chars), 0)::BIGINT FROM documents
UNION ALL SELECT 'filtered', 'rows', count(*) FROM k UNION ALL SELECT 'filtered', 'languages', count(*) FILTER (lang = 'en') FROM k
UNION ALL SELECT 'counted', 'rows', count(*) FROM g UNION ALL SELECT 'counted', 'most', coalesce(max(n), 0) FROM g
"""

#: Rules in order: name, pattern, whether one goes on where it fits, and what the SQL looks for.
RULES = [
    ("long", r"(?s)\A.{800}", True, "length(text) >= 800"),
    ("address", r"[A-Za-z0-9]@[A-Za-z]", True, "regexp_matches(text, '[A-Za-z0-9]@[A-Za-z]')"),
    ("license", r"(?i)license", False, "contains(lower(text), 'license')"),
    ("number", r"[0-9]{3}", True, "len(regexp_extract_all(text, '[0-9][0-9][0-9]')) > 0"),
    ("marked", r"[#|$]", False, "text <> translate(text, '#|$', '')"),
    ("article", r"\bthe\b", False, "len(list_filter(regexp_split_to_array(text, '[^A-Za-z0-9_\\x80-\\x{10FFFF}]+'), lambda w: w = 'the')) > 0"),
    ("rest", r"", True, "true"),
]


def q52_rules_that_go_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules that fit each document, up to the first that stops."""
    rules = spark.createDataFrame([(i, n, p, g) for i, (n, p, g, _) in enumerate(RULES)], "ordinal int, name string, pattern string, goes_on boolean")
    return all_matches(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), rules, "text").select("doc_id", "ordinal", "name")


_RULES = " UNION ALL ".join(f"SELECT doc_id, {i} AS ordinal, '{n}' AS name, {str(g).lower()} AS goes_on FROM documents WHERE text IS NOT NULL AND {sql}" for i, (n, _, g, sql) in enumerate(RULES))
Q52 = f"""
WITH m AS ({_RULES}), s AS (SELECT *, coalesce(sum((NOT goes_on)::INT) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stops FROM m)
SELECT doc_id, ordinal::INT AS ordinal, name FROM s WHERE stops = 0
"""


def queries() -> dict:
    return {"q50_sectioned_source": q50_sectioned_source, "q51_progress": q51_progress, "q52_rules_that_go_on": q52_rules_that_go_on}


def oracle_sql() -> dict:
    return {"q50_sectioned_source": Q50, "q51_progress": Q51, "q52_rules_that_go_on": Q52}
