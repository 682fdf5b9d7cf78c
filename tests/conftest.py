"""One small Spark session for all tests, with its checkpoint folder in pytest's own temporary folder."""

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    base = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.driver.memory", "3g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", str(base / "local"))
        .config("spark.sql.warehouse.dir", str(base / "warehouse"))
        .config("spark.checkpoint.dir", f"file://{base}/shared")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 6)
    return v


def rows(found, columns):
    """Rows as sorted tuples of plain values."""
    return sorted((tuple(_plain(v) for v in r) for r in found), key=repr)


@pytest.fixture(scope="session")
def same_as_sql(spark, duck):
    """Compares a query's result with that of its SQL."""

    def check(df, sql):
        own = df.toDF(*df.columns)
        columns = sorted(own.columns)
        other = duck.sql(sql)
        assert columns == sorted(other.columns)
        mine = rows([tuple(r) for r in own.select(*[f"`{c}`" for c in columns]).collect()], columns)
        theirs = rows(other.project(", ".join(f'"{c}"' for c in columns)).fetchall(), columns)
        assert mine == theirs

    return check
