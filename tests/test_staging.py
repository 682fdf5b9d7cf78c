"""Rows of one large row group are work for all cores."""

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tessera.functions import lexers as L
from tessera.operators import metrics as M
from tessera.plans import code_queries as C
from tessera.plans import r_queries as R
from tessera.staging import MOST_ROWS, dealt


def test_made_sources_are_not_one_task(spark, tmp_path):
    pq.write_table(pa.table({"p_partkey": list(range(5000))}), tmp_path / "part.parquet")
    pq.write_table(pa.table({"c_custkey": list(range(5000)), "c_acctbal": [1.5] * 5000}), tmp_path / "customer.parquet")
    for made in (C.sources(spark, str(tmp_path), "Ruby"), R.r_sources(spark, str(tmp_path))):
        sizes = made.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
        assert sum(sizes) == 5000 and max(sizes) <= 1000


def test_dealt_rows_are_the_same_and_tasks_have_a_bound(spark):
    rows = spark.range(0, 16 * MOST_ROWS + 5, 1, 1).withColumn("x", F.col("id") % 7)
    out = dealt(rows)
    sizes = out.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) <= MOST_ROWS * 1.01 and out.exceptAll(rows).isEmpty() and out.count() == rows.count()
    assert dealt(rows.where("id < 0")).count() == 0


def test_global_metrics_read_their_rows_once(spark):
    """Rows are made once, though they are used twice."""
    made = spark.sparkContext.accumulator(0)

    def count(frames):
        for x in frames:
            made.add(len(x))
            yield x

    out = M.with_global_metrics(spark.range(0, 100, 1, 2).mapInPandas(count, "id long"), {"most": F.max("id")})
    assert {r.most for r in out.collect()} == {99} and made.value == 100


def test_runs_hide_no_rule():
    """Signs that are read in one step end where a rule may begin."""
    assert L.tokens('x = s"a" + xs"b" + 9s"c"', "Scala") == [("P", "x = "), ("S", 's"a"'), ("P", " + xs"), ("S", '"b"'), ("P", " + 9s"), ("S", '"c"')]
    assert L.tokens("a; x9return /b/; return /c/; 9return /d/", "JS") == [("P", "a; x9return /b/; return "), ("R", "/c/"), ("P", "; 9return "), ("R", "/d/")]
    assert L.tokens("a\n__END__\nb", "Ruby") == [("P", "a\n"), ("C", "__END__\nb")]
