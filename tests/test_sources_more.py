"""The sectioned data source, progress events, and rules that go on."""

import pytest
from pyspark.sql import functions as F

from tessera.operators.rules import all_matches
from tessera.sources.progress import Progress
from tessera.sources.sectioned import sectioned_source

SCHEMA = "section string, header array<string>, place long, values array<string>"


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(sectioned_source())


def test_sections_of_three_types_come_back(spark, source, tmp_path):
    rows = [("a", ["x", "y"], 0, [str(i), f"v;{i}\n"]) for i in range(50)] + [("b", ["z"], 0, [None]), ("c", ["p", "q", "r"], 0, ["é", ""])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for _ in range(2):
        df.write.format("sectioned").mode("overwrite").save(f"{tmp_path}/out")
    got = sorted((r.section, *r.header, *r["values"]) for r in spark.read.format("sectioned").load(f"file://{tmp_path}/out").collect())
    assert got == sorted([("a", "x", "y", str(i), f"v {i} ") for i in range(50)] + [("b", "z", ""), ("c", "p", "q", "r", "é", "")])
    df.where("section = 'b'").write.format("sectioned").mode("append").save(f"{tmp_path}/out")
    assert spark.read.format("sectioned").load(f"{tmp_path}/out").count() == 53
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith(".part") and not p.name.endswith(".crc")]


def test_files_of_others_and_empty_folders(spark, source, tmp_path):
    (tmp_path / "in").mkdir()
    assert spark.read.format("sectioned").load(f"{tmp_path}/in").count() == 0
    (tmp_path / "in" / "one.txt").write_text("# date;x\nsection=s\na;b\n1;2\n3\nsection=t\nc\nsection=u\nd\n\n")
    got = [(r.section, r.header, r.place, r["values"]) for r in spark.read.format("sectioned").load(f"{tmp_path}/in").orderBy("section", "place").collect()]
    assert got == [("s", ["a", "b"], 0, ["1", "2"]), ("s", ["a", "b"], 1, ["3"]), ("u", ["d"], 0, [""])]


def test_a_failed_write_leaves_nothing(spark, source, tmp_path):
    df = spark.createDataFrame([("a", ["x"], 0, ["1"])], SCHEMA).union(spark.range(1, 2, 1, 1).select(F.lit("a"), F.array(F.lit("x")), F.col("id"), F.array(F.expr("cast(raise_error('stop') as string)"))))
    with pytest.raises(Exception):
        df.write.format("sectioned").mode("append").save(f"{tmp_path}/out")
    assert spark.read.format("sectioned").load(f"{tmp_path}/out").count() == 0


def test_progress(spark):
    run = Progress(spark)
    one = run.stage(spark.range(10), "a", even=F.count_if(F.col("id") % 2 == 0))
    assert one.count() == 10 and run.stage(one.where("id > 99"), "b", top=F.max("id")).count() == 0
    rows = run.events().orderBy("n").collect()
    assert [(r.kind, r.step, r.key, r.value) for r in rows] == [("begin", "a", None, None), ("count", "a", "rows", 10), ("count", "a", "even", 5), ("end", "a", None, None), ("begin", "b", None, None), ("count", "b", "rows", 0), ("count", "b", "top", 0), ("end", "b", None, None)]
    assert all(x.lapse_ms <= y.lapse_ms and x.at <= y.at for x, y in zip(rows, rows[1:])) and [r.line.split(";")[:2] for r in run.lines().collect()][:2] == [["begin", "0"], ["count", "1"]]


def test_rules_go_on_or_stop(spark):
    rules = spark.createDataFrame([(3, "c", "c", True), (1, "a", "a", True), (2, "b", "b", False), (4, "all", "", False), (5, "never", "", True)], "ordinal int, name string, pattern string, goes_on boolean")
    rows = spark.createDataFrame([(1, "abc"), (2, "ac"), (3, ""), (4, None), (5, "b")], "k int, t string").withColumn("name_", F.lit("x"))
    got = {}
    for r in all_matches(rows, rules, "t").orderBy("k", "ordinal").collect():
        got.setdefault(r.k, []).append(r["name"])
    assert got == {1: ["a", "b"], 2: ["a", "c", "all"], 3: ["all"], 5: ["b"]} and all_matches(rows, rules.limit(0), "t").count() == 0
