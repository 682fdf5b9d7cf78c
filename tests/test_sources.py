"""Scans, decoding, sinks and streams."""

import datetime

from pyspark.sql import functions as F

from tessera.sources import files as S
from tessera.sources import sinks
from tessera.streaming import events as E


def test_scan_decode_and_status(spark, tmp_path):
    (tmp_path / "src" / ".svn").mkdir(parents=True)
    (tmp_path / "src" / "a.py").write_bytes(b"x = 1\r\ny\rz\n")
    (tmp_path / "src" / "b.txt").write_bytes("é".encode("cp1252") + b" \x80")
    (tmp_path / "src" / "c.txt").write_bytes("\ufeffé".encode())
    (tmp_path / "src" / "w.txt").write_bytes("wide".encode("utf-16"))
    (tmp_path / "src" / "lib.so").write_bytes(bytes(range(8)) * 20)
    (tmp_path / "src" / "old.tar").write_bytes(b"x")
    (tmp_path / "src" / ".svn" / "entries").write_bytes(b"x")
    (tmp_path / "src" / "empty.py").write_bytes(b" \n")
    (tmp_path / "src" / "zero.py").write_bytes(b"")
    found = S.scan_files(spark, str(tmp_path))
    assert sorted(r.name for r in found.select("name").collect()) == ["a.py", "b.txt", "c.txt", "empty.py", "lib.so", "w.txt"]
    got = {r.name: (r.encoding, r.text) for r in S.with_text(found).collect()}
    assert got["a.py"] == ("US-ASCII", "x = 1\ny\nz\n") and got["b.txt"] == ("windows-1252", "é €")
    assert got["c.txt"] == ("UTF-8", "é") and got["w.txt"] == ("UTF-16LE", "wide") and got["lib.so"] == ("binary", None)
    assert [r.path.rsplit("/", 1)[1] for r in S.binary_libraries(found).collect()] == ["lib.so"]
    flagged = S.vendored_flags(S.with_text(found))
    status = {r.name: r.s for r in flagged.select("name", S.analysis_status(F.lit("Python"), F.col("name"), F.col("length"), F.col("text"), F.col("vendored")).alias("s")).collect()}
    assert status["a.py"] == "None" and status["empty.py"] == "Empty" and status["lib.so"] == "Binary"


def test_vendored_needs_a_package_outside(spark):
    of = lambda rows: sorted((r.path, r.vendored) for r in S.vendored_flags(spark.createDataFrame(rows, "path string, name string")).collect())
    inside = ("/a/node_modules/x.js", "x.js")
    assert of([inside]) == [(inside[0], False)]
    assert of([inside, ("/a/package.json", "package.json")]) == [(inside[0], True), ("/a/package.json", False)]


def test_lists_and_manifests(spark, tmp_path):
    (tmp_path / "list").write_text("ctx#/a/b.c\n/c/d.c\n\n")
    assert [tuple(r) for r in S.file_list(spark, str(tmp_path / "list")).collect()] == [("ctx", "/a/b.c"), (None, "/c/d.c")]
    (tmp_path / "params").write_text("[lang_ana] Java | PHP\n[dir_ana] a | b\nnoise\n")
    assert sorted(tuple(r) for r in S.parameter_manifest(spark, str(tmp_path / "params")).collect()) == [(0, "dir_ana", "a"), (0, "lang_ana", "Java"), (1, "dir_ana", "b"), (1, "lang_ana", "PHP")]
    (tmp_path / "rules").write_text('name;pattern\na;"x"";y"\n')
    assert [tuple(r) for r in S.rule_table(spark, str(tmp_path / "rules")).collect()] == [("a", 'x";y')]
    (tmp_path / "history").write_text("FILE;1;/a.x;Java:PHP\nFILE;2;/b.x\nDIR;3;/c\n")
    assert [tuple(r) for r in S.history(spark, str(tmp_path / "history")).collect()] == [("/a.x", ["Java", "PHP"]), ("/b.x", [])]


def test_properties_rules_and_third_parties(spark, tmp_path):
    (tmp_path / "p").write_text("# c\na = 1\n\nurl=x?y=z\nbad\n")
    assert [tuple(r)[1:] for r in S.properties(spark, str(tmp_path / "p")).collect()] == [("a", "1"), ("url", "x?y=z")]
    (tmp_path / "r.json").write_text('[{"name": "a", "technologies": ["Java", "JS"], "pattern": "x"}, {"name": "b", "technologies": ["PHP"], "pattern": "y"}, {"name": "c"}]')
    assert [r.name for r in S.json_rules(spark, str(tmp_path / "r.json"), ["java"]).collect()] == ["a"]
    rows = spark.createDataFrame([("/a", "None", "1"), ("/b", "External", "2")], "path string, status string, sha256 string")
    assert [tuple(r) for r in S.third_party(rows).collect()] == [("/b", "External", "2")]


def test_sectioned_file(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2, "x;y"), ("a", None, "l\nm")], "name string, n int, t string")
    lines = sinks.sectioned([sinks.section_lines(rows, "S", ["name", "n", "t"], ["name"])], {"k": "v"})
    assert [r.line for r in lines.collect()] == ["# k;v", "section=S", "name;n;t", "a;-1;l m", "b;2;x y"]
    sinks.write_sectioned(lines.coalesce(1), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 5
    assert sinks.lead_columns(["b", "a", "b"], ["a", "z"]) == ["a", "z", "b"]


def test_dump_and_fragments(spark):
    wide = spark.createDataFrame([("f", 1, None)], "path string, b int, a int")
    assert [r.line for r in sinks.counter_dump(wide, ["path"]).collect()] == ["a:-1", "b:1"]
    refs = spark.createDataFrame([("g:a@1",), ("g:b",)], "ref string")
    assert [r.element for r in sinks.pom_fragments(refs).collect()] == ["<dependency><groupId>g</groupId><artifactId>a</artifactId><version>1</version></dependency>", "<dependency><groupId>g</groupId><artifactId>b</artifactId></dependency>"]


def test_streams_give_what_batches_give(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(at + datetime.timedelta(minutes=20 * i), "view" if i % 2 else "click", float(i)) for i in range(12)]
    batch = spark.createDataFrame(rows, "ts timestamp, event_type string, value double")
    batch.write.parquet(str(tmp_path / "in"))
    stream = E.event_counts(E.file_stream(spark, str(tmp_path / "in"), batch.schema))
    query = stream.writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, E.event_counts(batch).collect()))
    docs = spark.createDataFrame([(1, "a\n\nb\n"), (2, None)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    E.write_stream(E.line_metrics(E.file_stream(spark, str(tmp_path / "docs"), docs.schema)), str(tmp_path / "out"), str(tmp_path / "cp2")).awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [(1, 3, 1, 2), (2, 0, 0, 0)]


def test_wide_encodings(spark):
    text = "hé\r\nlo"
    rows = spark.createDataFrame([(n, bytearray(text.encode(n))) for n in ("utf-32", "utf-16", "utf-8-sig", "cp1252")], "n string, content binary")
    got = {r.n: (r.encoding, r.text) for r in S.with_text(rows).collect()}
    assert {n: t for n, (_, t) in got.items()} == {n: "hé\nlo" for n in got} and got["utf-32"][0] == "UTF-32"
