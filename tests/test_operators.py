"""Operators on hand-made tables: nulls, repeats, empty tables, clashing names."""

from pyspark.sql import functions as F

from tessera.operators import closure as C
from tessera.operators import dependencies as D
from tessera.operators import discovery as Disc
from tessera.operators import keyword_scan as K
from tessera.operators import metrics as M
from tessera.operators import rules as R
from tessera.sources.files import with_path_parts

SPEC = """<?xml version="1.0"?>
<UserScan><keywordScan name="own" version="1.0">
  <keywordGroup name="TIMES" full_word="0" scope="code"><keywordItem id="1">TIMES</keywordItem></keywordGroup>
  <keywordGroup name="TOTAL_ALL"><keywordItem id="1">TOTALS</keywordItem></keywordGroup>
  <keywordGroup name="TOTAL_CODE" scope="code"><keywordItem id="1">TOTALS</keywordItem></keywordGroup>
  <keywordGroup name="CASE" sensitive="1" full_word="0" scope="code"><keywordItem id="2">perform</keywordItem></keywordGroup>
  <keywordGroup name="NAME" scope="string"><keywordItem id="3">NAME</keywordItem></keywordGroup>
</keywordScan></UserScan>"""

COBOL = """
       01  TABLE-A.
           02  ITEM  PIC X(80) OCCURS 12 TIMES.
           02  OTHER PIC X(10) OCCURS 3 TIMES.
      ******************************************
      * TOTALS
      ******************************************
       MAIN-PART.
           DISPLAY 'NAME = ' ITEM.
           PERFORM OTHER-PART.
           STOP RUN.
"""


def test_keyword_groups_of_a_specification(spark):
    (scan,) = K.read_scans(SPEC)
    files = M.with_views(spark.createDataFrame([("a.cbl", COBOL), ("b.cbl", None)], "name string, text string"), "Cobol")
    views = {"all": F.col("views.text"), "code": F.col("views.code"), "comment": F.col("views.comment"), "string": F.array_join("views.strings", "\n")}
    found = {r.name: r.asDict() for r in K.keyword_counts(files, scan, views, ["name"]).collect()}
    assert found["a.cbl"] == {"name": "a.cbl", "TIMES": 2, "TOTAL_ALL": 1, "TOTAL_CODE": 0, "CASE": 0, "NAME": 1}
    assert set(list(found["b.cbl"].values())[1:]) == {0}


PATTERNS = """<UserScan><keywordScan name="p">
  <patternGroup name="either"><patterns>
    <search id="a" sensitive="0"><filename>*.cbl</filename><regexContent>STOP(?: RUN)?</regexContent></search>
    <search id="b" sensitive="1"><filename>*.cbl</filename><content>stop</content></search></patterns><formula value="a or b"/></patternGroup>
  <patternGroup name="both"><patterns>
    <search id="a"><filename>*.cbl</filename><content>STOP</content></search>
    <search id="b"><filename>*.cbl</filename><content>NOTHING</content></search></patterns><formula value="a and b"/></patternGroup>
  <patternGroup name="wrong"><patterns><search id="a"><filename>*</filename><content>STOP</content></search></patterns><formula value="a and c"/></patternGroup>
</keywordScan></UserScan>"""


def test_pattern_formulas(spark):
    (scan,) = K.read_scans(PATTERNS)
    files = spark.createDataFrame([("x.cbl", COBOL), ("x.txt", COBOL), (None, None)], "name string, text string")
    found = K.pattern_results(files, scan, F.col("text"), F.col("name"), ["name"])
    assert sorted((tuple(r) for r in found.collect()), key=repr) == [("x.cbl", True, False, None), ("x.txt", False, False, None), (None, False, False, None)]
    assert [tuple(r) for r in K.application_results(found, scan).collect()] == [("either", 2, "OK"), ("both", 2, "KO"), ("wrong", 2, "-")]
    assert [r.logic for r in K.application_results(found.limit(0), scan).collect()] == ["KO", "KO", "-"]


def _files(spark, rows):
    return with_path_parts(spark.createDataFrame(rows, "path string, text string"))


def test_discovery(spark):
    rows = [
        ("/a/x.py", "import os"),
        ("/a/run", "#!/bin/ksh\necho"),
        ("/a/page.html", "<html><script>x</script>"),
        ("/a/plain.html", "<html>"),
        ("/a/i.php", "plain"),
        ("/b/q.sql", "package x"),
        ("/b/r.sql", "declare @x int"),
        ("/c/a.h", "int x;"),
        ("/c/b.mm", "x"),
        ("/d/a.h", "int x;"),
        ("/e/f.cls", None),
        ("/e/g.vb", ""),
        ("/f/m1.m", ""),
        ("/f/m2.mlx", ""),
        ("/g/unknown.zzz", "text"),
        (None, None),
        ("/a/x.py", "import os"),
    ]
    found = {r.path: (r.techno, r.mode) for r in Disc.discover(_files(spark, rows)).collect()}
    assert found["/a/x.py"] == ("Python", "from extension") and found["/a/run"] == ("Ksh", "from content")
    assert found["/a/page.html"][0] == "JS_EMBEDDED" and found["/a/plain.html"][0] is None or found["/a/plain.html"][0] == "JS_EMBEDDED"
    assert found["/a/i.php"] == ("PHP", "from content")
    assert found["/b/q.sql"] == ("PlSql", "from content") and found["/b/r.sql"] == ("TSql", "from content")
    assert found["/c/a.h"] == ("ObjCCpp", "from potential in directory") and found["/d/a.h"] == ("CCpp", "from last resort")
    assert found["/e/f.cls"] == ("VbDotNet", "from potential in directory")
    assert found["/g/unknown.zzz"] == (None, None) and found[None] == (None, None)
    assert Disc.discover(_files(spark, rows)).count() == len(rows)
    assert Disc.discover(_files(spark, rows).limit(0)).count() == 0


def test_votes_and_history(spark):
    rows = [("/v/a.cls", ""), ("/v/b.cls", ""), ("/w/x.py", "")]
    found = Disc.discover(_files(spark, rows))
    assert {r.techno for r in found.where("dir = '/v'").collect()} == {None}
    decided = spark.createDataFrame([("/v/a.cls", ["Apex"]), ("/w/x.py", [])], "name string, technos array<string>")
    after = {r.path: (r.techno, r.mode) for r in Disc.with_history(found, decided).collect()}
    assert after == {"/v/a.cls": ("Apex", "from history"), "/v/b.cls": (None, None)}
    tables = Disc.result_tables(found)
    assert tables["found"].count() == 1 and tables["potential"].count() == 2 and tables["unknown"].count() == 0


def test_closure_with_cycles_and_nulls(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "c"), ("x", None), (None, "y")], "parent string, child string")
    seeds = spark.createDataFrame([("a",), ("x",), ("a",), (None,)], "node string")
    assert sorted(tuple(r) for r in C.closure(edges, seeds).collect()) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("x", "x", 0)]
    assert C.closure(edges.limit(0), seeds.limit(0)).count() == 0


def test_scan_until_stable(spark):
    nexts = {"a": ["b"], "b": ["c", "a"], "c": []}

    def scan(known):
        return spark.createDataFrame([(y,) for r in known.collect() for y in nexts[r.ref]] or [(None,)], "ref string").where("ref IS NOT NULL")

    found, rounds = C.scan_until_stable(scan, spark.createDataFrame([("a",), ("a",)], "ref string"))
    assert sorted(r.ref for r in found.collect()) == ["a", "b", "c"] and rounds == 3


def test_first_rule_in_blocks(spark):
    rules = spark.createDataFrame([(2, "second", "b"), (1, "first", "a"), (3, "third", ".")], "ordinal int, name string, pattern string")
    rows = spark.createDataFrame([("ab",), ("b",), ("c",), ("",), (None,)], "t string")
    for block in (1, 2, 10):
        assert [r.rule for r in R.first_match(rows, rules, "t", block=block).collect()] == ["first", "second", "third", None, None]
    assert [r.rule for r in R.first_match(rows, rules.limit(0), "t").collect()] == [None] * 5


def test_descriptions_and_merged_rules(spark):
    rows = spark.createDataFrame([("Spring",), ("other",), (None,)], "name string")
    about = spark.createDataFrame([("spring", "apache"), ("SPRING", "zlib")], "name string, license string")
    assert [tuple(r) for r in R.described(rows, about).orderBy("name").collect()] == [(None, "unknown"), ("Spring", "apache"), ("other", "unknown")]
    own, other = spark.createDataFrame([("a", 1)], "k string, v int"), spark.createDataFrame([("a", 2), ("b", 3)], "k string, v int")
    assert sorted(tuple(r) for r in R.merged_rules(own, other, ["k"]).collect()) == [("a", 1), ("b", 3)]


def test_manifest_formats(spark):
    files = _files(
        spark,
        [
            ("/y/yarn.lock", '# yarn\n"@babel/core@^7.0.0", "@babel/core@^7.1.0":\n  version "7.20.1"\n\nleft-pad@1:\n  version "1.3.0"\n'),
            ("/y/package.json", '{"dependencies": {"left-pad": "^1.0.0"}}'),
            ("/p/poetry.lock", '[[package]]\nname = "click"\nversion = "8.1.3"\n'),
            ("/p/requirements.txt", "ignored==1\n"),
            ("/q/pyproject.toml", '[tool.poetry.dependencies]\npython = "^3.9"\nrich = "^13.0"\nhttpx = {version = ">=0.24", extras = ["a"]}\n\n[build]\n'),
            ("/r/setup.py", "setup(install_requires=['numpy>=1.20', \"six\"])"),
            ("/s/build.gradle", "def v = '2.5'\ndependencies {\n  implementation 'org.a:b:1.0'\n  testImplementation(\"org.c:d:$v\")\n}\n"),
            ("/t/x.csproj", '<Project><PackageReference Include="Newtonsoft.Json" Version="13.0.1" /></Project>'),
            ("/u/build.xml", "<project><pathelement location='lib/commons-io-2.6.jar'/></project>"),
            ("/v/s.R", "library(dplyr)\nrequire('ggplot2')\n"),
            ("/w/package.json", "{broken"),
            ("/w/pom.xml", None),
        ],
    )
    found = D.inventory(files)
    got = {(r.path, r.name): (r.version, r.environment) for r in found.collect()}
    assert got[("/p/poetry.lock", "click")] == ("8.1.3", "prod") and ("/p/requirements.txt", "ignored") not in got
    assert got[("/q/pyproject.toml", "rich")][0] == "^13.0" and got[("/q/pyproject.toml", "httpx")][0] == ">=0.24"
    assert got[("/r/setup.py", "numpy")][0] == ">=1.20" and got[("/r/setup.py", "six")][0] is None
    assert got[("/s/build.gradle", "org.a:b")] == ("1.0", "prod") and got[("/s/build.gradle", "org.c:d")] == ("2.5", "test")
    assert got[("/t/x.csproj", "Newtonsoft.Json")][0] == "13.0.1" and got[("/u/build.xml", "commons-io")][0] == "2.6"
    assert ("/v/s.R", "dplyr") in got and ("/v/s.R", "ggplot2") in got
    locked = {r.name: r.version for r in D.with_yarn_versions(found, files).where("path = '/y/package.json'").collect()}
    assert locked == {"left-pad": "1.3.0"}
    assert {r.name for r in D.yarn_lock(files).collect()} == {"@babel/core", "left-pad"}


def test_merge_and_conflicts(spark):
    rows = [("p", "d", "JS", "React", "1", "1.0", None, "prod"), ("q", "e", "JS", "react", "1", "1.10", "3", "test"), ("r", "f", "JS", "vue", "2", "3", None, "prod"), ("r", "f", "JS", "vue", "2", None, "2", "prod")]
    found = spark.createDataFrame(rows, "path string, dir string, techno string, name string, version string, low string, high string, environment string")
    got = {r.name: (r.low, r.high, r.conflict, r.environments, r.files) for r in D.merged(found).collect()}
    assert got == {"React": ("1.10", "3", False, "prod,test", 2), "vue": ("3", "2", True, "prod", 2)}
    assert D.merged(found.limit(0)).count() == 0


def test_bill_of_materials(spark):
    files = _files(spark, [("/bom.xml", '<bom><dependencies><dependency ref="org.a:b@1.2"/><dependency ref="c:d"/></dependencies></bom>')])
    assert sorted(tuple(r) for r in D.cyclonedx(files).select("group", "artifact", "version").collect()) == [("c", "d", None), ("org.a", "b", "1.2")]


def test_file_metrics_of_languages(spark):
    java = 'import java.util.*;\n// TODO later\nclass A { String ip = "192.168.1.20"; int f(int x) { return x > 0 ? 42 : 7; } }\n'
    files = spark.createDataFrame([("A.java", java), ("B.java", None)], "path string, text string")
    wide = M.file_metrics(files, "Java", ["path"])
    a, b = wide.orderBy("path").collect()
    assert (a.LinesOfCode, a.CommentLines, a.CommentBlocs, a.SuspiciousComments, a.MagicNumbers, a.TernaryOperators, a.ImportAll, a.HardCodedIP) == (2, 1, 1, 1, 1, 1, 1, 1)
    assert b.LinesOfCode == 0
    assert M.long_metrics(wide, ["path"], "Java").where("mnemonic = 'Return'").count() == 2
    for language in [*M.PROFILES, "Ada", "nothing"]:
        assert M.file_metrics(files, language, ["path"]).count() == 2
    sql = M.file_metrics(spark.createDataFrame([("a.sql", "select * from t; -- c\nselect distinct a from (select 1) order by a;\n")], "path string, text string"), "PlSql", ["path"]).head()
    assert (sql.Select, sql.SelectAll, sql.SelectDistinct, sql.SubQueries, sql.SQLOrderBy, sql.CommentLines) == (3, 1, 1, 1, 1, 1)


def test_worst_class_and_status(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2), ("c", 3)], "g string, k int")
    assert sorted(tuple(r) for r in rows.groupBy("g").agg(M.worst_class(F.col("k"))).collect()) == [("a", 1), ("b", 2), ("c", 3)]
    both = spark.createDataFrame([("x", 1), (None, None)], "t string, m int").select(M.status_bits(F.col("t"), [F.col("m")]))
    assert [r[0] for r in both.collect()] == [0, 5]
