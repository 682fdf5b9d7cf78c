"""Text functions with brackets, version keys without limits, manifests and scans: against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import literals as L
from tessera.functions import text as T
from tessera.functions import versions as Ver
from tessera.operators import closure as C
from tessera.operators import dependencies as Dep
from tessera.operators import discovery as D
from tessera.operators import metrics as M
from tessera.sources import files as S


def conditions(code, least=4):
    """Conditions by walking the text with a stack."""
    found = 0
    for m in re.finditer(r"\b(?:if|while|for|until|elsif|elseif)\s*\(", code):
        deep, i = 1, m.end()
        while i < len(code) and deep:
            deep += {"(": 1, ")": -1}.get(code[i], 0)
            i += 1
        if not deep:
            c = code[m.end() : i - 1]
            n = c.count("&&") + c.count("||")
            found += "&&" in c and "||" in c and n >= least
    return found


def test_conditions_of_any_depth(spark):
    rng = random.Random(6)

    def nested(d):
        return "x" if d == 0 else "(" + nested(d - 1) + rng.choice([" && y", " || z", ""]) + ")"

    texts = [f"if ({nested(rng.randint(0, 15))} && a || b) f(); while (p) q(); if (unclosed && (" for _ in range(40)] + ["", "#if (a && b || c && d)", "if (a && b || c && d || e) { }"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.n for r in rows.select("i", T.complex_conditions(F.col("t")).alias("n")).collect()}
    assert [got[i] for i in range(len(texts) - 2)] == [conditions(t) for t in texts[:-2]] and got[len(texts) - 2] == 0 and got[len(texts) - 1] == 1


def test_brackets_and_lines(spark):
    rows = spark.createDataFrame([("f(a, (b), [c, d]) {e}, g", ), ("no brackets, at all",), ("open (x",), (None,), ("",)], "t string")
    own = T.bracketed(F.col("t"))
    got = [tuple(r) for r in rows.select(own["inside"], own["behind"], T.split_outside(F.col("t"), ","), T.line_range(F.replace("t", F.lit(" "), F.lit("\n")), 2, 2)).collect()]
    assert got[0] == ("a, (b), [c, d]", " {e}, g", ["f(a, (b), [c, d]) {e}", " g"], "(b),")
    assert got[1] == (None, None, ["no brackets", " at all"], "brackets,") and got[2][:2] == (None, None) and got[3][2] == [""] and got[4][3] == ""


@pytest.mark.parametrize("code, n", [("if (a) b();", 1), ("if (a) { b(); }", 0), ("if (a) { } else b();", 1), ("else if (x) { y; }", 0), ("do { a; } while (b);", 0), ("for (i = 0; i < (n); i++) x;", 1), ("while (f(a)) ;", 0), ("if (a) if (b) c;", 2), ("", 0)])
def test_missing_braces(spark, code, n):
    assert spark.createDataFrame([(code,)], "t string").select(T.missing_braces(F.col("t"))).first()[0] == n


def test_version_keys_have_no_limits(spark):
    rng = random.Random(9)
    versions = [".".join(str(rng.choice([0, 0, 1, 7, 10, 10**rng.randint(1, 30)])) for _ in range(rng.randint(1, 14))) for _ in range(60)] + ["1", "1.0.0", "01.0"]
    rows = spark.createDataFrame([(a, b) for a in versions for b in rng.sample(versions, 6)], "a string, b string")

    def plain(v):
        own = [int(p) for p in v.split(".")]
        while own and own[-1] == 0:
            own.pop()
        return own

    for r in rows.select("a", "b", (Ver.order_key(F.col("a")) < Ver.order_key(F.col("b"))).alias("less"), Ver.compare(F.col("a"), F.col("b")).alias("sign")).collect():
        x, y = plain(r.a), plain(r.b)
        assert r.less == (x < y) and r.sign == (x < y) - (x > y)
    wild = spark.createDataFrame([("2.x", "2.999.1"), ("2.0.x", "2.0.7")], "a string, b string")
    assert all(r[0] for r in wild.select(Ver.order_key(F.col("a")) > Ver.order_key(F.col("b"))).collect())


def test_closures_never_end_early(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(6)], "parent string, child string")
    seed = spark.createDataFrame([("n0",)], "node string")
    with pytest.raises(RuntimeError):
        C.closure(chain, seed, max_rounds=3)
    assert C.closure(chain, seed, max_rounds=7).count() == 7
    with pytest.raises(RuntimeError):
        C.scan_until_stable(lambda refs: refs.select(F.concat("ref", F.lit("x")).alias("ref")), spark.createDataFrame([("a",)], "ref string"), max_rounds=3)


def test_files_too_big_keep_a_row(spark, tmp_path):
    (tmp_path / "a.c").write_text("x" * 50)
    (tmp_path / "b.c").write_text("x" * 500)
    got = {r.name: (r.status, r.content is None) for r in S.scan_files(spark, str(tmp_path), max_bytes=100).collect()}
    assert got == {"a.c": ("None", False), "b.c": ("TooBig", True)}


def test_libraries_names_and_quick_tests(spark):
    files = S.with_path_parts(spark.createDataFrame([("/l/log4j-core-2.17.1.jar",), ("/l/a.txt",), ("/l/x.dll",)], "path string"))
    assert sorted((r.name, r.library, r.version) for r in S.library_files(files).collect()) == [("log4j-core-2.17.1.jar", "log4j-core", "2.17.1"), ("x.dll", "x", None)]
    rows = spark.createDataFrame([("a" * 69 + "\x01",), ("a" * 70 + "\x01",), (None,)], "t string")
    assert [r[0] for r in rows.select(S.looks_binary(F.col("t"))).collect()] == [True, False, False]
    uuid = rows.limit(1).select(S.name_uuid(F.lit("a")).alias("a"), S.name_uuid(F.lit("a")).alias("b"), S.name_uuid(F.lit("c")).alias("c")).first()
    assert uuid.a == uuid.b != uuid.c and re.fullmatch(r"[0-9a-f]{8}-[0-9a-f]{4}-8[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}", uuid.a)


def test_properties_that_refer_to_each_other(spark):
    rows = spark.createDataFrame([("${a}", {"a": "${b}", "b": "1.${c}", "c": "2"}), ("${a}.${a}-${d}", {"a": "1"}), ("${a}", {"a": "${b}", "b": "${a}"}), ("3", None), ("${x}", None)], "v string, m map<string,string>")
    assert [r[0] for r in rows.select(Dep.interpolated(F.col("v"), F.col("m"))).collect()] == ["1.2", "1.1-", None, "3", ""]


def test_findings_of_literals(spark):
    yes = {L.is_ipv4: ['"192.168.1.1"', "'[11.0.0.1]'", '"12.0.0.0/8"'], L.is_ipv6: ['"fe80::1"', '"1:2:3:4:5:6:7:8"', '"1:2:3:4:5:6:10.0.0.1"'], L.is_path: ['"/etc/passwd"', '"C:\\\\Windows\\\\x"', '"\\\\\\\\host\\\\share"', '"file:///etc/abc"'], L.is_url: ['"https://a.b"'], L.is_credential: ["\"user = 'joe'\""]}
    no = {L.is_ipv4: ['"1.2.3.4"', '"1.2.3"', '"1111.1.1.1"', "192.168.1.1"], L.is_ipv6: ['"12:30:45"', '"::"', '"g::1"'], L.is_path: ['"/a/b"', '"etc/passwd"', '"/etc/a<b"', '"C:"'], L.is_url: ['"http://x/xmlns"', '"ftp://a"'], L.is_credential: ["\"user = ' '\"", '"username"', "\"color = 'red'\""]}
    for rule, literals in yes.items():
        assert all(r[0] for r in spark.createDataFrame([(x,) for x in literals], "s string").select(rule(F.col("s"))).collect()), rule
        assert not any(r[0] for r in spark.createDataFrame([(x,) for x in [*no[rule], None]], "s string").select(rule(F.col("s"))).collect()), rule
    rows = spark.createDataFrame([("dbPassword", '"x"'), ("dbPassword", '""'), ("colour", '"x"')], "n string, v string")
    assert [r[0] for r in rows.select(L.is_secret_assignment(F.col("n"), F.col("v"))).collect()] == [True, False, False]


def test_addresses_on_lines_that_explain_them(spark):
    rows = spark.createDataFrame([("/a", 'x = "192.168.0.1";\nversion = "12.0.0.1";\n\nnew Regex("11.0.0.1"); y = "13.1.1.1";\nz("14.0.0.2");')], "path string, text string")
    assert sorted((r.line, r.literal) for r in M.address_lines(rows, "Java", "path").collect()) == [(1, '"192.168.0.1"'), (5, '"14.0.0.2"')]


def test_metrics_have_one_column_each():
    for language, own in M.PROFILES.items():
        assert len({m.name for m in own}) == len(own), language
    assert len({m.name for own in M.PROFILES.values() for m in own}) >= 400


def test_dialects_of_text_and_of_code(spark):
    cases = {
        "create table t (a varchar2(3));": ["PlSql"],
        "-- varchar2 is oracle's\nselect 1": [],
        "declare @x int\ngo\n": ["TSql"],
        "start transaction; savepoint a;": ["MySQL", "PostgreSQL", "DB2"],
        "select json_query(a, '$') from t": ["MariaDB"],
        "x := 1; with recursive c as (select 1)": ["MySQL", "PostgreSQL"],
        "set gtid_domain_id = 1": ["MariaDB"],
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: sorted(r.d) for r in rows.select("t", D.sql_dialects(F.col("t")).alias("d")).collect()} == {t: sorted(d) for t, d in cases.items()}


def test_letters_beyond_ascii_and_carriage_returns_end_no_word_and_no_line_of_discovery(spark):
    """As the SQL's engine reads them: a word ends before such a letter, and a lone carriage return begins no line."""
    cases = {"Chréque aièè": ["MariaDB"], "échr(1)": ["MariaDB"], "chrono": [], "x\rgo\ry": [], "x\u2028go\u2028y": [], "x\ngo\ny": ["MySQL", "TSql"], "-- é\nà varchar2é": ["PlSql"]}
    files = spark.createDataFrame([(t, f"/d{i}", "sql", t) for i, t in enumerate(cases)], "path string, dir string, ext string, text string")
    assert {r.t: sorted(r.d) for r in files.select(F.col("text").alias("t"), D.sql_dialects(F.col("text")).alias("d")).collect()} == cases
    assert {r.path: r.techno for r in D.cascade(files).collect()} == {t: d[0] if len(d) == 1 else None for t, d in cases.items()}
