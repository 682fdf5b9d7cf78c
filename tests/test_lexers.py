"""Stateful lexers: what one pattern can't tell, and that no sign is lost."""

import random
import time

import pytest

from tessera.functions import lexers as L
from tessera.operators import metrics as M

CASES = [
    ("JS", "x = `http://a ${b}`; if (c) d();", "x = S; if (c) d();", ""),
    ("JS", "a = `p ${f({k: `q ${'}'}`})} r`; // `", "a = S; ", "// `"),
    ("JS", "y = a / b / c; z = /[/*\"]+\\//gi.test(s); return /`/ // d", "y = a / b / c; z = R.test(s); return R ", "// d"),
    ("TypeScript", "`\\`${`in`}` /* a */ + 1", "S  + 1", "/* a */"),
    ("Java", 'String s = """\n  // no comment "x" \\""" /*\n  """; // yes', "String s = S; ", "// yes"),
    ("Kotlin", '/* a /* b */ if */ val t = """ // "" ${x("}")} """" + "a ${b + "c"}"', " val t = S + S", "/* a /* b */ if */"),
    ("Scala", "/* /* */ if */ s\"${a + \"b\"}\" + '\\n' + 'sym // c", " S + S + 'sym ", "/* /* */ if */|// c"),
    ("Swift", 'let s = "a \\(f("b)")) c" + #"raw " \\"# /* /* */ */', "let s = S + S ", "/* /* */ */"),
    ("Rust", "fn f<'a>(x: &'a str) { r#\"a \" // b\"#; '\\'' } /* /**/ */", "fn f<'a>(x: &'a str) { S; S } ", "/* /**/ */"),
    ("CS", '$"a {x + "b"} {{" + @"c:\\" + """d "e" """ // f', "S + S + S ", "// f"),
    ("Go", 'a := `// "no`; b := "\\"" // yes', "a := S; b := S ", "// yes"),
    ("Groovy", "'''a\n// b''' + \"${c + \"d\"}\" =~ /e'\\/f/ // g", "S + S =~ R ", "// g"),
    ("Ruby", "=begin\nif x\n=end\ny = \"a #{b + \"c\"} # d\" # e\nz = <<~EOS\n # no\nEOS\n1 / 2 / 3", "\ny = S \nz = S\n1 / 2 / 3", "=begin\nif x\n=end|# e"),
    ("Perl", "=pod\nif\n=cut\n$#a = 1; # b", "\n$#a = 1; ", "=pod\nif\n=cut|# b"),
    ("PHP", "$a = <<<'X'\n // no\n X; #[Attr]\n# yes", "$a = S; #[Attr]\n", "# yes"),
    ("Lua", "--[==[ a\n]] ]==] x = [[ -- no ]] -- yes", " x = S ", "--[==[ a\n]] ]==]|-- yes"),
    ("PostgreSQL", "select $$ a ' -- b $$, $t$ $$ $t$ /* /* */ x */ -- c\nfrom 'it''s'", "select S, S  \nfrom S", "/* /* */ x */|-- c"),
    ("TSql", "/* /* */ go */ select 1 -- a", " select 1 ", "/* /* */ go */|-- a"),
]


@pytest.mark.parametrize("language, text, code, comments", CASES)
def test_what_one_pattern_cannot_tell(language, text, code, comments):
    found = L.tokens(text, language)
    assert "".join({"P": t, "S": "S", "R": "R", "C": ""}[k] for k, t in found) == code and "|".join(t for k, t in found if k == "C") == comments


SIGNS = ["'", '"', '"""', "`", "/", "*", "/*", "*/", "//", "#", "--", "[[", "]]", "$$", "${", "{", "}", "\\", "\n", "a", " ", "r#", "#{", "\\(", "(", ")", "=begin", "\n=end", "<<A\n", "<<<A\n", "é"]


@pytest.mark.parametrize("language", sorted(L.LEXERS))
def test_no_sign_is_lost(language):
    rng = random.Random(language)
    for _ in range(300):
        text = "".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 40)))
        found = L.tokens(text, language)
        assert "".join(t for _, t in found) == text and all(t for _, t in found)
        assert not any(a[0] == b[0] == "P" for a, b in zip(found, found[1:]))


def test_views_and_metrics(spark):
    rows = [("a", "x = `// not`;\nif (y) { z(`${`a`}`); } // TODO\n"), ("b", None), ("c", ""), ("d", "/* open\n if (x)")]
    files = spark.createDataFrame(rows, "path string, text string")
    cut = {r.path: r.views for r in M.with_views(files, "JS").collect()}
    assert cut["a"].code == 'x = "CHAINE";\nif (y) { z("CHAINE"); } \n' and cut["a"].comment == "\n// TODO\n" and cut["a"].strings == ["`// not`", "`${`a`}`"] and cut["a"].agglo == "P\nPC\n"
    assert cut["b"].code == "" and cut["c"].strings == [] and (cut["d"].code, cut["d"].comment) == ("\n", "/* open\n if (x)")
    m = {r.path: r for r in M.file_metrics(files, "JS", ["path"]).collect()}
    assert m["a"].LinesOfCode == 2 and m["a"].CommentLines == 1


@pytest.mark.parametrize("piece", ["r#\"", "/*", "`${", '"""', "'", "/a", "<<A\n", "$a$", "{", "=begin "])
def test_long_texts_take_seconds(piece):
    began = time.time()
    for language in L.LEXERS:
        text = piece * 20_000
        assert sum(len(t) for _, t in L.tokens(text, language)) == len(text)
    assert time.time() - began < 30


def test_dialects_of_variables(spark):
    """Names that two dialects have in part are sought as a whole."""
    from pyspark.sql import functions as F

    from tessera.operators.discovery import sql_dialects

    texts = {
        "set global gtid_mode = on; set binlog_format = row": [],
        "set slave_parallel_workers = 4": [],
        "show variables like encrypt_": [],
        "set alter_algorithm = x": ["MariaDB"],
        "set SQL_IF_EXISTS = 1": ["MariaDB"],
        "set innodb_defragment = 1": ["MariaDB"],
        "set join_cache_level = 2, max_statement_time = 3": ["MariaDB"],
        "set wsrep_on = 1": ["MariaDB"],
        "set binlog-annotate-row-events": ["MariaDB"],
        "select nvl(a, b) from t": ["MariaDB"],
        "set log_syslog = 1": ["MariaDB"],
        "set aria_x = 1; package": ["MariaDB"],
        "set xaria_x = 1": [],
    }
    rows = spark.createDataFrame(list(texts), "string").select("value", sql_dialects(F.col("value")).alias("d")).collect()
    assert {r.value: r.d for r in rows} == texts


def test_views_of_metrics(spark):
    """Each metric reads the view that holds what it looks for."""
    sql = "select /*+ full(t) */ a -- /*+ b\nfrom t where b like '%x' and c like 'y%' and d like N'_z' /* like '%q' */"
    c = '#include "/abs/x.h"\n#include <C:\\y.h>\n# include "rel/z.h"\n// #include "/no/w.h"\n'
    one = M.file_metrics(spark.createDataFrame([("a", sql)], "path string, text string"), "PlSql", ["path"]).first()
    assert (one.Hints, one.LikeLeadingWildcards) == (2, 2)
    other = M.file_metrics(spark.createDataFrame([("a", sql)], "path string, text string"), "TSql", ["path"]).first()
    assert (other.Hints, other.LikeLeadingWildcards) == (2, 2)
    assert M.file_metrics(spark.createDataFrame([("a", c)], "path string, text string"), "CCpp", ["path"]).first().AbsoluteIncludes == 2


def test_literals_nodes_and_limits_of_lexed_languages(spark):
    from tessera.operators import nodes as N

    text = "const a = `x {\n// y ${b('c')} \"`;\nfunction f(p, q) {\n  if (a) { g('d', /'{/); }\n}\n"
    files = spark.createDataFrame([("a", text)], "path string, text string")
    assert sorted((r.line, r.literal) for r in M.literal_lines(files, "JS", "path").collect()) == [(1, "`x {\n// y ${b('c')} \"`"), (4, "'d'")]
    assert [(r.string_id, r.literal) for r in M.string_table(files, "JS", "path").orderBy("string_id").collect()] == [(1, "`x {\n// y ${b('c')} \"`"), (2, "'d'")]
    assert sorted((r.node_id, r.kind, r.depth, r.last_line) for r in N.nodes(files, "JS", "path").collect()) == [(3, "function", 0, 4), (4, "if", 1, 4)]
    python = spark.createDataFrame([("a", "def f(self, a, b, c):\n  pass\ndef g(a, b, c, d):\n  pass\n")], "path string, text string")
    found = N.nodes(python, "Python", "path")
    limits = [N.node_metrics(found, "path", language=x).first().many_parameters for x in ("Python", "CS", "Java", "Ruby")]
    assert limits == [1, 2, 0, 0]
