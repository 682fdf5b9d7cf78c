"""Lexical views of sources whose literals and comments nest, made of the customers' numbers, and an automaton in SQL.

A customer's source joins pieces chosen by its numbers, which stand in them too, so all sources differ. The SQL walks
each text one sign at a time with a stack of states, and uses none of the library's patterns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import lexers as L
from tessera.staging import dealt

#: Pieces of each language, where {a} and {b} stand for numbers.
PIECES = {
    "JS": [
        "if (a{a}) { b{b}(); }\n",
        "x{a} = `t // {a} ${b{b} + `u ${'}' + \"`\"} {b}`} v`; if (d) e();\n",
        "y = a{a} / {b} / c; // d `{a}\n",
        "z = /[/{a}]'\"\\//g.test('{b}');\n",
        "/* if ({a}) ' ` \" // \n { } */ f({b});\n",
        "s = \"// no {a} \\\" /*\"; t = 'it\\'s {b}';\n",
        "return /`{a}'/;\n",
        "`\n${ {k{a}: {b}}.k / 2 }\n`;\n",
        "g(a, /\\/\\*{a}/, b{b} / 3) // /* {b}\n",
        "`${/}`/.test(`{a}`)}` /* ` */ + h;\n",
        "(i{a} + 1) / 2; `\\`${'{'}{b}`\n",
    ],
    "Kotlin": [
        "/* a {a} /* b */ if (c) */ x{b}()\n",
        "val s = \"p ${f(\"q{a}\")} /* \" // r\n",
        "val t = \"\"\" // {a}\n ${x{b} + \"}\"} \"q\" \"\"\"\n",
        "val c = '\"'; y{a} /* /**/ \" */\n",
        "// /* {b}\nz({a}) / 2\n",
        "\"esc \\\" ${ \"\"\"in {a}\"\"\" } $b\"\n",
        "val d = '\\''; \"\"\"{b}\\\"\"\"\"; /*/*{a}*/\n*/ w()\n",
    ],
}
_PICKS = ((1, 0), (3, 5), (7, 2), (5, 11), (11, 3), (13, 1))


def lexer_sources(spark: SparkSession, sf_dir: str, language: str) -> DataFrame:
    """(c_custkey, text)."""
    own = F.array(*[F.lit(x) for x in PIECES[language]])
    a, b = F.col("c_custkey"), F.floor("c_acctbal").cast("long") % 1000 + 1000
    picked = [F.get(own, ((a * m + b * (k + 1) + o) % len(PIECES[language])).cast("int")) for k, (m, o) in enumerate(_PICKS)]
    text = F.replace(F.replace(F.concat(*picked), F.lit("{a}"), a.cast("string")), F.lit("{b}"), b.cast("string"))
    return dealt(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_acctbal")).select("c_custkey", text.alias("text"))


def views_query(language: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views = L.lexical_views(F.col("text"), language)
        rows = lexer_sources(spark, sf_dir, language).select("c_custkey", views.alias("v"))
        return rows.select("c_custkey", "v.code", "v.comment", F.size("v.strings").alias("n_strings"), F.sha2(F.array_join("v.strings", "|"), 256).alias("strings"))

    run.__doc__ = f"Code, comments and strings of {language}, with nested literals and comments."
    return run


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def views_sql(language: str) -> str:
    own = "[" + ", ".join(map(_quoted, PIECES[language])) + "]"
    picked = " || ".join(f"({own})[(a * {m} + b * {k + 1} + {o}) % {len(PIECES[language])} + 1]" for k, (m, o) in enumerate(_PICKS))
    js = language == "JS"
    # t: the state on top; c, n, m: this sign and the next two; 1: what is pushed, with signs to skip
    opens = """WHEN c = '/' AND n = '/' THEN 'L0' WHEN c = '/' AND n = '*' THEN 'B1' WHEN c = '''' THEN 'S0' WHEN t = 'E' AND c = '{' THEN 'E0'"""
    if js:
        opens += """ WHEN c = '"' THEN 'D0' WHEN c = '`' THEN 'T0' WHEN c = '/' AND (prev = '' OR instr('(,=:[!&|?{};+-*%~^>', right(prev, 1)) > 0 OR right(prev, 6) = 'return') THEN 'R0'"""
    else:
        opens += """ WHEN c = '"' AND n = '"' AND m = '"' THEN 'T2' WHEN c = '"' THEN 'D0'"""
    inside = """WHEN t IN ('D', 'T') AND c = '$' AND n = '{' THEN 'E1'"""
    inside = inside.replace("('D', 'T')", "('T')") + " WHEN t = 'R' AND c = '[' THEN 'C0'" if js else inside + " WHEN t = 'B' AND c = '/' AND n = '*' THEN 'B1'"
    escapes = "t IN ('D', 'S', 'T', 'R', 'C')" if js else "t IN ('D', 'S')"
    # states that only end: X the end of a comment, F flags of a pattern, Q the quotes that end a text block
    swaps = "WHEN t = 'B' AND c = '*' AND n = '/' THEN 'X' " + ("WHEN t = 'R' AND c = '/' AND n BETWEEN 'a' AND 'z' THEN 'F'" if js else """WHEN t = 'T' AND c = '"' AND n = '"' AND m = '"' THEN 'Q'""")
    closes = """(t = 'L' AND c = chr(10)) OR (t = 'D' AND c = '"') OR (t = 'S' AND c = '''') OR (t = 'X') OR (t = 'E' AND c = '}')"""
    closes += """ OR (t = 'T' AND c = '`') OR (t = 'R' AND c = '/') OR (t = 'C' AND c = ']') OR (t = 'F' AND NOT n BETWEEN 'a' AND 'z')""" if js else """ OR (t = 'Q' AND n <> '"')"""
    return f"""
WITH RECURSIVE r AS (SELECT c_custkey, c_custkey AS a, floor(c_acctbal)::BIGINT % 1000 + 1000 AS b FROM customer),
s AS (SELECT c_custkey, replace(replace({picked}, '{{a}}', a::VARCHAR), '{{b}}', b::VARCHAR) AS text FROM r),
w AS (
  SELECT c_custkey, 0 AS i, 'P' AS st, 0 AS skip, '' AS prev, '' AS c, '' AS kind FROM s
  UNION ALL
  SELECT c_custkey, i, after, CASE WHEN skip > 0 THEN skip - 1 WHEN push <> '' THEN right(push, 1)::INT WHEN esc THEN 1 ELSE 0 END,
    CASE WHEN len(after) < len(st) AND t <> 'L' AND t <> 'E' AND right(after, 1) IN ('P', 'E') THEN '"' WHEN right(after, 1) = 'E' AND (push <> '' OR (skip = 1 AND t = 'E')) THEN '{{' WHEN t IN ('P', 'E') AND push = '' AND c NOT IN (' ', chr(10)) THEN right(prev || c, 6) ELSE prev END,
    c, CASE WHEN len(st) = 1 AND len(after) = 1 THEN 'P' WHEN len(st) = 1 THEN CASE WHEN right(after, 1) IN ('L', 'B') THEN 'c' WHEN right(after, 1) = 'R' THEN 'r' ELSE 's' END
      WHEN len(after) = 1 AND t = 'L' THEN 'P' WHEN substr(st, 2, 1) IN ('L', 'B', 'X') THEN 'C' ELSE 'S' END
  FROM (SELECT *, CASE WHEN push <> '' THEN st || left(push, 1) WHEN swap <> '' THEN left(st, len(st) - 1) || swap WHEN pop THEN left(st, len(st) - 1) ELSE st END AS after
  FROM (SELECT *, CASE WHEN skip > 0 THEN '' WHEN t IN ('P', 'E') THEN CASE {opens} ELSE '' END ELSE CASE {inside} ELSE '' END END AS push,
      CASE WHEN skip > 0 THEN '' ELSE CASE {swaps} ELSE '' END END AS swap, skip = 0 AND ({closes}) AS pop, skip = 0 AND {escapes} AND c = '\\' AS esc
  FROM (SELECT w.c_custkey, w.i + 1 AS i, st, skip, prev, right(st, 1) AS t, substr(text, w.i + 1, 1) AS c, substr(text, w.i + 2, 1) AS n, substr(text, w.i + 3, 1) AS m FROM w JOIN s USING (c_custkey) WHERE w.i < len(text))))
), g AS (SELECT *, sum(CASE WHEN kind = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY c_custkey ORDER BY i) AS k, CASE WHEN kind IN ('s', 'r', 'P', 'c') THEN i END AS mark FROM w WHERE i > 0),
h AS (SELECT *, max(mark) OVER (PARTITION BY c_custkey ORDER BY i) AS begun FROM g),
x AS (SELECT h.*, b.kind AS of FROM h JOIN g AS b ON b.c_custkey = h.c_custkey AND b.i = h.begun)
SELECT c_custkey,
  string_agg(CASE WHEN kind = 'P' THEN c WHEN kind IN ('s', 'r') THEN '"CHAINE"' WHEN c = chr(10) THEN c ELSE '' END, '' ORDER BY i) AS code,
  string_agg(CASE WHEN kind IN ('c', 'C') OR c = chr(10) THEN c ELSE '' END, '' ORDER BY i) AS comment,
  max(k)::INT AS n_strings, sha256(coalesce(string_agg(CASE WHEN kind = 's' AND k > 1 THEN '|' ELSE '' END || CASE WHEN of = 's' THEN c ELSE '' END, '' ORDER BY i), '')) AS strings
FROM x GROUP BY c_custkey
"""


_QUERIES = {f"q44_{x.lower()}_views": (views_query(x), views_sql(x)) for x in PIECES}


def queries() -> dict:
    return {name: run for name, (run, _) in _QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _QUERIES.items()}
