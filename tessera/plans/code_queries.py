r"""Queries over sources that are made from the tables' rows: metrics of each language, units, and text functions.

Each digit of a part's key, to the base of the number of a language's snippets, picks one of them, so the first 5,000
files at least all differ. The SQL cuts the same texts into the same views with another regex engine.
Metrics whose patterns look around (which that engine lacks) and the two that fold over brackets are left to
the tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import views as V
from tessera.functions.literals import FINDINGS
from tessera.operators import cloud as Cloud
from tessera.operators import metrics as M
from tessera.sources import files as S
from tessera.staging import dealt

#: A language's snippets make at least so many different files.
DIFFERENT = 5000

#: Snippets of each language.
SNIPPETS = {
    "CCpp": ["#  include \"C:\\lib\\y.h\"\n#include </usr/include/z.h>\n// #include \"/no/w.h\"", "#include <stdio.h>\n#include \"/abs/x.h\"\n#define MAX 100\n#define SQ(x) ((x)*(x))", "int main(void) {\n  char buf[256];\n  if (a = b) goto end; // TODO check\n  strcpy(buf, argv[1]);\n  printf(\"%s\", buf);\n  return 0;\n}", "/* if (x) {\n   old(); */\nfor (i = 0; i < 10; i++) { x += 3.14; }", "class A : public B {\n public:\n  virtual ~A();\n  explicit A(int x) { delete this; }\n};", "using namespace std;\nint *p = new int[5];\ndelete [] p;\ncout << static_cast<int>(3.5);", "try { f(); } catch (...) { }\ntry { g(); } catch (Exception e) { throw; }", "switch (x) {\n case 1: break;\n default: y = x ? 1 : 2;\n}", "#if defined(A)\n#pragma once\n#endif\nwhile (p != NULL && *p) p->next = q--;", "namespace { const int limit = 500; }\ntemplate <typename T> T twice(T t) { return 2 * t; }", "// ???\nsystem(\"rm -rf /tmp/x\"); do { x = y = 0; } while (0);;"],
    "Java": ["import java.util.*;\nimport java.io.File;\npackage a.b;", "public class A extends B implements C {\n  static final int N = 42;\n  private volatile int x = 1234;\n}", "try { run(); } catch (Exception e) { e.printStackTrace(); } finally { close(); }", "if (a == \"x\" || b.getClass() == c.getClass()) System.out.println(\"hello\");", "// FIXME: remove\nfor (int i = 0; i < 10; i++) { new Integer(5); System.gc(); }", "@Override\npublic String toString() { return x ? \"a\" : \"b\"; }", "/* case 1: old */\nswitch (k) { case 1: break; default: continue; }", "throw new RuntimeException(\"no\");\nsynchronized (this) { assert x > 0xFF; }", "new Thread(r).start(); Thread.sleep(100); System.exit(1);;", "StringBuffer s = new StringBuffer(); while (true) { if (o instanceof A) return; else break; }"],
    "CS": ["using System;\nnamespace N {\n  sealed partial class A { }\n}", "#region x\n[Serializable]\npublic event Handler H;\n#endregion", "try { f(); } catch { }\ntry { g(); } catch (Exception) { throw new Exception(\"x\"); }", "foreach (var x in xs) { Console.WriteLine(\"{0}\", x); }", "lock (o) { unsafe { GC.Collect(); } }", "async Task F() { await G(); dynamic d = 7; var s = o as string; if (o is int) goto end; }", "// TBD\nswitch (x) { case 10: break; default: return; }", "~A() { y = x ? 12 : 13; }"],
    "JS": ["var x = 1, y = 20; let z = null; const w = 300;", "function f(a) { if (a == 1 && b != 2) { alert(\"x\"); } else { return void 0; } }", "for (var k in o) { delete o[k]; console.log(k); }", "document.write(\"<p>\"); setTimeout(function() { eval(\"1\"); }, 1000);", "Array.prototype.last = function() { return this[this.length - 1]; };", "const g = async (a) => { await h(a); debugger; };", "// todo: later\ntry { x.innerHTML = \"a\"; } catch (e) { } finally { }", "switch (typeof x) { case \"a\": break; default: throw new Error(\"x\"); }", "class A { } export default A; import b from \"b\"; parseInt(x);", "/* while (x) { */\nwith (o) { y = z ? 1 : 2; } do { } while (q instanceof R);"],
    "TypeScript": ["interface A { readonly x: any; }\ntype B = string | number;", "enum C { X, Y }\nnamespace N { let a = b as string; }", "@Component\nclass D { constructor(private e: any) { f<string>(e!.g); } }", "function h(x) { if (x == 1) return 99; console.log(\"x\"); }", "// attention!!\nfor (const i of j) { switch (i) { case 1: break; } }"],
    "PHP": ["<?php\nfunction f($a) { global $b; echo \"x\" . \"y\"; return $a; }", "if ($_GET[\"q\"]) { include \"a.php\"; } elseif ($x) { die(\"no\"); }", "@fopen($f); mysql_query(\"select\"); system(\"ls\"); eval($c);", "# TODO\nforeach ($a as $k) { $$k = 12; unset($a[$k]); } ?>", "class A { static $x = 5; var $y; function __construct() { $this->z = new B; } }", "try { require_once \"b.php\"; } catch (Exception $e) { } <? print 42;"],
    "Go": ["package main\nimport \"fmt\"\nfunc main() { fmt.Println(\"x\") }", "func (s *S) F(a int) error { if err != nil { return err } else { panic(\"x\") } }", "go func() { defer mu.Unlock(); x := make(chan int) }()", "// fixme\nfor _, v := range m { switch v { case 1: fallthrough; default: continue } }", "type T struct { m map[string]interface{} }\nvar a, b = 10, 200", "func init() { time.Sleep(500); select { case <-c: recover() } }"],
    "Kotlin": ["fun f(x: Int) = x ?: 3\nval a = b!!", "data class A(val x: Int, var y: String?) { companion object { } }", "when (x) { is Int -> println(1) else -> y?.z }", "sealed class B; lateinit var c: C; override suspend fun g() { }", "xs.map { a, b -> a + b }; val d = e as F;\n// tbc", "for (i in 1..10) { if (i > 5) continue else break }"],
    "Scala": ["import a.b._\ncase class A(x: Int) extends B with C", "object M { lazy val x = 10; implicit def f(y: Int): String = y match { case 1 => null } }", "sealed trait T { override def g = println(\"x\") }", "for (i <- xs) yield i.asInstanceOf[Int] // !!", "var z = 5; try { h() } catch { case e: Exception => throw e }"],
    "Ruby": ["class A\n  @@n = 1\n  def f; yield self; end\nend", "if x then puts \"a\" elsif y then raise :bad else nil end", "begin\n  eval(\"1\")\nrescue\n  retry\nensure\n  $g = 2\nend", "xs.each do |x|\n  next unless x\n  break until y\nend # todo", "module M; require \"a\"; case z when 1; redo; end; end"],
    "Swift": ["func f(_ x: Int?) throws { guard let y = x else { return } }", "let a = b! \nlet c = try! d() as! E\nvar g = h?.i", "struct S { weak var t: T? = nil; init() { self.u = 10 } }", "extension A: P { func k(inout z: Int) { defer { print(\"x\") } } }", "// ???\nswitch q { case 1: fallthrough; default: break }\nrepeat { } while r"],
    "Rust": ["fn main() { let mut x = 10; println!(\"{}\", x); }", "impl T for S { pub fn g(&self) -> i32 { self.x.unwrap() } }", "match y { Some(z) => z.clone(), None => panic!(\"x\") }", "unsafe { let a = &mut b; loop { break; } }", "use std::io; mod m; enum E { A, B } // tbd", "async move { f().await.expect(\"e\"); vec![1, 2] }"],
    "PlSql": ["select /*+ full(t) */ a from t where b like '%x' and c like 'y%' and d LIKE '_z'", "create or replace procedure p as\nbegin\n  select * into x from t, u where a = null;\nend;", "-- todo\ncursor c is select distinct a from t order by 1;\nopen c; fetch c into x; close c;", "insert into t values (1, 'x'); update t set a = 'b' where c is null; delete from t;", "exception when others then rollback; raise; end;", "execute immediate 'drop table x'; commit; savepoint s; goto l;", "select a from t left outer join u on t.i = u.i where not exists (select 1 from v) group by a having count(*) > 1 union all select b from w;", "create index i on t (a); alter table t add b number; grant select on t to u; truncate table x;", "if a then b; elsif c then d; else e; end if; while x loop y; end loop; case when a like '%x' then 1 end", "merge into t using u on (a = b); lock table t in share mode; dbms_output.put_line('x'); return 1;"],
    "TSql": ["select /*+ full(t) */ a from t where b like '%x' and c like 'y%' and d LIKE '_z'", "create procedure p as select * from t with (nolock) where a <> null", "declare @x int; exec sp_executesql @s; print @@rowcount; waitfor delay '0:0:1'", "select a into #t from u cross join v; drop table #t; -- tbc", "begin transaction; update t set a = 1; commit", "create view v as select a from t natural join u where b in (select c from d)"],
    "Python": ["import os\nfrom a import *\nclass A:\n    def __init__(self, x=[]):\n        self.y = None", "def f(a, b={}):\n    if a == None or b is not None:\n        print('x')\n    elif type(a) == int:\n        return [i for i in b]\n    else:\n        pass", "try:\n    exec('1')\nexcept:\n    raise\nfinally:\n    os.system('ls')", "@wraps\nasync def g():\n    await h()\n    with open('f') as k: yield k", "# to be done\nfor x in y:\n    while True:\n        break\n    continue", "def _hidden():\n    global n; n = 1; del n\n    assert x != True\n    return lambda z: z + \\\n        1"],
    "Ksh": ["#!/bin/ksh\nset -e\nif [ -f \"$1\" ]; then\n  echo `date` | tee x\nfi", "for f in $(ls); do cat $f | grep a; done # todo", "while read l; do eval $l; sleep 1; done < f", "case $x in a) rm -rf y;; esac\nexport P=1; exit 2", "function g { local z=$((1+2)); return $z; } >> log &\ntrap 'kill $p' 0"],
    "HTML": ["<html><head><meta x=\"1\"><script>var a;</script><style>b</style></head>", "<!-- old\nmenu --><div style=\"c\"><p onclick=\"f()\">x</p></div>", "<ul><li><a href=\"d\">e</a></li></ul><img src=\"f.png\">", "<form><input name=\"g\"><label>h</label><button>i</button></form>", "<table><tr><td><font>j</font></td></tr></table><h1>k</h1><iframe></iframe>", "<%@ page %><%! int l; %><%= m %><% n(); %><c:if o=\"1\"><span>p</span><object></object>"],
    "Cobol": ["       PERFORM A UNTIL B.\n       GO TO C.", "       COPY D. CALL E. EXEC SQL SELECT END-EXEC. STOP RUN.", "       MAIN-PARA.\n       01 X OCCURS 5."],
}


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _digits(n: int) -> list[int]:
    """What a key is divided by for each of its digits to the base ``n``."""
    return [n**k for k in range(20) if k == 0 or n**k < DIFFERENT]


def _picked(own: list[str]) -> list:
    """A snippet for each digit of a part's key."""
    table = F.array(*[F.lit(x) for x in own])
    return [F.element_at(table, (F.floor(F.col("p_partkey") / d) % len(own) + 1).cast("int")) for d in _digits(len(own))]


def _picked_sql(own: list[str]) -> str:
    table = "[" + ", ".join(map(_quoted, own)) + "]"
    return ", ".join(f"({table})[p_partkey // {d} % {len(own)} + 1]" for d in _digits(len(own)))


def sources(spark: SparkSession, sf_dir: str, language: str) -> DataFrame:
    """(p_partkey, text): a file of the language for each part."""
    picked = _picked(SNIPPETS[language])
    return dealt(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")).select("p_partkey", F.concat_ws("\n", *picked).alias("text"))


def sources_sql(language: str) -> str:
    return f"SELECT p_partkey, concat_ws(chr(10), {_picked_sql(SNIPPETS[language])}) AS text FROM part"


def _re2(pattern: str) -> str:
    """A pattern of the views without possessive loops and without what looks around."""
    return pattern.replace("*+", "*").replace("++", "+").replace(r"(?<=\n.{6})", "").replace(r"(?<=\n)", "")


def views_sql(table: str, key: str, text: str, family: str) -> str:
    """CTEs that end with ``v`` (key, text, code, bare, comment, strings)."""
    f = V.FAMILIES[family]
    token = _quoted(rf"(?s)(?:{_re2(f.comment)})|(?:{_re2(f.string)})|[^{f.starts}]+|.".replace("\\x00", "\x01"))
    comment, string = _quoted(rf"(?s)^(?:{_re2(f.comment)})"), _quoted(rf"(?s)^(?:(?:{_re2(f.string)})$)")
    if family == "none":
        comment = string = "'^[^\\s\\S]$'"
    ends = "regexp_replace(x, '[^\\n]+', '', 'g')"
    return f"""s AS ({table}), t AS (SELECT {key}, {text} AS text, regexp_extract_all({text}, {token}) AS t FROM s),
v AS (SELECT {key}, text, coalesce(array_to_string(list_transform(t, lambda x: CASE WHEN regexp_matches(x, {comment}) THEN {ends} WHEN regexp_matches(x, {string}) THEN '"CHAINE"' || {ends} ELSE x END), ''), '') AS code,
  coalesce(array_to_string(list_transform(t, lambda x: CASE WHEN regexp_matches(x, {comment}) THEN {ends} ELSE x END), ''), '') AS bare,
  coalesce(array_to_string(list_transform(t, lambda x: CASE WHEN regexp_matches(x, {comment}) THEN x ELSE {ends} END), ''), '') AS comment, list_filter(t, lambda x: NOT regexp_matches(x, {comment}) AND regexp_matches(x, {string})) AS strings FROM t)"""


def code_sql(text: str, family: str) -> str:
    """The code view of a text as an expression."""
    f = V.FAMILIES[family]
    token, comment, string = _quoted(rf"(?s)(?:{_re2(f.comment)})|(?:{_re2(f.string)})|[^{f.starts}]+|."), _quoted(rf"(?s)^(?:{_re2(f.comment)})"), _quoted(rf"(?s)^(?:(?:{_re2(f.string)})$)")
    ends = "regexp_replace(x, '[^\\n]+', '', 'g')"
    return f"""coalesce(array_to_string(list_transform(regexp_extract_all({text}, {token}), lambda x: CASE WHEN regexp_matches(x, {comment}) THEN {ends} WHEN regexp_matches(x, {string}) THEN '"CHAINE"' || {ends} ELSE x END), ''), '')"""


def _lines(column: str, keep: str, terminated: bool) -> str:
    own = f"string_split({column}, chr(10))"
    own = f"({own})[1 : len({own}) - 1]" if terminated else own
    return f"len(list_filter({own}, lambda l: {keep}))::BIGINT"


_MARKS = r"[!?][!?]+|\b(?:a)\s+(?:verifier|faire|voir|revoir)|\b(?:todo|fixme|tbc|tbd|attention)\b"
#: Text whose letters beyond ASCII count as letters and whose other signs don't, for an engine whose word edges are ASCII's.
ASCII = r"regexp_replace(regexp_replace({0}, '[^\x00-\x7F\p{{L}}\p{{N}}]', ' ', 'g'), '[^\x00-\x7F]', 'x', 'g')"


def suspicious_sql(column: str, international: bool = False) -> str:
    marks = _MARKS + (r"|to\s+be\s+(?:verified|done)|\bwarning\b" if international else "")
    return _lines(ASCII.format(f"translate(lower({column}), 'àé', 'ae')"), f"regexp_matches(l, {_quoted(marks)})", False)


def commented_out_sql(column: str) -> str:
    bare = r"regexp_replace(l, '^[\s/*]+|[\s/*]+$', '', 'g')"
    word, rest = f"regexp_extract({bare}, '^[a-z]+')", rf"regexp_replace({bare}, '^[a-z]+\s*', '')"
    listed = lambda k: "(" + ", ".join(map(_quoted, T.STARTS[k])) + ")"
    keep = f"right({bare}, 1) IN (';', '{{', '}}') OR ({word} IN {listed('bracket')} AND starts_with({rest}, '(')) OR {word} IN {listed('alone')} OR ({word} IN {listed('colon')} AND contains({rest}, ':'))"
    return _lines(column, keep, False)


def magic_sql(column: str) -> str:
    statements = rf"list_filter(regexp_split_to_array({column}, '[\n;]'), lambda s: NOT regexp_matches(s, '^\s*#\s*define\b|^\s*(?:const|final)\b[^=]*='))"
    words = rf"flatten(list_transform({statements}, lambda s: regexp_extract_all(s, '[\w.]+')))"
    return rf"coalesce(len(list_filter({words}, lambda w: regexp_matches(w, '^\.?\d') AND NOT regexp_matches(w, '^(?:0*\d|[01]?\.0?)\.*$'))), 0)::BIGINT"


def ternary_sql(column: str) -> str:
    bare = rf"regexp_replace({column}, '<\s*\?\s*>', '', 'g')"
    return f"(length({bare}) - length(replace({bare}, '?', '')))::BIGINT"


_LAYOUT = r"array_to_string(list_transform(list_zip(string_split(code, chr(10)), string_split(comment, chr(10))), lambda z: (CASE WHEN regexp_matches(z[1], '\S') THEN 'P' ELSE '' END) || (CASE WHEN regexp_matches(z[2], '\S') THEN 'C' ELSE '' END)), chr(10))"
_PACKED = rf"(regexp_replace(regexp_replace({_LAYOUT}, '\n+', chr(10), 'g'), '^\n|\n$', '', 'g') || chr(10))"
FUNCTIONS = {
    "LinesOfCode": _lines("code", r"regexp_matches(l, '\S')", True),
    "BlankLines": _lines("text", r"NOT regexp_matches(l, '\S')", True),
    "CommentLines": _lines("comment", r"regexp_matches(l, '\S')", True),
    "AlphaNumCommentLines": _lines("comment", "regexp_matches(l, '[A-Za-z0-9]')", True),
    "CommentBlocs": rf"(len(regexp_extract_all({_PACKED}, '(?m)^PC$')) + len(regexp_extract_all({_PACKED}, '(?m)(?:^C\n)+')))::BIGINT",
    **{f"LongLines{n}": _lines("text", f"length(l) > {n}", False) for n in (80, 100, 120, 132)},
    "SuspiciousComments": suspicious_sql("comment"),
    "CommentedOutCode": commented_out_sql("comment"),
    "MagicNumbers": magic_sql("code"),
    "TernaryOperators": ternary_sql("code"),
}
#: Rules of the SQL's own for what a view must show: hints stand in comments, wildcards and paths in literals.
OWN = {
    "Hints": "((length(comment) - length(replace(comment, '/*+', ''))) // 3)::BIGINT",
    "LikeLeadingWildcards": r"len(list_filter(string_split(lower(regexp_replace(bare, '\s+', ' ', 'g')), 'like ' || chr(39))[2:], lambda x: left(x, 1) IN ('%', '_')))::BIGINT",
    "AbsoluteIncludes": r"len(list_filter(list_transform(string_split(bare, chr(10)), lambda l: replace(replace(l, ' ', ''), chr(9), '')), lambda l: left(l, 8) = '#include' AND (substr(l, 10, 1) IN ('/', '\') OR (substr(l, 11, 1) = ':' AND substr(l, 12, 1) IN ('/', '\')))))::BIGINT",
}


def comparable_metrics(language: str) -> list[M.Metric]:
    """The metrics of a language that the SQL can count."""
    return [m for m in M.profile(language) if (m.kind == "fn" and m.name in FUNCTIONS) or (m.kind == "count" and not any(x in m.rule for x in ("(?=", "(?!", "(?<")))]


def metrics_sql(language: str, table: str, key: str, text: str) -> str:
    def one(m: M.Metric) -> str:
        if m.name in OWN:
            return f'{OWN[m.name]} AS "{m.name}"'
        if m.kind == "count":
            return f'len(regexp_extract_all({m.view}, {_quoted(m.rule)}))::BIGINT AS "{m.name}"'
        own = suspicious_sql("comment", True) if m.name == "SuspiciousComments" and language == "Python" else FUNCTIONS[m.name]
        return f'{own} AS "{m.name}"'

    return f"WITH {views_sql(table, key, text, V.FAMILY_OF.get(language, 'none'))} SELECT {key}, {', '.join(map(one, comparable_metrics(language)))} FROM v"


def metrics_query(language: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return M.file_metrics(sources(spark, sf_dir, language), language, ["p_partkey"], only=[m.name for m in comparable_metrics(language)], findings=False)

    run.__doc__ = f"All metrics of {language} that SQL can count, over sources made from parts."
    return run


# Units, literals, text functions


def q31_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored units of made PL/SQL files, with their first lines and statements."""
    found = M.units(sources(spark, sf_dir, "PlSql"), "PlSql", "p_partkey")
    return found.select("p_partkey", "unit", "unit_name", "first_line", T.count_of(F.col("text"), ";").alias("statements"))


Q31 = rf"""
WITH s AS ({sources_sql('PlSql')}),
p AS (SELECT p_partkey, string_split(regexp_replace(text, '(?im)^([ \t]*create\s+(?:or\s+replace\s+)?(?:procedure|function|package|trigger)\b)', chr(1) || '\1', 'g'), chr(1)) AS p FROM s),
u AS (SELECT p_partkey, p, unnest(p) AS text, generate_subscripts(p, 1) AS i FROM p),
w AS (SELECT p_partkey, text, len(p) AS n, i, coalesce(sum(len(text) - len(replace(text, chr(10), ''))) OVER (PARTITION BY p_partkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS first_line FROM u)
SELECT p_partkey, (row_number() OVER (PARTITION BY p_partkey ORDER BY i))::INT AS unit, regexp_extract(text, '(?i)^[ \t]*create\s+(?:or\s+replace\s+)?(?:procedure|function|package(?:\s+body)?|trigger)\s+([\w.$#"\[\]]+)', 1) AS unit_name,
  first_line::INT AS first_line, (len(text) - len(replace(text, ';', '')))::BIGINT AS statements
FROM w WHERE n = 1 OR regexp_matches(text, '(?i)^[ \t]*create\s+(?:or\s+replace\s+)?(?:procedure|function|package|trigger)\b')
"""


def q32_unit_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of units, with the file's blank lines and those of code in each."""
    found = M.unit_metrics(sources(spark, sf_dir, "PlSql"), "PlSql", "p_partkey", ["BlankLines", "LinesOfCode"])
    return found.groupBy("p_partkey").agg(F.count("*").alias("units"), F.max("LinesOfCode").alias("lines"), F.sum("Select").alias("selects"), F.sum("Update").alias("updates"))


Q32 = rf"""
WITH m AS ({metrics_sql('PlSql', sources_sql('PlSql'), 'p_partkey', 'text')}), s AS ({sources_sql('PlSql')}),
p AS (SELECT p_partkey, string_split(regexp_replace(text, '(?im)^([ \t]*create\s+(?:or\s+replace\s+)?(?:procedure|function|package|trigger)\b)', chr(1) || '\1', 'g'), chr(1)) AS p FROM s),
u AS (SELECT p_partkey, len(p) AS n, unnest(p) AS text FROM p),
k AS (SELECT p_partkey, text FROM u WHERE n = 1 OR regexp_matches(text, '(?i)^[ \t]*create\s+(?:or\s+replace\s+)?(?:procedure|function|package|trigger)\b')),
c AS ({views_sql('SELECT p_partkey, text FROM k', 'p_partkey', 'text', 'sql').replace('s AS (', 'WITH s AS (', 1)} SELECT p_partkey, count(*) AS units, sum(len(regexp_extract_all(code, '(?i)\bselect\b')))::BIGINT AS selects, sum(len(regexp_extract_all(code, '(?i)\bupdate\b')))::BIGINT AS updates FROM v GROUP BY p_partkey)
SELECT p_partkey, units, "LinesOfCode" AS lines, selects, updates FROM c JOIN m USING (p_partkey)
"""


def q33_literal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String literals of made Java files with their lines."""
    return M.literal_lines(sources(spark, sf_dir, "Java"), "Java", "p_partkey").groupBy("p_partkey", "line").agg(F.count("*").alias("literals"), F.min("literal").alias("first"))


Q33 = rf"""
WITH {views_sql(sources_sql('Java'), 'p_partkey', 'text', 'c')},
u AS (SELECT p_partkey, unnest(t) AS x, generate_subscripts(t, 1) AS i FROM t),
w AS (SELECT p_partkey, x, coalesce(sum(len(x) - len(replace(x, chr(10), ''))) OVER (PARTITION BY p_partkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS line FROM u)
SELECT p_partkey, line::BIGINT AS line, count(*) AS literals, min(x) AS first FROM w WHERE regexp_matches(x, '(?s)^(?:"(?:[^"\\\n]|\\.)*"|''(?:[^''\\\n]|\\.)*'')$') GROUP BY ALL
"""


def q34_text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bracket splits, splits outside brackets, line ranges, name UUIDs and date stamps of orders' comments and keys."""
    orders = dealt(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus"))
    text = F.concat(F.lit("f("), F.col("o_orderpriority"), F.lit(", [a, "), F.col("o_orderkey").cast("string"), F.lit("], g(b, c)), "), F.col("o_orderstatus"), F.lit(", z"))
    rows = orders.select("o_orderkey", "o_orderdate", text.alias("t"))
    both = T.bracketed(F.col("t"))
    lines = F.replace(F.col("t"), F.lit(", "), F.lit("\n"))
    return rows.select("o_orderkey", both["inside"].alias("inside"), both["behind"].alias("behind"), F.size(T.split_outside(F.col("t"), ",")).alias("parts"), F.size(T.split_outside(both["inside"], ",")).alias("inner_parts"), T.line_range(lines, 2, 3).alias("some_lines"), S.name_uuid(F.col("o_orderkey")).alias("uuid"), S.date_stamp(F.col("o_orderdate")).alias("stamp"))


Q34 = r"""
WITH h AS (SELECT o_orderkey, o_orderdate, o_orderpriority AS p, o_orderstatus AS s, sha256(o_orderkey::VARCHAR) AS h FROM orders)
SELECT o_orderkey, p || ', [a, ' || o_orderkey || '], g(b, c)' AS inside, ', ' || s || ', z' AS behind, 3 AS parts, 3 AS inner_parts, '[a' || chr(10) || o_orderkey || ']' AS some_lines,
  substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-8' || substr(h, 14, 3) || '-' || (['8', '9', 'a', 'b'])[(instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1] || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS stamp
FROM h
"""


def q35_global_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each made page's forms beside those of all pages."""
    pages = M.file_metrics(sources(spark, sf_dir, "HTML"), "HTML", ["p_partkey"], only=["Forms", "Tags"], findings=False)
    return M.with_global_metrics(pages, {"all_forms": F.sum("Forms"), "most_tags": F.max("Tags")})


Q35 = f"""
WITH m AS ({metrics_sql('HTML', sources_sql('HTML'), 'p_partkey', 'text')}), g AS (SELECT sum("Forms")::BIGINT AS all_forms, max("Tags") AS most_tags FROM m)
SELECT p_partkey, "Tags", "Forms", all_forms, most_tags FROM m, g
"""

#: Snippets with what the cloud rules of a technology look for.
CLOUD = {
    "Python": ["import boto3\nc = boto3.client('s3')  # boto3.client('batch')", "t = boto3.resource(region, \"dynamodb\")\nos.environ['A']", "from kubernetes import client\nimport apache_beam as b", "import psycopg2, pymongo\nos.system('x'); os.remove(f)", "with open('f') as g: g.write(KeyWrapper(k))", "from google.cloud import storage\nshutil.copytree(a, b); os.chdir(d)"],
    "Java": ["import java.io.File;\nimport java.io.*;", "new File(\"x\").mkdirs(); f.createNewFile();", "import com.amazonaws.services.sqs.model;\n// new File(y)", "out.write(b); g.renameTo(h); i.isDirectory();", "import redis.clients.jedis.Jedis;"],
    "CS": ["using System.IO;\nusing System.Data.SqlClient;", "File.Move(a, b); Trace.WriteLine(\"x\"); Registry.GetValue(k);", "using RabbitMQ.Client;\n[DllImport(\"a\")]", "ConfigurationManager.AppSettings[\"b\"]; new Process();", "var p = Path.GetTempPath(); // File.Copy"],
}


def cloud_query(techno: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        picked = _picked(CLOUD[techno])
        files = dealt(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")).select("p_partkey", F.concat_ws("\n", *picked).alias("text"))
        counts = Cloud.file_detections(files, techno, ["p_partkey"]).drop(*FINDINGS)
        return Cloud.application_detections(counts, "p_partkey")

    run.__doc__ = f"The cloud rules of {techno} over sources made from parts, at application level."
    return run


def cloud_sql(techno: str) -> str:
    made = f"SELECT p_partkey, concat_ws(chr(10), {_picked_sql(CLOUD[techno])}) AS text FROM part"
    family = V.FAMILY_OF[techno]
    bare = code_sql("text", family).replace(""" WHEN regexp_matches(x, """ + _quoted(rf"(?s)^(?:(?:{_re2(V.FAMILIES[family].string)})$)") + """) THEN '"CHAINE"' || regexp_replace(x, '[^\\n]+', '', 'g')""", "")
    own = {m: f"len(regexp_extract_all(code, {_quoted(p)}))" for m, p in Cloud.rules(techno).items()} | {m: f"len(regexp_extract_all(bare, {_quoted(p)}))" for m, p in Cloud.text_rules(techno).items()}
    counts = ", ".join(f'{c}::BIGINT AS "{m}"' for m, c in own.items())
    return f"""WITH s AS ({made}), v AS (SELECT {code_sql('text', family)} AS code, {bare} AS bare FROM s), c AS (SELECT {counts} FROM v), u AS (UNPIVOT c ON {', '.join(f'"{m}"' for m in own)} INTO NAME mnemonic VALUE n)
SELECT mnemonic, count(*) FILTER (n > 0) AS files, sum(n)::BIGINT AS matches FROM u GROUP BY mnemonic"""


_QUERIES = {f"q30_{x.lower()}_metrics": (metrics_query(x), metrics_sql(x, sources_sql(x), "p_partkey", "text")) for x in SNIPPETS} | {
    **{f"q42_{x.lower()}_cloud": (cloud_query(x), cloud_sql(x)) for x in CLOUD},
    "q31_units": (q31_units, Q31),
    "q32_unit_metrics": (q32_unit_metrics, Q32),
    "q33_literal_lines": (q33_literal_lines, Q33),
    "q34_text_functions": (q34_text_functions, Q34),
    "q35_global_metrics": (q35_global_metrics, Q35),
}


def queries() -> dict:
    return {name: run for name, (run, _) in _QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _QUERIES.items()}
