r"""Nodes of source texts as an edge table, and metrics that need nesting.

A node is a line that opens a construct (function, class, loop, condition, try, switch). Its depth comes from
indentation (Python) or from the braces before it (languages with braces); its parent is the nearest node
before it that is less deep and not closed. Enclosing nodes are found in one pass over a text's lines with a stack;
siblings are window functions over (file, parent), whose size is that of one text.

Defined cases: null texts have no nodes; comments and strings are blanked first; a file key may repeat, and
its rows' nodes are kept apart by ``part`` (the row's number within its task and task number); unbalanced
braces never give a negative depth.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.lexers import LEXERS, lexical_views
from tessera.functions.views import FAMILY_OF, code_view
from tessera.staging import written

#: Kinds and how a line that opens one begins or reads, in order; the first that fits counts.
PYTHON_KINDS = [
    ("function", r"^\s*(?:async\s+)?def\s+(\w+)"),
    ("class", r"^\s*class\s+(\w+)"),
    ("if", r"^\s*if\b"),
    ("elif", r"^\s*elif\b"),
    ("else", r"^\s*else\s*:"),
    ("for", r"^\s*(?:async\s+)?for\b"),
    ("while", r"^\s*while\b"),
    ("try", r"^\s*try\s*:"),
    ("except", r"^\s*except\b"),
    ("finally", r"^\s*finally\s*:"),
    ("with", r"^\s*(?:async\s+)?with\b"),
]
BRACE_KINDS = [
    ("class", r"\b(?:class|interface|struct|enum|trait|object)\s+(\w+)"),
    ("if", r"\belse\s+if\s*\("),
    ("if", r"^\s*\}?\s*if\b"),
    ("else", r"\belse\b"),
    ("for", r"\b(?:for|foreach)\s*\("),
    ("while", r"\bwhile\s*\("),
    ("do", r"^\s*do\b"),
    ("switch", r"\b(?:switch|when)\s*\("),
    ("try", r"\btry\b"),
    ("catch", r"\bcatch\b"),
    ("finally", r"\bfinally\b"),
    ("function", r"\b(?:function|func|fun|def|sub)\s+(\w+)\s*\("),
    ("function", r"^\s*(?:[\w<>\[\],.:&*~]+\s+)+~?(\w+)\s*\([^;=]*$"),
]


def _kind(line: Column, kinds: list[tuple[str, str]]) -> tuple[Column, Column]:
    kind, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, p in reversed(kinds):
        fits = F.rlike(line, F.lit(p))
        kind = F.when(fits, F.lit(k)).otherwise(kind)
        name = F.when(fits, F.regexp_extract(line, p, 1) if "(\\w+)" in p else F.lit(None).cast("string")).otherwise(name)
    return kind, name


def _lines(code: Column, braces: bool) -> Column:
    """(n, line, a, b, c) of each line that isn't blank: its indentation, or its opened and closed braces and whether it begins with a closed one."""
    count = lambda line, sign: F.length(line) - F.length(F.replace(line, F.lit(sign), F.lit("")))
    indent = lambda line: F.length(F.regexp_extract(F.regexp_replace(line, "\t", "        "), r"^( *)", 1))

    def one(line: Column, i: Column) -> Column:
        a, b, c = (count(line, "{"), count(line, "}"), F.rlike(line, F.lit(r"^\s*\}")).cast("int")) if braces else (indent(line), F.lit(0), F.lit(0))
        return F.struct((i + 1).alias("n"), line.alias("line"), a.alias("a"), b.alias("b"), c.alias("c"))

    return F.filter(F.transform(F.split(code, "\n", -1), one), lambda r: F.trim(r["line"]) != "")


def nested(braces: bool):
    """A function of the arrays n, a, b, c and opened (of a text's lines): for each opened line its depth, parent (0: none), nesting and last line.

    One pass with a stack of what is open, which no column expression has.
    """

    @F.pandas_udf("depth array<int>, parent array<int>, nesting array<int>, last array<int>")
    def fold(ns: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series, opened: pd.Series) -> pd.DataFrame:
        out: dict[str, list] = {"depth": [], "parent": [], "nesting": [], "last": []}
        for row in zip(ns, a, b, c, opened):
            depths, parents, nestings, lasts = [], [], [], []
            stack: list[tuple[int, int, int]] = []  # depth, line and place of each node that is open
            now, line = 0, 0
            for n, up, down, leads, kind in zip(*(x.tolist() for x in row)):
                depth = max(0, now - leads) if braces else up
                now = max(0, now + up - down)
                while stack and stack[-1][0] >= depth:
                    lasts[stack.pop()[2]] = n - 1
                line = n
                if kind:
                    depths.append(depth)
                    parents.append(stack[-1][1] if stack else 0)
                    nestings.append(len(stack))
                    stack.append((depth, n, len(lasts)))
                    lasts.append(0)
            for _, _, at in stack:
                lasts[at] = line
            for k, v in zip(out, (depths, parents, nestings, lasts)):
                out[k].append(v)
        return pd.DataFrame(out)

    return fold


def nodes(files: DataFrame, language: str, key: str, text: str = "text") -> DataFrame:
    """(key, part, node_id: its line, parent_id (null at the top), kind, name, depth, nesting, last_line, statement).

    A projection and an explode: no shuffle. A node's lines, node_id to last_line, hold those of all nodes below it. Nodes are written
    once, so that whoever joins them with themselves sees the same parts: rows that come out of a shuffle have no order.
    """
    family = FAMILY_OF.get(language, "none")
    braces = family != "python"

    def opened(l: Column) -> Column:
        kind, name = _kind(l["line"], BRACE_KINDS if braces else PYTHON_KINDS)
        return F.struct(l["n"].alias("node_id"), kind.alias("kind"), name.alias("name"), F.trim(l["line"]).alias("statement"))

    code = lexical_views(F.col(text), language)["code"] if language in LEXERS else code_view(F.col(text), family)
    rows = files.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("part"), _lines(code, braces).alias("lines"))
    rows = rows.withColumn("opened", F.transform("lines", opened))
    fold = nested(braces)("lines.n", "lines.a", "lines.b", "lines.c", F.transform("opened", lambda x: x["kind"].isNotNull()))
    found = rows.select("key", "part", F.filter("opened", lambda x: x["kind"].isNotNull()).alias("x"), fold.alias("f"))
    each = found.select("key", "part", F.explode(F.arrays_zip("x", F.col("f.depth").alias("depth"), F.col("f.parent").alias("parent"), F.col("f.nesting").alias("nesting"), F.col("f.last").alias("last"))).alias("e"))
    own = each.select(
        F.col("key").alias(key), "part", "e.x.node_id", F.when(F.col("e.parent") > 0, F.col("e.parent")).alias("parent_id"), "e.x.kind", "e.x.name", "e.depth", "e.nesting", F.col("e.last").alias("last_line"), "e.x.statement"
    )
    return written(own, "nodes")


def with_siblings(found: DataFrame, key: str) -> DataFrame:
    """Nodes with the kinds of the sibling before and the sibling after."""
    own = Window.partitionBy(key, "part", "parent_id").orderBy("node_id")
    return found.withColumn("previous_kind", F.lag("kind").over(own)).withColumn("next_kind", F.lead("kind").over(own))


def parameters(statement: Column) -> Column:
    """The number of parameters in a function's opening line."""
    inside = F.regexp_extract(statement, r"\(([^()]*(?:\([^()]*\)[^()]*)*)", 1)
    flat = F.regexp_replace(F.regexp_replace(inside, r"\([^()]*\)|\[[^\[\]]*\]|<[^<>]*>", ""), r"(?<![\w])self\s*,?|(?<![\w])cls\s*,?", "")
    return F.when(F.trim(flat) == "", 0).otherwise(F.size(F.filter(F.split(flat, ","), lambda p: F.trim(p) != "")))


#: Parameters that a function may have, by language, and in languages without a limit of their own.
PARAMETERS = {"TSql": 5, "PlSql": 7, "Java": 7, "Groovy": 7, "Go": 7, "ObjC": 4, "Scala": 4, "Python": 3, "CS": 2}
OTHER_PARAMETERS = 5


def node_metrics(found: DataFrame, key: str, long_function: int = 60, many_parameters: int | None = None, deep: int = 4, language: str = "") -> DataFrame:
    """One row for each file that has nodes: counts by kind, functions that are long or take many parameters, deep nodes, missing last elses.

    ``many_parameters`` is the language's limit where it isn't given.
    """
    many_parameters = PARAMETERS.get(language, OTHER_PARAMETERS) if many_parameters is None else many_parameters
    f = F.col("kind") == "function"
    size = F.col("last_line") - F.col("node_id") + 1
    linked = with_siblings(found, key)
    open_chain = F.col("kind").isin("elif") & (F.coalesce("next_kind", F.lit("")).isin("elif", "else") == F.lit(False))
    counts = {k: F.count_if(F.col("kind") == k) for k in ("function", "class", "if", "for", "while", "try", "switch")}
    return linked.groupBy(key).agg(
        *[c.alias(f"n_{k}") for k, c in counts.items()],
        F.count_if(f & (size > long_function)).alias("long_functions"),
        F.count_if(f & (parameters(F.col("statement")) > many_parameters)).alias("many_parameters"),
        F.count_if(F.col("nesting") >= deep).alias("deep_nodes"),
        F.count_if(open_chain).alias("missing_final_else"),
        F.max("nesting").alias("max_nesting"),
        F.avg(F.when(f, size)).alias("function_lines_average"),
    )
