r"""Packages that R scripts load, with what their variables hold.

A script is cut into events in order: assignments, loops, functions, calls and loads. A variable that is loaded is resolved to the
last assignment of its name before the place where it is used, by one window over (script, name) in order of place; an
assignment that names another variable is a use of that one at its own place, and so on until nothing is left
to resolve. Places fall with each step, so chains end. A loop assigns its variable what it runs over, and a function's first
parameter holds what the script's calls of that function pass.

Defined cases: null texts have no events; names that nothing is assigned to are left out, but for those that ``library(name)`` and the like
load themselves; rows of equal paths are kept apart by ``part``; comments don't count; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.views import bare_view
from tessera.staging import written

_LIST = r"c\s*\([^()]*\)"
_TEXT = r"\"[^\"\n]*\"|'[^'\n]*'"
_NAME = r"[A-Za-z.][\w.]*"
#: Functions that load what they are given, and those that load all their arguments.
LOADS = r"(?:library|require|requireNamespace|loadNamespace|install\.packages|install_load|(?:pacman::)?p_load)"
SEVERAL = ("pacman", "p_load", "install_load")
#: What is worth a look in a script; the first that fits counts.
EVENTS = {
    "function": rf"{_NAME}\s*(?:<-|=)\s*function\s*\(\s*{_NAME}",
    "loop": rf"\bfor\s*\(\s*{_NAME}\s+in\s+(?:{_LIST}|{_NAME}|{_TEXT})",
    "mapped": rf"\b[lsv]apply\s*\(\s*(?:{_LIST}|{_NAME}|{_TEXT})\s*,\s*{_NAME}",
    "load": rf"\b{LOADS}\s*\((?:[^()]|\([^()]*\))*\)",
    "assignment": rf"{_NAME}\s*(?:<-|=(?!=))\s*(?:{_LIST}|{_TEXT}|{_NAME}(?=\s*(?:[\n;}})#]|\z)))",
    "call": rf"\b{_NAME}\s*\(\s*(?:{_LIST}|(?:{_TEXT}|{_NAME})(?=\s*[,)]))",
}


def _items(value: Column) -> Column:
    """The texts in a list, or in a text alone."""
    return F.transform(F.regexp_extract_all(value, F.lit(_TEXT), F.lit(0)), lambda x: F.substring(x, F.lit(2), F.length(x) - 2))


def events(files: DataFrame, text: str = "text") -> DataFrame:
    """(path, part, place, kind, name, other, items): name is what is assigned, other the variable or function that is named, items the texts."""
    own = files.where(F.col(text).isNotNull()).select("path", F.monotonically_increasing_id().alias("part"), bare_view(F.col(text), "shell").alias("code"))
    each = own.select("path", "part", F.posexplode(F.regexp_extract_all("code", F.lit("|".join(EVENTS.values())), F.lit(0))).alias("place", "e"))
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(EVENTS.items()):
        kind = F.when(F.rlike("e", F.lit(rf"\A(?:{pattern.replace(r'(?=\s*(?:[\n;}})#]|\z))', '').replace(r'(?=\s*[,)])', '')})")), F.lit(name)).otherwise(kind)
    e = each.withColumn("kind", kind)
    first = F.regexp_extract("e", rf"\A({_NAME})", 1)
    arg = F.regexp_extract("e", rf"\A[^(]*\(\s*({_NAME})", 1)
    last = F.regexp_extract("e", rf"({_NAME})\z", 1)
    name = F.when(F.col("kind").isin("assignment", "call", "function", "load"), first).when(F.col("kind") == "loop", arg)
    body = F.when(F.col("kind") == "mapped", F.regexp_extract("e", rf"(?s)\A[^(]*\(\s*({_LIST}|{_TEXT}|{_NAME})", 1)).when(F.col("kind") == "loop", F.regexp_extract("e", r"(?s)\bin\s+(.*)\z", 1)).when(F.col("kind") == "assignment", F.regexp_extract("e", r"(?s)(?:<-|=)\s*(.*)\z", 1))
    body = F.coalesce(body, F.regexp_extract("e", r"(?s)\A[^(]*\(\s*(.*)\z", 1))
    argument = F.when((F.col("kind") == "load") & ~first.isin(*SEVERAL), F.regexp_extract(body, rf"(?s)\A({_LIST}|{_TEXT})", 1)).otherwise(body)
    items = F.when(F.col("kind") == "function", F.array().cast("array<string>")).otherwise(_items(argument))
    variable = F.when((F.size("items") == 0) & ~F.rlike("body", F.lit(r"\Ac\s*\(")), F.regexp_extract("body", rf"\A({_NAME})", 1))
    cut = e.withColumn("name", name).withColumn("body", body).withColumn("items", items)
    return cut.select("path", "part", "place", "kind", "name", F.when(F.col("kind") == "function", last).otherwise(F.nullif(variable, F.lit(""))).alias("other"), "items", F.when(F.col("kind") == "mapped", last).alias("applied"), F.col("body").alias("body"))


def _calls(found: DataFrame) -> DataFrame:
    """Assignments of functions' first parameters: what the script's calls pass, at the place of the function."""
    functions = found.where("kind = 'function'").select("path", "part", F.col("name").alias("f"), F.col("other").alias("parameter"), F.col("place").alias("at"))
    passed = found.where("kind IN ('call', 'mapped')").withColumn("f", F.coalesce("applied", "name"))
    return functions.join(passed, ["path", "part", "f"]).select("path", "part", "parameter", "at", "place", "other", "items")


def r_packages(files: DataFrame) -> DataFrame:
    """(path, package): different packages of each script."""
    found = written(events(files), "r-events")
    loads = found.where("kind = 'load'")
    only = F.rlike("body", F.lit(r"character\.only\s*=\s*T"))
    listed = F.filter(F.split(F.regexp_replace("body", r"\)\s*\z", ""), ","), lambda x: F.rlike(x, F.lit(rf"\A\s*{_NAME}\s*\z")))
    bare_names = loads.where(F.col("name").isin(*SEVERAL)).select("path", F.explode(F.transform(listed, lambda x: F.trim(x))).alias("package"))
    quoted = loads.select("path", F.explode("items").alias("package")).union(bare_names)
    named = loads.where((F.size("items") == 0) & F.col("other").isNotNull() & ~F.col("name").isin(*SEVERAL)).select("path", "part", "place", F.col("other").alias("name"), only.alias("only"))
    mapped = found.where(F.col("kind") == "mapped").where(F.rlike("applied", F.lit(rf"\A{LOADS}\z")))
    listed = mapped.select("path", F.explode("items").alias("package"))
    variables = mapped.where("other IS NOT NULL").select("path", "part", "place", F.col("other").alias("name"), F.lit(True).alias("only"))

    set_at = found.where("kind IN ('assignment', 'loop')").select("path", "part", "name", "place", "kind", "other", "items")
    passed = _calls(found)
    parameters = passed.select("path", "part", F.col("parameter").alias("name"), F.col("at").alias("place"), F.lit("parameter").alias("kind"), F.lit(None).cast("string").alias("other"), F.array().cast("array<string>").alias("items")).distinct()
    known = written(set_at.unionByName(parameters), "r-known")
    uses = named.union(variables)
    out = quoted.union(listed)
    while True:
        both = known.select("path", "part", "name", "place", F.lit(None).cast("boolean").alias("only"), F.struct("place", "kind", "other", "items").alias("set")).unionByName(uses.select("path", "part", "name", "place", "only", F.lit(None).cast("struct<place:int,kind:string,other:string,items:array<string>>").alias("set")))
        before = Window.partitionBy("path", "part", "name").orderBy("place").rangeBetween(Window.unboundedPreceding, -1)
        solved = written(both.withColumn("last", F.last("set", ignorenulls=True).over(before)).where("set IS NULL").select("path", "part", "name", "place", "only", "last"), "r-uses")
        bare = solved.where((F.col("last").isNull() | ~F.col("last.kind").isin("loop", "parameter")) & (F.col("only") == F.lit(False)))
        taken = solved.where(F.col("last").isNotNull() & (F.col("only") | F.col("last.kind").isin("loop", "parameter")))
        out = out.union(bare.select("path", F.col("name").alias("package"))).union(taken.select("path", F.explode("last.items").alias("package")))
        chained = taken.where("last.other IS NOT NULL").select("path", "part", F.col("last.place").alias("place"), F.col("last.other").alias("name"), F.lit(True).alias("only"))
        given = taken.where("last.kind = 'parameter'").select("path", "part", F.col("name").alias("parameter"), F.col("last.place").alias("at")).distinct().join(passed, ["path", "part", "parameter", "at"])
        out = out.union(given.select("path", F.explode("items").alias("package")))
        uses = written(chained.union(given.where("other IS NOT NULL").select("path", "part", "place", F.col("other").alias("name"), F.lit(True).alias("only"))).distinct(), "r-chained")
        if uses.isEmpty():
            return out.where(F.rlike("package", F.lit(r"\A[A-Za-z][\w.]*\z"))).distinct()
