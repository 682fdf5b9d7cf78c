r"""Version numbers: canonical form, order, ranges.

A version is dotted numbers, with ``x`` standing for anything from there on. ``order_key`` is an array that
sorts as the versions do, for any number of parts and digits, with missing parts as zero; ``x`` sorts with the
highest, so a range that ends at ``2.x`` holds all of 2. Ranges are (least, greatest) pairs, null where open. Strict bounds are widened to
inclusive ones; ``<v`` bounds from above, and brackets are read like parentheses.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def canonical(version: Column) -> tuple[Column, Column]:
    """(dotted numbers, tag) of a version as it is written; nulls without a number."""
    v = F.regexp_replace(version, r"[-_](?=[^x\d]|$)", ".")
    item = r"(?:\d+|x(?:\.|$))"
    pattern = rf"({item}(?:\.{item})*)[.\-_]*(.*)"
    return F.nullif(F.regexp_extract(v, pattern, 1), F.lit("")), F.nullif(F.regexp_extract(v, pattern, 2), F.lit(""))


def comparable(version: Column) -> Column:
    """The parts of a version up to its first x, or null where it isn't dotted numbers."""
    v = F.regexp_replace(version, r"\.x.*$", ".x")
    return F.when(F.rlike(version, F.lit(r"^[.\dx]+$")), F.filter(F.split(v, r"\."), lambda p: p != ""))


_ZERO = "00000000010"  # one digit, which is 0


def _number(part: Column) -> Column:
    """A string of digits as one that sorts like its number: the count of its digits, then the digits."""
    bare = F.regexp_replace(part, r"^0+(?=.)", "")
    return F.concat(F.lpad(F.length(bare).cast("string"), 10, "0"), bare)


def order_key(version: Column) -> Column:
    """An array that sorts like the version; null where it can't be compared."""
    parts = comparable(version)
    own = F.transform(F.filter(parts, lambda p: p != "x"), _number)
    last = F.coalesce(F.array_max(F.transform(own, lambda p, i: F.when(p != _ZERO, i + 1).otherwise(0))), F.lit(0))
    return F.when(F.array_contains(parts, "x"), F.concat(own, F.array(F.lit("x")))).when(parts.isNotNull(), F.slice(own, F.lit(1), last))


def compare(previous: Column, new: Column) -> Column:
    """-1 if the previous version is greater, 1 if the new one is, 0 if they are equal as far as either's x."""
    a, b = F.coalesce(comparable(previous), F.array().cast("array<string>")), F.coalesce(comparable(new), F.array().cast("array<string>"))
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    state = F.struct(F.lit(0).alias("sign"), F.lit(False).alias("done"))

    def step(s: Column, p: Column) -> Column:
        x, y = F.coalesce(p["a"], F.lit("0")), F.coalesce(p["b"], F.lit("0"))
        wild = (x == "x") | (y == "x")
        m, n = _number(x), _number(y)
        sign = F.when(wild | (m == n), 0).when(m > n, -1).otherwise(1)
        return F.struct(F.when(s["done"], s["sign"]).otherwise(sign).alias("sign"), (s["done"] | wild | (sign != 0)).alias("done"))

    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.sign(F.size(b) - F.size(a)).cast("int")).otherwise(F.aggregate(pairs, state, step, lambda s: s["sign"]))


def _simple_range(v: Column) -> tuple[Column, Column]:
    bare = F.trim(F.regexp_replace(v, r"^[\s]*(?:>=|<=|~>|~=|===|==|!=|=|>|<|!|~|\^)\s*", ""))
    op = F.regexp_extract(v, r"^\s*(>=|<=|~>|~=|===|==|!=|=|>|<|!|~|\^)?", 1)
    none = F.lit(None).cast("string")
    upper = F.regexp_extract(bare, r"^(\d+)", 1)
    low = F.when(op.isin("<=", "<", "!=", "!"), none).otherwise(bare)
    high = F.when(op.isin(">=", ">", "~>", "~=", "~", "!=", "!"), none).when(op == "^", F.concat(upper, F.lit(".x"))).otherwise(bare)
    return low, high


def _of(ranges: Column, side: str, greatest: bool) -> Column:
    some = F.filter(ranges, lambda r: r[side].isNotNull())
    keyed = F.transform(some, lambda r: F.struct(F.coalesce(order_key(r[side]), F.array().cast("array<string>")).alias("k"), r[side].alias("v")))
    best = F.array_max(keyed) if greatest else F.array_min(keyed)
    return best["v"]


def version_range(version: Column) -> Column:
    """(least, greatest) of a requirement such as ``>=1.2,<2``, ``[1.0,2.0]``, ``~>1.4``, ``^1.2`` or a version."""
    bare = F.regexp_replace(version, r"^\s*[\[(]|[\])]\s*$", "")
    span = F.rlike(version, F.lit(r"^\s*[\[(].*,"))
    parts = F.split(bare, ",", -1)

    def one(p: Column) -> Column:
        low, high = _simple_range(p)
        return F.struct(low.alias("low"), high.alias("high"))

    several = F.transform(F.filter(parts, lambda p: F.trim(p) != ""), one)
    low = F.when(span, F.nullif(F.trim(F.element_at(parts, 1)), F.lit(""))).otherwise(_of(several, "low", True))
    high = F.when(span, F.nullif(F.trim(F.element_at(parts, -1)), F.lit(""))).otherwise(_of(several, "high", False))
    return F.when(version.isNull() | (F.trim(version).isin("", "-", "*")), F.struct(F.lit(None).cast("string").alias("low"), F.lit(None).cast("string").alias("high"))).otherwise(
        F.struct(low.alias("low"), high.alias("high"))
    )


def file_name_version(name: Column) -> Column:
    """The version in a library's file name."""
    return canonical(F.nullif(F.regexp_extract(name, r"[.\-_](\d+(?:[.\-_]\d+)*)", 1), F.lit("")))[0]


def file_name_library(name: Column) -> Column:
    """What stands before the version in a library's file name."""
    return F.regexp_extract(name, r"^(.*?)(?:[.\-]\d|$)", 1)
