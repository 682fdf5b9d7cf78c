r"""Ordered rules over rows: first match wins; rule sets and descriptions merged.

Rules are read in blocks of at most ``block`` and become the cases of one projection each, so there is
no join and no shuffle however many rows there are, and what a plan carries has a bound; several blocks are
several passes over narrow columns. Case-insensitive names join on their lower-case form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_match(rows: DataFrame, rules: DataFrame, text: str, as_column: str = "rule", block: int = 500) -> DataFrame:
    """``rows`` with the name of the first rule (by ``ordinal``) whose ``pattern`` is found in ``text``; null if none is.

    ``rules``: (ordinal, name, pattern). Null texts match nothing.
    """
    out = rows.withColumn(as_column, F.lit(None).cast("string"))
    own: list[tuple[str, str]] = []

    def folded(df: DataFrame) -> DataFrame:
        hit = F.when(F.col(as_column).isNotNull(), F.col(as_column))
        for n, p in own:  # one case after the other: patterns are compiled once, and later ones aren't tried
            hit = hit.when(F.rlike(F.col(text), F.lit(p)), F.lit(n))
        return df.withColumn(as_column, hit)

    for r in rules.orderBy("ordinal", "name").select("name", "pattern").toLocalIterator():
        own.append((r.name, r.pattern))
        if len(own) == block:
            out, own = folded(out), []
    return folded(out) if own else out


def all_matches(rows: DataFrame, rules: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``ordinal`` and ``name`` of each rule that fits, in a row each: rules are tried in order, and one that fits says whether to go on.

    ``rules``: (ordinal, name, pattern, goes_on); patterns are Python's. A lateral join with a table function: what a row gives
    depends on the rules before, so it is no join on a condition. The rules are sent to the tasks with the function. Rows
    that no rule fits, and null texts, give nothing.
    """
    own = [(r.ordinal, r.name, r.pattern, bool(r.goes_on)) for r in rules.orderBy("ordinal", "name").select("ordinal", "name", "pattern", "goes_on").toLocalIterator()]

    class Tried:
        def __init__(self) -> None:
            import re

            self.rules = [(ordinal, name, re.compile(pattern), goes_on) for ordinal, name, pattern, goes_on in own]

        def eval(self, value: str):
            for ordinal, name, pattern, goes_on in self.rules:
                if value is not None and pattern.search(value):
                    yield ordinal, name
                    if not goes_on:
                        return

    tried = F.udtf(Tried, returnType="ordinal int, name string")
    return rows.lateralJoin(tried(F.col(text).outer()))


def merged_rules(own: DataFrame, external: DataFrame, key: list[str]) -> DataFrame:
    """Rules of both tables; where both have a key, ``own`` wins."""
    return own.unionByName(external.join(own.select(*key), key, "left_anti"))


def described(rows: DataFrame, descriptions: DataFrame, name: str = "name", default: str = "unknown") -> DataFrame:
    """``rows`` with the columns that ``descriptions`` has for their name, case aside, or ``default``."""
    extra = [c for c in descriptions.columns if c != name]
    table = descriptions.groupBy(F.lower(name).alias("__low")).agg(*[F.min(c).alias(c) for c in extra])
    both = rows.join(table, F.lower(F.col(name)) == F.col("__low"), "left")
    return both.select(*rows.columns, *[F.coalesce(F.col(c).cast("string"), F.lit(default)).alias(c) for c in extra])
