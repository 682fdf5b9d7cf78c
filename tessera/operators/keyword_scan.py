r"""Keyword and pattern scans with formulas, over any table of texts.

A specification is a list of groups. A keyword group sums the matches of its items in one view of each
text; items are regexes, whole words and without case by default. A pattern group has named searches, each
for a file name (wildcards) and a content (text or regex), and a formula over them. Groups compile to one
projection, so a table is scanned once for all of them; the application level is one more aggregation.

Defined cases: null texts hold nothing; an item that is quoted is taken without its quotes; an invalid
formula gives null (written ``-``) at both levels; an empty table gives KO for every valid formula; groups
are named by position inside, so clashing or odd group names can't collide with the table's columns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.formulas import formula_column
from tessera.functions.text import text_of


@dataclass(frozen=True)
class Item:
    text: str
    name: str = ""


@dataclass(frozen=True)
class Search:
    """A pattern search; ``content`` is taken literally, ``regex`` as it stands; neither: the file name alone decides."""

    name: str
    filename: str = "*"
    content: str | None = None
    regex: str | None = None
    sensitive: bool = False
    full_word: bool = True


@dataclass(frozen=True)
class Group:
    name: str
    items: tuple[Item, ...] = ()
    searches: tuple[Search, ...] = ()
    formula: str | None = None
    weight: int = 2
    sensitive: bool = False
    full_word: bool = True
    scope: str = "all"


@dataclass(frozen=True)
class Scan:
    name: str
    groups: tuple[Group, ...] = field(default_factory=tuple)


def _flag(value: str | None, default: bool) -> bool:
    return default if value is None else value == "1"


def read_scans(xml: str) -> list[Scan]:
    """Scans from a keyword or pattern specification in XML."""
    out = []
    for scan in ElementTree.fromstring(xml).iter("keywordScan"):
        groups = []
        for g in scan:
            sensitive, full_word = _flag(g.get("sensitive"), False), _flag(g.get("full_word"), True)
            formula = g.find("formula")
            searches = tuple(
                Search(s.get("id"), s.findtext("filename", "*"), s.findtext("content"), s.findtext("regexContent"), _flag(s.get("sensitive"), sensitive), _flag(s.get("full_word"), full_word))
                for s in g.iter("search")
            )
            items = tuple(Item(i.text or "", i.get("id") or "") for i in g.iter("keywordItem"))
            groups.append(Group(g.get("name"), items, searches, None if formula is None else formula.get("value"), int(g.get("weight", 2)), sensitive, full_word, g.get("scope", "all")))
        out.append(Scan(scan.get("name"), tuple(groups)))
    return out


def keyword_pattern(text: str, sensitive: bool, full_word: bool) -> str:
    own = re.sub(r'^"|"$', "", text)
    return ("" if sensitive else "(?i)") + (rf"\b{own}\b" if full_word else own)


def name_pattern(wildcards: str, sensitive: bool) -> str:
    """A file name with ``*`` for any run of characters; ``.*`` written out stays a regex."""
    own = re.sub(r"(?<!\.)\*", ".*", re.sub(r"(?<!\.)\*\.", r".*\\.", wildcards))
    return ("" if sensitive else "(?i)") + rf"\b(?:{own})\b"


def _content_pattern(s: Search) -> str | None:
    if s.regex is not None:
        own = s.regex
    elif s.content is not None:
        own = re.escape(s.content)
        own = rf"\b{own}\b" if s.full_word else own
    else:
        return None
    return own if s.sensitive else f"(?i){own}"


def _view(scope: str, views: dict[str, Column]) -> Column:
    if scope not in views:
        raise ValueError(f"no view {scope!r} to scan; there are {sorted(views)}")
    return views[scope]


def group_count(group: Group, views: dict[str, Column]) -> Column:
    """Matches of all items of a keyword group; ``views``: a column for each scope."""
    text = text_of(_view(group.scope, views))
    total = F.lit(0).cast("bigint")
    for i in group.items:
        total = total + F.regexp_count(text, F.lit(keyword_pattern(i.text, group.sensitive, group.full_word)))
    return total


def _search_hit(s: Search, text: Column, name: Column) -> Column:
    hit = F.rlike(F.coalesce(name, F.lit("")), F.lit(name_pattern(s.filename, s.sensitive)))
    content = _content_pattern(s)
    return (hit if content is None else hit & F.rlike(text, F.lit(content))).cast("int")


def keyword_counts(files: DataFrame, scan: Scan, views: dict[str, Column], keys: list[str]) -> DataFrame:
    """``keys`` and a bigint column for each keyword group."""
    return files.select(*keys, *[group_count(g, views).alias(g.name) for g in scan.groups])


def pattern_results(files: DataFrame, scan: Scan, text: Column, name: Column, keys: list[str]) -> DataFrame:
    """``keys`` and a boolean for each pattern group: its formula over its searches' hits (null if invalid)."""
    hits, results = [], []
    for n, g in enumerate(scan.groups):
        own = {s.name: f"__hit_{n}_{s.name}" for s in g.searches}
        hits += [_search_hit(s, text_of(text), name).alias(own[s.name]) for s in g.searches]
        formula = g.formula or " or ".join(own)
        result = formula_column(formula, own)
        results.append((F.lit(None).cast("boolean") if result is None else result).alias(g.name))
    return files.select(*keys, *hits).select(*keys, *results)


def application_results(results: DataFrame, scan: Scan) -> DataFrame:
    """A row (name, weight, logic) for each group: OK if any file's result is true, KO if none is, - if the formula is invalid."""
    names = [f"g{n}" for n in range(len(scan.groups))]
    folded = results.select(*[F.col(f"`{g.name}`").alias(n) for g, n in zip(scan.groups, names)])
    one = folded.agg(*[F.bool_or(F.coalesce(n, F.lit(False))).alias(n) for n in names])
    rows = []
    for g, n in zip(scan.groups, names):
        columns = {s.name: s.name for s in g.searches}
        valid = formula_column(g.formula or " or ".join(columns), columns) is not None
        logic = F.when(F.coalesce(F.col(n), F.lit(False)), "OK").otherwise("KO") if valid else F.lit("-")
        rows.append(F.struct(F.lit(g.name).alias("name"), F.lit(g.weight).alias("weight"), logic.alias("logic")))
    return one.select(F.inline(F.array(*rows)))


def keyword_totals(counts: DataFrame, scan: Scan) -> DataFrame:
    """A row (name, files, matches) for each keyword group over the whole application."""
    one = counts.agg(*[F.struct(F.count_if(F.col(f"`{g.name}`") > 0).alias("files"), F.coalesce(F.sum(f"`{g.name}`"), F.lit(0)).cast("bigint").alias("matches")).alias(f"g{n}") for n, g in enumerate(scan.groups)])
    rows = [F.struct(F.lit(g.name).alias("name"), F.col(f"g{n}.files").alias("files"), F.col(f"g{n}.matches").alias("matches")) for n, g in enumerate(scan.groups)]
    return one.select(F.inline(F.array(*rows)))


def application_hits(results: DataFrame, scan: Scan) -> DataFrame:
    """A row (name, hits) for each pattern group as the log of a scan counts them: once for each file scanned and once more for each that matches."""
    one = results.agg(F.count("*").alias("files"), *[F.count_if(F.coalesce(F.col(f"`{g.name}`"), F.lit(False))).alias(f"g{n}") for n, g in enumerate(scan.groups)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(g.name).alias("name"), (F.col("files") + F.col(f"g{n}")).alias("hits")) for n, g in enumerate(scan.groups)])))


def results_by_name_then_content(files: DataFrame, scan: Scan, text: Column, name: Column, keys: list[str]) -> DataFrame:
    """``pattern_results`` in two steps: contents are looked at for files whose name fits some search only; all others have false, or null where the formula is invalid."""
    fits = F.lit(False)
    for g in scan.groups:
        for s in g.searches:
            fits = fits | F.rlike(F.coalesce(name, F.lit("")), F.lit(name_pattern(s.filename, s.sensitive)))
    return pattern_results(files, scan, F.when(fits, text), name, keys)


def sections(counts: DataFrame, scan: Scan, key: str) -> list[tuple[str, DataFrame, list[str]]]:
    """The three sections of a keyword result file: (title, rows, columns) of files, of groups, and of the application."""
    names = [g.name for g in scan.groups]
    total = keyword_totals(counts, scan)
    return [("files", counts, [key, *names]), ("groups", total, ["name", "files", "matches"]), ("application", total.agg(F.sum("matches").alias("matches")), ["matches"])]
