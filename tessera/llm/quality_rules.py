"""Quality rules whose thresholds follow the corpus, in DataFrame functions only.

Texts are read once, for counts. Each metric of a text is a whole number (a share is a per mille). The sketch of a
metric is the number of texts at each value rounded down to ``BITS`` significant bits, at most 1/64 off: sketches merge by
adding, so those of a language are sums of those of its sources, and all of them don't depend on the partitions. A
text fails a rule beyond the quartile and ``spread`` times the distance of the quartiles (or the rule's least distance, where half of
the texts are alike). A (language, source) of fewer than ``least_rows`` texts takes the quartiles of its language, and a language of
fewer those of all texts. Thresholds meet the counts in a join on both.

Repeated windows are found inside a row: hashes of all windows, sorted with their places, give suspects, and
suspects are compared word by word.

Defined cases: a null text is empty; texts without words fail (they have too few words) and are in no sketch; null languages and
sources are groups of their own; rows repeated each count and get equal answers; ids may be null; other columns, of any
name, aren't looked at; an empty table gives an empty result. One text takes about 100 bytes of memory a word.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import staged, text_of
from tessera.llm.exact_dedup import without

#: Words of a window, and significant bits of a sketched value.
WINDOW, BITS = 8, 7
_SPACE = r"[\x20\x09-\x0D]+"
#: Of each rule: the metric, the least distance of quartiles that counts, and whether low values fail too.
RULES = {
    "word_length": (lambda: F.expr("word_chars * 1000 div n_words"), 100, True),
    "symbols": (lambda: F.expr("n_symbols * 1000 div n_words"), 50, False),
    "duplicate_lines": (lambda: F.expr("n_dup_lines * 1000 div n_lines"), 100, False),
    "repeated_words": (lambda: F.expr("n_repeat_words * 1000 div n_words"), 50, False),
    "capitals": (lambda: F.expr("n_capitals * 1000 div word_chars"), 25, False),
}


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, _SPACE), lambda w: w != "")


def _twice(keys: Column, place: Callable[[Column], Column], key: Callable[[Column], Column]) -> Column:
    """The places, ascending, of the entries of an array whose key another entry has."""

    def alike(s: Column) -> Column:
        same = lambda x, j: F.coalesce(key(F.get(s, j)) == key(x), F.lit(False))
        marked = F.transform(s, lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), place(x)))
        return F.sort_array(F.filter(marked, lambda p: p.isNotNull()))

    return bound(F.sort_array(keys), alike)


def repeated_words(words: Column) -> Column:
    """The number of words in windows of WINDOW words that occur twice or more (the first time included), of an array of words."""

    def found(w: Column) -> Column:
        hashed = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.shiftleft(F.xxhash64(F.slice(w, i + 1, WINDOW)), 31).bitwiseOR(i.cast("long")))
        suspects = _twice(hashed, lambda x: x.bitwiseAND(F.lit((1 << 31) - 1)), lambda x: F.shiftright(x, 31))

        def sure(at: Column) -> Column:
            texts = F.transform(at, lambda i: F.struct(F.array_join(F.slice(w, i.cast("int") + 1, WINDOW), " ").alias("t"), i.alias("i")))
            start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
            step = lambda s, i: F.struct((i + WINDOW).alias("end"), (s["n"] + i + WINDOW - F.greatest(s["end"], i)).alias("n"))
            return F.aggregate(_twice(texts, lambda x: x["i"], lambda x: x["t"]), start, step, lambda s: s["n"])

        return bound(suspects, lambda at: F.when(F.size(at) == 0, F.lit(0).cast("long")).otherwise(sure(at)))

    return bound(words, lambda w: F.when(F.size(w) <= WINDOW, F.lit(0).cast("long")).otherwise(found(w)))


def text_counts(docs: DataFrame, text_col: str, **columns: Column) -> DataFrame:
    """The given columns, the counts of each text, and its hash (row_hash)."""
    text = text_of(text_col)
    blank = lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) == 0
    lines = F.filter(F.split(text, "\n"), lambda x: ~blank(x))
    sizes = bound(lines, lambda x: F.struct(F.size(x).cast("long").alias("lines"), F.size(F.array_distinct(x)).cast("long").alias("different")))
    counts = bound(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("words"), repeated_words(w).alias("repeats")))
    found = docs.select(
        *[c.alias(name) for name, c in columns.items()],
        F.xxhash64(text).alias("row_hash"),
        F.length(F.regexp_replace(text, _SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        sizes.alias("l"),
        counts.alias("c"),
    )
    return found.select("*", F.col("c.words").alias("n_words"), F.col("l.lines").alias("n_lines"), (F.col("l.lines") - F.col("l.different")).alias("n_dup_lines"), F.col("c.repeats").alias("n_repeat_words")).drop("c", "l")


def rounded(value: Column) -> Column:
    """A whole number of at least 0 without all but its BITS highest bits."""
    low = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, low), low)


def sketches(counts: DataFrame, *keys: str) -> DataFrame:
    """Rows (keys, rule, value, n): the number of texts of each group at each rounded value of each rule's metric."""
    metrics = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), metric().alias("value")) for name, (metric, _, _) in RULES.items()])).alias("m")
    return counts.where("n_words > 0").select(*keys, metrics).groupBy(*keys, F.col("m.rule").alias("rule"), rounded(F.col("m.value")).alias("value")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, *keys: str) -> DataFrame:
    return sketch.groupBy(*keys, "rule", "value").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, spread: float, *keys: str) -> DataFrame:
    """One row for each group of a sketch: rows, and an array of the rules' limits."""
    own = Window.partitionBy(*keys, "rule")
    rows = sketch.withColumn("rows", F.sum("n").over(own)).withColumn("upto", F.sum("n").over(own.orderBy("value")))
    quartile = lambda k: F.min(F.when(F.col("upto") * 4 >= F.col("rows") * k, F.col("value")))
    found = rows.groupBy(*keys, "rule").agg(F.max("rows").alias("rows"), quartile(1).alias("q1"), quartile(3).alias("q3"))
    least = F.create_map(*[F.lit(x) for name, (_, width, _) in RULES.items() for x in (name, width)])
    width = F.greatest(F.col("q3") - F.col("q1"), least[F.col("rule")]) * spread
    limits = found.select(*keys, "rows", F.struct("rule", (F.col("q1") - width).alias("low"), (F.col("q3") + width).alias("high")).alias("limit"))
    return limits.groupBy(*keys).agg(F.max("rows").alias("rows"), F.collect_list("limit").alias("limits"))


def thresholds(sketch: DataFrame, spread: float, least_rows: int) -> DataFrame:
    """One row (lang, source, limits) for each group of ``sketch`` (lang, source, rule, value, n)."""
    of_language, of_all = merged(sketch, "lang"), merged(sketch)
    own = fences(sketch, spread, "lang", "source")
    language = fences(of_language, spread, "lang").select(F.col("lang").alias("of"), F.col("rows").alias("more"), F.col("limits").alias("wider"))
    everything = fences(of_all, spread).select(F.col("limits").alias("widest"))  # one row, or none
    both = own.join(language, F.col("lang").eqNullSafe(F.col("of"))).join(F.broadcast(everything))
    limits = F.when(F.col("rows") >= least_rows, F.col("limits")).when(F.col("more") >= least_rows, F.col("wider")).otherwise(F.col("widest"))
    return both.select("lang", "source", limits.alias("limits"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", spread: float = 3.0, least_rows: int = 100) -> DataFrame:
    """One row per document: doc_id, row_hash, n_words, the counts, base_failed, failed (the adaptive rules that it fails), kept."""
    counts = staged(text_counts(docs, text_col, doc_id=F.col(id_col), lang=F.col(lang_col), source=F.col(source_col)), "counts")
    limits = staged(thresholds(staged(sketches(counts, "lang", "source"), "sketches"), spread, least_rows), "thresholds")
    limits = limits.select(F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), "limits")
    both = counts.join(limits, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left")

    def fails(name: str) -> Column:
        metric, _, both_sides = RULES[name]
        limit = F.get(F.filter("limits", lambda x: x["rule"] == name), F.lit(0))
        beyond = metric() > limit["high"]
        return F.coalesce(beyond | (metric() < limit["low"]) if both_sides else beyond, F.lit(False))

    worded = F.col("n_words") > 0
    failed = F.filter(F.array(*[F.when(worded & fails(name), F.lit(name)) for name in RULES]), lambda x: x.isNotNull())
    base = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    found = both.withColumn("base_failed", base).withColumn("failed", failed)
    kept = ~F.col("base_failed") & (F.size("failed") == 0)
    return found.select("doc_id", "row_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed", kept.alias("kept"))


def drop_by_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the rows that a rule rejects; columns as they were."""
    return without(docs, quality_rules(docs, id_col, text_col, **how).where("NOT kept").select("doc_id", "row_hash"), id_col, text_col)
