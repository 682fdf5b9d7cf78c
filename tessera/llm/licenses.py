"""License scans with ordered signature rules, in DataFrame functions only.

Every rule has a gate and words, which all its matches hold. The few different gates are sought in every text; a
rule's regex runs only on texts that hold its gate and all its words. All matches of a rule are detections. A detection
is suppressed if its interval lies inside that of another with a better (lower) priority, or inside a
strictly longer one; what is left gives the labels, and the best score of what is left is the score.

Base phrases are counted on words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower
case; here words also hold A-Z, and patterns ignore the case of ASCII letters, which is the same.

Defined cases: null and empty texts have no words, no labels and score 0; rows repeated get equal
answers; ids may be null; other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import text_of
from tessera.llm.license_rules import GATES, rules

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
_FOUND = "array<struct<a:int,b:int,priority:int,label:string,score:double>>"


def phrase_pattern(phrase: str) -> str:
    return rf"(?i)(?<!{WORD}){GAP.join(phrase.split())}(?!{WORD})"


def base_phrases(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, text) with n_words, n_base, first_word, last_word and an array of base labels."""
    text = F.col("text")
    word = F.lit(rf"{WORD}+")
    rows = rows.withColumn("lowered", F.lower(text))
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES.items():
        pattern = phrase_pattern(phrase)
        needed = reduce(lambda a, b: a & b, [F.contains("lowered", F.lit(w)) for w in phrase.split()])
        rows = rows.withColumn(f"n_{label}", F.when(needed, F.regexp_count(text, F.lit(pattern))).otherwise(0))
        some = F.col(f"n_{label}") > 0
        ahead = F.split(text, pattern, 2)[0]  # regexp_instr counts UTF-16 units, not characters
        behind = F.regexp_extract(text, rf"(?s)^(.*){pattern}", 1)
        counts.append(F.col(f"n_{label}"))
        firsts.append(F.when(some, F.regexp_count(ahead, word)))
        lasts.append(F.when(some, F.regexp_count(behind, word)))
        labels.append(F.when(some, F.lit(label)))
    return rows.select(
        "doc_id",
        "text",
        "lowered",
        F.regexp_count(text, word).cast("long").alias("n_words"),
        reduce(lambda a, b: a + b, counts).cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"),
        F.greatest(*lasts).cast("long").alias("last_word"),
        F.filter(F.array(*labels), lambda x: x.isNotNull()).alias("base"),
    )


def held_gates(low: Column) -> Column:
    """The gates that a lower-case text holds."""
    return F.filter(F.array(*[F.when(F.contains(low, F.lit(g)), F.lit(g)) for g in GATES]), lambda g: g.isNotNull())


def detections(low: Column, gates: Column) -> Column:
    """All detections in a lower-case text that holds ``gates``, before suppression."""
    kind = "array<struct<priority:int,label:string,gate:string,words:array<string>,pattern:string,score:double>>"
    table = F.from_json(F.lit(json.dumps(rules())), F.lit(kind))  # a constant, which is read once
    gated = F.filter(table, lambda r: F.array_contains(gates, r["gate"]) & F.forall(r["words"], lambda w: F.contains(low, w)))
    tried = F.transform(gated, lambda r: F.struct(r.alias("r"), F.regexp_extract_all(low, r["pattern"], F.lit(0)).alias("m")))

    def of_rule(t: Column) -> Column:
        r = t["r"]
        pairs = F.arrays_zip(F.slice(F.split(low, r["pattern"], F.lit(-1)), F.lit(1), F.size(t["m"])).alias("p"), t["m"].alias("m"))
        state = F.struct(F.lit(0).alias("at"), F.array().cast(_FOUND).alias("out"))

        def step(s: Column, x: Column) -> Column:
            a = s["at"] + F.length(x["p"])
            b = a + F.length(x["m"])
            one = F.struct(a.alias("a"), b.alias("b"), r["priority"].alias("priority"), r["label"].alias("label"), r["score"].alias("score"))
            return F.struct(b.alias("at"), F.concat(s["out"], F.array(one)).alias("out"))

        return F.aggregate(pairs, state, step, lambda s: s["out"])

    return F.flatten(F.transform(F.filter(tried, lambda t: F.size(t["m"]) > 0), of_rule))


def surviving(found: Column) -> Column:
    """Detections that no better one contains, by start.

    Sorted by start, longest and best first, every detection that contains another stands before it: one pass
    that keeps the furthest end so far tells whether there is one.
    """
    one = lambda x: F.struct(x["a"].alias("a"), (-x["b"]).alias("back"), x["priority"].alias("priority"), x["label"].alias("label"), x["score"].alias("score"))
    state = F.struct(F.lit(-1).alias("end"), F.array().cast(_FOUND).alias("out"))

    def step(s: Column, x: Column) -> Column:
        own = F.struct(x["a"].alias("a"), (-x["back"]).alias("b"), x["priority"].alias("priority"), x["label"].alias("label"), x["score"].alias("score"))
        return F.struct(F.greatest(s["end"], -x["back"]).alias("end"), F.when(-x["back"] <= s["end"], s["out"]).otherwise(F.concat(s["out"], F.array(own))).alias("out"))

    return F.aggregate(F.array_sort(F.transform(found, one)), state, step, lambda s: s["out"])


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base (array), detections (array), score."""
    rows = base_phrases(docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")))
    low = F.col("lowered")
    rows = rows.withColumn("gates", held_gates(low))
    rows = rows.withColumn("found", F.when(F.size("gates") > 0, detections(low, F.col("gates"))).otherwise(F.array().cast(_FOUND)))
    rows = rows.withColumn("detections", F.when(F.size("found") > 0, surviving(F.col("found"))).otherwise(F.array().cast(_FOUND)))
    best = F.array_max(F.transform("detections", lambda x: x["score"]))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base", "detections", F.greatest(F.coalesce(best, F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)).alias("score"))


def label_list(*arrays: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.concat(*arrays))), ",")
