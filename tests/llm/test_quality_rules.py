"""Adaptive quality rules against SQL, a loop over windows, and the labels."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import queries as Q
from tessera.llm.quality_rules import drop_by_rules, merged, quality_rules, repeated_words, rounded, sketches, text_counts, thresholds, words_of

SPACE = re.compile(r"[\x20\x09-\x0d]+")


def by_hand(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = [w for w in SPACE.split(text) if w]
    seen, hit = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for own in seen.values():
        if len(own) > 1:
            hit |= {i + j for i in own for j in range(8)}
    lines = [x for x in text.split("\n") if SPACE.sub("", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_query_is_that_of_the_sql(spark, sf, same_as_sql):
    same_as_sql(Q.op13_quality_rules(spark, sf), Q.oracle_sql()["op13_quality_rules"])


def texts(seed):
    rng = random.Random(seed)
    out = []
    for _ in range(60):
        words = [rng.choice("ab") for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.5 and len(words) > 8:
            at = rng.randrange(len(words) - 8)
            words += ["#x"] + words[at : at + rng.choice([7, 8, 9])] * rng.randint(1, 3)
        out.append("".join(w + rng.choice([" ", " ", "\t", "\n", "\n\n", "\x0b"]) for w in words))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_counts_are_those_of_loops(spark, seed):
    rows = list(enumerate(texts(seed)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in text_counts(df, "text", doc_id=F.col("doc_id")).collect()}
    assert found == {i: by_hand(t) for i, t in rows}


def test_awkward_documents(spark, docs, awkward, clashing):
    df = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en")).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "s"))
    extra = spark.createDataFrame([(500, "a " * 50_000, "en", "s"), (501, "\n".join(["same line"] * 9), None, None), (502, "Été ÉÉ à", "fr", "t")], df.schema)
    df = df.union(extra)
    expected = sorted(((d, *by_hand(t)) for d, t in [*awkward, *[(r.doc_id, r.text) for r in extra.collect()]]), key=repr)
    rows = quality_rules(df).collect()
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows), key=repr) == expected
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.kept and (r.base_failed or r.failed)) for r in rows)
    assert quality_rules(df.limit(0)).count() == 0
    wide = clashing.withColumn("rule", F.lit(1)).withColumn("limits", F.lit(2)).withColumn("n_words", F.lit(3)).withColumn("source", F.lit("x"))
    kept = drop_by_rules(wide)
    assert kept.columns == wide.columns and sorted(r.doc_id or 0 for r in kept.collect()) == sorted(r.doc_id or 0 for r in quality_rules(wide).where("kept").collect())


def test_sketches_merge(spark):
    """Those of sources add up to those of all rows, and quartiles are at most one part in 64 off."""
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice(["x", "y"]), "q" * rng.randint(1, 4000) + " w") for _ in range(900)]
    counts = text_counts(spark.createDataFrame(rows, "lang string, source string, text string"), "text", lang=F.col("lang"), source=F.col("source"))
    by_source = sketches(counts, "lang", "source")
    one = lambda df: sorted(tuple(r) for r in df.collect())
    assert one(merged(by_source).select("rule", "value", "n")) == one(sketches(counts).select("rule", "value", "n"))
    (limits,) = {tuple(map(tuple, sorted(r.limits))) for r in thresholds(by_source, 3.0, 10_000).collect()}
    low, high = next(x[1:] for x in limits if x[0] == "word_length")
    exact = sorted((len(t) - 1) * 1000 // 2 for _, _, t in rows)
    width = (high - low) / 7
    assert abs((low + 3 * width) / exact[224] - 1) < 1 / 60 and abs((high - 3 * width) / exact[674] - 1) < 1 / 60
    assert len(thresholds(by_source, 3.0, 50).collect()) == 6
    values = [0, 1, 127, 128, 129, 255, 1000, 123_456_789]
    assert [r[0] for r in spark.createDataFrame([(v,) for v in values], "value long").select(rounded(F.col("value"))).collect()] == [v >> e << e for v in values for e in [max(0, v.bit_length() - 7)]]


def test_windows_of_equal_hash_are_compared(spark):
    """Suspects that differ in words are no repeats."""
    df = spark.createDataFrame([("a b c d e f g h i", 0), ("a b c d e f g h a b c d e f g h", 16), ("a a a a a a a a a", 9), ("a b c d e f g h", 0)], "text string, n long")
    assert all(r[0] == r[1] for r in df.select(repeated_words(words_of(F.col("text"))), "n").collect())


def test_labelled_documents(spark):
    """Good documents stay, bad ones mostly go."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality IS NOT NULL")
    found = Q.op13_quality_rules(spark, sf).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.avg((F.col("n_words") >= 20).cast("int")).alias("long")).collect()
    share = {r.quality: r.kept / r.long for r in found}
    assert share[1] > 0.98 and share[0] < 0.1
