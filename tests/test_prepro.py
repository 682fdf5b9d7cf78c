"""Conditional compilation on small sources."""

import pytest
from pyspark.sql import functions as F

from tessera.functions.prepro import Expression, preprocessed, preprocessed_text

CASES = [
    ("a\n#if X\nb\n#else\nc\n#endif\nd", "a\n\nb\n\n\n\nd", 1),
    ("#ifndef H\n#define H\na\n#endif\n#ifdef H\nb\n#endif", "\n\na\n\n\nb\n", 0),
    ("#define A 0\n#if A\na\n#elif B\nb\n#elif C\nc\n#else\nd\n#endif", "\n\n\n\nb\n\n\n\n\n", 3),
    ("#if 0\n#if 1\na\n#else\nb\n#endif\n#else\nc\n#endif", "\n\n\n\n\n\n\nc\n", 2),
    ("#define A \\\n 3\n#if A > 2 && !defined(Z) || 0\na\n#endif", "\n\n\na\n", 0),
    ("#define A 3\n#if A > 4 && defined(A)\na\n#endif", "\n\n\n", 1),
    ("#define A\n#undef A\n#ifdef A\na\n#endif\n#if !A\nb\n#endif", "\n\n\n\n\n\nb\n", 1),
    ("#define F(x) 0\n#if F\na\n#endif\n#define G f()\n#if (G)\nb\n#endif", "\n\na\n\n\n\nb\n", 0),
    ("#ifndef A\na\n#endif\n#ifdef A\nb\n#endif", "\na\n\n\n\n", 1),
    ("#if !defined(A)\na\n#endif", "\na\n", 0),
    ("#endif\na\n#if X\nb", "\na\n\nb", 0),
    ("x # if\n", "x # if\n", 0),
    ("#else\n", None, 0),
    ("#if A\n#else\n#else\n#endif", None, 0),
    ("", "", 0),
]


@pytest.mark.parametrize("text, left, removed", CASES)
def test_what_conditions_leave(text, left, removed):
    assert preprocessed_text(text) == (left, removed)


def test_expressions():
    known = {"A": "3", "B": None, "C": "x"}
    for text, value in {"1 + 2 * 3 == 7": 1, "(1 + 2) * 3": 9, "-7 / 2": -3, "-7 % 3": -1, "1 << 4 | 1": 17, "A && B": 0, "defined(A) && !defined B": 1, "0x10 > 15UL": 1, "!A || ~0 == -1": 1}.items():
        assert Expression(text, known).value() == value
    deep = "(" * 5000 + "1" + ")" * 5000 + " + 0"
    assert preprocessed_text(f"#if {deep}\na\n#endif")[0] == "\na\n" and preprocessed_text("#if 1 / 0 + 1\na\n#endif")[0] == "\na\n"


def test_columns(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(CASES)] + [(99, None)], "i int, t string")
    got = {r.i: (r.p.prepro, r.p.removed) for r in rows.select("i", preprocessed(F.col("t")).alias("p")).collect()}
    assert got == {i: c[1:] for i, c in enumerate(CASES)} | {99: (None, 0)}
    assert rows.limit(0).select(preprocessed(F.col("t"))).count() == 0
