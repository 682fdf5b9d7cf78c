"""Awkward documents for every operator."""

import random

import pytest

WORDS = "the and of le de und der house river stone paper light über été naïve 2024 x1 a b c cc by general public license all rights reserved".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", ".", "\n", "!"]) for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Rows (doc_id, text) with nulls, empty, blank, repeated, tied and very long texts."""
    rng = random.Random(3)
    shared = prose(rng, 80)
    rows = [(i, prose(rng, rng.randint(0, 120))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, "one"), (104, shared), (105, f"before {shared} after"), (106, shared.upper()), (106, shared.upper()), (107, shared + " x"), (None, "no id here"), (None, None)]
    rows += [(108, prose(rng, 30_000)), (109, "x" * 200_000), (110, "é" * 50_000 + " " + shared), (-5, shared.replace(" ", "  "))]
    return rows


@pytest.fixture(scope="session")
def docs(spark, awkward):
    return spark.createDataFrame(awkward, "doc_id long, text string").repartition(3)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same with columns whose names operators use inside."""
    from pyspark.sql import functions as F

    for name in ("hits", "toxicity", "quality", "row_no", "digest", "shard", "slot", "norm", "length", "fp", "root", "node", "at", "lang"):
        docs = docs.withColumn(name, F.lit(7))
    return docs
