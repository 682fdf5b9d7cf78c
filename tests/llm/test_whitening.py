"""Whitening against a covariance that is formed, and its awkward inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import queries as Q
from tessera.llm.whitening import whitened


def by_hand(vectors, components=32):
    """n, exact deviations, whitened rows and shares from the eigenvectors of the covariance."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviations = [sum((n * c - s) ** 2 for c, s in zip(r, sums)) for r in x]
    z = np.array([[(n * c - s) / n for c, s in zip(r, sums)] for r in x])
    values, own = np.linalg.eigh(z.T @ z / n)
    values, own = values[::-1], own[:, ::-1]
    k = min(components, int((values > values[0] * 1e-14).sum()))
    return n, deviations, z @ own[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def check(rows, vectors, ids, components=32):
    n, deviations, expected, shares = by_hand(vectors, components)
    k = expected.shape[1]
    found = {}
    for r in rows:
        found.setdefault(r.vec_id, {})[r.component] = r
    assert len(rows) == n * k and set(found) == set(ids)
    mine = np.array([[found[i][c + 1].whitened for c in range(k)] for i in ids])
    signs = np.sign((mine * expected).sum(axis=0))
    assert np.allclose(mine, expected * signs, rtol=0, atol=1e-7)
    for i, d in zip(ids, deviations):
        assert all(r.n == n and r.deviation == d for r in found[i].values())
    one = found[ids[0]]
    assert np.allclose([one[c + 1].explained for c in range(k)], shares, rtol=1e-6) and len({r.identity_error for r in rows}) == 1
    measured = np.abs(mine.T @ mine / n - np.eye(k)).max()
    assert rows[0].identity_error < 1e-9 and measured < 1e-9


def test_query_is_that_of_the_covariance(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    check(Q.op11_whitening(spark, sf).collect(), [r.embedding for r in table], [r.vec_id for r in table])


def test_any_number_of_partitions_and_scales(spark, tmp_path):
    rng = np.random.default_rng(4)
    mix = rng.normal(size=(6, 6)) * [1, 10, 100, 0.1, 3, 5]
    rows = [(i, (rng.normal(size=6) @ mix + 500).tolist()) for i in range(300)]
    for parts in (1, 7, 70):
        spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts).write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
        check(Q.op11_whitening(spark, str(tmp_path)).collect(), [r[1] for r in rows], [r[0] for r in rows])


def test_awkward_vectors(spark):
    rng = np.random.default_rng(5)
    good = [(i, rng.normal(size=3).tolist()) for i in range(40)] + [(77, [1.0, 2.0, 3.0])] * 9 + [(None, [0.0, 0.0, 9.0])]
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [float("nan"), 1.0, 1.0]), (103, [1.0, float("-inf"), 1.0])]
    short = [(200, [5.0]), (201, [])]
    df = spark.createDataFrame(good + bad + short, "vec_id long, embedding array<double>").repartition(5)
    for name in ("n", "v", "r", "part", "at", "whitened", "deviation"):
        df = df.withColumn(name, F.lit(7))
    found = whitened(df, components=2).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in found) == sorted((i is None, i or 0) for i, _ in good + short)
    n, deviations, expected, shares = by_hand([(v + [0.0] * 3)[:3] for _, v in good + short], 2)
    at = {i: p for p, (i, _) in enumerate(good + short)}
    for r in found:
        assert r.whitening.n == n and int(r.whitening.deviation) == deviations[at[r.vec_id]] and np.allclose(np.abs(r.whitening.whitened), np.abs(expected[at[r.vec_id]])) and r["at"] == 7
        assert np.allclose(r.whitening.explained, shares)


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5, [(1, []), (2, [])], [(1, None)]])
def test_without_variance_there_is_no_component(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = whitened(df).collect()
    assert len(found) == sum(v is not None for _, v in rows) and all(r.whitening.whitened == [] and r.whitening.identity_error is None and r.whitening.deviation == 0 for r in found)


def test_far_entries_and_dependent_directions(spark):
    rows = [(i, [float(i), 2.0 * i, 1e30 if i == 3 else 0.0, -1e300]) for i in range(9)]
    found = whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(found) == 9 and len(found[0].whitening.whitened) == 1 and found[0].whitening.deviation is not None
    rows = [(i, [i / 8, i / 4, (i * i % 7) / 2]) for i in range(50)]
    found = whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(found[0].whitening.whitened) == 2 and found[0].whitening.identity_error < 1e-9
