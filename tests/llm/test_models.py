"""Toxicity and quality: exact inference on small chains, held-out figures, awkward inputs."""

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import queries as Q
from tessera.llm.quality import Hashed, Ordinal, graded, keep_quality
from tessera.llm.toxicity import BLOCK, blocks, drop_toxic, forward_backward, toxicity


def enumerated(scores, transition):
    """Marginals and expected transitions of one chain, over all labellings."""
    n = len(scores)
    total, on, moves = 0.0, np.zeros(n), np.zeros((2, 2))
    for y in itertools.product((0, 1), repeat=n):
        w = np.exp(sum(scores[t] * y[t] for t in range(n)) + sum(transition[a, b] for a, b in zip(y, y[1:])))
        total += w
        on += w * np.array(y)
        for a, b in zip(y, y[1:]):
            moves[a, b] += w
    return on / total, moves / total


def test_marginals_are_those_of_enumeration():
    """Chains longer than a block too: a seam between blocks changes nothing."""
    rng = np.random.default_rng(1)
    transition = rng.normal(0, 1, (2, 2))
    texts = [rng.normal(0, 2, n) for n in (1, 4, 7, 12, 3, 11)]
    width = 3
    parts = [t[i : i + width] for t in texts for i in range(0, len(t), width)]
    first = np.array([i == 0 for t in texts for i in range(0, len(t), width)])
    scores, lengths = np.zeros((len(parts), width)), np.array([len(p) for p in parts])
    for i, p in enumerate(parts):
        scores[i, : len(p)] = p
    found, pairs = forward_backward(scores, lengths, first, transition, pairs=True)
    expected = [enumerated(t, transition) for t in texts]
    assert np.allclose(np.concatenate([f[:n] for f, n in zip(found, lengths)]), np.concatenate([e[0] for e in expected]))
    assert np.allclose(pairs, sum(e[1] for e in expected))


def test_blocks_hold_every_word():
    block, place, lengths, first = blocks(np.array([0, 3, BLOCK, BLOCK + 1, 0]))
    assert len(block) == 2 * BLOCK + 4 and lengths.tolist() == [3, BLOCK, BLOCK, 1] and first.tolist() == [True, True, True, False] and place.max() == BLOCK - 1


def test_ordinal_gradients_are_those_of_differences():
    """With three grades: the loss against a loop over rows, its gradients against differences of the loss."""
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["good", "bad", "fair", "x1", "Word,"], rng.integers(1, 9))) for _ in range(12)] + [""]
    grade = rng.integers(0, 3, len(texts))
    raw = [t.encode() for t in texts]
    x = Hashed(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    model = Ordinal([1, 3, 7])
    model.weights = rng.normal(0, 0.5, Hashed.SIZE)
    model.thresholds = np.array([-0.4, 0.9])
    loss, by_weight, by_threshold = model.loss(x, grade)
    by_hand = 0.0
    for s, y in zip(model.score(x), grade):
        tail = [1.0, *(1 / (1 + np.exp(-(s - t))) for t in model.thresholds), 0.0]
        by_hand -= np.log(tail[y] - tail[y + 1]) / len(texts)
    assert abs(loss - by_hand) < 1e-9
    for array, gradient, places in ((model.weights, by_weight, np.flatnonzero(by_weight)), (model.thresholds, by_threshold, range(2))):
        for i in places:
            sides = []
            for step in (1e-5, -1e-5):
                array[i] += step
                sides.append(model.loss(x, grade)[0])
                array[i] -= step
            assert abs((sides[0] - sides[1]) / 2e-5 - gradient[i]) < 1e-5


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    for v in np.unique(score):
        rank[score == v] = rank[score == v].mean()
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())


SF = "/root/testdata/sf0.1"


def test_toxicity_on_rows_that_nothing_learned_from(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = Q.op9_toxicity(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    score, label = np.array([h[0] for h in held]), np.array([h[1] for h in held])
    assert auc(score, label) > 0.95
    assert ((score >= 0.5) == (label == 1)).mean() > 0.95


def test_quality_on_rows_that_nothing_learned_from(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in Q.op8_quality(spark, SF).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.doc_id in labels]
    score, label = np.array([r.p_good for r in rows]), np.array([labels[r.doc_id] for r in rows])
    assert auc(score, label) > 0.9 and ((score >= 0.5) == (label == 1)).mean() > 0.9


@pytest.fixture(scope="module")
def labels(spark, docs):
    rows = [(i, i % 3, int(i % 4 == 0)) for i in range(40)] + [(None, 1, 1), (100, None, None), (3, 2, 1), (999, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_scores_of_awkward_documents(clashing, labels):
    for found, name in ((toxicity(clashing, labels, as_column="own"), "score"), (graded(clashing, labels, grades=(0, 1, 2), as_column="own"), "tail")):
        assert found.columns == [*clashing.columns, "own"]
        rows = found.select("doc_id", "text", f"own.{name}").collect()
        assert len(rows) == clashing.count() and all(0 <= r[2] <= 1 for r in rows)
        of = {}
        for r in rows:
            of.setdefault(r.text or "", set()).add(r[2])
        assert all(len(v) == 1 for v in of.values())


def test_tails_never_cross(clashing, labels):
    for r in graded(clashing, labels, grades=(0, 1, 2), as_column="own").select("own.tails", "own.expected_grade").collect():
        assert r.tails[0] >= r.tails[1] and abs(r.expected_grade - sum(r.tails)) < 1e-9
    assert Ordinal([0, 1, 2]).tails(np.zeros(2)).shape == (2, 2)


def test_offending_offsets(spark):
    from tessera.llm.toxicity import fit_field

    clean = [f"the calm house number {i} stands near a river" for i in range(80)]
    bad = [f"the calm vile{'x' * (i % 3)} grubnak number {i} stands" for i in range(80)]
    field = fit_field([x for p in zip(clean, bad) for x in p], np.array([0, 1] * 80))
    assert field.document is not None
    rows = [(i, t) for i, t in enumerate(clean + bad)]
    docs = spark.createDataFrame([*rows, (500, "é the calm grubnak stands"), (501, "a calm river")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 80)) for i in range(160)], "doc_id long, toxic int")
    got = {r.doc_id: (r.score, [t for t in r.spans]) for r in toxicity(docs, labels).select("doc_id", "toxicity.*").collect()}
    assert got[500][0] > 0.5 > got[501][0]
    assert any("é the calm grubnak stands"[s.a : s.b] == "grubnak" for s in got[500][1]) and got[501][1] == []


def test_nothing_to_learn_from(clashing, labels):
    assert drop_toxic(clashing, labels.limit(0)).count() == clashing.count()
    assert drop_toxic(clashing, labels.where("toxic = 1")).columns == clashing.columns
    assert keep_quality(clashing, labels.limit(0)).columns == clashing.columns
    assert drop_toxic(clashing.limit(0), labels).count() == 0 and keep_quality(clashing.limit(0), labels).count() == 0
    assert {r[0] for r in toxicity(clashing, labels.limit(0), as_column="own").select("own.score").distinct().collect()} == {0.0}


def test_held_out_rows_teach_nothing(spark):
    rows = [(i, ("bad stuff " if i % 2 else "good stuff ") * 3 + str(i)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    of = lambda own: sorted((r[0], r[1]) for r in toxicity(docs, own).select("doc_id", "toxicity.score").collect())
    assert of(labels) == of(flipped)
