"""Quality by ordinal cumulative-link regression on graded ratings.

Every grade boundary shares one set of hashed text weights: P(grade > k) is a logistic function of
``score - threshold[k]`` with ascending thresholds, so tail probabilities never cross. The score is the
mean over a text's white-space words of the weights of the word, of its shape (runs of upper, lower,
digit and each other character) and of whether it repeats the word before, plus weights of the text's
length and of its share of different words. A text gets its expected grade, the probability of each
tail, and is selected if the tail of ``select_from`` is likely enough.

The fit uses at most ``sample`` labelled rows of each grade, of at most ``sample_doc_bytes`` bytes.

Defined cases: null, empty and blank texts are scored by their length alone; null grades and null
doc_ids teach nothing; of several grades of one doc_id the lowest counts; with fewer than two grades in
the sample every tail probability is 0.5; rows repeated get equal scores; extra columns, of any name,
are carried through untouched; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, NOT_SPACE, byte_blocks, span_hashes, unused_name, word_spans
from tessera.llm.sampling import fitted, labelled_sample

BITS = 16
LENGTHS, SHARES = 24, 11
_A, _B, _0 = ord("A"), ord("a"), ord("0")
#: Bytes to their shape class: A, a (also any byte of a non-ASCII character), 0, or the byte itself.
SHAPE = np.array([_A if 65 <= b <= 90 else _B if 97 <= b <= 122 or b >= 0x80 else _0 if 48 <= b <= 57 else b for b in range(256)], dtype=np.uint8)


class Hashed:
    """The hashed features of some texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        low = LOWER[data]
        starts, ends = word_spans(low, offsets, NOT_SPACE)
        self.edge = np.searchsorted(starts, offsets)
        self.counts = np.diff(self.edge)
        n = len(starts)
        words = span_hashes(low, starts, ends)
        shape = SHAPE[data]
        changes = np.ones(len(shape), bool)
        changes[1:] = shape[1:] != shape[:-1]
        changes[starts] = True
        rank = np.concatenate([[0], np.cumsum(changes)])
        shapes = span_hashes(shape[changes], rank[starts], rank[ends])
        again = np.zeros(n, np.int64)
        again[1:] = words[1:] == words[:-1]
        again[self.edge[:-1][self.counts > 0]] = 0
        size = np.uint64(64 - BITS)
        self.token = np.stack([(words >> size).astype(np.int64), ((shapes * np.uint64(0x9E3779B97F4A7C15)) >> size).astype(np.int64), (1 << BITS) + again])
        row_of = np.repeat(np.arange(len(self.counts)), self.counts)
        order = np.lexsort((words, row_of))
        fresh = np.ones(n, bool)
        fresh[1:] = (words[order][1:] != words[order][:-1]) | (row_of[order][1:] != row_of[order][:-1])
        different = np.bincount(row_of[order][fresh], minlength=len(self.counts))
        base = (1 << BITS) + 2
        length = np.minimum(LENGTHS - 1, np.frexp(self.counts)[1])
        share = np.where(self.counts > 0, different * (SHARES - 1) // np.maximum(self.counts, 1), 0)
        self.row = np.stack([base + length, base + LENGTHS + share])
        self.row_of = row_of

    SIZE = (1 << BITS) + 2 + LENGTHS + SHARES


class Ordinal:
    """Shared weights and ascending thresholds for grades ``grades`` (ascending)."""

    def __init__(self, grades: list[int]) -> None:
        self.grades = grades
        self.weights = np.zeros(Hashed.SIZE, np.float32)
        self.thresholds = np.zeros(max(0, len(grades) - 1))

    def score(self, x: Hashed) -> np.ndarray:
        own = self.weights[x.token].sum(axis=0)
        means = np.bincount(x.row_of, weights=own, minlength=len(x.counts)) / np.maximum(x.counts, 1)
        return means + self.weights[x.row].sum(axis=0)

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each row and each boundary k; they fall along a row."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds[None, :], -30, 30)))

    def fit(self, texts: list[str], y: np.ndarray, rounds: int = 12, step: float = 0.5, shrink: float = 1e-5) -> None:
        """Adaptive gradient steps on the log-likelihood of the grades (``y``: places in ``grades``)."""
        k = len(self.grades)
        above = [(y > j).mean() for j in range(k - 1)]
        self.thresholds = np.sort(-np.log(np.array(above) / (1 - np.array(above))))
        square, other = np.full(Hashed.SIZE, 1e-8), np.full(k - 1, 1e-2)
        order = np.random.default_rng(11).permutation(len(texts))
        batches = []
        for part in np.array_split(order, max(1, len(texts) // 64)):
            raw = [texts[i].encode() for i in part]
            batches.append((Hashed(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])), y[part]))
        for _ in range(rounds):
            for x, own in batches:
                if not len(own):
                    continue
                _, grad, move = self.loss(x, own)
                grad += shrink * self.weights
                square += grad * grad
                self.weights -= (step * grad / np.sqrt(square)).astype(np.float32)
                other += move * move
                self.thresholds = np.maximum.accumulate(self.thresholds - 0.1 * move / np.sqrt(other))

    def loss(self, x: Hashed, own: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The mean negative log-likelihood of grades ``own`` (places), and its gradients by weights and by thresholds."""
        k, n, row = len(self.grades), len(own), np.arange(len(own))
        t = np.concatenate([np.ones((n, 1)), self.tails(self.score(x)), np.zeros((n, 1))], axis=1)
        upper, lower = t[row, own], t[row, own + 1]  # P(grade >= y), P(grade > y)
        p = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        g = -(du - dl) / n  # by the score
        grad = np.bincount(x.token.ravel(), weights=np.tile((g / np.maximum(x.counts, 1))[x.row_of], 3), minlength=Hashed.SIZE)
        grad += np.bincount(x.row.ravel(), weights=np.tile(g, 2), minlength=Hashed.SIZE)
        move = np.zeros(k + 1)
        np.add.at(move, own, du / n)
        np.add.at(move, own + 1, -dl / n)
        return float(-np.log(p).mean()), grad, move[1:k]


def fit_ordinal(texts: list[str], found: np.ndarray, grades: tuple[int, ...]) -> Ordinal:
    """Fit on texts and their grades; grades that no text has get no threshold."""
    known = sorted(set(found.tolist()))
    model = Ordinal(known if len(known) > 1 else sorted(grades))
    if len(known) > 1:
        model.fit(texts, np.searchsorted(known, found))
    return model


def learn(docs: DataFrame, labels: DataFrame, label: str, grades: tuple[int, ...], id_col: str, text_col: str, sample: int, sample_doc_bytes: int) -> Ordinal:
    rows = labelled_sample(docs, labels, label, grades, F.min, id_col, text_col, sample, sample_doc_bytes)
    return fitted(rows, lambda texts, found: fit_ordinal(texts, found, grades))


def graded(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    grades: tuple[int, ...] = (0, 1),
    select_from: int | None = None,
    least_tail: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample: int = 2500,
    sample_doc_bytes: int = 16_384,
    as_column: str = "quality",
) -> DataFrame:
    """All columns of ``docs`` and a struct ``as_column``: expected_grade, tails (P(grade > k)), tail, selected.

    ``tail`` is the probability of a grade of at least ``select_from`` (the highest grade by default).
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(learn(docs, labels, label, grades, id_col, text_col, sample, sample_doc_bytes))
    known = model.value.grades
    wanted = max(1, int(np.searchsorted(known, known[-1] if select_from is None else select_from)))
    at = docs.columns.index(text_col)
    kind = pa.struct([("expected_grade", pa.float64()), ("tails", pa.list_(pa.float64())), ("tail", pa.float64()), ("selected", pa.bool_())])
    steps = np.diff(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, rows, data, offsets in byte_blocks(batch.column(at)):
                tails = model.value.tails(model.value.score(Hashed(data, offsets)))
                expected = known[0] + tails @ steps
                found += [{"expected_grade": e, "tails": t, "tail": t[wanted - 1], "selected": t[wanted - 1] >= least_tail} for e, t in zip(expected.tolist(), tails.tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, as_column])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, `{as_column}` struct<expected_grade: double, tails: array<double>, tail: double, selected: boolean>")


def keep_quality(docs: DataFrame, labels: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the rows that are not selected; columns as they were."""
    name = unused_name("quality", docs.columns)
    return graded(docs, labels, text_col=text_col, as_column=name, **how).where(F.col(f"{name}.selected")).select(*docs.columns)
