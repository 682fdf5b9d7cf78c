"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Tokens are words; labels exist for documents only, so tokens of the training sample are labelled from
them: in toxic documents, the words that carry a feature (the word or its first bytes) which many
toxic and next to no clean documents have; in clean documents, none. Two states (clean, toxic) with
hashed emission features and a transition matrix are fitted by gradient steps on the exact
log-likelihood, with expectations from forward-backward. A chain is a whole text. It is cut into blocks of
``BLOCK`` words only to work on many at a time: each block's transfer matrix is found first, the messages
that enter and leave each block are products of those, and marginals are then those of the whole chain.

A document's score is a logistic function, fitted on documents that neither the labelling nor the
field has seen, of the largest marginal and of the sum of squared marginals, as it is and for each 100
words. Offending offsets are the runs of words whose marginal of the toxic state is at least one half, in code points.

The fit uses at most ``sample`` labelled rows of each class, of at most ``sample_doc_bytes`` bytes
each; the rows are chosen by a hash of doc_id. Only the text is an input of a score.

Defined cases: null, empty and wordless texts have the score of no marginals; null labels and null
doc_ids teach nothing; a doc_id with several labels is toxic if one says so; with a sample that lacks
one of the classes, or an empty table, every score is 0; rows repeated get equal scores; extra
columns, of any name, are carried through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ALNUM, LOWER, byte_blocks, span_hashes, unused_name, word_spans
from tessera.llm.sampling import fitted, labelled_sample

BLOCK = 64
BITS = 18
FEATURES = 5


def token_features(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Feature numbers, a row for each: the word, its first 4 and 6 bytes, its last 4 bytes, and its length."""
    size = ends - starts
    spans = [(starts, ends), (starts, np.minimum(ends, starts + 4)), (starts, np.minimum(ends, starts + 6)), (np.maximum(starts, ends - 4), ends)]
    out = np.zeros((FEATURES, len(starts)), np.int32)
    for i, (a, b) in enumerate(spans):
        out[i] = (span_hashes(low, a, b) ^ np.uint64(0x9E3779B97F4A7C15 * (i + 1) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(64 - BITS)
    out[FEATURES - 1] = np.minimum(size, 31)
    return out


def blocks(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For words in row order: the block of each, and its place there; for blocks: their lengths, and whether a text starts there."""
    start = np.cumsum(counts) - counts
    place = np.arange(counts.sum()) - np.repeat(start, counts)
    per_row = -(-counts // BLOCK)
    heads = np.cumsum(per_row) - per_row
    block = np.repeat(heads, counts) + place // BLOCK
    first = np.zeros(int(per_row.sum()), bool)
    first[heads[per_row > 0]] = True
    return block, place % BLOCK, np.bincount(block, minlength=len(first)), first


def products(m: np.ndarray) -> np.ndarray:
    """The products of the first 1, 2, 3, ... of a row of 2 x 2 matrices, each up to a factor, by doubling."""
    out, step = m / m.sum(axis=(1, 2), keepdims=True), 1
    while step < len(out):
        new = out[:-step] @ out[step:]
        out = np.concatenate([out[:step], new / new.sum(axis=(1, 2), keepdims=True)])
        step *= 2
    return out


def transfers(psi: np.ndarray, lengths: np.ndarray, first: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Each block's transfer matrix, up to a factor. A block that starts a text forgets what came before: its rows are equal."""
    rows, scale = [], []
    for x, y in ((1.0, 0.0), (0.0, 1.0)):
        x, y, log = np.full(len(psi), x), np.full(len(psi), y), np.zeros(len(psi))
        for t in range(psi.shape[1]):
            u, v = x * a[0, 0] + y * a[1, 0], (x * a[0, 1] + y * a[1, 1]) * psi[:, t]
            if t == 0:
                u, v = np.where(first, 1.0, u), np.where(first, psi[:, 0], v)
            z, alive = u + v, lengths > t
            x, y, log = np.where(alive, u / z, x), np.where(alive, v / z, y), log + np.where(alive, np.log(z), 0.0)
        rows.append(np.stack([x, y], axis=1))
        scale.append(log)
    most = np.maximum(*scale)
    return np.stack([r * np.exp(np.maximum(s - most, -600.0))[:, None] for r, s in zip(rows, scale)], axis=1)


def forward_backward(scores: np.ndarray, lengths: np.ndarray, first: np.ndarray, transition: np.ndarray, pairs: bool = False):
    """Marginals of the toxic state for scores of shape (blocks, words), and the expected transitions if asked for.

    Blocks of a text follow each other, each but a text's last one full; ``first`` says where a text starts.
    """
    n, size = scores.shape
    psi, a = np.exp(np.clip(scores, -30, 30)), np.exp(transition)
    m = transfers(psi, lengths, first, a)
    enter, leave = np.ones((n, 2)), np.ones((n, 2))
    if not first.all():
        enter[1:] = products(m)[:-1, 0]
        leave[:-1] = products(m[::-1].transpose(0, 2, 1))[::-1][1:].sum(axis=1)
        enter[first] = 1.0
        enter /= enter.sum(axis=1, keepdims=True)
        leave /= leave.sum(axis=1, keepdims=True)
    f0, f1 = np.empty((size, n)), np.empty((size, n))
    x, y = enter.T
    for t in range(size):
        u, v = x * a[0, 0] + y * a[1, 0], (x * a[0, 1] + y * a[1, 1]) * psi[:, t]
        if t == 0:
            u, v = np.where(first, 1.0, u), np.where(first, psi[:, 0], v)
        z = u + v
        x, y = u / z, v / z
        f0[t], f1[t] = x, y
    out = np.zeros((n, size))
    b0, b1 = leave.T
    expected = np.zeros((2, 2))
    for t in range(size - 1, -1, -1):
        p0, p1 = f0[t] * b0, f1[t] * b1
        out[:, t] = p1 / (p0 + p1)
        alive = lengths > t  # places past the end of a text say nothing about those before
        c0, c1 = b0, psi[:, t] * b1
        if pairs:
            g0, g1 = (f0[t - 1], f1[t - 1]) if t else enter.T
            q = np.array([g0 * a[0, 0] * c0, g0 * a[0, 1] * c1, g1 * a[1, 0] * c0, g1 * a[1, 1] * c1])
            expected += (q / q.sum(axis=0))[:, alive if t else alive & ~first].sum(axis=1).reshape(2, 2)
        u, v = a[0, 0] * c0 + a[0, 1] * c1, a[1, 0] * c0 + a[1, 1] * c1
        z = u + v
        b0, b1 = np.where(alive, u / z, b0), np.where(alive, v / z, b1)
    return (out, expected) if pairs else out


class Words:
    """The words of some texts, with their features."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.low = LOWER[data]
        self.starts, self.ends = word_spans(self.low, offsets, ALNUM)
        edge = np.searchsorted(self.starts, offsets)
        self.counts, self.edge = np.diff(edge), edge
        self.features = token_features(self.low, self.starts, self.ends)


class Field:
    """The fitted field: emission weights, transitions, and the document's logistic function."""

    def __init__(self) -> None:
        self.weights = np.zeros((1 << BITS) + 32, np.float32)
        self.transition = np.zeros((2, 2))
        self.bias = 0.0
        self.document: np.ndarray | None = None  # weights of what ``aggregate`` gives

    def _at(self, features: np.ndarray) -> np.ndarray:
        f = features.copy()
        f[FEATURES - 1] += 1 << BITS
        return f

    def marginals(self, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if not features.shape[1]:
            return np.zeros(0)
        block, place, lengths, first = blocks(counts)
        scores = np.zeros((len(lengths), BLOCK))
        scores[block, place] = self.weights[self._at(features)].sum(axis=0) + self.bias
        return forward_backward(scores, lengths, first, self.transition)[block, place]

    def fit(self, features: np.ndarray, counts: np.ndarray, labels: np.ndarray, rounds: int = 6, step: float = 0.3, shrink: float = 1e-4) -> None:
        """Adaptive gradient steps over batches of about 100 texts."""
        at = self._at(features)
        word_edge = np.concatenate([[0], np.cumsum(counts)])
        square = np.full(len(self.weights), 1e-6)
        other = np.full(5, 1e-6)
        self.bias = -3.0
        rng = np.random.default_rng(7)
        groups = [g for g in np.array_split(rng.permutation(len(counts)), max(1, len(counts) // 100)) if len(g)]
        for _ in range(rounds):
            for group in groups:
                words = np.concatenate([np.arange(word_edge[d], word_edge[d + 1]) for d in group])
                if not len(words):
                    continue
                block, place, lengths, first = blocks(counts[group])
                own, truth = at[:, words], labels[words]
                scores = np.zeros((len(lengths), BLOCK))
                scores[block, place] = self.weights[own].sum(axis=0) + self.bias
                found, expected = forward_backward(scores, lengths, first, self.transition, pairs=True)
                rest = found[block, place] - truth
                inner = np.flatnonzero(~(first[block] & (place == 0)))  # words with one before them
                seen = np.bincount(truth[inner - 1] * 2 + truth[inner], minlength=4).reshape(2, 2)
                g = np.bincount(own.ravel(), weights=np.tile(rest, FEATURES), minlength=len(self.weights)) / len(group)
                g += shrink * self.weights
                square += g * g
                self.weights -= (step * g / np.sqrt(square)).astype(np.float32)
                h = np.concatenate([[rest.sum()], (expected - seen).ravel()]) / len(group)
                other += h * h
                move = 0.1 * h / np.sqrt(other)
                self.bias -= move[0]
                self.transition = np.clip(self.transition - move[1:].reshape(2, 2), -6, 6)

    def aggregate(self, marginals: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """(1, largest marginal, log of 1 + the sum of squares, the same of the squares for each 100 words) of each row."""
        n = len(edge) - 1
        out = np.zeros((n, 4))
        out[:, 0] = 1
        some = np.flatnonzero(np.diff(edge) > 0)
        if len(some):
            out[some, 1] = np.maximum.reduceat(marginals, edge[some])
            squares = np.add.reduceat(marginals**2, edge[some])
            out[some, 2] = np.log1p(squares)
            out[some, 3] = np.log1p(100 * squares / np.diff(edge)[some])
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.zeros(len(x)) if self.document is None else 1 / (1 + np.exp(-np.clip(x @ self.document, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(hess, x.T @ (p - y) + ridge * w)
    return w


def token_labels(features: np.ndarray, doc_of: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """1 for words of toxic documents that carry a feature which goes with toxic documents.

    A feature goes with them if its documents are toxic far more often than others, and if that is no
    chance: its log-likelihood ratio exceeds the logarithm of the number of features looked at.
    """
    n_bad, n_good = max(1, toxic.sum()), max(1, (1 - toxic).sum())
    found = np.zeros(features.shape[1], bool)
    for f in features[:3]:
        pair = np.unique(doc_of * (1 << BITS) + f)
        of, bad = pair % (1 << BITS), toxic[pair // (1 << BITS)]
        p = np.bincount(of[bad == 1], minlength=1 << BITS)
        q = np.bincount(of[bad == 0], minlength=1 << BITS)
        share = np.maximum(p + q, 1) / (n_bad + n_good)
        ratio = p * np.log(np.maximum(p, 1e-9) / n_bad / share) + q * np.log(np.maximum(q, 1e-9) / n_good / share)
        odds = np.log((p + 0.1) / n_bad) - np.log((q + 0.1) / n_good)
        found |= ((ratio > np.log(max(2, (p + q > 0).sum()))) & (odds > 2.0))[f]
    return (found & (toxic[doc_of] == 1)).astype(np.int64)


def fit_field(texts: list[str], toxic: np.ndarray) -> Field:
    """Fit on texts and their labels: three quarters teach the field, the rest the document's function."""
    field = Field()
    if not len(texts) or toxic.min() == toxic.max():
        return field
    raw = [t.encode() for t in texts]
    words = Words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    teach = np.arange(len(texts)) % 4 != 3
    if toxic[~teach].sum() == 0 or toxic[teach].sum() == 0:
        teach[:] = True
    doc_of = np.repeat(np.arange(len(texts)), words.counts)
    own = teach[doc_of]
    labels = token_labels(words.features[:, own], doc_of[own], toxic)
    field.fit(words.features[:, own], words.counts[teach], labels)
    x = field.aggregate(field.marginals(words.features, words.counts), words.edge)
    rest = ~teach if not teach.all() else teach
    field.document = logistic(x[rest], toxic[rest])
    return field


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int, sample_doc_bytes: int) -> Field:
    return fitted(labelled_sample(docs, labels, "toxic", (0, 1), F.max, id_col, text_col, sample, sample_doc_bytes), fit_field)


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample: int = 1500,
    sample_doc_bytes: int = 16_384,
    as_column: str = "toxicity",
) -> DataFrame:
    """All columns of ``docs`` and a struct ``as_column``: score, and spans (offending [a, b) in code points)."""
    field = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, id_col, text_col, sample, sample_doc_bytes))
    at = docs.columns.index(text_col)
    kind = pa.struct([("score", pa.float64()), ("spans", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = field.value
        for batch in batches:
            found: list[dict] = []
            for _, rows, data, offsets in byte_blocks(batch.column(at)):
                words = Words(data, offsets)
                p = model.marginals(words.features, words.counts)
                scores = model.score(model.aggregate(p, words.edge))
                own = [{"score": s, "spans": []} for s in scores.tolist()]
                bad = np.flatnonzero(p >= 0.5)
                if len(bad):
                    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    row_of = np.searchsorted(words.edge, bad, side="right") - 1
                    joined = (np.diff(bad) == 1) & (np.diff(row_of) == 0)
                    heads = np.flatnonzero(np.concatenate([[True], ~joined]))
                    tails = np.append(heads[1:], len(bad)) - 1
                    base = points[offsets[row_of[heads]]]
                    for r, a, b in zip(row_of[heads].tolist(), (points[words.starts[bad[heads]]] - base).tolist(), (points[words.ends[bad[tails]]] - base).tolist()):
                        own[r]["spans"].append({"a": a, "b": b})
                found += own
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, as_column])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, `{as_column}` struct<score: double, spans: array<struct<a: bigint, b: bigint>>>")


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = 0.5, **how) -> DataFrame:
    """``docs`` without the rows whose score is at least ``threshold``; columns as they were."""
    name = unused_name("toxicity", docs.columns)
    return toxicity(docs, labels, text_col=text_col, as_column=name, **how).where(F.col(f"{name}.score") < threshold).select(*docs.columns)
