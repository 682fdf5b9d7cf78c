"""Whitening of embeddings by a tall-skinny QR: exact sums, one R a partition, a tree of R factors, SVD of the last.

Every entry c becomes the integer y = floor(64 * c) (``scale`` is a parameter; an offset added to all of them changes
no result, so none is). A first scan adds up the integers exactly. A second takes y - T / n, whose numerator is exact,
into a QR decomposition that is updated batch by batch; each partition gives one triangle of d rows, and triangles meet
in groups of ``FAN`` until one is left. Its singular values and right vectors are those of all centred rows together, so
they whiten without a covariance having been formed. A third scan measures what was reached: the covariance of
the whitened rows against the identity. A fourth gives the rows.

No task holds more than a batch and a few triangles of d * d doubles, and the driver one triangle; nothing is
broadcast but the d * ``components`` projection.

Defined cases: rows whose vector is null or holds null or non-finite entries are left out; shorter vectors count as
filled with zeros up to the longest; entries beyond 2**62 / 64 count as that; directions without variance (singular
values of less than ``TINY`` of the largest, where no digit would be sure) have no component, so one row alone, or rows all
alike, give no components; rows repeated each count and get equal results (up to the order of additions); ids may
be null; extra columns are carried through; an empty table gives an empty result. ``deviation`` is exact
up to 38 digits, and null beyond.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Triangles that meet in one step of the tree.
FAN = 8
#: Singular values below this share of the largest are rounding.
TINY = 1e-11
#: Doubles of one pass in numpy.
PASS = 1 << 20
_FAR = float(1 << 62)


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite."""
    wide = vector.cast("array<double>")
    return F.coalesce(F.forall(wide, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False))


def integers(column, size: int | None, scale: int) -> Iterator[tuple[int, np.ndarray]]:
    """floor(scale * c) of an Arrow list column as int64 matrices of ``size`` columns (the longest vector's where None), with their first row."""
    lengths = np.diff(np.asarray(column.offsets, np.int64))
    flat = np.asarray(column.flatten(), np.float64)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    width = int(lengths.max(initial=0)) if size is None else size
    step = max(1, PASS // max(1, width))
    for low in range(0, len(lengths), step):
        own = lengths[low : low + step]
        out = np.zeros((len(own), width), np.int64)
        part = np.floor(np.clip(flat[ends[low] : ends[low + len(own)]] * scale, -_FAR, _FAR)).astype(np.int64)
        if (own == width).all():
            out[:] = part.reshape(out.shape)
        else:
            out[np.arange(width)[None, :] < own[:, None]] = part
        yield low, out


def exact_sums(vectors: DataFrame, scale: int) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of each dimension's integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, high, low = 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for _, y in integers(batch.column(0), None, scale):
                grow = max(0, y.shape[1] - len(high))
                high, low = np.pad(high, (0, grow)), np.pad(low, (0, grow))
                high[: y.shape[1]] += (y >> 31).sum(axis=0)  # two halves: neither overflows below 2**31 rows
                low[: y.shape[1]] += (y & 0x7FFFFFFF).sum(axis=0)
                rows += len(y)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(high))), pa.array([rows, *high.tolist()]), pa.array([0, *low.tolist()])], names=["at", "high", "low"])

    exact = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    found = vectors.mapInArrow(run, "at long, high long, low long").groupBy("at").agg(exact("high").alias("high"), exact("low").alias("low")).collect()  # a row for each dimension
    sums = {r["at"]: int(r["high"]) * (r["at"] < 0 or 1 << 31) + int(r["low"]) for r in found}
    return sums.get(-1, 0), [sums[i] for i in range(len(sums) - 1)]


class Centre:
    """Subtracts the means n-th parts of exact sums: y - T / n = (y - whole) - rest / n with integers ``whole`` and ``rest``."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n = n
        pairs = [divmod(t, n) for t in sums]
        self.whole = np.array([p[0] for p in pairs], np.int64)
        self.rest = [p[1] for p in pairs]
        self.share = np.array([p[1] / n for p in pairs])

    def centred(self, y: np.ndarray) -> np.ndarray:
        return (y - self.whole) - self.share

    def deviations(self, y: np.ndarray) -> pa.Array:
        """Sums over dimensions of (n * y - T)**2, exact."""
        w, wide = y - self.whole, pa.decimal128(38, 0)
        most = (int(np.abs(w).max(initial=0)) + 1) * self.n
        if most * most * max(1, w.shape[1]) < 1 << 62:
            return pa.array(((w * self.n - np.array(self.rest, np.int64)) ** 2).sum(axis=1)).cast(wide)
        found = ((w.astype(object) * self.n - np.array(self.rest, object)) ** 2).sum(axis=1).tolist()
        return pa.array([Decimal(v) if v < 10**38 else None for v in found], wide)


def triangle(blocks: Iterator[np.ndarray], width: int) -> np.ndarray:
    """The R factor of all rows of ``blocks`` together."""
    r = np.zeros((0, width))
    for block in blocks:
        r = np.linalg.qr(np.concatenate([r, block]), mode="r")
    return r


def last_triangle(vectors: DataFrame, centre: Centre, scale: int) -> np.ndarray:
    """The R factor of all centred rows, by a tree over the partitions' own."""
    width = len(centre.whole)
    names, kind = ["part", "r"], "part long, r array<double>"

    def one(part: int, r: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([r.ravel().tolist()], pa.list_(pa.float64()))], names=names)

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = triangle((centre.centred(y) for b in batches for _, y in integers(b.column(0), width, scale)), width)
        if len(r):
            yield one(TaskContext.get().partitionId(), r)

    def merged(table: pa.Table) -> pa.Table:
        parts = table.sort_by("part")
        r = triangle((np.array(x).reshape(-1, width) for x in parts.column("r").to_pylist()), width)
        return pa.Table.from_batches([one(parts.column("part")[0].as_py(), r)])

    level, left, step = vectors.mapInArrow(of_rows, kind), vectors.rdd.getNumPartitions(), FAN
    while True:
        level = level.groupBy(F.expr(f"part div {step}")).applyInArrow(merged, kind)
        if step >= left:
            break
        step *= FAN
    found = level.collect()  # one triangle
    return triangle((np.array(x.r).reshape(-1, width) for x in found), width)


def identity_error(vectors: DataFrame, centre: Centre, project: np.ndarray, scale: int) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, from a scan of all rows."""
    width, k = project.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, product = np.zeros(k), np.zeros((k, k))
        for b in batches:
            for _, y in integers(b.column(0), width, scale):
                z = centre.centred(y) @ project
                total += z.sum(axis=0)
                product += z.T @ z
        sums = np.concatenate([total, product.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], names=["at", "v"])

    found = {r["at"]: r["v"] for r in vectors.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()}  # k + k * k numbers
    sums = np.array([found[i] for i in range(len(found))]) / centre.n
    mean, second = sums[:k], sums[k:].reshape(k, k)
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def whitened(df: DataFrame, vector_col: str = "embedding", components: int = 32, scale: int = 64, as_column: str = "whitening") -> DataFrame:
    """All columns of the usable rows of ``df`` and a struct ``as_column``: n, deviation, whitened (an array), explained (an array), identity_error.

    ``whitened`` has the row's coordinates on the first ``components`` unit eigenvectors of the covariance, by falling
    variance, each over its standard deviation; ``explained`` the components' shares of the variance.
    """
    rows = df.where(usable(F.col(vector_col)))
    vectors = rows.select(F.col(vector_col).cast("array<double>").alias("v"))
    n, sums = exact_sums(vectors, scale)
    centre = Centre(max(n, 1), sums)
    r = last_triangle(vectors, centre, scale) if n and sums else np.zeros((0, len(sums)))
    _, values, right = np.linalg.svd(r, full_matrices=False) if r.size else (None, np.zeros(0), np.zeros((0, len(sums))))
    known = int((values > TINY * values.max(initial=0)).sum())
    k = min(components, known)
    explained = (values[:k] ** 2 / max((values**2).sum(), 1e-300)).tolist()
    project = right[:k].T * (np.sqrt(n) / values[:k])
    error = identity_error(vectors, centre, project, scale) if k else None
    shared = df.sparkSession.sparkContext.broadcast((centre, project))
    at = rows.columns.index(vector_col)
    numbers = pa.list_(pa.float64())
    kind = pa.struct([("n", pa.int64()), ("deviation", pa.decimal128(38, 0)), ("whitened", numbers), ("explained", numbers), ("identity_error", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, project = shared.value
        for batch in batches:
            for low, y in integers(batch.column(at), len(project), scale):
                count = len(y)
                offsets = lambda: pa.array(np.arange(count + 1, dtype=np.int32) * k)
                z = pa.ListArray.from_arrays(offsets(), pa.array((centre.centred(y) @ project).ravel()))
                shares = pa.ListArray.from_arrays(offsets(), pa.array(np.tile(np.array(explained, np.float64), count)))
                parts = [pa.array(np.full(count, n)), centre.deviations(y), z, shares, pa.array([error] * count, pa.float64())]
                own = pa.StructArray.from_arrays(parts, fields=list(kind))
                yield pa.RecordBatch.from_arrays([*batch.slice(low, count).columns, own], names=[*batch.schema.names, as_column])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, `{as_column}` struct<n: long, deviation: decimal(38,0), whitened: array<double>, explained: array<double>, identity_error: double>")
