"""Sequence packing with length buckets that minimise padding.

The global histogram of lengths decides ``buckets`` upper bounds by dynamic programming: a sequence is
padded to the bound of its bucket, and the sum of padding over all sequences is the least possible for
that number of bounds. Inside a bucket, sequences are numbered and cut into batches of as many rows as
fit the token budget at the bucket's bound.

The histogram is exact at every size. n different lengths sum up to n * n / 2 tokens at least, so a corpus
of T tokens has at most sqrt(2 * T) of them: six million for 2 * 10**13 tokens, in two arrays on the driver.
Numbering needs no whole bucket in one task: rows are dealt to slices by a hash, counted by (bucket,
slice), and numbered inside their slice behind the counts of the slices before it.

Defined cases: a null text has length zero and lies in the first bucket; a sequence longer than the
budget is a batch of its own; rows repeated with one doc_id get places of their own; rows without a doc_id
are dealt to slices by their number in a written table, so which of their places each gets may differ
between runs; an empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import staged, text_of


def best_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> tuple[list[int], int]:
    """The upper bounds that minimise padding, ascending, and the padding.

    ``lengths`` ascend. With C and S the sums of counts and of counts x length so far, a bucket of the
    lengths i+1..j costs L[j] * (C[j] - C[i]) - (S[j] - S[i]). That cost fulfils the quadrangle inequality, so
    the best i never falls as j grows: a layer is solved at far apart j first, and those between look only
    at what lies between their neighbours' i.
    """
    n = len(lengths)
    if not n:
        return [], 0
    wide = np.dtype(object) if float(lengths[-1]) * float(np.sum(counts)) >= 2.0**62 else np.dtype(np.int64)
    x = np.concatenate([[0], np.asarray(lengths)]).astype(wide)
    c = np.concatenate([[0], np.asarray(counts)]).astype(wide)
    total, weight = np.cumsum(c), np.cumsum(c * x)
    best = x * total - weight  # all in one bucket
    back = [np.zeros(n + 1, np.int64)]
    for _ in range(1, min(buckets, n)):
        best, choice = _layer(x, total, weight, best)
        back.append(choice)
    bounds, j = [], n
    for choice in reversed(back):
        if j == 0:
            break
        bounds.append(int(lengths[j - 1]))
        j = int(choice[j])
    return bounds[::-1], int(best[n])


def _layer(x: np.ndarray, total: np.ndarray, weight: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least costs with one bucket more than ``before``, and the least i that gives each."""
    n = len(x) - 1
    now, choice = np.zeros_like(before), np.zeros(n + 1, np.int64)
    step = 1 << n.bit_length()
    while step:
        own = np.arange(step, n + 1, 2 * step) if step <= n else np.zeros(0, np.int64)
        low = choice[own - step]
        above = own + step
        high = np.where(above <= n, choice[np.minimum(above, n)], own - 1)
        size = np.minimum(high, own - 1) - low + 1
        edge = np.cumsum(size)
        at = 0
        while at < len(own):  # as many as have about a million pairs together
            to = max(at + 1, int(np.searchsorted(edge, (edge[at - 1] if at else 0) + (1 << 20), side="right")))
            k = size[at:to]
            head = np.cumsum(k) - k
            i = np.arange(int(k.sum())) - np.repeat(head, k) + np.repeat(low[at:to], k)
            j = np.repeat(own[at:to], k)
            cost = before[i] + x[j] * (total[j] - total[i]) - (weight[j] - weight[i])
            least = np.minimum.reduceat(cost, head)
            hit = np.flatnonzero(cost == np.repeat(least, k))
            first = hit[np.searchsorted(hit, head)]
            now[own[at:to]], choice[own[at:to]] = least, i[first]
            at = to
        step //= 2
    return now, choice


def histogram(lengths: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The different lengths of the column ``length``, ascending, and their counts."""
    found = lengths.groupBy("length").agg(F.count("*").alias("rows")).toArrow()
    own, rows = (found.column(k).to_numpy() for k in ("length", "rows"))
    order = np.argsort(own)
    return own[order], rows[order]


def word_count(text_col: str = "text") -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text."""
    return F.regexp_count(text_of(text_col), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    length: Column | None = None,
    buckets: int = 16,
    budget: int = 32768,
    slice_rows: int = 50_000,
) -> DataFrame:
    """One row per document: doc_id, n_tokens, bucket, padded_to, padding, batch_id, slot.

    ``length`` is any column expression of a sequence's length; words and an end mark by default.
    ``batch_id`` is ``bucket:number``. All rows of a batch are padded to its bucket's bound.
    """
    length = word_count() + 1 if length is None else length
    salt = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id())
    rows = staged(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(length.cast("bigint"), F.lit(0)).alias("n_tokens"), salt.alias("salt")), "lengths")
    bounds, _ = best_bounds(*histogram(rows.select(F.col("n_tokens").alias("length"))), buckets)
    limits = F.array(*[F.lit(b).cast("bigint") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    bucket = F.aggregate(limits, F.lit(0), lambda n, b: n + F.when(F.col("n_tokens") > b, 1).otherwise(0))
    n_rows = rows.count()
    slices = max(1, -(-n_rows // slice_rows))
    own = rows.withColumn("bucket", bucket).withColumn("slice", F.pmod(F.xxhash64("doc_id", "n_tokens", "salt"), F.lit(slices)))

    sizes = own.groupBy("bucket", "slice").agg(F.count("*").alias("rows"))
    ahead = Window.partitionBy("bucket").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("bucket").alias("of_bucket"), F.col("slice").alias("of_slice"), F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("offset"))
    offsets = staged(offsets, "offsets")
    inside = F.row_number().over(Window.partitionBy("bucket", "slice").orderBy("doc_id", "n_tokens"))
    placed = own.withColumn("inside", inside - 1).join(offsets, (F.col("bucket") == F.col("of_bucket")) & (F.col("slice") == F.col("of_slice")))
    bound = F.element_at(limits, F.col("bucket") + 1) if bounds else F.lit(0).cast("bigint")
    placed = placed.withColumn("padded_to", bound).withColumn("place", F.col("offset") + F.col("inside"))
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("padded_to"), F.lit(1)))).cast("bigint")
    return placed.select(
        "doc_id",
        "n_tokens",
        F.col("bucket").cast("int").alias("bucket"),
        "padded_to",
        (F.col("padded_to") - F.col("n_tokens")).alias("padding"),
        F.concat_ws(":", F.col("bucket").cast("string"), F.floor(F.col("place") / room).cast("string")).alias("batch_id"),
        F.pmod(F.col("place"), room).alias("slot"),
    )
