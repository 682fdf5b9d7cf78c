"""Helpers shared by the training-data operators: staging, byte blocks, word splitting."""

from __future__ import annotations

import atexit
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on; a single longer document makes a longer pass.
BLOCK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or on a local master one of our own where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: a folder that all executors share is needed")
        at = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
    return at.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended, and the folder is left to the cluster's own cleaning
        pass


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/tessera-{tag}-{uuid.uuid4().hex[:12]}"
    atexit.register(_remove, spark, path)
    return path


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back, which cuts the lineage."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Remove the files of a staged table that nothing reads any more."""
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        _remove(df.sparkSession, f)


def text_of(column: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def unused_name(base: str, taken: list[str]) -> str:
    """``base``, with underscores before it until no column has that name (names are compared without case)."""
    low = {x.lower() for x in taken}
    while base.lower() in low:
        base = f"_{base}"
    return base


def byte_table(keep) -> np.ndarray:
    """A table of 256 booleans from a predicate on byte values."""
    return np.array([keep(b) for b in range(256)])


#: ASCII letters to lower case, other bytes as they are.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of text whose A-Z are lower-cased.
ALNUM = byte_table(lambda b: b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122)
#: Bytes of words [^\x20\x09-\x0D]+.
NOT_SPACE = byte_table(lambda b: b != 32 and not 9 <= b <= 13)


def byte_blocks(column, limit: int = BLOCK_BYTES):
    """Cut an Arrow string column into row ranges of about ``limit`` bytes.

    Yields (first row, rows, bytes as uint8, offsets of the rows in them); nulls count as empty.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    buffers = column.buffers()
    if len(column) == 0:
        return
    at = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(column):
        high = int(np.searchsorted(at, at[low] + limit, side="right")) - 1
        high = min(max(high, low + 1), len(column))
        yield low, high - low, data[at[low] : at[high]], at[low : high + 1] - at[low]
        low = high


def word_spans(low: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the words of all rows; a word never crosses rows."""
    n = len(low)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = table[low]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = inside[ends]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse, modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, BLOCK_BYTES + 1024)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * _MIX
    return h ^ (h >> np.uint64(29))


def span_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of byte spans, independent of where they stand."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(low) + 1)
    total = np.zeros(len(low) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts])


def gram_hashes(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of ``k`` consecutive words from the words' hashes; row edges are the caller's business."""
    n = len(word_hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * _BASE + word_hashes[j : j + n]
    return mixed(h)
