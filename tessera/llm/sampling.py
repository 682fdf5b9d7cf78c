"""The bounded sample of labelled rows that classifiers are fitted on, and the fit in one task."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import text_of


def _order(doc_id: int) -> tuple[int, int]:
    return (doc_id * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 32, doc_id


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    values: tuple[int, ...],
    of_several,
    id_col: str,
    text_col: str,
    sample: int,
    sample_doc_bytes: int,
) -> DataFrame:
    """Rows (doc_id, text, label): at most ``sample`` of each value, of at most ``sample_doc_bytes`` bytes each.

    Only rows whose crc32(doc_id) mod 5 is not 0 are taken, chosen by a hash of doc_id; ``of_several``
    settles several labels of one doc_id. The chosen ids, at most ``sample`` for each value, are what is
    broadcast.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(*values))
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).groupBy("doc_id").agg(of_several("label").alias("label"))
    chosen = None
    for value in values:
        part = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.union(part)
    chosen = F.broadcast(chosen.select(F.col("doc_id").alias("of"), "label"))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).where(F.octet_length("text") <= sample_doc_bytes)
    return rows.join(chosen, F.col("doc_id") == F.col("of")).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "label")


def _once(table: pa.Table) -> tuple[list[str], np.ndarray]:
    """Texts and labels in an order that depends on the ids alone; equal texts once, with their least id's label."""
    rows = sorted(zip(*(table.column(k).to_pylist() for k in ("doc_id", "text", "label"))), reverse=True)
    once = {text: (doc_id, label) for doc_id, text, label in rows}
    ordered = sorted(once.items(), key=lambda x: (_order(x[1][0]), x[0]))
    return [t for t, _ in ordered], np.array([v[1] for _, v in ordered], dtype=np.int64)


def fitted(sample: DataFrame, fit: Callable[[list[str], np.ndarray], object]):
    """What ``fit`` makes of the texts and labels of a bounded sample. It runs in one task; only the model comes to the driver.

    A task that is lost is run again, with the same rows in the same order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        model = fit(*_once(pa.Table.from_batches(parts))) if parts else fit([], np.zeros(0, np.int64))
        yield pa.record_batch([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    found = sample.repartition(1).mapInArrow(run, "model binary").head()
    return pickle.loads(bytes(found.model)) if found else fit([], np.zeros(0, np.int64))
