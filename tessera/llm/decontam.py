"""Benchmark decontamination by winnowing.

Both sides keep the minimum k-gram hash of every sliding window. With k words a gram and
``window - k + 1`` grams a window, any shared span of ``window`` words holds the same window on both
sides and so at least one kept fingerprint in common: every shared span of that length is found.
Documents' fingerprints are joined to the benchmark's. Documents with a hit are extended from it over the
whole text: each of their windows is sought among the different windows of the items, and its words'
bytes are compared, so the work grows with the words and the hits, however often texts repeat themselves.
Items shorter than the window are single windows of their own length; for each such length every gram is kept.

The benchmark is the stated query set. It is cut into blocks of at most ``block_bytes`` of text (a
longer item makes a block of its own), so what is broadcast has a bound at any size of the benchmark;
the documents are scanned once a block, and with one block there is no shuffle at all.

Defined cases: null and wordless texts have no words and no hits; items without words are ignored;
item ids may repeat, and an item is reported if any of its rows occurs; rows repeated in ``docs`` each
get their own answer; an empty benchmark leaves every document clean; null doc_ids are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ALNUM, LOWER, byte_blocks, gram_hashes, span_hashes, staged, text_of, unused_name, word_spans

NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Words that are compared at a time.
WORDS = 1 << 18


def winnowed(grams: np.ndarray, width: int, fits: np.ndarray | None = None) -> np.ndarray:
    """Which grams are the minimum of some window of ``width`` grams (ties keep each); fits: windows that count."""
    n = len(grams) - width + 1
    if n <= 0:
        return np.zeros(len(grams), bool)
    least = grams[:n].copy()
    for j in range(1, width):
        np.minimum(least, grams[j : j + n], out=least)
    kept = np.zeros(len(grams), bool)
    for j in range(width):
        own = grams[j : j + n] == least
        kept[j : j + n] |= own if fits is None else own & fits
    return kept


class Block:
    """The fingerprints and windows of one block of the benchmark; small, and the same for every task."""

    def __init__(self, items: list[tuple[str, str]], window: int, k: int) -> None:
        self.window, self.k, self.width = window, k, window - k + 1
        raw = [text.encode() for _, text in items]
        self.ids = [item_id for item_id, _ in items]
        self.low = LOWER[np.frombuffer(b"".join(raw), np.uint8)]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        self.starts, self.ends = word_spans(self.low, offsets, ALNUM)
        h = span_hashes(self.low, self.starts, self.ends)
        edge = np.searchsorted(self.starts, offsets)
        counts = np.diff(edge)
        item = np.repeat(np.arange(len(items)), counts)
        left = edge[1:][item] - np.arange(len(h))  # words from here to the end of the item
        #: by length of the spans sought: sorted fingerprints, and sorted windows with the item and place of each, neighbours of equal bytes within an item once
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for span in sorted({min(int(c), window) for c in counts} - {0}):
            of_items = counts >= window if span == window else counts == span
            windows = gram_hashes(h, span)
            place = np.flatnonzero(of_items[item[: len(windows)]] & (left[: len(windows)] >= span))
            order = np.lexsort((place, item[place], windows[place]))
            place = place[order]
            own, of = windows[place], item[place]
            once = np.ones(len(place), bool)
            once[1:] = (own[1:] != own[:-1]) | (of[1:] != of[:-1])
            again = np.flatnonzero(~once)  # equal hashes may be those of other words: only equal bytes are a repeat
            once[again] = ~self._same(self.low, self.starts, self.ends, place[again], place[again - 1], span)
            if span == window:
                grams = gram_hashes(h, k)
                n = max(0, len(grams) - self.width + 1)
                kept = winnowed(grams, self.width, left[:n] >= window)
                marks = np.unique(grams[kept & of_items[item[: len(grams)]]])
            else:
                marks = np.unique(own)
            self.tables[span] = (marks, own[once], of[once], place[once])

    def hits(self, data: np.ndarray, offsets: np.ndarray):
        """(words of each row, [(row, first word, end word, item)]) for the rows of one byte block; words count within the row."""
        low = LOWER[data]
        starts, ends = word_spans(low, offsets, ALNUM)
        edge = np.searchsorted(starts, offsets)
        counts = np.diff(edge)
        out: list[tuple[int, int, int, int]] = []
        if not len(starts) or not self.tables:
            return counts, out
        row_of = np.repeat(np.arange(len(counts)), counts)
        left = edge[1:][row_of] - np.arange(len(starts))  # words from here to the end of the row
        h = span_hashes(low, starts, ends)
        for span, (marks, windows, items, places) in self.tables.items():
            k = self.k if span == self.window else span
            grams = gram_hashes(h, k)
            if not len(grams):
                continue
            grams = np.where(left[: len(grams)] >= k, grams, NONE)
            if span == self.window:
                n = len(grams) - self.width + 1
                kept = np.flatnonzero(winnowed(grams, self.width, left[: max(n, 0)] >= span))
            else:
                kept = np.flatnonzero(left[: len(grams)] >= span)
            at = np.minimum(np.searchsorted(marks, grams[kept]), len(marks) - 1)
            hit = np.zeros(len(counts), bool)
            hit[row_of[kept[marks[at] == grams[kept]]]] = True
            if not hit.any():
                continue
            own = gram_hashes(h, span)
            p = np.flatnonzero(hit[row_of[: len(own)]] & (left[: len(own)] >= span))
            first, last = np.searchsorted(windows, own[p]), np.searchsorted(windows, own[p], side="right")
            size = last - first
            p = np.repeat(p, size)
            entry = np.arange(len(p)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
            same = self._same(low, starts, ends, p, places[entry], span)
            p, item = p[same], items[entry[same]]
            order = np.lexsort((p, item))
            p, item = p[order], item[order]
            row = row_of[p]
            new = np.ones(len(p), bool)
            new[1:] = (np.diff(p) != 1) | (np.diff(item) != 0) | (np.diff(row) != 0)
            a = np.flatnonzero(new)
            b = np.append(a[1:], len(p)) - 1
            base = edge[row[a]]
            out += zip(row[a].tolist(), (p[a] - base).tolist(), (p[b] - base + span).tolist(), item[a].tolist()) if len(p) else []
        return counts, out

    def _same(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, p: np.ndarray, q: np.ndarray, span: int) -> np.ndarray:
        """Whether the ``span`` words from ``p`` on are those of the block from ``q`` on, byte by byte."""
        out = np.zeros(len(p), bool)
        step = max(1, WORDS // span)
        for at in range(0, len(p), step):
            x = (p[at : at + step, None] + np.arange(span)).ravel()
            y = (q[at : at + step, None] + np.arange(span)).ravel()
            size = ends[x] - starts[x]
            differ = size != self.ends[y] - self.starts[y]
            own = np.where(differ, 0, size)
            place = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
            odd = low[np.repeat(starts[x], own) + place] != self.low[np.repeat(self.starts[y], own) + place]
            differ[np.repeat(np.arange(len(own)), own)[odd]] = True
            out[at : at + step] = ~differ.reshape(-1, span).any(axis=1)
        return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> list[list[tuple[str, str]]]:
    """The benchmark's rows by block, read block by block; a block's bytes are bounded, and so is what the driver holds at a time."""
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), text_of(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    for i in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i)
        yield [(r.id, r.text) for r in part.toLocalIterator()]


def _scan(docs: DataFrame, name: str, text: str, block) -> DataFrame:
    """``docs`` with a struct column ``name``: words, hit runs and items of one block."""
    fields = "n_words: bigint, runs: array<struct<a: bigint, b: bigint>>, items: array<string>"
    kind = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("items", pa.list_(pa.string()))])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, rows, data, offsets in byte_blocks(batch.column(at)):
                counts, hits = block.value.hits(data, offsets)
                own = [{"n_words": n, "runs": [], "items": set()} for n in counts.tolist()]
                for row, a, b, item in hits:
                    own[row]["runs"].append({"a": a, "b": b})
                    own[row]["items"].add(block.value.ids[item])
                found += [x | {"items": sorted(x["items"])} for x in own]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, `{name}` struct<{fields}>")


def benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    k: int = 5,
    block_bytes: int = 8 << 20,
    as_column: str = "hits",
) -> DataFrame:
    """All columns of ``docs`` and a struct ``as_column``: n_words, runs (maximal equal runs [a, b) in words) and items (sorted ids).

    Rows are the rows of ``docs``. With several blocks the rows are numbered in a staged copy first.
    """
    spark = docs.sparkSession
    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        return _scan(docs, as_column, text_col, spark.sparkContext.broadcast(Block(first, window, k)))
    row = unused_name("row_no", docs.columns)
    numbered = staged(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    parts = []
    for items in [first, second, *blocks]:
        block = spark.sparkContext.broadcast(Block(items, window, k))
        parts.append(staged(_scan(numbered.select(row, text_col), as_column, text_col, block).select(row, as_column), "hits"))
        block.unpersist()
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    merged = every.groupBy(row).agg(
        F.struct(
            F.max(f"{as_column}.n_words").alias("n_words"),
            F.flatten(F.collect_list(f"{as_column}.runs")).alias("runs"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list(f"{as_column}.items")))).alias("items"),
        ).alias(as_column)
    )
    return numbered.join(merged, row).drop(row)


def words_hit(runs: str):
    """The number of words in the union of an array of runs."""
    state = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))
    return F.aggregate(
        F.array_sort(runs),
        state,
        lambda s, r: F.struct((s["n"] + F.greatest(F.lit(0).cast("bigint"), r["b"] - F.greatest(r["a"], s["end"]))).alias("n"), F.greatest(s["end"], r["b"]).alias("end")),
        lambda s: s["n"],
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the rows that share a window with the benchmark; columns as they were."""
    name = unused_name("hits", docs.columns)
    return benchmark_hits(docs, benchmark, text_col, as_column=name, **how).where(F.size(f"{name}.runs") == 0).select(*docs.columns)


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
