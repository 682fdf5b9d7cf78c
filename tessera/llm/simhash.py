"""SimHash near-duplicates found with BK-trees.

Every document gets a 64-bit majority fingerprint of its word shingles. Two fingerprints that differ
in at most ``radius`` bits agree on at least ``blocks - radius`` of ``blocks`` bit blocks, so each
distinct fingerprint goes to one shard for every choice of that many blocks, and every linked pair
meets in some shard. Each shard holds a BK-tree (children keyed by their Hamming distance to the
parent); a search follows only edges within the radius. A shard's tree is built and searched where
the shard's members are gathered: all trees together grow with the corpus, so sending them to every
task has no size bound, and routing by shard key replaces it. A shard of more than ``shard_limit``
members is not built; its members are dealt again by finer blocks (``fine_blocks``), which leaves few
enough free bits for a bound on the size of a shard.

A shard returns each linked member with the least member of its local group, so output is linear in
the members, however many pairs are near each other; components are then found over those links.

Defined cases: a null or blank text has fingerprint zero and links like any other; texts of fewer
words than a shingle are one shingle; a null doc_id gets a row and is never the component's id unless
all its members are null; repeated rows each get their row; an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import staged, text_of
from tessera.llm.components import connected_components

SEED = 42


def fingerprint(text: bytes, words: int, distinct: bool) -> int:
    """The majority bits of XXH64 over the shingles of ``text``, as a signed integer."""
    w = text.lower().split()  # bytes: A-Z only, and exactly the six ASCII white-space characters
    if not w:
        return 0
    if len(w) < words:
        shingles = [b" ".join(w)]
    elif words == 1:
        shingles = w
    else:
        shingles = [b" ".join(s) for s in zip(*(w[i:] for i in range(words)))]
    if distinct:
        shingles = list(set(shingles))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, SEED) for s in shingles), np.dtype(">u8"), len(shingles))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h)).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distinct: bool = False) -> DataFrame:
    """Rows (doc_id, fp), one per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", words, distinct) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def block_masks(blocks: int, radius: int) -> list[int]:
    """Signed 64-bit masks, one for each choice of ``blocks - radius`` of the bit blocks."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    part = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    masks = [sum(part[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


class BKTree:
    """A Burkhard-Keller tree over 64-bit integers under Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def near_then_add(self, value: int, radius: int) -> list[int]:
        """The places of stored values within ``radius`` of ``value``, which is then stored."""
        values, children = self.values, self.children
        found: list[int] = []
        if values:
            stack = [0]
            while stack:
                at = stack.pop()
                d = (values[at] ^ value).bit_count()
                if d <= radius:
                    found.append(at)
                low, high = d - radius, d + radius
                for edge, child in children[at].items():
                    if low <= edge <= high:
                        stack.append(child)
            at = 0
            while True:
                d = (values[at] ^ value).bit_count()
                if d not in children[at]:
                    children[at][d] = len(values)
                    break
                at = children[at][d]
        values.append(value)
        children.append({})
        return found


def shard_links(members: list[int], radius: int) -> list[tuple[int, int]]:
    """(member, least member of its group) for the members of one shard that link to others."""
    members = sorted(members)
    parent = list(range(len(members)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    tree = BKTree()
    for i, value in enumerate(members):
        for j in tree.near_then_add(value & 0xFFFFFFFFFFFFFFFF, radius):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return [(members[i], members[r]) for i in range(len(members)) if (r := root(i)) != i]


def _search(shards: DataFrame, radius: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for members in batch.column(0):
                for x, y in shard_links(members.as_py(), radius):
                    a.append(x)
                    b.append(y)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return shards.select("members").mapInArrow(run, "a bigint, b bigint")


def _keyed(fps: DataFrame, blocks: int, radius: int) -> DataFrame:
    keys = [F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(block_masks(blocks, radius))]
    return fps.select("fp", F.explode(F.array(*keys)).alias("key")).select("fp", "key.choice", "key.bits")


def linked_fingerprints(fps: DataFrame, radius: int = 2, blocks: int = 6, fine_blocks: int = 12, shard_limit: int = 1024) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct ``fp`` within ``radius`` bits."""
    keyed = _keyed(fps, blocks, radius)
    sizes = staged(keyed.groupBy("choice", "bits").agg(F.count("*").alias("size")).where("size > 1"), "shards")
    members = keyed.join(sizes, ["choice", "bits"])
    few = members.where(F.col("size") <= shard_limit).groupBy("choice", "bits").agg(F.collect_list("fp").alias("members"))
    out = _search(few, radius)
    if not sizes.where(F.col("size") > shard_limit).isEmpty():
        many = staged(members.where(F.col("size") > shard_limit).select("fp").distinct(), "many")
        finer = _keyed(many, fine_blocks, radius).groupBy("choice", "bits").agg(F.collect_list("fp").alias("members")).where("size(members) > 1")
        out = out.union(_search(finer, radius))
    return out


def simhash_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 3,
    distinct: bool = False,
    radius: int = 2,
    **search,
) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest doc_id reachable over links)."""
    rows = staged(fingerprints(docs, id_col, text_col, words, distinct), "fingerprints")
    nodes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "nodes")
    roots = connected_components(linked_fingerprints(nodes.select("fp"), radius, **search))
    tied = staged(nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least_id"), "tied")
    least = staged(tied.groupBy("root").agg(F.min("least_id").alias("component_id")), "least")
    named = staged(tied.join(least, "root").select(F.col("fp").alias("of"), "component_id"), "named")
    return rows.join(named, F.col("fp") == F.col("of"), "left").select("doc_id", "fp", "component_id")
