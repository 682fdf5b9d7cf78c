"""The prefix trie of conversations by Patricia construction over sorted sequences.

A turn is the first 128 bits of the SHA-256 of its role and text, and the number of its words; a conversation is the bytes of
its turns' digests, whose order keeps those with a common prefix together. Texts are read once and never shuffled.

1. Equal conversations become one sequence. They are range-partitioned by sequence and id, so a hot one is spread
   over many tasks; each task joins its run of ids to a string, and the strings of one sequence go through one hash in order.
2. Sequences are range-partitioned and sorted. Each task reads them as a stream and keeps a stack of points, which
   are made only at branches (the common prefix of neighbours), ends and leaves. A point that is done knows its subtree;
   the unary nodes of the edge above it have its members, so their sums follow by adding up the edge from below.
3. A prefix that sequences of several tasks share is a prefix of the first or of the last sequence of each of them. These
   prefixes, two paths a task, are made points at every depth and leave the task as parts. Parts of one node are added
   up by key. What counts once a node (its words, whether it is a leaf) is taken from the distinct ones.

Memory: one conversation's digests (20 bytes a turn) are a row, and a task waits with the children of an open branch.

Defined cases: null roles and texts are empty; turns are ordered by turn, null first, ties by digest; rows repeated are turns
of their own; rows without a conv_id belong to no conversation and are left out; conversations
without turns end at the root; other columns, of any name, aren't looked at; no conversations give no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import staged

#: Bytes of a turn's digest, and of a node's key.
WIDTH = 16
#: Rows of a batch that leaves a task, and characters of ids that are joined to one string.
ROWS, JOINED = 16_384, 1 << 20
EMPTY = hashlib.sha256(b"").hexdigest()

_NODE = "seam boolean, conv_id long, depth int, parent_conv_id long, parent_key binary, n_convs long, n_children long, n_leaves long, counted long, once long, inner boolean, key binary, line array<binary>, own_words long, ends_sha256 string"
_NAMES = [c.split()[0] for c in _NODE.split(", ")]
_TYPES = [pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), *[pa.int64()] * 5, pa.bool_(), pa.binary(), pa.list_(pa.binary()), pa.int64(), pa.string()]


def turns_of(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv_id, turns: an array of digest and words in order)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH)
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words")).alias("x"),
    )
    ordered = F.sort_array(F.collect_list("x"))
    return rows.groupBy("conv_id").agg(ordered.alias("x")).select("conv_id", F.transform("x", lambda x: F.struct(x["digest"].alias("digest"), x["words"].alias("words"))).alias("turns"))


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by sequence and id become one row for each run of a sequence: its ids joined (and one more for each JOINED characters)."""
    rows: list[tuple] = []
    run, ids, size = None, [], 0

    def close() -> None:
        if run is not None:
            rows.append((run[0], ids[0], ",".join(map(str, ids)), len(ids), run[1], run[2]))

    def batch() -> pa.RecordBatch:
        kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=["ends", "first", "ids", "n", "path", "words"])

    for b in batches:
        for conv_id, ends, path, words in zip(*(c.to_pylist() for c in b.columns)):
            if run is None or run[0] != ends or size > JOINED:
                close()
                run, ids, size = (ends, path, words), [], 0
            ids.append(conv_id)
            size += 12
            if len(rows) >= ROWS:
                yield batch()
                rows.clear()
    close()
    if rows:
        yield batch()


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by sequence and first id become one row for each sequence, with the digest of all its ids in order."""
    rows: list[tuple] = []
    now = None

    def batch() -> pa.RecordBatch:
        kinds = [pa.binary(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=["path", "words", "n", "least", "ends_sha256"])

    for b in batches:
        for ends, first, ids, n, path, words in zip(*(c.to_pylist() for c in b.columns)):
            if now is not None and now[0] == ends:
                now[5].update(b"," + ids.encode())
                now[3] += n
                continue
            if now is not None:
                rows.append((*now[1:5], now[5].hexdigest()))
            now = [ends, path, words, n, first, hashlib.sha256(ids.encode())]
            if len(rows) >= ROWS:
                yield batch()
                rows.clear()
    if now is not None:
        rows.append((*now[1:5], now[5].hexdigest()))
        yield batch()


def keys_of(path: bytes) -> list[bytes]:
    """The keys of all prefixes of a path, the empty one first."""
    h, out = hashlib.blake2b(digest_size=WIDTH), []
    for at in range(0, len(path) + 1, WIDTH):
        out.append(h.copy().digest())
        h.update(path[at : at + WIDTH])
    return out


def common(a: bytes, b: bytes) -> int:
    """The number of turns that two paths share at their start."""
    most = min(len(a), len(b))
    low, high = 0, most // WIDTH
    while low < high:
        middle = (low + high + 1) // 2
        if a[low * WIDTH : middle * WIDTH] == b[low * WIDTH : middle * WIDTH]:
            low = middle
        else:
            high = middle - 1
    return low


class Point:
    """A branch, end or leaf that is still open: what its finished children and its own ends add up to."""

    __slots__ = ("depth", "seam", "n", "least", "children", "leaves", "counted", "once", "inner", "sha", "waiting")

    def __init__(self, depth: int, seam: bool = False, n: int = 0, least: int | None = None, sha: str = EMPTY) -> None:
        self.depth, self.seam, self.n, self.least, self.sha = depth, seam, n, least, sha
        self.children = self.leaves = self.counted = self.once = 0
        self.inner = False
        self.waiting: list[tuple] = []

    def take(self, n: int, least: int, leaves: int, counted: int, once: int) -> None:
        self.n += n
        self.least = least if self.least is None else min(self.least, least)
        self.leaves += leaves
        self.counted += counted
        self.once += once
        self.inner = True


class Patricia:
    """The compressed trie of one task's sorted sequences; rows of nodes gather in ``rows``.

    ``counted`` is the sum of members times words over a subtree and ``once`` that of words; the saved tokens are their
    difference. A seam's ``once``, ``children`` and ``leaves`` leave out what other seams add.
    """

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.stack: list[Point] = []
        self.path: bytes | None = None
        self.words: list[int] = []
        self.keys: list[bytes] = []

    def add(self, path: bytes, words: list[int], n: int, least: int, sha: str) -> None:
        depth = len(path) // WIDTH
        if self.path is None:
            self.keys = keys_of(path)
            self.stack = [Point(d, True) for d in range(depth)]
        else:
            shared = common(self.path, path)
            while self.stack[-1].depth > shared:
                done = self.stack.pop()
                if not done.seam and self.stack[-1].depth < shared:
                    self.stack.append(Point(shared))
                self.close(done)
        self.stack.append(Point(depth, self.path is None, n, least, sha))
        self.path, self.words = path, words

    def close(self, p: Point) -> None:
        if p.seam:
            return self.close_seam(p, p.depth - 1)
        above = self.stack[-1]
        for child in p.waiting:
            self.rows.append((*child[:3], p.least, *child[4:]))
        leaves, children, sha = p.leaves if p.inner else 1, p.children, p.sha
        counted, once = p.counted, p.once
        for d in range(p.depth, above.depth, -1):  # the point itself, then the edge above it from below
            counted += p.n * self.words[d - 1]
            once += self.words[d - 1]
            row = (False, p.least, d, p.least, None, p.n, children, leaves, counted, once, None, None, None, None, sha)
            if d - 1 > above.depth:
                self.rows.append(row)
            elif above.seam:
                self.rows.append((*row[:3], None, self.keys[above.depth], *row[5:]))
            else:
                above.waiting.append(row)
            children, sha = 1, EMPTY
        above.children += 1
        above.take(p.n, p.least, leaves, counted, once)

    def close_seam(self, p: Point, to: int) -> None:
        """A part of a node for the point and for each prefix above it, down to depth ``to`` (excluded)."""
        inner, children, sha, counted = p.inner, p.children, p.sha, p.counted
        for d in range(p.depth, to, -1):
            own = self.words[d - 1] if d else 0
            counted += p.n * own
            self.rows.append((True, p.least, d, None, None, p.n, children, p.leaves, counted, p.once, inner, self.keys[d], self.keys[:d], own, sha))
            inner, children, sha = True, 0, EMPTY
        if self.stack:
            self.stack[-1].take(p.n, p.least, p.leaves, counted, p.once)

    def finish(self) -> None:
        """What is still open lies on the last path, whose prefixes are all seams."""
        if self.path is None:
            return
        self.keys = keys_of(self.path)
        while self.stack:
            p = self.stack.pop()
            self.rows += [(*child[:3], None, self.keys[p.depth], *child[5:]) for child in p.waiting]
            self.close_seam(p, self.stack[-1].depth if self.stack else -1)


def _trie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made = Patricia()

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*made.rows), _TYPES)], names=_NAMES)
        made.rows.clear()
        return out

    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            made.add(*row)
            if len(made.rows) >= ROWS:
                yield batch()
    made.finish()
    if made.rows:
        yield batch()


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie over rows (conv_id, turns: as of ``turns_of``), one conv_id a row.

    Columns: conv_id (the smallest member), depth, parent_conv_id (the parent's; null for the root), n_convs, n_children, n_leaves,
    saved_tokens (over the subtree, each node's words for all its members but one), ends_sha256 (of the ids that end at the node).
    """
    parts = lambda field: F.transform("turns", lambda x: x[field])
    path = F.unhex(F.array_join(parts("digest"), ""))
    own = staged(conversations.select("conv_id", F.unhex(F.sha2(path, 256)).alias("ends"), path.alias("path"), parts("words").cast("array<int>").alias("words")), "paths")
    runs = own.repartitionByRange("ends", "conv_id").sortWithinPartitions("ends", "conv_id").mapInArrow(_ids, "ends binary, first long, ids string, n long, path binary, words array<int>")
    distinct = runs.repartition("ends").sortWithinPartitions("ends", "first").mapInArrow(_sequences, "path binary, words array<int>, n long, least long, ends_sha256 string")
    distinct = staged(distinct, "sequences")
    made = staged(distinct.repartitionByRange("path").sortWithinPartitions("path").mapInArrow(_trie, _NODE), "trie")

    parts_of = made.where("seam").groupBy("key")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "counted", "once")]
    same = [F.first(c).alias(c) for c in ("depth", "line", "own_words")]
    ends = F.max(F.when(F.col("ends_sha256") != EMPTY, F.col("ends_sha256"))).alias("ends_sha256")
    seams = staged(parts_of.agg(F.min("conv_id").alias("conv_id"), F.max("inner").alias("inner"), ends, *sums, *same), "seams")
    up = seams.select("depth", "own_words", (~F.col("inner")).cast("long").alias("leaf"), F.posexplode(F.concat("line", F.array("key"))).alias("at", "of"))
    below = up.groupBy("of").agg(F.sum("own_words").alias("all_words"), F.sum("leaf").alias("all_leaves"), F.sum((F.col("at") == F.col("depth") - 1).cast("long")).alias("all_children"))
    whole = seams.join(below, F.col("key") == F.col("of")).select(
        "conv_id",
        "depth",
        F.element_at(F.concat(F.array(F.lit(None).cast("binary")), "line"), -1).alias("parent_key"),
        "n_convs",
        (F.col("n_children") + F.col("all_children")).alias("n_children"),
        (F.col("n_leaves") + F.col("all_leaves")).alias("n_leaves"),
        (F.col("counted") - F.col("once") - F.col("all_words")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
        "key",
    )
    whole = staged(whole, "seams")
    parents = whole.select(F.col("key").alias("of"), F.col("conv_id").alias("of_conv"))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inside = made.where("NOT seam").withColumn("saved_tokens", F.col("counted") - F.col("once"))
    hanging = inside.where("parent_key IS NOT NULL").drop("parent_conv_id").unionByName(whole, allowMissingColumns=True)
    hanging = hanging.join(parents, F.col("parent_key") == F.col("of"), "left").withColumn("parent_conv_id", F.col("of_conv"))
    return inside.where("parent_key IS NULL").select(*names).union(hanging.select(*names))
