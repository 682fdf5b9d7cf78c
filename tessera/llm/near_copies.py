"""Near-duplicate groups at a Jaccard similarity of word shingles, by several SimHashes and BK-trees.

One 64-bit fingerprint within two bits finds hardly any pair whose shingle sets have a Jaccard similarity
of 0.8: such a pair differs in ten of 64 bits on average. So each text gets ``FPS`` fingerprints of its
set of shingles. A text stands in a shard for each key, which is some of these bits; in every
shard a BK-tree over one fingerprint (children keyed by their Hamming distance to the parent) finds the
members within ``radius`` bits, and a pair that was found is linked if all ``64 * FPS`` bits together differ
in no more places than two sets of the wanted similarity would. The expected share of differing bits is
acos(2s / (1 + s)) / pi at similarity s; ``SLACK`` standard deviations are added, so a pair at exactly
0.8 is linked with probability 0.96, one at 0.85 or more with 0.99 at least and one at 0.7 with 0.2.

Keys have more bits where there are more texts, so that unrelated texts fill a shard to ``SHARE`` on average at any size, and as
many keys as a pair needs to meet with probability 0.98: rows grow with the texts to the power 1.24.

Trees are built where their members are gathered: all trees together grow with the corpus, so sending
them to every task has no size bound. Only texts that are much alike fill a shard of more than ``shard_limit`` members.
It is searched as a whole in two rounds: first a tree for each piece of at most ``shard_limit`` members, which go to several tasks
beyond ``DEAL`` members. Then, where members
have different roots still, those outside the largest root are sought among all members: these are dealt in parts,
and so are those that are sought; a task has the tree of one part and searches it for one part. A shard
returns each member with the least member of its local group, so what is returned is linear in the members.

Defined cases: null and wordless texts are alike and form one group; a text of fewer words than a
shingle is one shingle; repeated rows are alike; a null doc_id sorts after all others when the row that
stays is chosen; an empty table gives an empty result; other columns are carried through untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, NOT_SPACE, byte_blocks, gram_hashes, mixed, span_hashes, staged, text_of, word_spans
from tessera.llm.components import connected_components
from tessera.llm.exact_dedup import without

FPS, BLOCK = 8, 12
PER_FP = 64 // BLOCK
#: Unrelated members of a shard, on average, and the probability that a similar pair meets in one.
SHARE, MEETING = 256, 0.98
#: Members of a large shard in one part, and pairs held at a time.
DEAL, PAIRS = 1 << 14, 1 << 16
#: Shingles of a text whose bits are added up together, such groups at a time, and shard rows that are searched at a time.
GROUP, GROUPS, ROWS = 64, 512, 1 << 16
#: Standard deviations by which the limit of differing bits exceeds its expectation.
SLACK = 1.75
_SEEDS = (np.arange(1, FPS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def differing(similarity: float) -> float:
    """The expected share of bits in which two texts differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def bit_limit(similarity: float) -> int:
    """Differing bits, of all ``64 * FPS``, up to which two texts count as similar."""
    p = differing(similarity)
    n = 64 * FPS
    return int(n * p + SLACK * math.sqrt(n * p * (1 - p)))


def key_width(texts: int) -> int:
    """The bits of a key for a number of different texts."""
    return max(BLOCK, math.ceil(math.log2(max(1, texts) / SHARE)))


class Keys:
    """The shard keys of signatures: the blocks of ``BLOCK`` bits of each fingerprint, or for wider keys as many choices of any bits as
    similar pairs need to meet; and the fingerprint by which each key's shards are searched."""

    def __init__(self, width: int, similarity: float) -> None:
        self.width = width
        self.picks = [(fp, [64 * fp + place * BLOCK + i for i in range(BLOCK)]) for fp in range(FPS) for place in range(PER_FP)]
        if width > BLOCK:
            same = (1 - differing(similarity)) ** width
            rng = np.random.default_rng(width)
            count = max(len(self.picks), math.ceil(math.log(1 - MEETING) / math.log1p(-same)))
            self.picks = [(k % FPS, rng.choice(64 * FPS, width, replace=False).tolist()) for k in range(count)]
        self.fp = np.array([fp for fp, _ in self.picks])

    def bits(self, sig: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(len(sig), np.uint64)
        for i, place in enumerate(self.picks[k][1]):
            out |= (sig[:, place // 64] >> np.uint64(place % 64) & np.uint64(1)) << np.uint64(i)
        return out.view(np.int64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The different shingle hashes of each row of a byte block, and the row of each, in row order."""
    low = LOWER[data]
    starts, ends = word_spans(low, offsets, NOT_SPACE)
    edge = np.searchsorted(starts, offsets)
    counts = np.diff(edge)
    own = span_hashes(low, starts, ends)
    row = np.repeat(np.arange(len(counts)), counts)
    grams = gram_hashes(own, words)
    whole = edge[1:][row[: len(grams)]] - np.arange(len(grams)) >= words
    h, r = [grams[whole]], [row[: len(grams)][whole]]
    for i in np.flatnonzero((counts > 0) & (counts < words)).tolist():
        h.append(gram_hashes(own[edge[i] : edge[i + 1]], int(counts[i])))
        r.append(np.array([i]))
    h, r = np.concatenate(h), np.concatenate(r)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[new], r[new]


def bit_counts(x: np.ndarray) -> np.ndarray:
    """How often each bit is set along the first axis (of at most ``GROUP``) of (n, groups, FPS): (groups, 64 * FPS).

    Carry-save adders take three words of one weight to one of that weight and one of the next, for all
    groups at once; what is left are the binary digits of the counts.
    """
    total = np.zeros((x.shape[1], 64 * FPS), np.uint8)
    weight, now = 0, x
    while len(now):
        carries = []
        while len(now) > 1:
            m = max(1, len(now) // 3)
            a, b = now[:m], now[m : 2 * m]
            if len(now) == 2:
                now, carry = a ^ b, a & b
            else:
                c = now[2 * m : 3 * m]
                both = a ^ b
                carry = (a & b) | (c & both)
                now = np.concatenate([both ^ c, now[3 * m :]])
            carries.append(carry)
        total += np.unpackbits(now[0].view(np.uint8), axis=1) << np.uint8(weight)
        weight += 1
        now = np.concatenate(carries) if carries else now[:0]
    return total


def signatures(h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """The fingerprints, of shape (rows, FPS): majority bits of differently mixed shingle hashes (``row`` ascends)."""
    ones = np.zeros((rows, 64 * FPS), np.int32)
    total = np.bincount(row, minlength=rows)
    place = np.arange(len(h)) - np.repeat(np.cumsum(total) - total, total)
    groups = -(-total // GROUP)
    group = np.repeat(np.cumsum(groups) - groups, total) + place // GROUP
    row_of = np.repeat(np.arange(rows), groups)
    for low in range(0, len(row_of), GROUPS):
        of = row_of[low : low + GROUPS]
        a, b = np.searchsorted(group, (low, low + len(of)))
        x = np.zeros((GROUP, len(of), FPS), np.uint64)
        x[place[a:b] % GROUP, group[a:b] - low] = mixed(mixed(h[a:b, None] ^ _SEEDS[None, :]) * _SEEDS[None, :])
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        ones[of[first]] += np.add.reduceat(bit_counts(x), first, axis=0, dtype=np.int32)
    return np.packbits(ones * 2 > total[:, None], axis=1).view(np.uint64)


def node_ids(sig: np.ndarray) -> np.ndarray:
    h = np.zeros(len(sig), np.uint64)
    for i in range(FPS):
        h = mixed(h * _SEEDS[i] + sig[:, i])
    return h.view(np.int64)


def signed_documents(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """Rows (doc_id, row_hash, node, sig), one per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, rows, data, offsets in byte_blocks(batch.column(2)):
                sig = signatures(*shingle_sets(data, offsets, words), rows)
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * FPS), rows, [None, pa.py_buffer(sig.tobytes())])
                yield pa.record_batch([batch.column(0).slice(low, rows), batch.column(1).slice(low, rows), pa.array(node_ids(sig)), raw.cast(pa.binary())], names=["doc_id", "row_hash", "node", "sig"])

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("row_hash"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, row_hash bigint, node bigint, sig binary")


def _matrix(column) -> np.ndarray:
    """A binary Arrow column of signatures as (rows, FPS)."""
    return np.frombuffer(column.cast(pa.binary(8 * FPS)).buffers()[1], np.uint64).reshape(-1, FPS)[column.offset : column.offset + len(column)] if len(column) else np.zeros((0, FPS), np.uint64)


def _keyed(nodes: DataFrame, keys: Keys) -> DataFrame:
    """(place, bits, root, sig) from (root, sig): a row for each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                root, raw = batch.column(0).slice(low, 2048), batch.column(1).slice(low, 2048)
                sig = _matrix(pa.array(raw.to_pylist(), pa.binary()))
                for k in range(len(keys.picks)):
                    yield pa.record_batch([pa.array(np.full(len(sig), k, np.int32)), pa.array(keys.bits(sig, k)), root, raw], names=["place", "bits", "root", "sig"])

    return nodes.select("root", "sig").mapInArrow(run, "place int, bits bigint, root bigint, sig binary")


class Forest:
    """The BK-trees of several shards side by side: nodes are rows, children of a node are ordered by edge."""

    def __init__(self, value: np.ndarray, shard: np.ndarray) -> None:
        """``shard``: the shard of each row, ascending. The first row of a shard is its root; at each node the
        first row at a distance is the child with that edge, and later rows at that distance go on below it."""
        n = len(value)
        self.value = value
        self.root = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))[shard - shard[0]] if n else np.zeros(0, np.int64)
        parent, edge = np.full(n, -1), np.zeros(n, np.int64)
        row = np.flatnonzero(np.arange(n) != self.root)
        at = self.root[row]
        while len(row):
            d = np.bitwise_count(value[row] ^ value[at]).astype(np.int64)
            order = np.lexsort((row, d, at))
            row, at, d = row[order], at[order], d[order]
            first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (d[1:] != d[:-1])]))
            child = np.repeat(row[first], np.diff(np.append(first, len(row))))
            parent[row[first]], edge[row[first]] = at[first], d[first]
            rest = np.ones(len(row), bool)
            rest[first] = False
            row, at = row[rest], child[rest]
        self.child = np.flatnonzero(parent >= 0)
        self.child = self.child[np.lexsort((edge[self.child], parent[self.child]))]
        self.code = parent[self.child] * 128 + edge[self.child]

    def near(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """All pairs (a < b) of one shard within ``radius``, at most ``PAIRS`` at a time."""
        for v, q in self._followed(self.value, self.root, radius):
            yield v[v < q], q[v < q]

    def near_to(self, value: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs (row, place in ``value``) within ``radius``, of a forest of one tree."""
        if len(self.value):
            yield from self._followed(value, np.zeros(len(value), np.int64), radius)

    def _followed(self, value: np.ndarray, root: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """From the given roots, only edges within the radius are followed."""
        todo = [(np.arange(len(value)), root)]
        while todo:
            query, node = todo.pop()
            if len(query) > PAIRS:
                todo.append((query[PAIRS:], node[PAIRS:]))
            q, v = query[:PAIRS], node[:PAIRS]
            d = np.bitwise_count(value[q] ^ self.value[v]).astype(np.int64)
            hit = d <= radius
            yield v[hit], q[hit]
            a = np.searchsorted(self.code, v * 128 + np.maximum(d - radius, 0))
            b = np.searchsorted(self.code, v * 128 + np.minimum(d + radius, 64), side="right")
            count = b - a
            start = np.cumsum(count) - count
            if count.any():
                todo.append((np.repeat(q, count), self.child[np.repeat(a - start, count) + np.arange(count.sum())]))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row reachable from each row over the pairs, by repeated minima."""
    root = np.arange(n)
    while len(a):
        least = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        root = root[root]
        if (root == before).all():
            break
    return root


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray, a_sig: np.ndarray, b_sig: np.ndarray, limit: int) -> np.ndarray:
    """``root`` with the roots ``a`` and ``b`` as one where their signatures are similar."""
    hit = np.bitwise_count(a_sig ^ b_sig).sum(axis=1, dtype=np.int64) <= limit
    if not hit.any():
        return root
    own, at = np.unique(np.concatenate([a[hit], b[hit]]), return_inverse=True)
    to = np.arange(len(root))
    to[own] = own[_roots(len(own), *np.split(at, 2))]
    return to[root]


def shard_links(value: np.ndarray, sig: np.ndarray, shard: np.ndarray, radius: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, root row) of the rows that link to others of their shard."""
    root = np.arange(len(value))
    for x, y in Forest(value, shard).near(radius):
        some = root[x] != root[y]
        x, y = x[some], y[some]
        root = _joined(root, root[x], root[y], sig[x], sig[y], limit)
    moved = np.flatnonzero(root != np.arange(len(value)))
    return moved, root[moved]


def _search(shards: DataFrame, keys: Keys, piece: int, radius: int, limit: int) -> DataFrame:
    """Links (a, b) of nodes from rows (place, bits, size: of the shard, sig); a partition's shards come one after the other, in order, cut into pieces."""

    def starts(table: pa.Table) -> np.ndarray:
        """Where pieces start; the first row starts one."""
        place, bits, salt = (table.column(k).to_numpy() for k in ("place", "bits", "salt"))
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1]) | (bits[1:] != bits[:-1]) | (salt[1:] != salt[:-1])
        at = np.arange(len(place))
        return new | ((at - np.maximum.accumulate(np.where(new, at, 0))) % piece == 0)

    def linked(table: pa.Table) -> pa.RecordBatch:
        sig = _matrix(table.column("sig").combine_chunks().cast(pa.binary()))
        value = sig[np.arange(len(sig)), keys.fp[table.column("place").to_numpy()]]
        a, b = shard_links(value, sig, np.cumsum(starts(table)) - 1, radius, limit)
        ids = node_ids(sig)
        return pa.record_batch([pa.array(ids[a]), pa.array(ids[b])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < ROWS:
                continue
            table = pa.Table.from_batches(held)
            cut = int(np.flatnonzero(starts(table))[-1])  # rows of the last piece may go on
            if cut:
                yield linked(table.slice(0, cut))
            held = table.slice(cut).to_batches()
            size -= cut
        if size:
            yield linked(pa.Table.from_batches(held))

    # a hot shard goes to several tasks; members meet others in each place, so that a large group of copies still gets one root
    salt = F.pmod(F.xxhash64("sig", "place"), F.ceil(F.col("size") / DEAL)).cast("int").alias("salt")
    ordered = shards.select("place", "bits", salt, "sig").repartition("place", "bits", "salt").sortWithinPartitions("place", "bits", "salt", "sig")
    return ordered.mapInArrow(run, "a bigint, b bigint")


def links_to(value: np.ndarray, sig: np.ndarray, label: np.ndarray, sought: np.ndarray, sought_sig: np.ndarray, sought_label: np.ndarray, radius: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(label, least label linked to it) by the pairs of a sought row and a row of the tree that have different labels."""
    names, own = np.unique(np.concatenate([label, sought_label]), return_inverse=True)
    of, to = own[: len(label)], own[len(label) :]
    root = np.arange(len(names))
    for v, q in Forest(value, np.zeros(len(value), np.int64)).near_to(sought, radius):
        some = root[of[v]] != root[to[q]]
        v, q = v[some], q[some]
        root = _joined(root, root[of[v]], root[to[q]], sig[v], sought_sig[q], limit)
    moved = np.flatnonzero(root != np.arange(len(root)))
    return names[moved], names[root[moved]]


def _search_large(members: DataFrame, keys: Keys, radius: int, limit: int) -> DataFrame:
    """Links (a, b) of roots from the rows (place, bits, root, sig) of large shards; members of a shard's largest root are not sought."""

    def linked(table: pa.Table) -> pa.Table:
        sig = _matrix(table.column("sig").combine_chunks().cast(pa.binary()))
        value = sig[:, keys.fp[table.column("place")[0].as_py()]]
        label, asked = table.column("root").to_numpy(), table.column("sought").to_numpy(zero_copy_only=False)
        a, b = links_to(value[~asked], sig[~asked], label[~asked], value[asked], sig[asked], label[asked], radius, limit)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    each = members.groupBy("place", "bits", "root").agg(F.count("*").alias("n"))
    parts = lambda n: F.ceil(n / DEAL).cast("int")
    several = each.groupBy("place", "bits").agg(F.max_by("root", F.struct("n", "root")).alias("top"), F.sum("n").alias("all"), (F.sum("n") - F.max("n")).alias("rest")).where("rest > 0")
    several = staged(several.select("place", "bits", "top", parts(F.col("all")).alias("parts"), parts(F.col("rest")).alias("asks")), "several")
    held = members.join(several, ["place", "bits"])
    of = lambda n: F.pmod(F.xxhash64("sig"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    tree = held.select("place", "bits", "root", "sig", F.lit(False).alias("sought"), of(F.col("parts")).alias("i"), every("asks").alias("j"))
    asked = held.where("root <> top").select("place", "bits", "root", "sig", F.lit(True).alias("sought"), every("parts").alias("i"), of(F.col("asks")).alias("j"))
    return tree.union(asked).groupBy("place", "bits", "i", "j").applyInArrow(linked, "a bigint, b bigint")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, radius: int = 16, shard_limit: int = 512) -> DataFrame:
    """One row per document: doc_id, row_hash (of the text), keep_id and keep_hash (of the row that stays)."""
    rows = staged(signed_documents(docs, id_col, text_col, words), "signatures")
    limit = bit_limit(similarity)
    different = staged(rows.select("sig").distinct().select(F.lit(0).cast("bigint").alias("root"), "sig"), "different")
    keys = Keys(key_width(different.count()), similarity)
    keyed = _keyed(different, keys).drop("root")
    sizes = staged(keyed.groupBy("place", "bits").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    roots = connected_components(_search(keyed.join(sizes, ["place", "bits"]), keys, shard_limit, radius, limit))
    placed = rows.join(roots, "node", "left").select("doc_id", "row_hash", "sig", F.coalesce("root", "node").alias("root"))
    large = sizes.where(F.col("size") > shard_limit)
    if not large.isEmpty():
        members = _keyed(placed.select("root", "sig").distinct(), keys).join(large, ["place", "bits"])
        more = connected_components(_search_large(members, keys, radius, limit)).select(F.col("node").alias("root"), F.col("root").alias("least"))
        placed = placed.join(more, "root", "left").withColumn("root", F.coalesce("least", "root"))
    placed = placed.select("doc_id", "row_hash", "root")
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("row_hash"))
    kept = placed.groupBy("root").agg(F.min(order).alias("k")).select("root", F.col("k.doc_id").alias("keep_id"), F.col("k.row_hash").alias("keep_hash"))
    kept = staged(kept, "kept")  # a join of two plain exchanges, which can be split where a group is hot
    return placed.join(kept, "root").select("doc_id", "row_hash", "keep_id", "keep_hash")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one document of each group of near copies; columns as they were.

    Rows that repeat both the doc_id and the text of the row that stays stay with it.
    """
    found = near_groups(docs, id_col, text_col, **how)
    gone = found.where(~(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("row_hash") == F.col("keep_hash"))))
    return without(docs, gone.select("doc_id", "row_hash"), id_col, text_col)
