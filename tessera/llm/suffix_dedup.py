"""Removal of byte strings that an earlier document has, with suffix arrays where they are needed.

A byte goes if a string of ``SPAN`` bytes that covers it also starts in a document with a smaller
doc_id. Comparing all suffixes of all shards with each other would be quadratic in the shards, so equal
strings are first brought together by content. Every window of ``SPAN`` bytes keeps the least hash of
its ``GRAM``-byte grams as an anchor, so equal windows have equal anchors at equal places:

1. Texts are dealt to shards by doc_id. Each shard reports its anchors' hashes once, with the hash of
   the anchor's context (all bytes of all windows that hold it) and the smallest doc_id.
2. By anchor hash: anchors of one document only are dropped. If all contexts of an anchor are equal, its
   smallest doc_id settles every window of the context. Otherwise it settles those shards' contexts that a
   smaller doc_id of another shard has as a whole, and one shard for each context is asked for its bytes.
3. Shards send the contexts asked for, which stand at edges of repeated passages.
   Those that share half a window's other bytes with none of their anchor are passed over.
   By anchor hash the rest form pieces of at most ``PIECE`` bytes. Each piece gets a suffix array by
   Larsson-Sadakane refinement and common prefixes by Kasai's rule; runs of prefixes of at least
   ``SPAN`` bytes are equal windows. A group that spans pieces is merged by binary search of a piece's
   windows in the sorted windows of the pieces before it, which hold the smaller doc_ids.
   An anchor of more than ``most_contexts`` contexts forms no group: shards report each of its windows once, by
   hash, with the smallest doc_id, and groups are by anchor and window, so they hold a row a shard at most.
4. Shards mark what was settled in 2 and 3, and what their own documents repeat, and cut it out.

Decisions compare the bytes themselves in 3, and in 1, 2 and 4 48-bit hashes of contexts together with
48-bit hashes of anchors; for anchors of many contexts 64-bit hashes of windows. Text is shuffled once, compressed: all uses of the shards share one exchange.

Defined cases: a null text is the empty text; texts of fewer than ``SPAN`` bytes stay whole; a null
doc_id counts as larger than all others; rows with the same doc_id don't remove from each other; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import byte_blocks, mixed, powers, span_hashes, text_of

SPAN, GRAM = 50, 20
WINDOWS = SPAN - GRAM + 1
PIECE = 1 << 18
LAST = (1 << 63) - 1
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_HIGH, _LOW = np.uint64(0xFFFFFFFFFFFF0000), np.uint64(0xFFFFFFFFFFFF)


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` of every ``width`` values in a row, by doubling."""
    size = 1
    while size * 2 <= width:
        x = best(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return best(x[: len(x) - rest], x[rest:]) if rest else x


class Anchors:
    """The anchors of the texts of one byte block, with their contexts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        none = np.zeros(0, np.int64)
        self.place = self.row = self.low = self.high = none
        self.hash = self.context = self.total = np.zeros(0, np.uint64)
        if len(data) < SPAN:
            return
        x = data.astype(np.uint64)
        x = x[:-1] | x[1:] << np.uint64(8)
        x = x[:-2] | x[2:] << np.uint64(16)
        n = len(data) - GRAM + 1
        g = np.zeros(n, np.uint64)
        for at in range(0, GRAM, 4):
            g = (g ^ x[at : at + n]) * _C1
            g ^= g >> np.uint64(31)
        g *= _C3
        key = (g >> np.uint64(32)).astype(np.uint32)
        least = _sliding(key, WINDOWS, np.minimum)
        edge = np.zeros(WINDOWS - 1, np.uint32)
        place = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), WINDOWS, np.maximum) == key)
        row = np.searchsorted(offsets, place, side="right") - 1
        low, high = np.maximum(offsets[row], place - WINDOWS + 1), np.minimum(offsets[row + 1], place + SPAN)
        keep = (place + GRAM <= offsets[row + 1]) & (high - low >= SPAN)
        self.place, self.row, self.low, self.high = place[keep], row[keep], low[keep], high[keep]
        self.hash = mixed(g[self.place]) & _HIGH
        up, down = powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
        left = (self.place - self.low).astype(np.uint64)
        self.total = total
        self.context = mixed((total[self.high] - total[self.low]) * down[self.low] + left * _C2) & _LOW | np.uint64(1)


    def windows(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The windows of some anchors: the anchor of each, where it starts, and its hash."""
        count = self.high[anchors] - self.low[anchors] - SPAN + 1
        of = np.repeat(anchors, count)
        start = self.low[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        _, down = powers(len(self.data) + 1)
        return of, start, mixed((self.total[start + SPAN] - self.total[start]) * down[start])


def _shard_anchors(docs, texts) -> tuple[list[Anchors], np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """The blocks of a shard with their anchors; hashes, contexts and doc_ids of all; and the doc_ids of each block's rows."""
    blocks, ids = [], []
    for low, rows, data, offsets in byte_blocks(texts):
        blocks.append(Anchors(data, offsets))
        ids.append(docs[low : low + rows])
    if not blocks:
        none = np.zeros(0, np.uint64)
        return [], none, none, np.zeros(0, np.int64), []
    return blocks, np.concatenate([b.hash for b in blocks]), np.concatenate([b.context for b in blocks]), np.concatenate([i[b.row] for b, i in zip(blocks, ids)]), ids


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where a new group starts in sorted keys."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, d, text) as one compressed row (shard, rows) for each shard of a batch."""
    how = pa.ipc.IpcWriteOptions(compression="zstd")
    for batch in batches:
        shard = batch.column(0).to_numpy()
        order = np.argsort(shard, kind="stable")
        edge = np.append(_heads(shard[order]), len(order))
        blobs = []
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            sink = pa.BufferOutputStream()
            own = batch.select(["d", "text"]).take(pa.array(order[a:b]))
            with pa.ipc.new_stream(sink, own.schema, options=how) as out:
                out.write_batch(own)
            blobs.append(sink.getvalue().to_pybytes())
        yield pa.record_batch([pa.array(shard[order][edge[:-1]], pa.int32()), pa.array(blobs, pa.binary())], names=["shard", "rows"])


def _columns(table: pa.Table):
    """The doc_ids and texts of a shard's packed rows."""
    own = [pa.ipc.open_stream(b.as_buffer()).read_all() for b in table.column("rows").combine_chunks()] if table.num_rows else []
    if not own:
        return np.zeros(0, np.int64), pa.array([], pa.large_string())
    both = pa.concat_tables(own)
    return both.column("d").to_numpy(), both.column("text").cast(pa.large_string()).combine_chunks()


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def report(table: pa.Table) -> pa.Table:
    """Step 1: a row for each anchor hash of a shard; the lowest bit of ``h`` says if several documents have it, the next 15 how many contexts there are; c is 0 if they differ."""
    docs, texts = _columns(table)
    _, h, c, d, _ = _shard_anchors(docs, texts)
    order = np.argsort(h)
    h, c, d = h[order], c[order], d[order]
    at = _heads(h)
    if len(at):
        first, last = np.minimum.reduceat(d, at), np.maximum.reduceat(d, at)
        c0, c1 = np.minimum.reduceat(c, at), np.maximum.reduceat(c, at)
        some = np.flatnonzero(np.repeat(c0 != c1, np.diff(np.append(at, len(h)))))
        some = some[np.lexsort((c[some], h[some]))]
        some = some[_heads(h[some], c[some])]
        several = _heads(h[some])
        count = np.ones(len(at), np.uint64)
        count[c0 != c1] = np.minimum(np.diff(np.append(several, len(some))), 0x7FFF)
        h = h[at] | (first < last).astype(np.uint64) | count << np.uint64(1)
        c, d = np.where(c0 == c1, c0, np.uint64(0)), first
    return pa.table({"h": _signed(h), "c": _signed(c), "d": pa.array(d, pa.int64())})


def settle(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Step 2: rows (d, h, c, first) of anchors that several documents have; c is 0 where all contexts are equal.

    Where they differ, only the shard with the smallest doc_id of each context is asked for its bytes (first
    is null); the others lose that context as a whole. A shard with several contexts is asked for them all.
    The lowest bit of ``h`` is set where more than ``most`` contexts of an anchor are asked for.
    """
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches]
    if not parts:
        return
    h, c, d = (np.concatenate(x) for x in zip(*parts))
    several = (h & 1).astype(bool)
    count = h >> 1 & 0x7FFF
    h = h & ~np.int64(0xFFFF)
    order = np.lexsort((d, c, h))
    h, c, d, several, count = h[order], c[order], d[order], several[order], count[order]
    at = _heads(h)
    size = np.diff(np.append(at, len(h)))
    first = np.repeat(np.minimum.reduceat(d, at), size)
    repeated = np.repeat((size > 1) | np.logical_or.reduceat(several, at), size)
    same = np.repeat((c[at] == np.maximum.reduceat(c, at)) & (c[at] != 0), size)
    own = _heads(h, c)
    least = np.repeat(d[own], np.diff(np.append(own, len(h))))
    asked = np.zeros(len(h), bool)
    asked[own] = True
    asked = ~same & (asked | (c == 0))
    h = h | (asked & np.repeat(np.add.reduceat(np.where(asked, count, 0), at) > most, size))
    take = np.flatnonzero(repeated & (~same | (first < d) | several))
    for low in range(0, len(take), 100_000):
        t = take[low : low + 100_000]
        found = pa.array(np.where(same[t], first[t], least[t]), pa.int64(), mask=asked[t])
        yield pa.record_batch([pa.array(d[t]), pa.array(h[t]), pa.array(np.where(same[t], 0, c[t])), found], names=["d", "h", "c", "first"])


def contexts(table: pa.Table, open_anchors: pa.Table) -> pa.Table:
    """Step 3, in shards: the different contexts (h, c, d: smallest doc_id, bytes, left: bytes before the anchor) asked for.

    For anchors of many contexts, their different windows: c is the window's hash, left -2 if several documents have it or else -1.
    """
    docs, texts = _columns(table)
    blocks, h, c, d, _ = _shard_anchors(docs, texts)
    wanted = np.unique(open_anchors.column("h").to_numpy()).view(np.uint64)
    many = (wanted & np.uint64(1)).astype(bool)
    keep = np.flatnonzero(np.isin(h, wanted[~many]))
    order = keep[np.lexsort((d[keep], c[keep], h[keep]))]
    chosen = order[_heads(h[order], c[order])]
    edge = np.cumsum([0, *[len(b.place) for b in blocks]])
    of = np.searchsorted(edge, chosen, side="right") - 1
    found, left = [], []
    for i, b in zip(chosen.tolist(), of.tolist()):
        block, k = blocks[b], i - edge[b]
        found.append(block.data[block.low[k] : block.high[k]].tobytes())
        left.append(int(block.place[k] - block.low[k]))
    out = pa.table({"h": _signed(h[chosen]), "c": _signed(c[chosen]), "d": pa.array(d[chosen], pa.int64()), "bytes": pa.array(found, pa.binary()), "left": pa.array(left, pa.int16())})
    parts = [(low, *b.windows(np.flatnonzero(np.isin(b.hash, wanted[many] ^ np.uint64(1))))) for low, b in zip(edge.tolist(), blocks)] if many.any() else []
    if not parts:
        return out
    of = np.concatenate([low + of for low, of, _, _ in parts])
    h, c, d = h[of], np.concatenate([c for _, _, _, c in parts]), d[of]
    order = np.lexsort((c, h))
    h, c, d = h[order], c[order], d[order]
    at = _heads(h, c)
    if not len(at):
        return out
    first, last = np.minimum.reduceat(d, at), np.maximum.reduceat(d, at)
    left = np.where(first < last, -2, -1).astype(np.int16)
    return pa.concat_tables([out, pa.table({"h": _signed(h[at]), "c": _signed(c[at]), "d": pa.array(first), "bytes": pa.array([b""] * len(at), pa.binary()), "left": pa.array(left)})])


def may_match(h: np.ndarray, raw: pa.Array, left: np.ndarray) -> np.ndarray:
    """Contexts that share half of what a window has besides the anchor, before it or behind it, with another of the anchor.

    A window that holds the anchor takes ``SPAN - GRAM`` further bytes, so half of them on one side at least.
    """
    half = (SPAN - GRAM) // 2
    at = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
    data = np.frombuffer(raw.buffers()[2], np.uint8)[at[0] : at[-1]] if len(raw) else np.zeros(0, np.uint8)
    low, high = at[:-1] - at[0], at[1:] - at[0]
    keep = np.zeros(len(raw), bool)
    for start in (low + left - half, low + left + GRAM):
        fits = np.flatnonzero((start >= low) & (start + half <= high))
        key = mixed(span_hashes(data, start[fits], start[fits] + half) ^ mixed(h[fits].view(np.uint64)))
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        keep[fits[count[back] > 1]] = True
    return keep


def suffix_array(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The order of all suffixes of the strings between ``edges``, by Larsson-Sadakane refinement.

    A suffix ends with its string; equal ones are in order of their places, as if each string had an end mark
    of its own. Suffixes start sorted by seven bytes (nine bits each, so that the end sorts before every
    byte); each round doubles the sorted length, and sorts only the suffixes whose group has others still, by
    the ranks of the suffixes that stand so much later.
    """
    n = len(data)
    end_of = np.repeat(edges[1:], np.diff(edges))
    place = np.arange(n)
    x = np.zeros(n, np.uint64)
    wide = np.concatenate([data.astype(np.uint64) + np.uint64(1), np.zeros(7, np.uint64)])
    for j in range(7):
        x = x << np.uint64(9) | np.where(place + j < end_of, wide[j : j + n], np.uint64(0))
    order = np.argsort(x)
    at = _heads(x[order])
    count = np.diff(np.append(at, n))
    rank = np.zeros(n + 1, np.int64)  # the place of a group's first member, from 1; 0 stands past the end
    rank[order] = np.repeat(at + 1, count)
    open_places = np.flatnonzero(np.repeat(count > 1, count))
    size, longest = 7, int(np.diff(edges).max(initial=0))
    while len(open_places) and size < longest:
        own = order[open_places]
        later = np.where(own + size < end_of[own], rank[np.minimum(own + size, n)], 0)
        key = rank[own] * (n + 1) + later  # both are at most n, and n is below 2**31
        again = np.argsort(key)
        own, key = own[again], key[again]
        order[open_places] = own
        at = _heads(key)
        count = np.diff(np.append(at, len(own)))
        rank[own] = np.repeat(open_places[at] + 1, count)
        open_places = open_places[np.repeat(count > 1, count)]
        size *= 2
    own = order[open_places]
    order[open_places] = own[np.argsort(rank[own] * (n + 1) + own)]
    return order


def common_prefixes(data: np.ndarray, edges: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes of neighbours in the suffix array of the strings between ``edges``, up to ``cap``.

    Kasai's rule (a suffix shares at least one byte less with its predecessor than the one before it
    did), walked for all strings side by side.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    end_of = np.repeat(edges[1:], np.diff(edges))
    out = np.zeros(n, np.int16)
    length = np.diff(edges)
    now = np.zeros(len(length), np.int64)
    for t in range(int(length.max(initial=0))):
        live = np.flatnonzero(length > t)
        i = edges[live] + t
        j = before[i]
        k = np.maximum(now[live] - 1, 0)
        room = np.where(j >= 0, np.minimum(np.minimum(end_of[i] - i, end_of[j] - j), cap), 0)
        k = np.minimum(k, room)
        grow = np.flatnonzero(k < room)
        while len(grow):
            grow = grow[data[i[grow] + k[grow]] == data[j[grow] + k[grow]]]
            k[grow] += 1
            grow = grow[k[grow] < room[grow]]
        now[live] = k
        out[i] = k
    return out


def _piece_firsts(raw: list[bytes], d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the windows of one piece: their starts, their strings' numbers, and the smallest doc_id of each; and the piece's bytes."""
    data = np.frombuffer(b"".join(raw), np.uint8)
    edges = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    order = suffix_array(data, edges)
    shared = common_prefixes(data, edges, order, SPAN)
    string = np.repeat(np.arange(len(raw)), np.diff(edges))
    # runs of neighbours that share SPAN bytes; a suffix that is shorter sorts before all windows that it begins, so it ends no run
    new = shared[order] < SPAN
    new[:1] = True
    at = np.flatnonzero(new)
    least = np.minimum.reduceat(d[string[order]], at)
    first = np.zeros(len(data), np.int64)
    first[order] = np.repeat(least, np.diff(np.append(at, len(order))))
    starts = np.concatenate([np.arange(a, b - SPAN + 1) for a, b in zip(edges[:-1], edges[1:])]) if len(raw) else np.zeros(0, np.int64)
    return starts, string[starts], first[starts], data


def match_windows(table: pa.Table) -> pa.RecordBatch:
    """Windows of anchors with many contexts: a row (d, h, c, -1, -1, smallest doc_id) for each shard that loses some."""
    h, c, d, left = (table.column(x).to_numpy() for x in ("h", "c", "d", "left"))
    order = np.lexsort((d, c, h))
    at = _heads(h[order], c[order])
    first = np.repeat(d[order][at], np.diff(np.append(at, len(order))))
    some = np.flatnonzero((first < d[order]) | (left[order] == -2))
    t, none = order[some], np.full(len(some), -1, np.int32)
    return pa.record_batch([pa.array(d[t]), pa.array(h[t]), pa.array(c[t]), pa.array(none), pa.array(none), pa.array(first[some])], names=["d", "h", "c", "a", "b", "first"])


def match_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 3, by anchor hash: rows (d, h, c, runs); runs are (from, to, smallest doc_id) of windows that a smaller doc_id has."""
    parts = list(batches)
    if not parts:
        return
    table = pa.Table.from_batches(parts).combine_chunks()
    if not table.num_rows:
        return
    many = table.column("left").to_numpy() < 0
    if many.any():
        yield match_windows(table.filter(pa.array(many)))
        table = table.filter(pa.array(~many)).combine_chunks()
        if not table.num_rows:
            return
    table = table.filter(pa.array(may_match(table.column("h").to_numpy(), table.column("bytes").chunk(0), table.column("left").to_numpy())))
    h, c, d = (table.column(x).to_numpy() for x in ("h", "c", "d"))
    raw = table.column("bytes").to_pylist()
    order = np.lexsort((c, d, h))  # within an anchor by ascending doc_id
    size = np.cumsum(np.array([len(raw[i]) for i in order.tolist()]))
    low = 0
    tables: list[tuple[np.ndarray, np.ndarray]] = []  # sorted windows, and their smallest doc_ids, of the open group's earlier pieces
    while low < len(order):
        high = int(np.searchsorted(size, (size[low - 1] if low else 0) + PIECE, side="right"))
        high = max(high, low + 1)
        rows = order[low:high]
        starts, string, first, data = _piece_firsts([raw[i] for i in rows.tolist()], d[rows])
        splits = high < len(order) and h[order[high]] == h[rows[-1]]
        if tables or splits:
            view = np.lib.stride_tricks.sliding_window_view(data, SPAN)
            windows = np.ascontiguousarray(view[starts]).view(f"S{SPAN}").ravel()
            for known, ids in tables:
                at = np.minimum(np.searchsorted(known, windows), len(known) - 1)
                first = np.where(known[at] == windows, np.minimum(first, ids[at]), first)
            if splits:
                own = np.flatnonzero(h[rows][string] == h[rows[-1]])
                keep = own[np.lexsort((first[own], windows[own]))]
                keep = keep[_heads(windows[keep])]
                tables = [*tables, (windows[keep], first[keep])] if h[rows[0]] == h[rows[-1]] else [(windows[keep], first[keep])]
            else:
                tables = []
        own_d = d[rows][string]
        hit = np.flatnonzero(first < own_d)
        if len(hit):
            base = np.searchsorted(string, string[hit])  # starts are in order of strings
            offset = hit - base
            new = np.concatenate([[True], (np.diff(hit) != 1) | (np.diff(string[hit]) != 0) | (np.diff(first[hit]) != 0)])
            a = np.flatnonzero(new)
            b = np.append(a[1:], len(hit)) - 1
            who = rows[string[hit[a]]]
            yield pa.record_batch(
                [pa.array(d[who]), pa.array(h[who]), pa.array(c[who]), pa.array(offset[a], pa.int32()), pa.array(offset[b], pa.int32()), pa.array(first[hit[a]])],
                names=["d", "h", "c", "a", "b", "first"],
            )
        low = high


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: int) -> np.ndarray:
    """The value of each wanted key in sorted unique keys."""
    if not len(keys):
        return np.full(len(wanted), missing)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)


def cut_out(table: pa.Table, settled: pa.Table) -> pa.Table:
    """Step 4: per document what is removed, and the digest of the rest."""
    docs, texts = _columns(table)
    blocks, h, c, d, ids = _shard_anchors(docs, texts)
    order = np.lexsort((c, h))
    at = _heads(h[order], c[order])
    local = np.zeros(len(h), np.int64)
    if len(at):
        local[order] = np.repeat(np.minimum.reduceat(d[order], at), np.diff(np.append(at, len(h))))
    sh, sc = settled.column("h").to_numpy().view(np.uint64), settled.column("c").to_numpy().view(np.uint64)
    sf, sa, sb = settled.column("first").to_numpy(), settled.column("a").to_numpy(), settled.column("b").to_numpy()
    many = np.flatnonzero(sa < 0)
    whole = np.flatnonzero((sc == 0) & (sa >= 0))
    whole = whole[np.argsort(sh[whole])]
    whole = whole[_heads(sh[whole])]
    whole_first = _lookup(sh[whole], sf[whole], h, LAST)
    gone = np.minimum(local, whole_first) < d
    runs = np.flatnonzero((sc != 0) & (sa >= 0))
    pair = lambda a, b: mixed(a ^ b * _C1)
    runs = runs[np.argsort(pair(sh[runs], sc[runs]), kind="stable")]
    run_keys = pair(sh[runs], sc[runs])
    many = many[np.argsort(pair(sh[many], sc[many]))]
    many_keys, many_anchors = pair(sh[many], sc[many]), np.unique(sh[many])
    own_keys = pair(h, c)
    lo, hi = np.searchsorted(run_keys, own_keys), np.searchsorted(run_keys, own_keys, side="right")
    out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")}
    edge = 0
    for block, own_ids in zip(blocks, ids):
        n = len(block.place)
        here = slice(edge, edge + n)
        edge += n
        change = np.zeros(len(block.data) + 1, np.int64)
        g = np.flatnonzero(gone[here])
        np.add.at(change, block.low[g], 1)
        np.add.at(change, block.high[g], -1)
        some = np.flatnonzero(hi[here] > lo[here])
        if len(some):
            count = (hi[here] - lo[here])[some]
            anchor = np.repeat(some, count)
            first = np.cumsum(count) - count
            j = runs[np.repeat(lo[here][some], count) + np.arange(count.sum()) - np.repeat(first, count)]
            use = sf[j] < d[here][anchor]
            np.add.at(change, block.low[anchor[use]] + sa[j[use]], 1)
            np.add.at(change, np.where(sb[j[use]] < 0, block.high[anchor[use]], block.low[anchor[use]] + sb[j[use]] + SPAN), -1)
        if len(many):
            of, start, window = block.windows(np.flatnonzero(np.isin(block.hash, many_anchors)))
            start = start[_lookup(many_keys, sf[many], pair(block.hash[of], window), LAST) < d[here][of]]
            np.add.at(change, start, 1)
            np.add.at(change, start + SPAN, -1)
        removed = np.cumsum(change[:-1]) > 0
        starts = removed.copy()
        starts[1:] &= ~removed[:-1]
        inner = block.offsets[:-1][block.offsets[:-1] < len(removed)]
        starts[inner] = removed[inner]
        sums, spans = np.concatenate([[0], np.cumsum(removed)]), np.concatenate([[0], np.cumsum(starts)])
        kept = block.data[~removed].tobytes()
        kept_at = np.arange(len(removed) + 1) - sums
        for i, doc in enumerate(own_ids.tolist()):
            a, b = int(block.offsets[i]), int(block.offsets[i + 1])
            out["doc_id"].append(None if doc == LAST else doc)
            out["n_bytes"].append(b - a)
            out["n_removed"].append(int(sums[b] - sums[a]))
            out["n_spans"].append(int(spans[b] - spans[a]))
            out["kept_sha256"].append(hashlib.sha256(kept[kept_at[a] : kept_at[b]]).hexdigest())
    kinds = [pa.int64()] * 4 + [pa.string()]
    return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds)})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 8 << 20, most_contexts: int = 3000) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST)).alias("d"), text_of(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n = max(1, -(-total // shard_bytes))
    of = F.pmod(F.xxhash64("d"), F.lit(n)).cast("int").alias("shard")
    shards = rows.select(of, "d", "text").mapInArrow(packed, "shard int, rows binary")
    anchors = shards.groupBy("shard").applyInArrow(report, "h bigint, c bigint, d bigint")
    settled = anchors.repartition(n, F.shiftright("h", 16)).mapInArrow(lambda batches: settle(batches, most_contexts), "d bigint, h bigint, c bigint, first bigint").select(of, "h", "c", "first")
    unsettled = settled.where("first IS NULL").select("shard", "h")
    found = shards.groupBy("shard").cogroup(unsettled.groupBy("shard")).applyInArrow(contexts, "h bigint, c bigint, d bigint, bytes binary, left smallint")
    group = F.when(F.col("left") < 0, F.xxhash64("h", "c")).otherwise(F.col("h"))
    matched = found.repartition(n, group).mapInArrow(match_contexts, "d bigint, h bigint, c bigint, a int, b int, first bigint")
    whole = settled.where("first IS NOT NULL").select("shard", "h", "c", F.lit(0).alias("a"), F.lit(-1).alias("b"), "first")
    every = whole.union(matched.select(of, "h", "c", "a", "b", "first"))
    return shards.groupBy("shard").cogroup(every.groupBy("shard")).applyInArrow(cut_out, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
