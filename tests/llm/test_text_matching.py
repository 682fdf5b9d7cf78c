"""Decontamination, exact duplicates and repeated byte strings against brute force."""

import hashlib
import random
import re

import pytest

from tessera.llm import queries as Q
from tessera.llm.decontam import Block, benchmark_hits, drop_contaminated, winnowed, words_hit
from tessera.llm.exact_dedup import drop_exact_duplicates, exact_groups
from tessera.llm.suffix_dedup import common_prefixes, remove_repeats, suffix_array

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(text, items, window=10):
    own, hit, ids = words(text), set(), set()
    for item_id, item in items:
        w = words(item)
        m = min(window, len(w))
        grams = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if m else set()
        for p in range(len(own) - m + 1) if m else ():
            if tuple(own[p : p + m]) in grams:
                hit.update(range(p, p + m))
                ids.add(str(item_id))
    return len(own), len(hit), sorted(ids)


@pytest.fixture(scope="module")
def items(awkward):
    texts = [t for _, t in awkward if t]
    return [(1, texts[0]), (2, " ".join(words(texts[1])[:9])), (3, "the and"), (4, None), (5, ""), (1, "cc by"), (7, texts[-3][-400:]), (8, "nowhere to be found in any of these documents at all ever"), (None, "stone paper light")]


@pytest.mark.parametrize("block_bytes", [8 << 20, 200])
def test_hits_are_those_of_brute_force(spark, docs, awkward, items, block_bytes):
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = benchmark_hits(docs, bench, block_bytes=block_bytes)
    got = sorted(((r[0], r[1], r[2], r[3]) for r in found.select("doc_id", "hits.n_words", words_hit("hits.runs"), "hits.items").collect()), key=repr)
    want = sorted(((d, *brute_hits(t, [("" if i is None else i, x) for i, x in items])) for d, t in awkward), key=repr)
    assert got == want
    assert any(w[2] for w in want) and any(not w[2] for w in want)


def test_hits_with_other_columns_and_empty_tables(spark, clashing, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = drop_contaminated(clashing, bench)
    assert kept.columns == clashing.columns and 0 < kept.count() < clashing.count()
    assert drop_contaminated(clashing, bench.limit(0)).count() == clashing.count()
    assert drop_contaminated(clashing.limit(0), bench).count() == 0


def test_texts_that_repeat_themselves():
    """A long text of one word against a long item of it, and of two words in turn: seconds, and the right hits."""
    import numpy as np

    from tessera.llm.common import byte_blocks
    import pyarrow as pa

    block = Block([("a", "x " * 3000), ("b", "x y " * 2000), ("c", "z"), ("d", "x y x")], 10, 5)
    texts = ["x " * 60_000, "x y " * 30_000, "no hit at all", "y x y", "X, y; x"]
    found = {}
    for low, _, data, offsets in byte_blocks(pa.array(texts)):
        counts, hits = block.hits(data, offsets)
        for row, a, b, item in hits:
            found.setdefault((low + row, block.ids[item]), np.zeros(60_000, bool))[a:b] = True
    assert {k: int(v.sum()) for k, v in found.items()} == {(0, "a"): 60_000, (1, "b"): 60_000, (1, "d"): 59_999, (4, "d"): 3}


def test_different_windows_of_one_hash(spark):
    """Two words whose polynomial hashes modulo 2**64 are equal for any base: neither hides the other's windows."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    two = one.translate(str.maketrans("ab", "ba"))
    rest = "c d e f g h i j k"
    items = [(1, f"{one} {rest} {two} {rest} {one} {rest}")]
    rows = [(1, f"{two} {rest}"), (2, f"{one} {rest}"), (3, f"x {rest}"), (4, f"{rest} {two}")]
    found = benchmark_hits(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = [(r[0], r[1], r[2]) for r in found.select("hits.n_words", words_hit("hits.runs"), "hits.items").collect()]
    assert got == [brute_hits(t, items) for _, t in rows] and [g[1] for g in got] == [10, 10, 0, 10]


def test_every_window_keeps_a_gram():
    import numpy as np

    grams = np.random.default_rng(0).integers(0, 9, 500).astype(np.uint64)
    kept = winnowed(grams, 6)
    assert all(kept[i : i + 6].any() for i in range(495)) and kept.sum() < 500


def test_op1_same_as_sql(spark, sf, same_as_sql):
    same_as_sql(Q.op1_decontamination(spark, sf), Q.OP1_SQL)


def brute_exact(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((d, t or ""))
    out = []
    for norm, own in groups.items():
        keep = min(own, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))
        for d, t in own:
            out.append((d, keep[0], len(own), d == keep[0] and len(t) == len(keep[1]), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [1 << 26, 64])
def test_exact_groups(docs, awkward, bits, monkeypatch):
    monkeypatch.setattr("tessera.llm.exact_dedup.MOST_BITS", bits)
    got = exact_groups(docs, digest_all=True).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_exact(awkward)


def test_exact_duplicates_go(clashing, awkward):
    kept = drop_exact_duplicates(clashing)
    assert kept.columns == clashing.columns
    assert {re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in kept.collect()} == {re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in awkward}
    assert drop_exact_duplicates(clashing.limit(0)).count() == 0


def test_exact_rows_with_one_id(spark):
    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "ab"), (2, "ab")], "doc_id long, text string")
    assert [(r.doc_id, r.text) for r in drop_exact_duplicates(rows).collect()] == [(1, "a b")] * 2  # repeats of the row that stays


def test_op5_same_as_sql(spark, sf, same_as_sql):
    same_as_sql(Q.op5_exact_dedup(spark, sf), Q.OP5_SQL)


def brute_repeats(rows, span=50):
    first = {}
    own = [(d, (t or "").encode()) for d, t in rows]
    last = 1 << 63
    for d, b in own:
        for i in range(len(b) - span + 1):
            w = b[i : i + span]
            k = last if d is None else d
            if k < first.get(w, last + 1):
                first[w] = k
    out = []
    for d, b in own:
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if first[b[i : i + span]] < (last if d is None else d):
                gone[i : i + span] = b"\x01" * span
        spans = len([m for m in re.finditer(b"\x01+", bytes(gone))])
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def repeated():
    rng = random.Random(11)
    passages = ["".join(rng.choice("abcdefgh é") for _ in range(rng.choice([50, 60, 120, 400]))) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randint(0, 6)):
            parts.append(rng.choice(passages)[rng.randint(0, 8) :] if rng.random() < 0.6 else "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(1, 150))))
        rows.append((i * 3 % 151, "".join(parts)))
    rows += [(7, "a" * 3000), (8, "a" * 49), (9, "a" * 50), (3000, "ab" * 700), (3001, "b" + "ab" * 650), (None, passages[0]), (None, None), (4000, passages[1] + passages[1]), (4000, passages[2] * 2)]
    return rows


@pytest.mark.parametrize("shard_bytes", [8 << 20, 4000])
def test_repeats_are_those_of_brute_force(spark, repeated, shard_bytes, monkeypatch):
    rows = spark.createDataFrame(repeated, "doc_id long, text string")
    got = sorted((tuple(r) for r in remove_repeats(rows, shard_bytes=shard_bytes).collect()), key=repr)
    assert got == brute_repeats(repeated)


def test_repeats_of_awkward_documents(docs, awkward):
    assert sorted((tuple(r) for r in remove_repeats(docs, shard_bytes=50_000).collect()), key=repr) == brute_repeats(awkward)
    assert remove_repeats(docs.limit(0)).count() == 0


def test_op4_same_as_sql(spark, sf, same_as_sql):
    same_as_sql(Q.op4_suffix_dedup(spark, sf), Q.OP4_SQL)


@pytest.mark.parametrize("shard_bytes", [8 << 20, 3_000])
def test_anchors_of_many_contexts_go_by_window(spark, repeated, shard_bytes):
    rows = spark.createDataFrame(repeated, "doc_id long, text string")
    got = sorted((tuple(r) for r in remove_repeats(rows, shard_bytes=shard_bytes, most_contexts=1).collect()), key=repr)
    assert got == brute_repeats(repeated)


def test_pieces_of_a_group_merge_by_binary_search(repeated, monkeypatch):
    import numpy as np
    import pyarrow as pa

    from tessera.llm import suffix_dedup as S

    rng = random.Random(2)
    raw = [b"".join(rng.choice([b"x" * 60, b"y" * 55, b"z" * 70]) for _ in range(2))[:88] for _ in range(60)]
    batch = pa.record_batch([pa.array([7] * 60, pa.int64()), pa.array(range(60), pa.int64()), pa.array(range(60), pa.int64()), pa.array(raw, pa.binary()), pa.array([20] * 60, pa.int16())], names=["h", "c", "d", "bytes", "left"])

    def runs(piece):
        monkeypatch.setattr(S, "PIECE", piece)
        out = set()
        for b in S.match_contexts(iter([batch])):
            for r in b.to_pylist():
                out |= {(r["d"], i, r["first"]) for i in range(r["a"], r["b"] + 1)}
        return out

    assert runs(1 << 22) == runs(300) and np.any([runs(300)])


def test_a_window_across_two_contexts_ends_no_run():
    import pyarrow as pa

    from tessera.llm.suffix_dedup import match_contexts

    w = bytes(range(65, 115))
    # the end of the second context and the start of the third make the window once more, where it doesn't count
    raw = [w, b"#" * 20 + w[:20], w[20:] + b"#" * 30, w + b"#", w]
    ids = pa.array(range(len(raw)), pa.int64())
    batch = pa.record_batch([pa.array([7] * len(raw), pa.int64()), ids, ids, pa.array(raw, pa.binary()), pa.array([0] * len(raw), pa.int16())], names=["h", "c", "d", "bytes", "left"])
    got = {(r["d"], r["a"], r["b"], r["first"]) for b in match_contexts(iter([batch])) for r in b.to_pylist()}
    assert got == {(3, 0, 0, 0), (4, 0, 0, 0)}


def test_suffix_arrays_and_prefixes():
    import numpy as np

    rng = np.random.default_rng(4)
    for n, letters in ((0, 2), (1, 2), (50, 1), (300, 2), (500, 200)):
        data = rng.integers(0, letters, n).astype(np.uint8)
        raw = data.tobytes()
        for edges in (np.array([0, n]), np.array([0, n // 3, n]), np.unique(np.array([0, *range(0, n, 7), n]))):
            if len(edges) < 2:
                continue
            end = np.repeat(edges[1:], np.diff(edges))
            order = suffix_array(data, edges)
            assert order.tolist() == sorted(range(n), key=lambda i: (raw[i : end[i]], i))
            shared = common_prefixes(data, edges, order, 20)
            for k in range(1, n):
                a, b = raw[order[k - 1] : end[order[k - 1]]], raw[order[k] : end[order[k]]]
                want = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
                assert shared[order[k]] == min(want, 20)
