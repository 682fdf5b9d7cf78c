"""SimHash components and near-copy groups against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.llm.near_copies import bit_limit, drop_near_copies, near_groups
from tessera.llm.simhash import BKTree, fingerprint, linked_fingerprints, shard_links, simhash_components


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w)] if len(w) < 3 else [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(fps):
    """fps: (id, fingerprint); the least id reachable over links of two bits or fewer."""
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 2:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(fps):
        r = root(i)
        if d is not None and (least.get(r) is None or d < least[r]):
            least[r] = d
    return [least.get(root(i)) for i in range(len(fps))]


@pytest.mark.parametrize("how", [{}, {"shard_limit": 1}])
def test_components_of_awkward_documents(docs, awkward, how):
    fps = [(d, plain_fingerprint(t)) for d, t in awkward]
    want = sorted(((d, f"{f:016x}", c) for (d, f), c in zip(fps, brute_components(fps))), key=repr)
    found = simhash_components(docs, **how).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id")
    assert sorted((tuple(r) for r in found.collect()), key=repr) == want


def test_fingerprint_of_no_words_and_ties():
    assert fingerprint(b" \n", 3, False) == 0
    assert fingerprint(b"A b\x0bC d", 3, False) & 0xFFFFFFFFFFFFFFFF == plain_fingerprint("a B c D")


@pytest.mark.parametrize("limit", [1024, 4])
def test_all_links_of_planted_fingerprints(spark, limit):
    rng = random.Random(8)
    values = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        values.add(x)
        for _ in range(rng.randint(0, 6)):
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
            values.add(x)
    listed = sorted(values)
    comp = brute_components(list(enumerate(listed)))
    signed = [v - (1 << 64) if v >> 63 else v for v in listed]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    roots = {r.node: r.root for r in connected_components(linked_fingerprints(fps, shard_limit=limit)).collect()}
    mine = [roots.get(v, v) for v in signed]
    assert [[a == b for b in mine] for a in mine] == [[a == b for b in comp] for a in comp]
    assert linked_fingerprints(fps.limit(0)).count() == 0


def test_trees_find_all_neighbours():
    rng = random.Random(1)
    tree, stored = BKTree(), []
    for _ in range(300):
        v = rng.getrandbits(10)
        assert sorted(tree.near_then_add(v, 2)) == [i for i, x in enumerate(stored) if (x ^ v).bit_count() <= 2]
        stored.append(v)
    assert shard_links([], 2) == [] and shard_links([5], 2) == []


def test_long_paths_settle(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 101), (5, 4)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or {tuple(w)}


def jaccard(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(21)
    vocabulary = ["w%d" % i for i in range(3000)]
    rows = []
    for g in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 400))]
        rows.append((g * 10, " ".join(base)))
        for c in range(g % 4):
            own = list(base)
            for _ in range(max(1, len(own) // 100)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((g * 10 + c + 1, " ".join(own)))
    return rows


@pytest.mark.parametrize("limit", [512, 2])
def test_near_copies_are_grouped(spark, copies, limit):
    rows = spark.createDataFrame(copies, "doc_id long, text string")
    keep = {r.doc_id: r.keep_id for r in near_groups(rows, shard_limit=limit).collect()}
    texts = dict(copies)
    alike = {(a, b): jaccard(texts[a], texts[b]) for a in texts for b in texts if a < b and a // 10 == b // 10}
    close, closer = ([p for p, s in alike.items() if s >= least] for least in (0.8, 0.85))
    assert len(closer) > 30 and all(keep[a] == keep[b] for a, b in closer)
    assert sum(keep[a] == keep[b] for a, b in close) >= 0.9 * len(close)
    assert all(k // 10 == d // 10 for d, k in keep.items())


def test_trees_side_by_side_find_all_pairs():
    from tessera.llm.near_copies import Forest

    rng = np.random.default_rng(0)
    value = rng.integers(0, 1 << 12, 200).astype(np.uint64)
    shard = np.sort(rng.integers(0, 9, 200))
    got = sorted((int(a), int(b)) for x, y in Forest(value, shard).near(2) for a, b in zip(x, y))
    assert got == [(i, j) for i in range(200) for j in range(i + 1, 200) if shard[i] == shard[j] and (int(value[i]) ^ int(value[j])).bit_count() <= 2]


def test_near_copies_go(clashing, awkward):
    kept = drop_near_copies(clashing)
    assert kept.columns == clashing.columns
    ids = [r.doc_id for r in kept.collect()]
    assert -5 in ids and not {104, 105, 107, 110} & set(ids) and {106, 108, 109} <= set(ids)
    assert sum(i in (100, 101, 102, None) for i in ids) >= 1
    assert drop_near_copies(clashing.limit(0)).count() == 0


def test_limits_ascend():
    assert bit_limit(1.0) == 0 and bit_limit(0.9) < bit_limit(0.8) < bit_limit(0.5)


def test_large_shards_are_searched_as_a_whole(spark, copies):
    rows = spark.createDataFrame(copies, "doc_id long, text string")
    whole, cut = ({r.doc_id: r.keep_id for r in near_groups(rows, shard_limit=n).collect()} for n in (512, 2))
    assert cut == whole and len(set(cut.values())) < len(cut)


def test_pairs_of_a_dense_shard_are_not_held():
    import tracemalloc

    from tessera.llm.near_copies import shard_links

    rng = np.random.default_rng(3)
    sig = np.repeat(rng.integers(0, 1 << 63, (1, 8)).astype(np.uint64), 3000, axis=0)
    sig[np.arange(3000), rng.integers(0, 8, 3000)] ^= np.uint64(1) << rng.integers(0, 63, 3000).astype(np.uint64)
    tracemalloc.start()
    row, root = shard_links(sig[:, 0].copy(), sig, np.zeros(3000, np.int64), 16, 87)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert row.tolist() == list(range(1, 3000)) and not root.any()
    assert peak < 64 << 20


def test_large_shards_are_dealt_to_tasks(spark, copies, monkeypatch):
    from tessera.llm import near_copies

    rows = spark.createDataFrame(copies, "doc_id long, text string")
    whole = {r.doc_id: r.keep_id for r in near_groups(rows).collect()}
    monkeypatch.setattr(near_copies, "DEAL", 1)
    assert {r.doc_id: r.keep_id for r in near_groups(rows, shard_limit=2).collect()} == whole


def test_parts_find_all_links_of_different_labels():
    """Those sought among the rows of a tree, against a comparison of all pairs."""
    from tessera.llm.near_copies import links_to

    rng = np.random.default_rng(5)
    sig = np.repeat(rng.integers(0, 1 << 63, (40, 8)).astype(np.uint64), 60, axis=0)
    sig[np.arange(2400), rng.integers(0, 8, 2400)] ^= np.uint64(1) << rng.integers(0, 63, 2400).astype(np.uint64)
    label = np.arange(2400) + 7
    a, b = links_to(sig[:, 0], sig, label, sig[:, 0], sig, label, 16, 87)
    assert dict(zip(a.tolist(), b.tolist())) == {i + 7: i // 60 * 60 + 7 for i in range(2400) if i % 60}
    label, ask = np.where(np.arange(2400) % 60 < 50, np.arange(2400) // 60 * 60, np.arange(2400)), np.arange(2400) % 60 == 59
    a, b = links_to(sig[:, 0], sig, label, sig[ask, 0], sig[ask], label[ask], 16, 87)
    got = dict(zip(a.tolist(), b.tolist()))
    assert all(got[i] == i // 60 * 60 for i in np.flatnonzero(ask))
    assert links_to(sig[:0, 0], sig[:0], label[:0], sig[:, 0], sig, label, 16, 87)[0].size == 0


@pytest.mark.parametrize("width", [12, 14, 18, 22, 26])
def test_similar_pairs_meet_at_every_width(width):
    """Pairs whose bits differ as at a similarity of 0.8: a key in common, near in its fingerprint, near as a whole."""
    from tessera.llm.near_copies import Keys, differing

    rng = np.random.default_rng(width)
    one = rng.integers(0, 1 << 63, (1500, 8)).astype(np.uint64)
    flips = np.packbits(rng.random((1500, 512)) < differing(0.8), axis=1).view(np.uint64)
    two, keys = one ^ flips, Keys(width, 0.8)
    near = np.bitwise_count(flips) <= 16
    met = np.zeros(1500, bool)
    for k, (fp, _) in enumerate(keys.picks):
        met |= (keys.bits(one, k) == keys.bits(two, k)) & near[:, fp]
    linked = met & (np.bitwise_count(flips).sum(axis=1) <= bit_limit(0.8))
    assert met.mean() > 0.94 and linked.mean() > 0.9
    apart = np.roll(one, 1, axis=0)
    assert np.mean([(keys.bits(one, k) == keys.bits(apart, k)).mean() for k in range(len(keys.picks))]) < 4 / 2**min(width, 12)


def test_shards_of_unrelated_texts_stay_bounded():
    from tessera.llm.near_copies import SHARE, Keys, key_width

    assert all(n / 2 ** key_width(n) <= SHARE for n in (0, 1, 10**3, 10**6, 10**9, 10**12)) and key_width(10**5) == 12
    rows = [n * len(Keys(key_width(n), 0.8).picks) for n in (10**6, 10**8, 10**10)]
    assert all(b / a < 100**1.3 for a, b in zip(rows, rows[1:]))


def test_wider_keys_give_the_same_groups(spark, copies, monkeypatch):
    from tessera.llm import near_copies

    rows = spark.createDataFrame(copies, "doc_id long, text string")
    narrow = {r.doc_id: r.keep_id for r in near_groups(rows).collect()}
    monkeypatch.setattr(near_copies, "key_width", lambda n: 16)
    wide = {r.doc_id: r.keep_id for r in near_groups(rows).collect()}
    assert sum(narrow[d] == wide[d] for d in narrow) >= 0.95 * len(narrow)
