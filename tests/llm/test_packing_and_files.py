"""Packing against brute force, token files by exact round trips."""

import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import token_files as T
from tessera.llm.common import byte_blocks
from tessera.llm.packing import best_bounds, histogram, pack_documents

TOKENIZER = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def padding_of(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts))


@pytest.mark.parametrize("seed", range(12))
def test_bounds_are_the_best(seed):
    rng = random.Random(seed)
    lengths = sorted(rng.sample(range(1, 60), rng.randint(1, 9)))
    counts = [rng.randint(1, 9) for _ in lengths]
    for k in (1, 2, 3, 20):
        bounds, cost = best_bounds(lengths, counts, k)
        least = min(padding_of(lengths, counts, (*c, lengths[-1])) for n in range(min(k, len(lengths))) for c in itertools.combinations(lengths[:-1], n))
        assert cost == least == padding_of(lengths, counts, bounds) and len(bounds) <= k and bounds == sorted(bounds)
    assert best_bounds([], [], 3) == ([], 0)


def quadratic(lengths, counts, k):
    """The least padding by the plain recurrence."""
    best = [0] + [None] * len(lengths)
    for _ in range(k):
        best = [0] + [min(best[i] + sum(counts[m] * (lengths[j - 1] - lengths[m]) for m in range(i, j)) for i in range(j) if best[i] is not None) for j in range(1, len(lengths) + 1)]
    return best[-1]


@pytest.mark.parametrize("seed", range(6))
def test_bounds_of_many_lengths(seed):
    rng = np.random.default_rng(seed)
    lengths = np.sort(rng.choice(10_000, 45, replace=False)) + 1
    counts = rng.integers(1, 10**6, 45)
    for k in (2, 5):
        bounds, cost = best_bounds(lengths, counts, k)
        assert cost == quadratic(lengths.tolist(), counts.tolist(), k) == padding_of(lengths.tolist(), counts.tolist(), bounds)
    bounds, cost = best_bounds(lengths, counts * 10**12, 5)  # beyond 64 bits
    assert cost == 10**12 * quadratic(lengths.tolist(), counts.tolist(), 5)


def test_histogram_is_exact(spark):
    own, counts = histogram(spark.range(5000).select((F.col("id") % 2500 + 1).alias("length")))
    assert own.tolist() == list(range(1, 2501)) and set(counts.tolist()) == {2}


@pytest.mark.parametrize("slice_rows", [50_000, 7])
def test_packed_documents(docs, awkward, slice_rows):
    budget = 500
    rows = pack_documents(docs, buckets=4, budget=budget, slice_rows=slice_rows).collect()
    count = lambda t: len((t or "").replace("\x0b", " ").split()) + 1
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == sorted((d or 0, count(t)) for d, t in awkward)
    assert len({r.padded_to for r in rows}) <= 4 and all(r.n_tokens + r.padding == r.padded_to for r in rows)
    batches = {}
    for r in rows:
        batches.setdefault(r.batch_id, []).append(r)
    for own in batches.values():
        assert len({r.padded_to for r in own}) == 1 and sorted(r.slot for r in own) == list(range(len(own)))
        assert len(own) == 1 or sum(r.padded_to for r in own) <= budget
    for bound in {r.padded_to for r in rows}:
        sizes = sorted(len(b) for b in batches.values() if b[0].padded_to == bound)
        assert len(set(sizes)) <= 2 and (len(sizes) < 2 or sizes[1:] == [sizes[-1]] * (len(sizes) - 1))


def test_packing_of_other_lengths_and_empty_tables(spark, clashing):
    assert pack_documents(clashing, length=F.length("text")).count() == clashing.count()
    assert pack_documents(clashing.limit(0)).count() == 0


@given(st.lists(st.integers(0, 2**32 - 1), max_size=2500))
@settings(max_examples=40, deadline=None)
def test_blocks_round_trip(values):
    ids = np.array(values, np.uint32)
    blocks = T.encode_blocks(ids)
    starts = np.cumsum([0, *map(len, blocks)])[:-1]
    assert (T.decode_blocks(b"".join(blocks), starts) == ids).all()


def test_outliers_are_exceptions():
    ids = np.full(1024, 1000, np.uint32) + np.arange(1024, dtype=np.uint32) % 16
    ids[[5, 900]] = 4_000_000_000
    (block,) = T.encode_blocks(ids)
    assert len(block) < 1024 and (T.decode_blocks(block, np.array([0])) == ids).all()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


def encoded(texts):
    encoder, out, counts = T.PieceEncoder(TOKENIZER, 2), [], []
    for _, _, data, offsets in byte_blocks(pa.array(texts, pa.string()), 200):
        ids, n = encoder.encode(data, offsets)
        out += ids.tolist()
        counts += n
    return out, counts


ALPHABET = st.lists(st.sampled_from([*"abZ' \n\t,.!19é’“<|>  　\u0085 \r\x1c\x00Ω中٣_-😀", "<|endoftext|>"]), max_size=40).map("".join)


@given(st.lists(ALPHABET, max_size=12))
@settings(max_examples=150, deadline=None)
def test_ids_are_those_of_the_library(library, texts):
    want = [e.ids + [2] for e in library.encode_batch(texts, add_special_tokens=False)]
    assert encoded(texts) == ([i for w in want for i in w], [len(w) for w in want])


def test_bounded_table_of_pieces(library, monkeypatch):
    monkeypatch.setattr(T, "MEMO", 3)
    texts = [f"word{i} and more, {i * 7} signs." for i in range(60)]
    want = [e.ids + [2] for e in library.encode_batch(texts, add_special_tokens=False)]
    assert encoded(texts)[0] == [i for w in want for i in w]


def thue_morse(n):
    word = "a"
    for _ in range(n):
        word += word.translate({97: "b", 98: "a"})
    return word, word.translate({97: "b", 98: "a"})


def test_pieces_of_equal_hashes_are_told_apart(library, monkeypatch):
    """Words that a polynomial hash modulo 2**64 can't tell apart, and a hash that tells nothing apart."""
    texts = [*thue_morse(12), "x " + thue_morse(10)[0], "x " + thue_morse(10)[1]]
    want = [i for e in library.encode_batch(texts, add_special_tokens=False) for i in [*e.ids, 2]]
    assert encoded(texts)[0] == want
    monkeypatch.setattr(T.PieceEncoder, "_hashes", lambda self, data, starts, ends: (ends - starts).astype(np.uint64) // np.uint64(4))
    texts = [f"word{i} and more, {i * 7} signs." for i in range(60)]
    want = [i for e in library.encode_batch(texts, add_special_tokens=False) for i in [*e.ids, 2]]
    assert encoded(texts)[0] == want


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def test_files_round_trip(spark, docs, awkward, library, tmp_path, monkeypatch):
    import xxhash

    folder = str(tmp_path / "tokens")
    T.write_token_files(docs, folder, TOKENIZER, 2, part_text_bytes=100_000)
    files = spark.read.parquet(folder)
    assert files.count() > 1
    monkeypatch.setattr(T, "PARTS", 2)
    got = [tuple(r) for r in T.read_token_files(spark, folder).orderBy("start").collect()]
    ordered = sorted(awkward, key=lambda r: (r[0] is not None, r[0] or 0, signed(xxhash.xxh64_intdigest((r[1] or "").encode(), 42)), (r[1] or "").encode()))
    place, want = 0, []
    for d, t in ordered:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((d, place, len(ids), zlib.crc32(ids.tobytes())))
        place += len(ids)
    assert got == want
    data = bytes(files.where("ids > 20").first().content)
    with pytest.raises(ValueError):
        T.FileReader(data[:-3])
    reader = T.FileReader(data)
    whole = reader.ids(0, reader.n_ids)
    assert (reader.ids(5, 9) == whole[5:9]).all() and len(reader.ids(4, 4)) == 0


def test_files_are_closed_when_they_are_full(spark, docs, library, tmp_path, monkeypatch):
    """A part of several files: the same rows."""
    folder = str(tmp_path / "tokens")
    table = docs.select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(30))).alias("i"), F.substring("text", 1, 100_000).alias("text"))
    T.write_token_files(table, folder, TOKENIZER, 2)
    assert spark.read.parquet(folder).groupBy("part").agg(F.count("*").alias("n")).where("n > 1").count()
    rows = T.read_token_files(spark, folder).orderBy("start").collect()
    assert len(rows) == table.count() and all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))


def test_no_documents_no_files(docs):
    assert T.token_file_digest(docs.limit(0), TOKENIZER, 2).count() == 0
