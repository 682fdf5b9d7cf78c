"""Token ids in binary files of patched frame-of-reference blocks.

A file holds the ids of a range of documents in doc_id order::

    b"PFOR0001"
    blocks           each BLOCK ids (the last may be short)
    block index      uint64 place of every block, and one past the last
    document table   int64 doc_id, uint8 1 if it is null, uint64 number of ids
    footer           uint64 place of the index, blocks, documents, ids; b"PFOR0001"

A block subtracts its minimum and packs the remainders at one width, chosen among the widths of a few
percentiles of the remainders as the one that takes the least room. Remainders that don't fit are
stored whole in a list of exceptions behind the packed words::

    uint32 minimum, uint16 ids, uint8 width, uint8 unused, uint16 exceptions, uint16 unused
    packed words     64 ids at a time in ``width`` little-endian uint64
    exceptions       uint16 places, uint32 remainders

Spark writes the files: each is the value ``content`` of a row (part, seq, docs, ids, content) of a Parquet
table, so they reach any store that Spark reaches, and an attempt that is lost leaves nothing behind. A task
yields a file each ``FILE_IDS`` ids, or one document's if that is more. Texts are cut where the byte-level
pre-tokenizer always cuts, and each distinct piece is encoded once by the library for a Python worker. Pieces
are looked up by hash and then compared byte by byte; a text with a piece whose hash another one has, with
special tokens or with unusual white space is encoded whole.

Defined cases: a null or empty text has the end id only; null doc_ids come first, and rows with equal
doc_ids are ordered by a hash of their text, then by the text; each row is a document; an empty table
writes no file; other columns are not looked at.
"""

from __future__ import annotations

import io
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import byte_blocks, byte_table, fresh_path, span_hashes, text_of

MAGIC = b"PFOR0001"
BLOCK = 1024
#: Pieces that a worker's table holds at most before it starts afresh, besides those of one block.
MEMO = 2_000_000
#: Ids from which on a file is closed, and parts whose ids are summed up together.
FILE_IDS, PARTS = 1 << 21, 1024
PERCENTILES = (0.75, 0.9, 0.95, 0.98, 1.0)
_HEAD = np.dtype([("least", "<u4"), ("ids", "<u2"), ("width", "u1"), ("_a", "u1"), ("exceptions", "<u2"), ("_b", "<u2")])
_DOC = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("ids", "<u8")])


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 64 values below 2**width as rows of ``width`` words."""
    out = np.zeros((len(values), width), np.uint64)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        out[:, word] |= values[:, i] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= values[:, i] >> np.uint64(64 - shift)
    return out


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(words), 64), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        v = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            v = v | words[:, word + 1] << np.uint64(64 - shift)
        out[:, i] = v & mask
    return out


def _widths(values: np.ndarray) -> np.ndarray:
    """The bits that each value takes, 1 at least."""
    return np.maximum(1, np.frexp(values.astype(np.float64))[1])


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """The blocks of an array of ids below 2**32."""
    if not len(ids):
        return []
    n = -(-len(ids) // BLOCK)
    full = np.full(n * BLOCK, ids[-1], np.uint64)
    full[: len(ids)] = ids
    full = full.reshape(n, BLOCK)
    least = full.min(axis=1)
    rest = full - least[:, None]
    bits = np.sort(_widths(rest), axis=1)
    chosen, price = np.zeros(n, np.int64), np.full(n, np.inf)
    for p in PERCENTILES:
        w = bits[:, min(BLOCK - 1, int(p * BLOCK))]
        cost = w * BLOCK + (bits > w[:, None]).sum(axis=1) * 48.0
        better = cost < price
        chosen[better], price[better] = w[better], cost[better]
    out: list[bytes] = [b""] * n
    for width in np.unique(chosen).tolist():
        rows = np.flatnonzero(chosen == width)
        own = rest[rows]
        over = own >> np.uint64(width) != 0
        packed = pack(np.where(over, np.uint64(0), own).reshape(-1, 64), width).astype("<u8").reshape(len(rows), -1)
        for at, row in enumerate(rows.tolist()):
            places = np.flatnonzero(over[at])
            head = np.zeros(1, _HEAD)
            head["least"], head["width"], head["exceptions"] = least[row], width, len(places)
            head["ids"] = min(BLOCK, len(ids) - row * BLOCK)
            out[row] = head.tobytes() + packed[at].tobytes() + places.astype("<u2").tobytes() + own[at][places].astype("<u4").tobytes()
    return out


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that start at ``starts``."""
    if not len(starts):
        return np.zeros(0, np.uint32)
    size = _HEAD.itemsize
    heads = np.frombuffer(b"".join(data[s : s + size] for s in starts.tolist()), _HEAD)
    out = np.zeros((len(starts), BLOCK), np.uint64)
    for width in np.unique(heads["width"]).tolist():
        rows = np.flatnonzero(heads["width"] == width)
        room = BLOCK // 8 * width
        words = np.frombuffer(b"".join(data[s + size : s + size + room] for s in starts[rows].tolist()), "<u8").reshape(-1, width)
        out[rows] = unpack(words, width).reshape(len(rows), BLOCK)
        for row in rows[heads["exceptions"][rows] > 0].tolist():
            m, at = int(heads["exceptions"][row]), int(starts[row]) + size + room
            out[row, np.frombuffer(data, "<u2", m, at)] = np.frombuffer(data, "<u4", m, at + 2 * m)
    out += heads["least"].astype(np.uint64)[:, None]
    keep = np.arange(BLOCK)[None, :] < heads["ids"][:, None]
    return out[keep].astype(np.uint32)


class FileWriter:
    """Writes one file; ids are packed as they come."""

    def __init__(self, sink) -> None:
        self.sink, self.place, self.ids = sink, 0, 0
        self.starts: list[int] = []
        self.docs: list[tuple[int, int, int]] = []
        self.rest = np.zeros(0, np.uint32)
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.place += len(data)

    def _flush(self, ids: np.ndarray) -> None:
        for block in encode_blocks(ids):
            self.starts.append(self.place)
            self._put(block)

    def add(self, doc_ids: list, counts: list[int], ids: np.ndarray) -> None:
        self.docs += [(d or 0, d is None, n) for d, n in zip(doc_ids, counts)]
        self.ids += len(ids)
        both = np.concatenate([self.rest, ids])
        whole = len(both) // BLOCK * BLOCK
        self._flush(both[:whole])
        self.rest = both[whole:]

    def close(self) -> int:
        self._flush(self.rest)
        index = self.place
        self._put(np.array([*self.starts, self.place], "<u8").tobytes())
        self._put(np.array(self.docs, _DOC).tobytes())
        self._put(np.array([index, len(self.starts), len(self.docs), self.ids], "<u8").tobytes() + MAGIC)
        return self.ids


class FileReader:
    """Reads one file's bytes; ``ids`` decodes only the blocks of the range asked for."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC or data[-8:] != MAGIC:
            raise ValueError("not a token file, or one that was cut off")
        index, blocks, docs, self.n_ids = (int(x) for x in np.frombuffer(data, "<u8", 4, len(data) - 40))
        self.data = data
        self.starts = np.frombuffer(data, "<u8", blocks, index).astype(np.int64)
        self.docs = np.frombuffer(data, _DOC, docs, index + 8 * (blocks + 1))

    def ids(self, first: int, last: int) -> np.ndarray:
        if last <= first:
            return np.zeros(0, np.uint32)
        low, high = first // BLOCK, -(-last // BLOCK)
        return decode_blocks(self.data, self.starts[low:high])[first - low * BLOCK : last - low * BLOCK]


_ENCODERS: dict[tuple[str, int], PieceEncoder] = {}


def encoder_of(path: str, end_id: int) -> PieceEncoder:
    """One encoder for each Python worker, which later tasks of the worker find filled."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = PieceEncoder(path, end_id)
    return _ENCODERS[path, end_id]


#: White space in ASCII, what else Python or Unicode may take for some, and ASCII letters and digits.
_SPACE = byte_table(lambda b: b == 32 or 9 <= b <= 13)
_WORD = byte_table(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)
_SIGN = byte_table(lambda b: 32 < b < 127 and not chr(b).isalnum())


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pre-tokenizer cuts whatever stands around, for texts without ``odd_rows``' signs.

    That is before a lone space or newline between other characters, after such a newline, and between an
    ASCII letter or digit and an ASCII sign. Rows start pieces too.
    """
    space = _SPACE[data]
    plain = ~space
    cut = np.zeros(len(data) + 2, bool)
    lone = np.zeros(len(data), bool)
    lone[1:-1] = space[1:-1] & plain[:-2] & plain[2:]
    lone &= (data == 32) | (data == 10)
    edge = offsets[1:-1]
    lone[edge[edge < len(data)]] = False  # white space at the edge of a row isn't between two characters
    last = offsets[1:] - 1
    lone[last[last >= 0]] = False
    cut[: len(data)] = lone
    cut[1 : len(data) + 1] |= lone & (data == 10)
    cut[1 : len(data)] |= _WORD[data[:-1]] & _SIGN[data[1:]]
    cut = cut[: len(data)]
    cut[offsets[:-1][offsets[:-1] < len(data)]] = True
    return np.flatnonzero(cut)


def odd_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows with what may be a special token, or with white space beyond ASCII's usual."""
    x = np.concatenate([data, np.zeros(2, np.uint8)])
    a, b, c = x[:-2], x[1:-1], x[2:]
    odd = (a == 0x3C) & (b == 0x7C)
    odd |= (a >= 0x1C) & (a <= 0x1F)
    odd |= (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    odd |= (a == 0xE1) & (b == 0x9A) & (c == 0x80)
    odd |= (a == 0xE2) & (((b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
    odd |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
    return np.unique(np.searchsorted(offsets, np.flatnonzero(odd), side="right") - 1)


class PieceEncoder:
    """Ids of texts, with each distinct piece encoded once by the tokenizers library.

    The table of pieces is sorted by hash, holds their bytes, and starts afresh when it has more than ``MEMO``
    entries, so its memory is bounded.
    """

    def __init__(self, path: str, end_id: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end_id = end_id
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.first, self.count, self.at, self.size = (np.zeros(0, np.int64) for _ in range(4))
        self.ids, self.body = np.zeros(0, np.uint32), np.zeros(0, np.uint8)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, raw: list[bytes]) -> None:
        """Add new pieces; ``keys`` ascend."""
        parts = [own for low in range(0, len(raw), 20_000) for own in self._encode([r.decode() for r in raw[low : low + 20_000]])]
        count, size = np.array([len(p) for p in parts]), np.array([len(r) for r in raw])
        place = np.searchsorted(self.keys, keys)
        new = {"keys": keys, "first": len(self.ids) + np.cumsum(count) - count, "count": count, "at": len(self.body) + np.cumsum(size) - size, "size": size}
        for name, own in new.items():
            setattr(self, name, np.insert(getattr(self, name), place, own))
        self.ids = np.concatenate([self.ids, *parts])
        self.body = np.concatenate([self.body, np.frombuffer(b"".join(raw), np.uint8)])

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each piece of a byte block: its start, the place and number of its ids, and whether its entry has other bytes."""
        starts = piece_starts(data, offsets)
        ends = np.append(starts[1:], len(data))
        size = ends - starts
        keys, some, back = np.unique(self._hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > MEMO:
            self._forget()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        if not known.all():
            raw, new = data.tobytes(), some[~known]
            self._learn(keys[~known], [raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist())])
            at = np.searchsorted(self.keys, keys)
        entry = at[back]
        other = self.size[entry] != size
        own = np.where(other, 0, size)  # compare the bytes of entries of the right size
        place = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
        differ = data[np.repeat(starts, own) + place] != self.body[np.repeat(self.at[entry], own) + place]
        other[np.repeat(np.arange(len(own)), own)[differ]] = True
        return starts, self.first[entry], self.count[entry], other

    def _hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return span_hashes(data, starts, ends) ^ (ends - starts).astype(np.uint64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """The ids of all rows of a byte block, each with the end id, and the number of each."""
        rows = len(offsets) - 1
        own = np.zeros(rows, np.int64)
        ids, whole = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(data):
            starts, first, count, other = self._pieces(data, offsets)
            row = np.searchsorted(offsets, starts, side="right") - 1
            whole = row[other]
            own = np.bincount(row, weights=count, minlength=rows).astype(np.int64)
            before = np.cumsum(count) - count
            ids = self.ids[np.repeat(first - before, count) + np.arange(int(count.sum()))]
        edge = np.cumsum(own)
        odd = np.union1d(odd_rows(data, offsets), whole).tolist()
        if not odd:
            return np.insert(ids, edge, self.end_id).astype("<u4"), (own + 1).tolist()
        parts = np.split(ids, edge[:-1])
        raw = data.tobytes()
        for i, found in zip(odd, self._encode([raw[offsets[i] : offsets[i + 1]].decode() for i in odd])):
            parts[i] = found
        end = np.array([self.end_id], np.uint32)
        return np.concatenate([x for p in parts for x in (p, end)]).astype("<u4"), [len(p) + 1 for p in parts]


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_text_bytes: int = 16 << 20,
) -> None:
    """Write the ids of ``docs`` in ascending doc_id order to the token files of ``folder``."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    ordered = rows.repartitionByRange(max(1, -(-total // part_text_bytes)), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        encoder, sink = encoder_of(tokenizer_path, end_id), io.BytesIO()
        writer = FileWriter(sink)

        def closed() -> pa.RecordBatch:
            n = writer.close()
            values = [[part], [seq], [len(writer.docs)], [n], [sink.getvalue()]]
            return pa.record_batch([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["part", "seq", "docs", "ids", "content"])

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for low, n, data, offsets in byte_blocks(batch.column(1)):
                found, counts = encoder.encode(data, offsets)
                writer.add(doc_ids[low : low + n], counts, found)
                if writer.ids >= FILE_IDS:
                    yield closed()
                    seq, sink = seq + 1, io.BytesIO()
                    writer = FileWriter(sink)
        if writer.docs:
            yield closed()

    files = ordered.select("doc_id", "text").mapInArrow(run, "part int, seq int, docs bigint, ids bigint, content binary")
    files.write.option("compression", "none").parquet(folder)  # blocks are packed


def file_starts(files: DataFrame) -> DataFrame:
    """(f_part, f_seq, before: ids of all files before it): sums over groups of ``PARTS`` parts, then inside each."""
    own = files.select("part", "seq", "ids", F.floor(F.col("part") / PARTS).alias("chunk"))
    ahead = lambda w: F.coalesce(F.sum("ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chunks = own.groupBy("chunk").agg(F.sum("ids").alias("ids"))
    chunks = chunks.select(F.col("chunk").alias("of"), ahead(Window.orderBy("chunk")).alias("base"))  # a row for each PARTS parts
    inside = own.withColumn("inside", ahead(Window.partitionBy("chunk").orderBy("part", "seq")))
    return inside.join(chunks, F.col("chunk") == F.col("of")).select(F.col("part").alias("f_part"), F.col("seq").alias("f_seq"), (F.col("base") + F.col("inside")).alias("before"))


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = spark.read.schema("part int, seq int, docs bigint, ids bigint, content binary").parquet(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, content in zip(*batch.columns):
                file = FileReader(content.as_py())
                at = np.concatenate([[0], np.cumsum(file.docs["ids"])]).astype(np.int64)
                for low in range(0, len(file.docs), 4096):
                    docs = file.docs[low : low + 4096]
                    own = at[low : low + len(docs) + 1]
                    ids = file.ids(int(own[0]), int(own[-1])).astype("<u4")
                    crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(own - own[0], own[1:] - own[0])]
                    where = [pa.array(np.full(len(docs), x.as_py(), np.int32)) for x in (part, seq)]
                    yield pa.record_batch(
                        [*where, pa.array(docs["doc_id"], pa.int64(), mask=docs["null"] == 1), pa.array(own[:-1]), pa.array(np.diff(own)), pa.array(crc, pa.int64())],
                        names=["part", "seq", "doc_id", "place", "n_tokens", "ids_crc32"],
                    )

    found = files.select("part", "seq", "content").mapInArrow(run, "part int, seq int, doc_id bigint, place bigint, n_tokens bigint, ids_crc32 bigint")
    both = found.join(file_starts(files), (F.col("part") == F.col("f_part")) & (F.col("seq") == F.col("f_seq")))
    return both.select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def token_file_digest(docs: DataFrame, tokenizer_path: str, end_id: int, **how) -> DataFrame:
    """Write ``docs`` to token files in the shared folder and read them back."""
    folder = fresh_path(docs.sparkSession, "tokens")
    write_token_files(docs, folder, tokenizer_path, end_id, **how)
    return read_token_files(docs.sparkSession, folder)
