"""Encodings against Python's own codecs."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.sources import files as S

FRENCH = "L'été dernier, à la crèche, le café coûtait 3 € ; voilà où élève et père étaient.\r\n"
JAPANESE = "これは日本語の文章です。カタカナも漢字も入っています。\r\n"


def contents():
    rng = random.Random(4)
    out = []
    for name, codec, text in [
        ("US-ASCII", "ascii", "plain text\r\nx = 1\r"),
        ("UTF-8", "utf-8", FRENCH + JAPANESE),
        ("UTF-8", "utf-8-sig", FRENCH),
        ("UTF-16LE", "utf-16", FRENCH),
        ("EUC-JP", "euc_jp", JAPANESE),
        ("ISO-8859-1", "latin-1", FRENCH.replace("€", "e")),
        ("ISO-8859-15", "iso-8859-15", FRENCH),
        ("windows-1252", "cp1252", FRENCH),
        ("IBM850", "cp850", FRENCH.replace("€", "e")),
        ("UTF-32", "utf-32", FRENCH),
    ]:
        for _ in range(6):
            words = text.split(" ")
            own = " ".join(words + rng.choices(words, k=rng.randint(0, 200)))
            out.append((name, own.encode(codec), own))
    return out


def test_ten_encodings_are_told_and_read(spark):
    made = contents()
    rows = spark.createDataFrame([(i, bytearray(c)) for i, (_, c, _) in enumerate(made)], "i int, content binary")
    got = {r.i: (r.encoding, r.text) for r in S.with_text(rows).collect()}
    assert got == {i: (name, text.replace("\r\n", "\n").replace("\r", "\n")) for i, (name, _, text) in enumerate(made)}


def test_other_trials_and_awkward_contents(spark):
    sjis = JAPANESE.encode("shift_jis")
    made = [sjis, "ﾊﾝｶｸ".encode("shift_jis") + sjis, b"", b"\xa0\xa0", b"\x81\xe9\x80", b"\x00\x01" * 9 + b"a" * 20, b"\xa4\xa2" * 500_000, b"\xe9" * 1_000_001, None, b"\xdd\x73\x66\x73a", b"\x8f\xa1"]
    rows = spark.createDataFrame([(i, None if c is None else bytearray(c)) for i, c in enumerate(made)], "i int, content binary")
    usual = [r[0] for r in rows.orderBy("i").select(S.encoding_of(F.col("content"))).collect()]
    assert usual[2:] == ["US-ASCII", "IBM850", "IBM850", "binary", "EUC-JP", "ISO-8859-1", None, "UTF-EBCDIC", "IBM850"]
    other = rows.withColumn("e", S.encoding_of(F.col("content"), ("US-ASCII", "UTF-8", "Shift_JIS"))).withColumn("t", S.decoded(F.col("content"), F.col("e"))).orderBy("i").collect()
    assert [r.e for r in other[:3]] == ["Shift_JIS", "Shift_JIS", "US-ASCII"] and other[0].t == JAPANESE.replace("\r\n", "\n") and other[5].t is None and other[8].t is None and other[9].t is None


@pytest.mark.parametrize("name, codec", [("windows-1252", "cp1252"), ("IBM850", "cp850"), ("ISO-8859-15", "iso-8859-15"), ("ISO-8859-1", "latin-1")])
def test_every_byte_is_read(spark, name, codec):
    every = bytes(b for b in range(32, 256) if bytes([b]).decode(codec, "ignore"))
    row = spark.createDataFrame([(bytearray(every),)], "content binary").select(S.decoded(F.col("content"), F.lit(name)).alias("t")).first()
    assert row.t == every.decode(codec)
