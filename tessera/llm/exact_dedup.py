"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Three scans of the text and shuffles of narrow rows only; no text is ever moved. The first scan counts
normalised lengths. The second hashes a prefix of the rows whose length occurs more than once, and counts
(length, prefix) pairs. The third hashes the full content of the rows whose pair occurs more than once. What
is left after a step is told to the next scan by a bit filter sized by the number of keys left, of at most
``MOST_BITS`` bits (16 MB), which bounds what is broadcast at any input size; past about that many keys it lets more
and more rows through. A false positive costs one hash and changes no result, because groups are formed by
full hash.

Defined cases: a null text is the empty text; a null doc_id sorts after all others when the row that
stays is chosen; rows repeated with the same doc_id and text each count in ``group_size`` and get the
same answer; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import staged, text_of, unused_name

#: The most bits of a filter.
MOST_BITS = 1 << 26
#: The characters that normalisation deletes.
WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, WHITE, "")


def repeated(rows: DataFrame, *keys: str) -> tuple[DataFrame, int]:
    """A bit filter (word, mask) over the keys that more than one row has, and its number of bits."""
    alive = staged(rows.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1").select(F.xxhash64(*keys).alias("key")), "repeated")
    bits = min(MOST_BITS, max(1 << 16, 1 << (16 * alive.count()).bit_length()))
    slots = alive.select(F.pmod("key", F.lit(bits)).alias("slot")).groupBy(F.shiftright("slot", 6).alias("word"))
    return slots.agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 AS int))")).alias("mask")), bits


def with_flag(rows: DataFrame, found: tuple[DataFrame, int], flag: str, *keys: Column) -> DataFrame:
    """``rows`` with ``flag``: whether the filter may hold their keys."""
    table, bits = found
    slot = F.pmod(F.xxhash64(*keys), F.lit(bits))
    both = rows.withColumn("slot", slot).join(F.broadcast(table), F.shiftright("slot", 6) == F.col("word"), "left")
    bit = F.expr("mask & shiftleft(1L, cast(slot & 63 AS int))") != 0
    return both.withColumn(flag, F.coalesce(bit, F.lit(False))).drop("slot", "word", "mask")


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = 256,
    digest_all: bool = False,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, row_hash (of the raw text).

    Texts are equal when they are identical without white space. Of equal texts the one with the most
    code points, then the smallest doc_id, stays. ``text_sha256`` is null for documents that the first
    two refinements settle, unless ``digest_all`` asks for the digest of every text.
    """
    norm = normalised(text_of(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.length(text_of(text_col)).alias("points"), F.xxhash64(text_of(text_col)).alias("row_hash"), norm.alias("norm"))
    length, prefix = F.length("norm"), F.xxhash64(F.substring("norm", 1, prefix_chars))
    lengths = repeated(rows.select(length.alias("length")), "length")
    sized = with_flag(rows.select("norm"), lengths, "alive", length).where("alive").select(length.alias("length"), prefix.alias("prefix"))
    pairs = repeated(sized, "length", "prefix")
    digest = F.unhex(F.sha2("norm", 256))
    second = with_flag(rows, pairs, "alive", length, prefix)
    second = staged(second.select("doc_id", "points", "row_hash", "alive", (digest if digest_all else F.when(F.col("alive"), digest)).alias("digest")), "exact")

    best = F.max(F.struct("points", (-F.col("doc_id")).alias("back"), F.col("doc_id"))).alias("best")
    groups = second.where("alive").groupBy("digest").agg(F.count("*").alias("group_size"), best).where("group_size > 1")
    groups = groups.select(F.col("digest").alias("of"), "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.points").alias("keep_points"))
    groups = staged(groups, "groups")  # a join of two plain exchanges, which can be split where a group is hot
    out = second.join(groups, (F.col("digest") == F.col("of")) & F.col("alive"), "left")
    kept = F.col("of").isNull() | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points")))
    return out.select(
        "doc_id",
        F.when(F.col("of").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        kept.alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "row_hash",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were.

    Rows that repeat both the doc_id and the text of the row that stays stay with it.
    """
    return without(docs, exact_groups(docs, id_col, text_col, **how).where("NOT kept").select("doc_id", "row_hash"), id_col, text_col)


def without(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` without the rows (doc_id, row_hash: the text's) of ``rows``; no column name of ``docs`` can clash."""
    gone_id, gone_text = (unused_name(n, docs.columns) for n in ("gone_id", "gone_text"))
    gone = rows.select(F.col("doc_id").alias(gone_id), F.col("row_hash").alias(gone_text)).distinct()
    same = F.col(id_col).eqNullSafe(F.col(gone_id)) & (F.xxhash64(text_of(text_col)) == F.col(gone_text))
    return docs.join(gone, same, "left_anti")
