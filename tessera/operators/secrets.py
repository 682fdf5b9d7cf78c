r"""Secrets in literals: keys over several literals, variables with secret names, credentials, tokens.

Literals become rows in order. A literal with a key's begin opens a block that goes on to the next begin; all that is known of a
block comes from windows over it: whether its first literal behind the begin is blank, and where its first end
is. A key cut into many literals is one finding, at its begin.

Rules: a block counts if something stands between its begin and its end, in one literal or in several; a blank literal right behind
the begin, or an end there, closes it without a finding; without an end there is none. Literals inside a block
are no other findings. Outside, a literal is looked at for the variable that it is given to, then for a secret name with
a value inside it, then as a token; the first that fits counts.

Defined cases: null texts have no literals; comments don't count; rows of equal keys are kept apart by ``part``; other columns
aren't carried; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.literals import is_credential, is_secret_assignment, is_token
from tessera.functions.views import FAMILY_OF, bare_view

#: The marks of keys and certificates.
_KIND = r"(?:RSA|DSA|EC)?\s*\b(?:PRIVATE\s+KEY|CERTIFICATE)\b"
BEGIN, END = rf"\bBEGIN\s+{_KIND}", rf"\bEND\s+{_KIND}"
_LITERAL = r"(?:(\w+)\s*(?::\s*\w+\s*)?=\s*)?(\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+')"


def named_literals(files: DataFrame, language: str, key: str, text: str = "text") -> DataFrame:
    """(key, part, place, variable, literal): literals in order, with the variable that each is given to (empty without one)."""
    code = bare_view(F.col(text), FAMILY_OF.get(language, "none"))
    pairs = F.arrays_zip(F.regexp_extract_all(code, F.lit(_LITERAL), F.lit(1)).alias("variable"), F.regexp_extract_all(code, F.lit(_LITERAL), F.lit(2)).alias("literal"))
    own = files.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("part"), pairs.alias("pairs"))  # numbered before they are exploded
    return own.select("key", "part", F.posexplode("pairs").alias("place", "x")).select("key", "part", "place", "x.variable", "x.literal")


def _blank(literal: Column) -> Column:
    return F.trim(F.regexp_replace(literal, r"^[\"']|[\"']$|\\n", "")) == ""


def secrets(files: DataFrame, language: str, key: str, text: str = "text") -> DataFrame:
    """(key, place, kind): key, variable, credential or token, with the number of the literal in its text (from 0)."""
    found = named_literals(files, language, key, text)
    begins, ends = F.rlike("literal", F.lit(BEGIN)), F.rlike("literal", F.lit(END))
    inside = F.regexp_extract("literal", rf"(?s){BEGIN}[\s\-]*(.*?)[\s\-]*{END}", 1)
    whole = begins & F.rlike("literal", F.lit(rf"(?s){BEGIN}.*{END}"))
    order = Window.partitionBy("key", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = found.select("*", begins.alias("begins"), (ends & ~begins).alias("ends"), whole.alias("whole"), (F.regexp_replace(inside, r"\\n|\s", "") != "").alias("filled"), _blank(F.col("literal")).alias("blank")).withColumn("block", F.sum(begins.cast("int")).over(order))
    block = Window.partitionBy("key", "part", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    second = F.nth_value(F.struct("place", "blank", "ends"), 2).over(block)
    rows = rows.withColumn("head", F.first(F.struct("place", "whole", "filled")).over(block)).withColumn("second", second).withColumn("end", F.min(F.when(F.col("ends"), F.col("place"))).over(block))
    empty = F.col("second.blank") | F.col("second.ends")
    closed = F.when(F.col("head.whole"), F.col("head.place")).when(empty, F.col("second.place")).otherwise(F.col("end"))
    outside = (F.col("block") == 0) | F.coalesce(F.col("place") > closed, F.lit(False))
    is_key = F.col("begins") & F.when(F.col("head.whole"), F.col("head.filled")).otherwise(F.coalesce(~empty & F.col("end").isNotNull(), F.lit(False)))
    kind = F.when(is_key, "key").when(~outside, F.lit(None)).when(is_secret_assignment(F.col("variable"), F.col("literal")), "variable").when(is_credential(F.col("literal")), "credential").when(is_token(F.col("literal")), "token")
    return rows.select(F.col("key").alias(key), "place", kind.alias("kind")).where("kind IS NOT NULL")
