r"""File scans: recursive listing with filters, decoding, and what can't be analysed.

``scan_files`` reads names and sizes first; filters on them are applied before any content is read. Files
of no bytes at all have no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions.versions import file_name_library, file_name_version

#: Names that are never descended into, sizes in bytes, and extensions.
IGNORED_NAMES = [".svn", ".git"]
BINARY_LIBRARIES = ["jar", "dll", "a", "lib", "so"]
EXCLUDED_EXTENSIONS = ["tar"]
MAX_DISCOVERY_BYTES = 10_240_000
MAX_ANALYSIS_BYTES = 3_072_000
#: Share of control bytes above which a content with two of them in a row is binary.
CONTROL_SHARE = 0.04
#: Bytes at the beginning of a library that tell whether it is binary.
FIRST_BYTES = 70
_CONTROL = r"[\x00-\x08\x0E-\x1A\x1C-\x1F]"


def with_path_parts(files: DataFrame, path: str = "path") -> DataFrame:
    """``files`` with dir, name and ext (lower case, empty if there is none)."""
    p = F.regexp_replace(F.col(path), r"[\\/]+", "/")
    name = F.regexp_extract(p, r"([^/]*)$", 1)
    return files.withColumn("dir", F.regexp_extract(p, r"^(.*)/[^/]*$", 1)).withColumn("name", name).withColumn("ext", F.lower(F.regexp_extract(name, r".\.([^.]+)$", 1)))


def kept_path(path: Column, ignored_names: list[str] = IGNORED_NAMES, ignored_paths: list[str] | None = None) -> Column:
    """True for paths without an ignored directory or file name and that no ignored pattern fits."""
    parts = F.split(path, r"[\\/]+")
    out = ~F.arrays_overlap(parts, F.array(*[F.lit(n) for n in ignored_names]))
    for pattern in ignored_paths or []:
        out &= ~F.rlike(path, F.lit(pattern))
    return out


def scan_files(spark: SparkSession, root: str, ignored_names: list[str] = IGNORED_NAMES, ignored_paths: list[str] | None = None, max_bytes: int = MAX_DISCOVERY_BYTES, glob: str | None = None) -> DataFrame:
    """path, dir, name, ext, length, content, status of all files below ``root`` that aren't ignored or excluded.

    A file of more than ``max_bytes`` bytes has the status TooBig and no content, which isn't read; others have the status None (the word).
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    found = reader.load(root).where(kept_path(F.col("path"), ignored_names, ignored_paths))
    small = found.where(F.col("length") <= max_bytes).select("path", "length", "content", F.lit("None").alias("status"))
    big = found.where(F.col("length") > max_bytes).select("path", "length", F.lit(None).cast("binary").alias("content"), F.lit("TooBig").alias("status"))
    both = with_path_parts(small.union(big))
    return both.where(~F.col("ext").isin(*EXCLUDED_EXTENSIONS)).select("path", "dir", "name", "ext", "length", "content", "status")


#: What the library scan takes for a library, by extension.
LIBRARY_EXTENSIONS = [*BINARY_LIBRARIES, "war", "ear", "aar", "nupkg", "whl", "gem", "egg"]


def library_files(files: DataFrame) -> DataFrame:
    """Files that are libraries by their extension, with the library's name and version from the file name."""
    own = files.where(F.col("ext").isin(*LIBRARY_EXTENSIONS))
    bare = F.regexp_replace("name", r"\.[^.]+$", "")
    return own.select("path", "dir", "name", file_name_library(bare).alias("library"), file_name_version(bare).alias("version"))


def looks_binary(text: Column) -> Column:
    """The quick test of discovery: a control sign other than white space among the first 70 characters."""
    return F.coalesce(F.rlike(F.substring(text, 1, 70), F.lit(_CONTROL)), F.lit(False))


def name_uuid(name: Column) -> Column:
    """A UUID that depends on a name alone: the name's SHA-256 in the usual form, marked as version 8."""
    h = F.sha2(name.cast("string"), 256)
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), F.pmod(F.conv(F.substring(h, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("8"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def date_stamp(at: Column) -> Column:
    """A timestamp as the header of result files writes it."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")


def is_binary(content: Column) -> Column:
    """More than 4 % control bytes, and two of them in a row."""
    raw = F.decode(content, "ISO-8859-1")
    return (F.regexp_count(raw, F.lit(_CONTROL)) > F.length(raw) * CONTROL_SHARE) & F.rlike(raw, F.lit(_CONTROL + "{2}"))


#: What a text of an encoding consists of, byte by byte. Single-byte ones hold any byte, but for those that windows-1252 leaves free.
VALID = {
    "US-ASCII": r"[\x00-\x7F]",
    "EUC-JP": r"[\x00-\x7F]|\x8E[\xA1-\xDF]|\x8F[\xA1-\xFE]{2}|[\xA1-\xFE]{2}",
    "Shift_JIS": r"[\x00-\x7F\xA1-\xDF]|[\x81-\x9F\xE0-\xFC][\x40-\x7E\x80-\xFC]",
    "windows-1252": r"[^\x81\x8D\x8F\x90\x9D]",
    "ISO-8859-1": r"[\x00-\xFF]",
    "ISO-8859-15": r"[\x00-\xFF]",
    "IBM850": r"[\x00-\xFF]",
}
#: The order in which encodings are tried, and bytes that speak for one: accented letters, and the euro sign.
TRIED = ("US-ASCII", "UTF-8", "EUC-JP")
LATIN_LETTERS, DOS_LETTERS, EURO_WINDOWS, EURO_LATIN = "\xe0\xe9\xe8", "\x85\x82", "\x80", "\xa4"


def decodes(content: Column, encoding: str) -> Column:
    """Whether bytes can be read in an encoding."""
    if encoding == "UTF-8":
        return F.is_valid_utf8(content.cast("string"))
    return F.rlike(F.decode(content, "ISO-8859-1"), F.lit(rf"(?s)\A(?:{VALID[encoding]})*+\z"))


def likely_encoding(content: Column) -> Column:
    """The single-byte encoding that the accented letters of bytes speak for; null if there are none."""
    raw = F.decode(content, "ISO-8859-1")
    count = lambda signs: F.length(raw) - F.length(F.translate(raw, signs, ""))
    latin, dos, windows, euro = map(count, (LATIN_LETTERS, DOS_LETTERS, EURO_WINDOWS, EURO_LATIN))
    return F.when(content.isNull() | (latin + dos == 0), F.lit(None)).when(dos > latin, "IBM850").when(windows > euro, "windows-1252").when(windows + euro > 0, "ISO-8859-15").otherwise("ISO-8859-1")


def encoding_of(content: Column, tried: tuple[str, ...] = TRIED) -> Column:
    """The encoding of a text, ``binary`` if it is none.

    A byte-order mark decides; else the first of ``tried`` in which the bytes can be read; else what the letters speak
    for, as far as the bytes can be read in it; else IBM850, in which all can.
    """
    head = F.hex(F.substring(content, 1, 4))
    found = (
        F.when(head.startswith("EFBBBF"), "UTF-8")
        .when(head.isin("FFFE0000", "0000FEFF"), "UTF-32")
        .when(head.startswith("FFFE"), "UTF-16LE")
        .when(head.startswith("FEFF"), "UTF-16BE")
        .when(head == "DD736673", "UTF-EBCDIC")
        .when(is_binary(content), "binary")
    )
    for one in tried:
        found = found.when(decodes(content, one), one)
    likely = likely_encoding(content)
    return found.when(likely.isNotNull() & ((likely != "windows-1252") | decodes(content, "windows-1252")), likely).when(content.isNotNull(), "IBM850")


def _table(codec: str) -> tuple[str, str]:
    """What ISO-8859-1 and a single-byte encoding make of the bytes that they read differently."""
    pairs = [(chr(b), bytes([b]).decode(codec, "ignore") or chr(b)) for b in range(0x80, 0x100)]
    return tuple("".join(x) for x in zip(*[p for p in pairs if p[0] != p[1]]))


_SINGLE = {"windows-1252": _table("cp1252"), "IBM850": _table("cp850"), "ISO-8859-15": _table("iso-8859-15")}
_DOUBLE = {"EUC-JP": "euc_jp", "Shift_JIS": "cp932"}


@F.pandas_udf(StringType())
def _double_byte(content: pd.Series, encoding: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else c.decode(_DOUBLE[e], "replace") for c, e in zip(content, encoding)], dtype=object)


def decoded(content: Column, encoding: Column) -> Column:
    """The text without its byte-order mark, with every line end as ``\\n``; null for binary contents. Signs that an encoding doesn't have are U+FFFD.

    Only contents of double-byte encodings go to Python.
    """
    text = (
        F.when(encoding == "UTF-16LE", F.decode(content, "UTF-16LE"))
        .when(encoding == "UTF-32", F.decode(content, "UTF-32"))
        .when(encoding == "UTF-16BE", F.decode(content, "UTF-16BE"))
        .when(encoding == "ISO-8859-1", F.decode(content, "ISO-8859-1"))
        .when(encoding.isin("UTF-8", "US-ASCII"), F.make_valid_utf8(content.cast("string")))
    )
    for name, (latin, own) in _SINGLE.items():
        text = text.when(encoding == name, F.translate(F.decode(content, "ISO-8859-1"), latin, own))
    double = encoding.isin(*_DOUBLE)
    text = text.when(double, _double_byte(F.when(double, content), encoding))
    return F.regexp_replace(F.regexp_replace(text, "^\ufeff", ""), r"\r\n?", "\n")


def with_text(files: DataFrame) -> DataFrame:
    """``files`` with encoding, text, and the content's CRC-32 and SHA-256."""
    c = F.col("content")
    out = files.withColumn("crc", F.crc32(c)).withColumn("sha256", F.sha2(c, 256)).withColumn("encoding", encoding_of(c))
    return out.withColumn("text", decoded(c, F.col("encoding"))).drop("content")


def binary_libraries(files: DataFrame) -> DataFrame:
    """path, sha256 of binary libraries, which leave the flow; their first bytes tell."""
    return files.where(F.col("ext").isin(*BINARY_LIBRARIES) & is_binary(F.substring("content", 1, FIRST_BYTES))).select("path", F.sha2("content", 256).alias("sha256"))


#: Names of files that a tool writes.
GENERATED = r"(?i)designer|reference|assemblyinfo"


def wrapped(text: Column) -> Column:
    """Stored code that is obfuscated: a create statement whose body is only a ``wrapped`` mark."""
    return F.coalesce(F.rlike(text, F.lit(r"(?is)^\s*create\b[^;]{0,400}\bwrapped\b\s|\bwith\s+encryption\b\s+as\s*$")), F.lit(False))


def analysis_status(language: Column, name: Column, length: Column, text: Column, vendored: Column) -> Column:
    """Why a file isn't analysed, or None (the word) if it is."""
    longest = F.array_max(F.transform(F.split(text, "\n", -1), lambda x: F.length(x)))
    return (
        F.when(length > MAX_ANALYSIS_BYTES, "TooBig")
        .when(text.isNull(), "Binary")
        .when(~F.rlike(text, F.lit(r"\S")), "Empty")
        .when(vendored, "External")
        .when(language.isin("CS", "VbDotNet") & F.rlike(name, F.lit(GENERATED)), "Generated")
        .when(language.isin("JS", "TypeScript") & (longest > 4096), "Minified")
        .when(language.isin("PlSql", "TSql") & wrapped(text), "Wrapped")
        .otherwise("None")
    )


def vendored_flags(files: DataFrame) -> DataFrame:
    """``files`` with ``vendored``: below node_modules, where any package file exists outside of it."""
    inside = F.contains("path", F.lit("/node_modules/"))
    package = files.where(F.col("name").isin("package.json", "package-lock.json") & ~inside).limit(1).select(F.lit(True).alias("__has_package"))
    return files.join(F.broadcast(package), how="left").withColumn("vendored", inside & F.coalesce("__has_package", F.lit(False))).drop("__has_package")  # one row at most


def file_list(spark: SparkSession, path: str) -> DataFrame:
    """context (null without one) and path from a list with lines ``context#file`` or ``file``."""
    line = F.trim(F.col("value"))
    both = F.contains(line, F.lit("#"))
    return spark.read.text(path).where(line != "").select(F.when(both, F.substring_index(line, "#", 1)).alias("context"), F.when(both, F.expr("substring(trim(value), instr(trim(value), '#') + 1)")).otherwise(line).alias("path"))


def parameter_manifest(spark: SparkSession, path: str) -> DataFrame:
    """analyzer (place), field, value from lines ``[field] v1 | v2``: the n-th value belongs to the n-th analyzer."""
    own = spark.read.text(path).select(F.regexp_extract("value", r"^\s*\[(\w+)\]\s*(.*)$", 1).alias("field"), F.regexp_extract("value", r"^\s*\[(\w+)\]\s*(.*)$", 2).alias("all")).where("field <> ''")
    return own.select("field", F.posexplode(F.split("all", r"\s*\|\s*")).alias("analyzer", "value")).select("analyzer", "field", F.trim("value").alias("value"))


def rule_table(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """A rule file: ``;`` between fields, ``"`` doubled inside quotes."""
    return spark.read.csv(path, sep=";", quote='"', escape='"', header=header, multiLine=True)


def history(spark: SparkSession, path: str) -> DataFrame:
    """User decisions, lines ``FILE;id;name[;t1:t2]``: name and technologies (an empty array excludes the file)."""
    part = F.split("value", ";")
    return spark.read.text(path).where(F.element_at(part, 1) == "FILE").select(F.element_at(part, 3).alias("name"), F.coalesce(F.filter(F.split(F.try_element_at(part, F.lit(4)), ":"), lambda x: x != ""), F.array().cast("array<string>")).alias("technos"))


def properties(spark: SparkSession, path: str) -> DataFrame:
    """place, key, value of ``key=value`` lines; values may hold further ``=``; blank lines and comments are skipped."""
    at = F.instr("value", "=")
    own = spark.read.option("wholetext", "true").text(path).select(F.posexplode(F.split("value", r"\r?\n")).alias("place", "value"))
    return own.where((at > 1) & ~F.rlike("value", F.lit(r"^\s*#"))).select("place", F.trim(F.substring(F.col("value"), F.lit(1), at - 1)).alias("key"), F.trim(F.substring(F.col("value"), at + 1, F.length("value"))).alias("value"))


def json_rules(spark: SparkSession, path: str, technologies: list[str]) -> DataFrame:
    """Rules of a JSON list (name, technologies, pattern) for any of the given technologies, case aside."""
    rules = spark.read.schema("name string, technologies array<string>, pattern string").option("multiLine", "true").json(path)
    wanted = [t.lower() for t in technologies]
    return rules.where(F.exists("technologies", lambda t: F.lower(t).isin(*wanted))).select("name", "technologies", "pattern")


def third_party(files: DataFrame) -> DataFrame:
    """(path, cause, sha256) of files that aren't the project's own, from a table with a ``status`` column."""
    return files.where(F.col("status").isin("External", "Generated", "Minified")).select("path", F.col("status").alias("cause"), "sha256")
