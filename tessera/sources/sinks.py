"""Sinks: sectioned CSV, result files by kind, dependency lists as POM text.

Sections are composed as a table (section, part, place, line) and written in that order, so any number of
rows streams through the sort; nothing passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def csv_field(value: Column) -> Column:
    """A value for a ``;`` file: no line ends or separators, missing written as -1."""
    return F.coalesce(F.nullif(F.translate(value.cast("string"), "\n\r\x0b\x0c\x85  ;", "        "), F.lit("")), F.lit("-1"))


def csv_line(columns: list[Column]) -> Column:
    return F.concat_ws(";", *[csv_field(c) for c in columns])


def _sortable(value: Column, kind: str) -> Column:
    """A string that sorts like the value: whole numbers by sign and width, others as they are written."""
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        return value.cast("string")
    wide = value.cast("decimal(20,0)")
    return F.when(value < 0, F.concat(F.lit("-"), F.lpad((wide + F.lit("10000000000000000000").cast("decimal(20,0)")).cast("string"), 20, "0"))).otherwise(F.lpad(wide.cast("string"), 20, "0"))


def section_lines(rows: DataFrame, section: str, columns: list[str], order: list[str]) -> DataFrame:
    """The lines of one section: its title and header once, then a line for each row in ``order``."""
    spark = rows.sparkSession
    head = spark.range(1).select(F.lit(section).alias("section"), F.inline(F.array(F.struct(F.lit(0).alias("part"), F.lit("").alias("place"), F.lit(f"section={section}").alias("line")), F.struct(F.lit(1).alias("part"), F.lit("").alias("place"), F.lit(";".join(columns)).alias("line")))))
    kinds = dict(rows.dtypes)
    place = F.concat_ws("\x01", *[_sortable(F.col(o), kinds[o]) for o in order])
    return head.union(rows.select(F.lit(section), F.lit(2), place, csv_line([F.col(c) for c in columns])))


def sectioned(parts: list[DataFrame], metadata: dict[str, str] | None = None) -> DataFrame:
    """All sections' lines (section, part, place, line) behind ``# key;value`` lines, in order of section, part and place."""
    spark = parts[0].sparkSession
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if metadata:
        head = [F.struct(F.lit("").alias("section"), F.lit(0).alias("part"), F.lit(f"{n:06d}").alias("place"), F.lit(f"# {k};{v}").alias("line")) for n, (k, v) in enumerate(metadata.items())]
        out = spark.range(1).select(F.inline(F.array(*head))).unionByName(out)
    return out.orderBy("section", "part", "place")


def write_sectioned(lines: DataFrame, path: str) -> None:
    lines.select("line").write.text(path)


def lead_columns(wanted: list[str], lead: list[str]) -> list[str]:
    """Columns with ``lead`` first, each once."""
    return list(dict.fromkeys([*lead, *wanted]))


def counter_dump(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line ``name:value``) of a wide table of metrics, by name."""
    names = sorted(c for c in metrics.columns if c not in keys)
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("-1")).alias("value")) for c in names])
    return metrics.select(*keys, F.inline(pairs)).select(*keys, "name", F.concat_ws(":", "name", "value").alias("line"))


def pom_fragments(dependencies: DataFrame) -> DataFrame:
    """A dependency element for each ``group:artifact@version`` reference."""
    ref = F.col("ref")
    group = F.substring_index(ref, ":", 1)
    rest = F.expr("substring(ref, instr(ref, ':') + 1)")
    parts = [("groupId", group), ("artifactId", F.substring_index(rest, "@", 1)), ("version", F.when(F.contains(rest, F.lit("@")), F.substring_index(rest, "@", -1)))]
    tags = [F.when(v.isNotNull(), F.concat(F.lit(f"<{k}>"), v, F.lit(f"</{k}>"))) for k, v in parts]
    return dependencies.select("ref", F.concat(F.lit("<dependency>"), F.concat_ws("", *tags), F.lit("</dependency>")).alias("element"))


def kept_results(results: DataFrame, cause_class: str = "cause_class") -> DataFrame:
    """Result rows that are written: those of cause class 1 or 2."""
    return results.where(F.col(cause_class).isin(1, 2))


def view_dump(files: DataFrame, views: list[str], key: str = "path") -> DataFrame:
    """(key, view, text): a row for each view of each file, as a dump for debugging writes them; ``write.partitionBy("view")`` gives a folder a view."""
    pairs = F.array(*[F.struct(F.lit(v).alias("view"), F.col(f"views.{v}").cast("string").alias("text")) for v in views])
    return files.select(key, F.inline(pairs))


def comment_checks(hits: DataFrame, key: str = "path") -> DataFrame:
    """Lines that a comment check found, in order of file and line."""
    return hits.orderBy(key, "line")


def maven_rows(declared: DataFrame) -> DataFrame:
    """(line, path, place): dependency elements as path-numbered rows, ``normal`` or ``managed``, in order of file and element."""
    kind = F.when(F.col("managed"), "managed").otherwise("normal")
    own = Window.partitionBy("path").orderBy("managed", "group", "artifact", "version")
    numbered = declared.withColumn("place", F.row_number().over(own))
    fields = [F.col("place"), kind, F.col("group"), F.col("artifact"), F.col("version"), F.col("scope")]
    return numbered.select("path", "place", csv_line([F.col("path"), *fields]).alias("line"))
