r"""SQL queries cut into clauses, and what lint rules say of them.

A text's tokens become rows. Brackets give each token its depth by a running sum, and an opening bracket is a mark at the depth
inside it, so the tokens of one depth fall into one segment for each bracket. In a segment, queries begin
with ``select`` and clauses with their words, again by running counts. All of it is windows over (text, depth) and
sums over (text, query); nothing looks back into a text.

Defined cases: null texts have no queries; comments don't count and literals are one token; brackets without a partner end
with the text; rows of equal keys are kept apart by ``part``; other columns aren't carried; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.views import code_view

_TOKEN = r"\"chaine\"|[\w.#@$\[\]]+|<>|[<>!]=|\S"
#: Words that begin a clause, words that join, and words before the first column that are none.
CLAUSES = ("select", "into", "from", "where", "group", "having", "order", "on", "union", "except", "intersect", "set", "values", "limit", "fetch", "for", "option", "using")
JOINING = ("join", "inner", "left", "right", "full", "outer", "cross", "natural", "apply")
BEFORE_COLUMNS = ("select", "all", "distinct", "top", "percent", "with", "ties")
#: Signs of text that one task takes: its tokens are sorted several times at once.
TASK_CHARS = 1_000_000
#: Columns and tables of a query that is too large.
MAX_COLUMNS, MAX_TABLES = 9, 4


def tokens(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, part, place, token, selects: so many so far, depth, segment): brackets belong to the depth outside them.

    Texts are dealt to as many tasks as their length asks for, so what a task sorts has the same size however many there are.
    """
    own = files.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("part"), F.lower(code_view(F.col(text), "sql")).alias("code"))
    each = own.select("key", "part", F.posexplode(F.regexp_extract_all("code", F.lit(_TOKEN), F.lit(0))).alias("place", "token"))
    chars = files.agg(F.sum(F.length(text).cast("long"))).first()[0] or 0
    session = files.sparkSession
    tasks = max(math.ceil(chars / TASK_CHARS), min(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions"))))
    each = each.repartition(tasks, "key", "part")  # all windows are over these two and more
    order = Window.partitionBy("key", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    opened, closed = (F.col("token") == "(").cast("int"), (F.col("token") == ")").cast("int")
    deep = each.withColumn("depth", F.greatest(F.lit(0), F.sum(opened - closed).over(order) - opened))
    deep = deep.withColumn("selects", F.sum((F.col("token") == "select").cast("int")).over(order))
    marks = F.when(F.col("token") == "(", F.array(F.struct("depth", F.lit(False).alias("mark")), F.struct((F.col("depth") + 1).alias("depth"), F.lit(True).alias("mark")))).otherwise(F.array(F.struct("depth", F.lit(False).alias("mark"))))
    rows = deep.select("key", "part", "place", "token", "selects", F.inline(marks))
    within = Window.partitionBy("key", "part", "depth").orderBy("place", F.col("mark").cast("int")).rowsBetween(Window.unboundedPreceding, 0)
    begins = F.col("mark") | (F.col("token") == ";")
    return rows.withColumn("segment", F.sum(begins.cast("int")).over(within)).where("NOT mark")


def clauses(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, part, depth, segment, query: the place of its select, clause, item: from 1, place, token): tokens of queries; items of a clause are parted by commas."""
    own = Window.partitionBy("key", "part", "depth", "segment").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    word = F.when(F.col("token").isin(*CLAUSES), F.col("token")).when(F.col("token").isin(*JOINING), F.lit("join"))
    found = tokens(files, key, text)
    found = found.withColumn("query", F.last(F.when(F.col("token") == "select", F.col("place")), ignorenulls=True).over(own)).withColumn("clause", F.last(word, ignorenulls=True).over(own)).where("query IS NOT NULL")
    inside = Window.partitionBy("key", "part", "query", "clause").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return found.withColumn("item", F.sum((F.col("token") == ",").cast("int")).over(inside) + 1)


def queries_of(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row for each query of each text: key, part, query, depth, columns, star, tables, comma_join, missing_alias, joins_in_where, nests (another query in it), complex, too_many_tables."""
    found = clauses(files, key, text)
    near = Window.partitionBy("key", "part", "depth", "segment").orderBy("place")
    qualified = lambda c: F.coalesce(F.rlike(c, F.lit(r"^[a-z_#@\[][\w#@$\[\]]*\.[\w.#@$\[\]]+$")), F.lit(False))
    found = found.withColumn("tie", (F.col("token") == "=") & (F.col("clause") == "where") & qualified(F.lag("token").over(near)) & qualified(F.lead("token").over(near)))
    behind = near.rowsBetween(1, Window.unboundedFollowing)
    until = F.first(F.when(F.col("token") == ")", F.col("selects")), ignorenulls=True).over(behind)
    found = found.withColumn("inner", F.when(F.col("token") == "(", F.coalesce(until, F.col("selects")) - F.col("selects")).otherwise(0))
    in_from = F.col("clause") == "from"
    items = found.groupBy("key", "part", "query", "depth", "clause", "item").agg(
        F.count_if(~F.col("token").isin(",", *CLAUSES, "as")).alias("words"),
        F.count_if(F.col("token") == ")").alias("groups"),
        F.count_if(~F.col("token").isin(*BEFORE_COLUMNS, "(", ")") & (F.col("token") != "*")).alias("named"),
        F.count_if(F.col("token") == "*").alias("stars"),
        F.count_if(F.col("tie")).alias("ties"),
        F.count_if(F.col("token").isin("join", "apply")).alias("joins"),
        F.sum("inner").alias("inner"),
    )
    plain = F.col("words") - F.col("groups") * 2  # a bracket is two signs here: what stands in it is deeper
    query = items.groupBy("key", "part", "query", "depth").agg(
        F.coalesce(F.max(F.when(F.col("clause") == "select", F.col("item"))), F.lit(0)).cast("int").alias("columns"),
        F.bool_and(F.when(F.col("clause") == "select", (F.col("item") == 1) & (F.col("stars") == 1) & (F.col("named") == 0))).alias("star"),
        F.coalesce(F.max(F.when(in_from, F.col("item"))), F.lit(0)).cast("int").alias("listed"),
        F.sum("joins").cast("int").alias("joins"),
        F.count_if(in_from & (F.when(F.col("groups") > 0, plain < 1).otherwise(plain < 2))).cast("int").alias("bare"),
        F.sum("ties").cast("int").alias("joins_in_where"),
        (F.sum("inner") > 0).alias("nests"),
    )
    comma = F.col("listed") > 1
    tables = F.col("listed") + F.col("joins")
    return query.select(
        F.col("key").alias(key), "part", "query", "depth", "columns", "star", tables.alias("tables"), comma.alias("comma_join"), (comma & (F.col("bare") > 0)).alias("missing_alias"), "joins_in_where",
        "nests", (F.col("star") | (F.col("columns") > MAX_COLUMNS)).alias("complex"), (tables > MAX_TABLES).alias("too_many_tables"),
    )


def lint(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row for each text with queries: how many break each rule."""
    count = lambda c: F.count_if(F.col(c)).alias
    return queries_of(files, key, text).groupBy(key).agg(
        F.count("*").alias("Select"), count("comma_join")("NotANSI_Joins"), count("missing_alias")("MissingTableAlias"), count("nests")("SubQueries"), count("complex")("ComplexQueries"),
        count("too_many_tables")("OnToManyTablesQueries"), F.sum("joins_in_where").alias("JoinsOutsideOn"),
    )
