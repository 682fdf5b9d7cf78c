"""Queries cut into clauses."""

import time

import pytest

from tessera.operators.sql_clauses import lint, queries_of

CASES = [
    ("select a, b from t", [(2, False, 1, False, False, 0, False)]),
    ("select * from t, u v where t.a = v.a and 'x, y' = t.b -- from no, such", [(1, True, 2, True, True, 1, False)]),
    ("select f(a, (b)), g(c, d) from t x, u as y inner join v on x.i = v.i cross apply w", [(2, False, 4, True, False, 0, False)]),
    ("select (select max(a) from t) m from (select 1 from v) w, x y union select b from z", [(1, False, 2, True, False, 0, True), (1, False, 1, False, False, 0, False), (1, False, 1, False, False, 0, False), (1, False, 1, False, False, 0, False)]),
    ("select top (5) * from t; update t set a = 1, b = 2 where t.a = u.b; insert into t (a, b) select c, d from e", [(1, True, 1, False, False, 0, False), (2, False, 1, False, False, 0, False)]),
    ("select coalesce((select 1), 2), 3", [(2, False, 0, False, False, 0, True), (1, False, 0, False, False, 0, False)]),
    ("select (a", [(1, False, 0, False, False, 0, False)]),
    (") select b", [(1, False, 0, False, False, 0, False)]),
    ("", []),
    (None, []),
]


@pytest.fixture(scope="module")
def found(spark):
    files = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "k int, text string").repartition(3)
    out = {}
    for r in queries_of(files, "k").collect():
        out.setdefault(r.k, []).append((r["columns"], r.star, r.tables, r.comma_join, r.missing_alias, r.joins_in_where, r.nests))
    return out


@pytest.mark.parametrize("case", range(len(CASES)))
def test_queries(found, case):
    assert sorted(found.get(case, [])) == sorted(CASES[case][1])


def test_long_and_repeated_texts(spark):
    began = time.time()
    text = "".join(f"select a{i}, (select b from c, d where c.x = d.x) from t{i};\n" for i in range(4000)) + "(" * 3000
    files = spark.createDataFrame([("a", text), ("a", text), ("b", None)], "k string, text string")
    (one,) = lint(files, "k").collect()
    assert (one.Select, one.SubQueries, one.NotANSI_Joins, one.MissingTableAlias, one.JoinsOutsideOn) == (16_000, 8000, 8000, 8000, 8000) and time.time() - began < 180
    assert lint(files.limit(0), "k").count() == 0


def test_tasks_grow_with_the_texts(spark, monkeypatch):
    """What one task sorts has a bound: small shuffled blocks don't make few tasks of many tokens."""
    from pyspark.sql import functions as F

    from tessera.operators import sql_clauses as S

    monkeypatch.setattr(S, "TASK_CHARS", 1000, raising=False)
    files = spark.range(0, 1000, 1, 2).select("id", F.lit("select a, b from t where x = 1 and y = 2").alias("text"))
    found = S.tokens(files, "id")
    sizes = found.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= 30 and sum(r["count"] for r in sizes) == 1000 * 14
    assert S.lint(files, "id").count() == 1000 and S.lint(files.where("id < 0"), "id").count() == 0
