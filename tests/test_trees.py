"""Tree operations against walks over plain Python trees; long texts in little time."""

import random
import time

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import metrics as M
from tessera.operators import nodes as N
from tessera.operators import trees as Tr

KINDS = ["a", "b", "c", None]


def random_tree(rng, n, tree):
    """Rows (tree, node_id, parent_id, kind, depth, nesting, last_line) in document order."""
    parents, rows = [], []
    for i in range(n):
        while parents and rng.random() < 0.4:
            parents.pop()
        place = 3 * i + 1
        rows.append([tree, place, parents[-1] if parents else None, rng.choice(KINDS), len(parents), len(parents), 0])
        parents.append(place)
    for r in rows:
        inside = {r[1]}
        for x in rows:
            if x[2] in inside:
                inside.add(x[1])
        r[6] = max(inside)
    return [tuple(r) for r in rows]


def ancestors(rows):
    by = {(r[0], r[1]): r for r in rows}
    out = {}
    for r in rows:
        up, now = [], r
        while now[2] is not None:
            now = by[now[0], now[2]]
            up.append(now)
        out[r[0], r[1]] = up
    return out


SCHEMA = "tree string, node_id int, parent_id int, kind string, depth int, nesting int, last_line int"


def test_operations_are_those_of_walks(spark):
    rng = random.Random(8)
    rows = [r for t in range(12) for r in random_tree(rng, rng.randint(1, 40), f"t{t}")]
    df, up = spark.createDataFrame(rows, SCHEMA).repartition(3), ancestors(rows)
    one = lambda d: sorted(map(tuple, d.collect()))
    assert one(Tr.pairs_below(df, df, ["tree"])) == sorted((k[0], a[1], k[1]) for k, own in up.items() for a in own)

    def expected(within, kinds, stop, first_only=False):
        out = []
        for r in rows:
            for i, a in enumerate(up[r[0], r[1]]):
                between = up[r[0], r[1]][:i]
                if r[3] in kinds and a[3] in within and not any(b[3] in stop or (first_only and b[3] in kinds) for b in between):
                    out.append((r[0], a[1], r[1], r[3]))
        return sorted(out)

    for within, kinds, stop in ((["a"], ["b"], ["c"]), (["a"], ["a", "b"], ["a"]), (["b", "c"], ["c"], [])):
        assert one(Tr.below(df, ["tree"], within, kinds, stop)) == expected(within, kinds, stop)
        assert one(Tr.below(df, ["tree"], within, kinds, stop, first_only=True)) == expected(within, kinds, stop, True)
    has = {(r[0], r[1]): False for r in rows}
    for k, own in up.items():
        for a in own:
            has[a[0], a[1]] |= next(r[3] for r in rows if (r[0], r[1]) == k) == "c"
    assert {(r.tree, r.node_id): r.has for r in Tr.with_contains(df, ["tree"], ["c"], "has").collect()} == has
    seen = {}
    for r in rows:
        if not any(a[3] == "b" for a in up[r[0], r[1]]) and not seen.get(r[0], [(0, 0, 0, "")])[-1][3] == "c":
            seen.setdefault(r[0], []).append(r)
    assert sorted((r.tree, r.node_id) for r in Tr.visited(df, ["tree"], F.col("kind") == "b", F.col("kind") == "c").collect()) == sorted((r[0], r[1]) for own in seen.values() for r in own)
    cloned = Tr.clones(df, ["tree"], F.col("kind") == "a")
    top = {r[1]: r for r in rows if r[0] == "t3"}
    for r in cloned.where("tree = 't3'").collect():
        was = top[r.node_id + r.root_id - 1]
        assert (r.kind, r.last_line, r.nesting) == (was[3], was[6] - r.root_id + 1, was[5] - top[r.root_id][5]) and r.parent_id == (None if r.node_id == 1 else was[2] - r.root_id + 1)
    assert cloned.count() == sum(r[3] == "a" for r in rows) + sum(a[3] == "a" for own in up.values() for a in own)
    assert {(r.tree, r.kind): r.ids for r in Tr.kinds_of(df, ["tree"]).collect()}["t3", "a"] == [i for i, r in sorted(top.items()) if r[3] == "a"]
    assert Tr.below(df.limit(0), ["tree"], ["a"], ["b"], ["c"]).count() == 0


def test_long_texts_take_seconds(spark):
    """100,000 lines, brackets and units in one text, nested or not."""
    began = time.time()
    deep = "\n".join(" " * min(i, 200) + f"if x{i}:" for i in range(3000))
    flat = "\n".join(f"def f{i}(a):\n  if a:\n    pass" for i in range(33_000))
    braces = "\n".join(f"function f{i}() {{" for i in range(20_000)) + "\n}" * 20_000
    files = spark.createDataFrame([("deep", deep), ("flat", flat)], "path string, text string")
    found = {r.path: r for r in N.nodes(files, "Python", "path").groupBy("path").agg(F.count("*").alias("n"), F.max("nesting").alias("most"), F.max("last_line").alias("last")).collect()}
    assert (found["deep"].n, found["deep"].most) == (3000, 200) and (found["flat"].n, found["flat"].most, found["flat"].last) == (66_000, 1, 99_000)
    nested = N.nodes(spark.createDataFrame([("b", braces)], "path string, text string"), "JS", "path")
    assert nested.agg(F.max("nesting")).first()[0] == 19_999
    assert Tr.with_contains(nested, ["path", "part"], ["function"], "more").where("NOT more").count() == 1
    assert Tr.below(N.nodes(files, "Python", "path"), ["path", "part"], ["function"], ["if"], ["class"]).count() == 33_000
    signs = spark.createDataFrame([("(" * 50_000 + "a,b" + ")" * 50_000 + ",c",)], "t string")
    own = T.bracketed(F.col("t"))
    inside, behind, parts = signs.select(F.length(own["inside"]), own["behind"], T.split_outside(F.col("t"), ",")).first()
    assert (inside, behind, len(parts)) == (100_001, ",c", 2)
    units = "\n".join(f"create procedure p{i} as\nselect 1;" for i in range(20_000))
    last = M.units(spark.createDataFrame([("u", units)], "path string, text string"), "PlSql", "path").agg(F.max("first_line"), F.count("*")).first()
    assert tuple(last) == (39_999, 20_000)
    assert time.time() - began < 240  # a busy machine too; quadratic work would take hours


def test_scan_gives_every_state(spark):
    rows = spark.createDataFrame([([],), ([1],), (list(range(1, 1300)),), (None,)], "x array<int>")
    got = [r[0] for r in rows.select(T.scan(F.col("x"), F.lit(0), lambda s, x: s + x)).collect()]
    assert got[0] == [] and got[1] == [1] and got[2] == [i * (i + 1) // 2 for i in range(1, 1300)]


def test_parts_are_the_same_in_every_branch_of_a_join(spark):
    """Rows that come out of a shuffle may come in another order each time: nodes that are joined with themselves must still meet."""
    texts = spark.range(0, 300, 1, 3).select(F.col("id").alias("k"), F.lit("class A:\n  if x:\n    y\nclass B:\n  for z in y:\n    w").alias("text"))
    own = N.nodes(texts.mapInPandas(lambda frames: (x.sample(frac=1) for x in frames), "k long, text string"), "Python", "k")
    assert Tr.clones(own, ["k", "part"], F.col("kind") == "class").count() == 300 * 4
    assert Tr.below(own, ["k", "part"], ["class"], ["if", "for"], stop=["try"]).count() == 300 * 2


def test_places_meet_in_blocks_up_to_the_longest_interval(spark, monkeypatch):
    """Short trees don't send each of their places to the blocks that long ones would need."""
    seen, own = [], Tr._blocks_of_place
    monkeypatch.setattr(Tr, "_blocks_of_place", lambda place, *sizes: (seen.append(sizes), own(place, *sizes))[1])
    for longest, size in ((1, 0), (3, 1), (4, 2), (1000, 9)):
        df = spark.createDataFrame([("t", 5, 5 + longest), ("t", 5 + longest, 5 + longest), ("t", 6 + longest, 6 + longest)], "tree string, node_id int, last_line int")
        assert [tuple(r) for r in Tr.pairs_below(df, df, ["tree"]).collect()] == [("t", 5, 5 + longest)] and seen[-1] == (size,)
