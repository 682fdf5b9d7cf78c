"""The prefix trie against a dictionary of all prefixes, whatever the partitions."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import queries as Q
from tessera.llm.prefix_trie import WIDTH, common, keys_of, prefix_trie, turns_of

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def ordered(rows):
    """The turns (role, text) of each conversation."""
    out = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[: 2 * WIDTH]
            out.setdefault(c, []).append((turn is not None, turn or 0, digest, role, text))
    return {c: [x[3:] for x in sorted(own)] for c, own in out.items()}


def by_hand(convs):
    members, ends, nodes = {}, {}, []
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    words = lambda p: len(p[-1][1].translate(dict.fromkeys([*range(9, 14)], " ")).replace("\x1c", "x").split(" ")) - p[-1][1].translate(dict.fromkeys([*range(9, 14)], " ")).split(" ").count("") if p else 0

    done = {}
    for p in sorted(members, key=len, reverse=True):
        below = [done[k] for k in kids.get(p, [])]
        done[p] = (sum(b[0] for b in below) if below else 1, sum(b[1] for b in below) + (len(members[p]) - 1) * words(p))
    for p, own in members.items():
        ids = ",".join(map(str, sorted(ends.get(p, []))))
        nodes.append((min(own), len(p), min(members[p[:-1]]) if p else None, len(own), len(kids.get(p, [])), *done[p], hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(nodes, key=repr)


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + turns[h:]
    return out


def made_rows(seed, n, alphabet, longest):
    """Conversations over few turns, so that many share prefixes, end inside each other or are equal."""
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.choice([1, 2, 3, rng.randint(0, longest)])):
            rows.append((c, t, rng.choice(["user", "assistant"]) if alphabet > 3 else "user", " ".join(["w"] * rng.randint(0, alphabet))))
        if rng.random() < 0.3:
            rows += [(c, 50 + t, "user", f"only {c} {t}") for t in range(rng.randint(1, 6))]
    return rows


def answer(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_query_is_that_of_the_dictionary_and_the_sql(spark, sf, same_as_sql):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert answer(Q.op12_prefix_trie(spark, sf)) == by_hand(rebuilt(ordered(rows)))
    same_as_sql(Q.op12_prefix_trie(spark, sf), Q.oracle_sql()["op12_prefix_trie"])


@pytest.mark.parametrize("partitions", ["1", "4", "23"])
def test_any_partitions_give_the_same_nodes(spark, partitions):
    """Few rows a task, so that branches, ends and whole paths are shared by many tasks."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for seed, n, alphabet, longest in ((1, 60, 1, 9), (2, 80, 4, 5), (3, 40, 2, 40)):
            rows = made_rows(seed, n, alphabet, longest) + [(1000 + i, t, "user", "a copy") for i in range(50) for t in range(3)]
            df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
            assert answer(prefix_trie(turns_of(df))) == by_hand(ordered(rows))
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_awkward_conversations(spark, tmp_path):
    rows = [(1, None, None, None), (1, None, "user", None), (1, 0, "user", ""), (2, 1, "user", " \n "), (2, 1, "user", " \n "), (2, 1, "user", "é\x0bx"), (None, 0, "user", "lost"), (-5, 2, "us", "er: x"), (-5, 1, "user", ": x")]
    rows += [(7, t, "user", f"turn {t} " + "long " * 20_000 if t == 3 else f"turn {t}") for t in range(400)] + [(8, t, "user", f"turn {t}") for t in range(3)] + [(9, 0, "role", "word " * 300_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    for name in ("turns", "path", "ends", "key", "seam", "words", "digest", "depth"):
        df = df.withColumn(name, F.lit(7))
    assert answer(prefix_trie(turns_of(df))) == by_hand(ordered(rows))
    assert prefix_trie(turns_of(df.limit(0))).count() == 0
    none = turns_of(df).where("conv_id < 3").withColumn("turns", F.slice("turns", 1, 0))
    assert answer(prefix_trie(none)) == by_hand({-5: [], 1: [], 2: []})
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    mine = [r for r in rows if r[0] != -5]  # the remainder of a negative id has the sign of the id here
    spark.read.parquet(f"{tmp_path}/conversations.parquet").where("conv_id <> -5 OR conv_id IS NULL").write.parquet(f"{tmp_path}/b/conversations.parquet")
    assert answer(Q.op12_prefix_trie(spark, f"{tmp_path}/b")) == by_hand(rebuilt(ordered(mine)))


def test_prefixes():
    path = bytes(range(160))
    assert len(keys_of(path)) == 11 and keys_of(path)[:4] == keys_of(path[: 3 * WIDTH]) and common(path, path[: 5 * WIDTH] + b"x" * 32) == 5 and common(b"", path) == 0 and common(path, path) == 10
