import hashlib
import random
import zlib
from collections import defaultdict

import duckdb

from tersely.llm.turntrie import op13_turn_trie, scanned, trie, trie_sql

SCHEMA = "conv_id long, turn long, role string, text string, depth int, tag int"


def brute(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        path = turns.get(base, [])[:h] + turns[c][h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].add(c)
        ends[tuple(path)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        saved[node] = sum(saved[k] for k in children[node]) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
    for node, own in members.items():
        digest = hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest()
        yield (min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(children[node]), leaves[node], saved[node], digest)


def conversations(rng):
    words = ["a", "b", "É́", "", None, "long " * 30]
    rows = []
    for c in [*range(-130, 130, 3), *range(400, 620), 1000, 1001, 1002]:
        for k in range(rng.choice([0, 1, 2, 4, 7])):
            rows.append((c, rng.choice([k, k, k, 0, None, -k]), rng.choice(["user", "assistant", None]), rng.choice(words) if rng.random() < 0.7 else f"{c % 5} {k}"))
    for c in range(700, 760):  # copies, and prefixes of one another
        rows += [(c, k, ("user", "assistant")[k % 2], f"t{k}") for k in range(c % 7 + 3)]
    rows += [(c, k, "user", f"n{k}") for c in (2000, 2001, 2100) for k in range(900)] + [(None, 0, "user", "x"), (None, None, None, None)]
    return rows


def test_trie_matches_brute_force_and_sql(spark, tmp_path):
    rows = conversations(random.Random(5))
    df = spark.createDataFrame([(*r, 7, 8) for r in rows], SCHEMA).repartition(3)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = op13_turn_trie(spark, str(tmp_path))
    assert [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"]
    mine = [tuple(r) for r in got.collect()]
    assert len(mine) == len(set(mine)) and set(mine) == set(brute(rows))
    short = [r for r in rows if r[0] is None or r[0] < 2000]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet' WHERE conv_id IS NULL OR conv_id < 2000")
    assert set(con.execute(trie_sql()).fetchall()) == set(brute(short))


def test_collisions_are_split(spark):
    rng = random.Random(6)
    rows = [(c, k, rng.choice(["user", "assistant"]), f"w{rng.randrange(9)}") for c in [*range(30), *range(100, 110)] for k in range(rng.randrange(7))]
    df = spark.createDataFrame([(*r, 7, 8) for r in rows], SCHEMA)
    assert {tuple(r) for r in trie(df, modulus=2).collect()} == set(brute(rows))


def test_a_long_conversation_over_many_tasks(spark):
    df = spark.createDataFrame([(c, k, "user", f"n{k}", 0, 0) for c in (5, 6, 7) for k in range(400)] + [(8, 0, "user", "n0", 0, 0)], SCHEMA)
    rows = scanned(df).select("c", "pos", "text", "s0", "s3").collect()
    assert sorted((r.c, r.pos, r.text) for r in rows) == sorted([(c, k + 1, f"n{k}") for c in (5, 6, 7) for k in range(400)] + [(8, 1, "n0")])
    sums = defaultdict(set)
    for r in rows:
        sums[r.pos].add((r.s0, r.s3))
    assert all(len(v) == 1 for v in sums.values()) and len({min(v) for v in sums.values()}) == 400


def test_empty_and_turnless(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert trie(df).count() == 0
    # no conversation 100 to take turns from, and fewer own ones than are left out
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    one = spark.createDataFrame([(c, 0, "user", "x", 0, 0)], SCHEMA)
    assert [tuple(r) for r in trie(one).collect()] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
