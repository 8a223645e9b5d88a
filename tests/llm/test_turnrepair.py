import hashlib
import heapq
import random
import zlib
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from tersely.llm.turnrepair import damaged, op12_turn_repair, repair_sql, repaired

SCHEMA = "conv_id long, turn long, role string, text string, n int, kept int"


def damage(rows):
    out, ids = defaultdict(list), set()
    for conv, turn, role, text in rows:
        ids.add(conv)
        role, text = (" " if x is None else x for x in (role, text))
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        code = zlib.crc32(name.encode()) % 20
        text = "" if code == 1 else "".join(c for c in text if c not in ".!?") if code == 2 else text
        out[conv] += [(turn, "user" if code == 4 else role, text)] * {0: 0, 3: 2}.get(code, 1)
    return ids, out


def cheapest(rows):
    """Best first over (cost, audit): states are rows read and the last role left."""
    allowed = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, lines = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, audit, list(lines)
        for r, name in (("u", "user"), ("a", "assistant")):
            if r in allowed[last]:
                heapq.heappush(heap, (cost + 3, audit + "I", i, r, (*lines, f"{name}:")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last, lines))
            if fault not in ("blank", "duplicate"):
                late = 3 * (fault == "truncated")
                if role[:1] and role[:1] in allowed[last]:
                    heapq.heappush(heap, (cost + late, audit + "K", i + 1, role[:1], (*lines, f"{role}:{text}")))
                for r, name in (("u", "user"), ("a", "assistant")):
                    if r in allowed[last]:
                        heapq.heappush(heap, (cost + late + 3, audit + "R", i + 1, r, (*lines, f"{name}:{text}")))


def brute(rows):
    ids, convs = damage(rows)
    for conv in ids:
        turns = sorted(convs[conv], key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        seen, marked = set(), []
        for _, role, text in turns:
            bare = text.rstrip(" \t\n\x0b\f\r")
            marked.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""))
            seen.add((role, text))
        known = [t[0] for t in turns if t[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, lines = cheapest(marked)
        faults = [sum(m[2] == k for m in marked) for k in ("blank", "duplicate", "truncated")]
        yield (conv, gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_repairs_match_best_first_search(spark, tmp_path):
    rng = random.Random(3)
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "u", "Ärzte"], ["Yes.", "No!", "why?", "cut off", " \n", "", None, "Yes. \n", "É. ", "a.b"]
    rows = []
    for conv in [*range(-20, 180), None]:
        for k in range(rng.choice([0, 1, 2, 3, 5, 9])):
            rows.append((conv, rng.choice([k, k, k, 2 * k, 0, -k, None]), rng.choice(roles[: rng.choice([3, 5, 10])]), rng.choice(texts) if rng.random() < 0.6 else f"text {k}."))
    # several ranges of turns, in order and not
    rows += [(500, k, ("user", "assistant")[k % 2], f"t{k}.") for k in range(1200)] + [(501, 37 * k - 4000, rng.choice(roles), rng.choice(texts)) for k in range(300)] + [(502, 0, "user", "x" * 200_000)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA).repartition(5)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = op12_turn_repair(spark, str(tmp_path))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    mine = {tuple(r) for r in got.collect()}
    assert mine == set(brute(rows))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet' WHERE conv_id IS NULL OR conv_id < 500")
    assert set(con.execute(repair_sql()).fetchall()) == {r for r in mine if r[0] is None or r[0] < 500}


def test_repaired_turns_and_empty_tables(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "user", "More?"), (2, 0, "assistant", "Hello."), (3, 0, "system", "Be brief.")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    got = {r.conv_id: (r.cost, r.audit, [tuple(t) for t in r.repaired]) for r in repaired(df).collect()}
    # rewriting the second question costs as much as an answer put before the third would
    assert got[1] == (7, "KDR", [("user", "Hi."), ("assistant", "More?")])
    assert got[2] == (3, "IK", [("user", ""), ("assistant", "Hello.")])
    assert got[3] == (4, "D", [])
    assert repaired(df.limit(0)).count() == 0 and damaged(df.limit(0)).count() == 0
    gone = repaired(df.where("conv_id = 2"), F.lit(False)).collect()
    assert [(r.conv_id, r.gaps, r.cost, r.audit, r.repaired) for r in gone] == [(2, 0, 0, "", [])]
