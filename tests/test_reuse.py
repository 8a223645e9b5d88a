"""Reuse by time, sketches and messages that say the same, against plain Python."""

import itertools
import random
import re

from pyspark.sql import functions as F

from tersely.operators import conversation, logs, reuse


def replay(uses, ttl):
    state, out = {}, []
    for k, t, ms, i in sorted((u for u in uses if u[0] is not None and u[1] is not None), key=lambda u: (u[0], u[1], u[2] or 0.0, u[3])):
        hit = k in state and t - state[k][0] < ttl
        if not hit:
            state[k] = (t, ms or 0.0)
        out.append((i, hit, state[k][1] if hit else 0.0))
    return sorted(out)


def test_reuse_equals_a_replay(spark):
    rng = random.Random(9)
    uses = [(rng.choice("aaaaab"), float(rng.randrange(40_000)), float(n % 7 + n / 1000), n) for n in range(700)]  # long runs of busy stretches
    uses += [("c", 10.0 * n, float(n), 1000 + n) for n in range(300)] + [("d", 400.0 * n, 1.0, 2000 + n) for n in range(40)] + [(None, 1.0, 1.0, 3000), ("a", None, 1.0, 3001), ("e", -5.5, None, 3002), ("e", 294.4, 2.0, 3003), ("e", 294.5, 2.5, 3004)]
    df = spark.createDataFrame([(*u, "x", 1) for u in uses], "key string, ts double, latency_ms double, id long, _k string, _n int").repartition(5)
    got = reuse.reuse_report(df)
    assert got.columns == [*df.columns, "hit", "saved_ms"]
    assert sorted((r.id, r.hit, r.saved_ms) for r in got.collect()) == replay(uses, 300.0)
    assert reuse.reuse_report(df.limit(0)).count() == 0


def test_sketches_are_close_and_add_up(spark):
    df = spark.range(60_000).select(F.concat(F.lit("t"), (F.col("id") % 23_000).cast("string")).alias("text"), (F.col("id") % 10).alias("day"), F.lit("k").alias("k"), (F.col("id") % 2).alias("mode"))
    stored = reuse.reuse_sketches(df, "text", ["k"], "day", within=("mode",)).cache()
    assert stored.count() == 10
    for first, last in ((0, 9), (2, 5), (7, 7)):
        exact = logs.reuse(df.where(f"day between {first} and {last}"), "text", ["k"], within=("mode",)).first()
        got = reuse.reuse_over(stored, ["k"], F.lit(first), F.lit(last)).first()
        assert got.lookups == exact.lookups and abs(got.distinct_texts - exact.distinct_texts) <= 0.02 * exact.distinct_texts and abs(got.reuse_rate - exact.reuse_rate) < 0.02


def test_redundant_pairs_equal_all_pairs(spark):
    rng = random.Random(4)
    rows = []
    for conv in range(12):
        base = [rng.sample("abcdefghijklmnopqrstuvwxyz", rng.randrange(1, 12)) for _ in range(3)]
        for turn in range(15):
            said = [w for w in rng.choice(base) if rng.random() < 0.9] + rng.sample("ABCxyz", rng.randrange(3))
            rows.append((conv, turn, " ".join(said)))
    rows += [(50, 0, None), (50, 1, ""), (50, 2, "."), (51, 0, "same words here"), (51, 1, "Same, words: HERE here"), (51, 1, "same words here")]
    df = spark.createDataFrame([(*r, 0, "") for r in rows], "conv_id long, turn long, text string, id int, k string")
    for most in (0.3, 0.7, 0.9):
        want = []
        for (c, t, x), (d, u, y) in itertools.combinations(rows, 2):
            a, b = (set(re.findall(r"\w+", (s or "").lower())) for s in (x, y))
            if c == d and a and b and len(a & b) / len(a | b) > most:
                want.append((c, min(t, u), max(t, u), round(len(a & b) / len(a | b), 6)))
        got = sorted(tuple(r) for r in conversation.redundant_pairs(df, most).collect())
        assert got == sorted(want) and want
