"""What a store of answers with a time to live would have saved, and how often texts come again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tersely.functions.lineage import written
from tersely.functions.names import fresh

#: Sketches of distinct texts have 2 ** 14 registers: their standard error is 0.8 %.
REGISTERS = 14


def reuse_report(uses: DataFrame, key: str = "key", time: str = "ts", latency: str = "latency_ms", ttl: float = 300.0) -> DataFrame:
    """``uses`` with ``hit`` and ``saved_ms``: a use is a hit within ``ttl`` seconds of the miss that made its entry, and saves that
    miss's latency.  Ties in time go by latency.  Uses without a key or a time are left out.

    Time is cut into stretches of ``ttl``, each of which has one miss of a key at most, and all work is by key and stretch, so
    one key that holds most uses is spread over its time.  Each use points to the use that would be the next miss if it were
    one: the first one ``ttl`` later or after.  A stretch after an empty one begins with a miss; from those the misses are found by
    doubling the pointers, in as many rounds as the longest run of busy stretches has binary digits.
    """
    k, t, c, w, n = fresh(uses, "_k", "_t", "_c", "_w", "_n")
    life = int(round(ttl * 1_000_000))
    rows = uses.withColumns({k: F.col(key).cast("string"), t: F.round(F.col(time).cast("double") * 1_000_000).cast("long"), c: F.coalesce(F.col(latency).cast("double"), F.lit(0.0))})
    rows = rows.where(F.col(k).isNotNull() & F.col(t).isNotNull()).withColumn(w, F.floor(F.col(t) / life))
    rows = written(rows.withColumn(n, F.row_number().over(Window.partitionBy(k, w).orderBy(t, c, F.xxhash64(*[F.col(x).cast("string") for x in uses.columns])))))
    own = rows.select(F.col(k).alias("k"), F.col(w).alias("w"), F.col(n).cast("long").alias("n"), F.col(t).alias("t"), F.col(c).alias("c"))
    # one row a busy stretch of a key
    by_key = Window.partitionBy("k").orderBy("w")
    stretches = own.groupBy("k", "w").agg(F.count("*").alias("size")).withColumns({"before": F.lag("w").over(by_key), "next": F.lead("w").over(by_key)})
    heads = stretches.where(F.col("before").isNull() | (F.col("before") < F.col("w") - 1)).select("k", "w", F.lit(1).cast("long").alias("n"))
    # a use asks, in the stretch after its own, for the first use a life later
    asked = own.select("k", (F.col("w") + 1).alias("w"), (F.col("t") + life).alias("t"), F.lit(0).alias("kind"), F.col("n").alias("source"), F.lit(None).cast("long").alias("target"))
    held = own.select("k", "w", "t", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("source"), F.col("n").alias("target"))
    later = Window.partitionBy("k", "w").orderBy(F.desc("t"), F.desc("kind"), F.desc("target"))
    pointed = asked.unionByName(held).withColumn("found", F.last("target", True).over(later)).where("kind = 0")
    # where that stretch has none, the next busy one begins with it; after an empty stretch that is a miss anyway
    pointers = pointed.join(stretches.select("k", "w", "next"), ["k", "w"]).select("k", (F.col("w") - 1).alias("w"), F.col("source").alias("n"), F.when(F.col("found").isNotNull(), F.col("w")).otherwise(F.col("next")).alias("to_w"), F.coalesce("found", F.lit(1).cast("long")).alias("to_n")).where("to_w is not null")
    targets = pointers.select("k", F.col("to_w").alias("w"), F.col("to_n").alias("n")).unionByName(heads).distinct()
    jumps = written(pointers.join(targets, ["k", "w", "n"], "left_semi"))
    misses = written(heads)
    while True:
        found = misses.join(jumps, ["k", "w", "n"]).select("k", F.col("to_w").alias("w"), F.col("to_n").alias("n"))
        new = written(found.distinct().join(misses, ["k", "w", "n"], "left_anti"))
        if new.isEmpty():
            break
        misses = written(misses.unionByName(new))
        twice = jumps.alias("a").join(jumps.alias("b"), (F.col("a.k") == F.col("b.k")) & (F.col("a.to_w") == F.col("b.w")) & (F.col("a.to_n") == F.col("b.n")))
        jumps = written(twice.select("a.k", "a.w", "a.n", "b.to_w", "b.to_n"))
    made = own.join(misses, ["k", "w", "n"]).select("k", "w", F.col("n").alias("miss"), F.col("c").alias("cost"))
    entry = lambda shift, name: made.select(F.col("k").alias(k), (F.col("w") + shift).alias(w), F.col("miss").alias(f"{name}n"), F.col("cost").alias(f"{name}c"))
    a, b = fresh(rows, "_a", "_b")
    out = rows.join(entry(0, a), [k, w], "left").join(entry(1, b), [k, w], "left")
    here = F.coalesce(F.col(n) >= F.col(f"{a}n"), F.lit(False))
    hit = ~F.coalesce(F.col(n) == F.col(f"{a}n"), F.lit(False))
    saved = F.when(~hit, 0.0).when(here, F.col(f"{a}c")).otherwise(F.col(f"{b}c"))
    return out.select(*[F.col(x) for x in uses.columns], hit.alias("hit"), saved.alias("saved_ms"))


def _held(texts: DataFrame, text: str, longest: int) -> DataFrame:
    return texts.where((F.octet_length(text) > 0) & (F.octet_length(text) <= longest))


def reuse_sketches(texts: DataFrame, text: str, keys: list[str], day: str | Column, longest: int = 65536, within: tuple[str, ...] = ()) -> DataFrame:
    """``keys, day, lookups, sketch``: for each day the uses of texts that a cache would hold, and a sketch of the different ones.

    Sketches are a few kB whatever they count, so they are stored once and any stretch of days is put together from them.
    """
    what = F.sha2(F.concat_ws("\u001f", F.col(text), *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in within]), 256)
    on = F.col(day) if isinstance(day, str) else day
    return _held(texts, text, longest).groupBy(*keys, on.alias("day")).agg(F.count("*").alias("lookups"), F.hll_sketch_agg(what, F.lit(REGISTERS)).alias("sketch"))


def reuse_over(sketches: DataFrame, keys: list[str], first: Column | None = None, last: Column | None = None) -> DataFrame:
    """``keys, lookups, distinct_texts, reuse_rate`` of the days from ``first`` to ``last``, from ``reuse_sketches`` alone."""
    for bound, test in ((first, lambda d, b: d >= b), (last, lambda d, b: d <= b)):
        sketches = sketches if bound is None else sketches.where(test(F.col("day"), bound))
    out = sketches.groupBy(*keys).agg(F.sum("lookups").alias("lookups"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_texts"))
    return out.withColumn("reuse_rate", F.round(F.greatest(F.lit(0.0), 1 - F.col("distinct_texts") / F.col("lookups")), 6))
