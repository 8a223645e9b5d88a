"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A term's weight in a text is its count.  Consistent weighted sampling strews points at random over weight and time, anew for each term
and each of ``SAMPLES`` samples; a text's sample is the earliest point that lies below the weight of its term.  Two texts share it
with the probability of their generalised Jaccard similarity.  Counts are whole, so the weights are cut into cells of one: of a cell only
the earliest point can be a sample, a text holds a cell whole or not at all, and only the order of times matters.  So a cell's time is
one draw, a hash of term, cell and sample, alike in law to the first arrival of a Poisson process; the largest hash counts as earliest.
The hash names the sampled term and cell, so a sample is one long and a fingerprint their short hashes.
A text and its edited form share most cells, so both are counted together and a cell draws once for the two.

Texts are dealt once, by ranges of their ids, so that a document meets the next one without a second shuffle.

Defined results: a null or empty text has no terms and one fixed fingerprint, so two such texts are alike (1.0); rows that
repeat an id follow one another by their text; null ids come first, and the last row is followed by the first of these; a single
document is its own next one; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from math import ceil, sqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tersely.llm.common import cut, fresh, partitions, table

#: A likeness is off by sqrt(p (1 - p) / SAMPLES) on average, 0.044 at most.
SAMPLES = 128
#: Samples whose code is compiled together.
GROUP = 16


def keyed(k: int) -> int:
    """A fixed 64-bit key for a sample of a group."""
    return int.from_bytes(hashlib.blake2b(str(k).encode(), digest_size=8).digest(), signed=True)


def counted(rows: DataFrame, keys: list[str], texts: tuple[str, ...]) -> DataFrame:
    """``keys, term, _x, _y``: one row for each distinct term of a row's texts, with its counts in the first and in the second.
    The empty string may be among them, with zeros, so a row without words still has a term."""
    lines = rows.select(*keys, F.posexplode(F.array(*[F.lower(F.coalesce(t, F.lit(""))) for t in texts])).alias("_side", "_line"))
    words = lines.select(*keys, "_side", F.explode(F.split("_line", "[\\x09-\\x0D\\x20]+")).alias("_word"))
    count = lambda side: F.sum(F.when((F.col("_side") == side) & (F.col("_word") != ""), 1).otherwise(0))
    return words.groupBy(*keys, F.xxhash64("_word").alias("term")).agg(count(0).alias("_x"), count(1).alias("_y"))


def cells(terms: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, _cell, _of``: the cells of weight of ``counted`` terms by a hash, and whose they are: both texts' (0), the first's (1), the second's (2)
    or, for a term without weight, nobody's (3)."""
    each = terms.select(*keys, "term", "_x", "_y", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest("_x", "_y", F.lit(1)))).alias("_n"))
    first, second = F.col("_n") <= F.col("_x"), F.col("_n") <= F.col("_y")
    return each.select(*keys, F.xxhash64("term", "_n").alias("_cell"), F.when(first & second, 0).when(first, 1).when(second, 2).otherwise(3).alias("_of"))


def signatures(rows: DataFrame, keys: list[str], text: str = "text", other: str | None = None, samples: int = SAMPLES) -> DataFrame:
    """``keys`` and ``sig``, the short hashes of the samples, and ``sig_other`` those of a second text; the keys must name single rows."""
    known = cells(counted(rows, keys, (text, other) if other else (text,)), keys)
    # samples are worked out in groups: the code of so few is compiled as one, that of all of them isn't
    width, sides = min(GROUP, samples), 2 if other else 1
    (group,) = fresh(known, "_group")
    drawn = known.withColumn(group, F.explode(F.sequence(F.lit(0), F.lit(-(-samples // width) - 1)))).select(*keys, group, "_of", F.xxhash64("_cell", group).alias("_h"))
    best = drawn.groupBy(*keys, group, "_of").agg(*[F.max(F.xxhash64(F.col("_h").bitwiseXOR(F.lit(keyed(k))))).alias(f"_{k}") for k in range(width)])
    held = lambda n: F.col("_of").isin(0, n + 1)
    found = best.groupBy(*keys, group).agg(*[F.max(F.when(held(n), F.col(f"_{k}"))).alias(f"_{n}_{k}") for k in range(width) for n in range(sides)])
    short = lambda c: F.when(F.col(c).isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(c).bitwiseAND(F.lit(0xFFFFFFFF)))
    part = lambda n: F.array(*[short(f"_{n}_{k}") for k in range(width)]).alias(f"p{n}")
    parts = F.sort_array(F.collect_list(F.struct(F.col(group), *[part(n) for n in range(sides)])))
    joined = found.groupBy(*keys).agg(parts.alias("_parts"))
    side = lambda n: F.slice(F.flatten(F.transform("_parts", lambda x: x[f"p{n}"])), 1, samples)
    return joined.select(*keys, side(0).alias("sig"), *[side(1).alias("sig_other")] * bool(other))


def likeness(a: str, b: str, samples: int = SAMPLES) -> Column:
    same = F.zip_with(a, b, lambda x, y: (x == y).cast("int"))
    return F.aggregate(same, F.lit(0), lambda n, x: n + x) / F.lit(float(samples))


def printed(sig: str) -> Column:
    return F.lower(F.array_join(F.transform(sig, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def by_ranges(ids: DataFrame, column: str, ranges: int) -> Column:
    """The number of a row's range of ``column``; the bounds are quantiles, one a range."""
    side = max(1, ceil(sqrt(ranges)))
    shares = [k / side**2 for k in range(1, side**2)]
    bounds = ids.select(F.percentile_approx(column, shares, 10 * side * side).alias("b")).first()["b"] if shares else []
    if not bounds:
        return F.lit(0)
    fine = [bounds[k : k + side] for k in range(0, len(bounds), side)]
    under = lambda xs: F.size(F.filter(xs, lambda x: x < F.col(column)))
    numbers = lambda xs: F.array(*[F.lit(int(x)) for x in xs])
    coarse = under(numbers(part[-1] for part in fine))
    return F.coalesce(coarse * side + under(F.get(F.array(*[numbers(part) for part in fine]), F.least(coarse, F.lit(len(fine) - 1)))), F.lit(0))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, next_text, range, n``: each row with the text of the next one by id, the last with the first's."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    ranges = 4 * partitions(docs)  # so that tasks get about as many each
    number = by_ranges(rows.select("doc_id"), "doc_id", ranges)
    dealt = rows.withColumn("range", number)
    order = Window.partitionBy("range").orderBy("doc_id", "text")
    dealt = dealt.withColumn("n", F.row_number().over(order)).withColumn("own_next", F.lead("text").over(order))
    # the first row of each range, for the last row of the one before: as many rows as ranges
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("first")
    firsts = rows.select("doc_id", number.alias("range")).groupBy("range").agg(first)
    whole = Window.orderBy("range")
    firsts = firsts.select(F.col("first.doc_id").alias("first_id"), F.coalesce(F.lag("range").over(whole), F.max("range").over(Window.partitionBy())).alias("range"))
    heads = cut(rows.join(F.broadcast(firsts), F.col("doc_id").eqNullSafe(F.col("first_id"))).groupBy("range").agg(F.min("text").alias("head")))
    found = dealt.join(heads, "range", "left")
    return found.select("doc_id", "text", F.coalesce("own_next", "head", "text").alias("next_text"), "range", "n")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """``doc_id, fingerprint`` for every row."""
    rows = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"), F.monotonically_increasing_id().alias("n")))
    return rows.select("doc_id", "n").join(signatures(rows, ["n"], "text", samples=samples), "n").select("doc_id", printed("sig").alias("fingerprint"))


def op6_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(table(spark, sf_dir, "documents"))
    size = F.char_length("text")
    edited = rows.select("doc_id", "range", "n", size.cast("long").alias("n_chars"), "text", F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 4) as int))"), F.expr("substring(next_text, 1, cast(floor(char_length(text) / 4) as int))")).alias("edited"))
    keys = ["range", "n", "doc_id", "n_chars", "e"]
    pair = signatures(edited.withColumn("e", F.unhex(F.sha2("edited", 256))), keys, "text", "edited").withColumnRenamed("sig_other", "edited_sig")
    pair = cut(pair.withColumn("e", F.lower(F.hex("e"))))
    order = Window.partitionBy("range").orderBy("n")
    heads = pair.where("n = 1").select("range", "sig")
    whole = Window.orderBy("range")
    heads = heads.select(F.coalesce(F.lag("range").over(whole), F.max("range").over(Window.partitionBy())).alias("range"), F.col("sig").alias("head"))
    found = pair.withColumn("own_next", F.lead("sig").over(order)).join(heads, "range", "left").withColumn("next_sig", F.coalesce("own_next", "head"))
    return found.select("doc_id", "n_chars", F.col("e").alias("edited_sha256"), printed("sig").alias("fingerprint"), printed("edited_sig").alias("edited_fingerprint"), likeness("sig", "edited_sig").alias("near_edited"), likeness("sig", "next_sig").alias("near_next"))
