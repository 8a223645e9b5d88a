"""How alike answers are before and after compression, and the level that follows from it."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tersely.functions.names import fresh, let
from tersely.functions.text import length_ratio, paired_counts, words


def cosine(counts: Column) -> Column:
    """Cosine of two texts' word counts (``paired_counts``); 0 if either has no words."""
    total = lambda f: F.aggregate(counts, F.lit(0).cast("long"), lambda n, c: n + f(c))
    xx, yy = total(lambda c: c["x"] * c["x"]), total(lambda c: c["y"] * c["y"])
    return F.when((xx > 0) & (yy > 0), total(lambda c: c["x"] * c["y"]) / (F.sqrt(xx) * F.sqrt(yy))).otherwise(0.0)


def jaccard(counts: Column) -> Column:
    """Shared share of two texts' words; 1 if both have none."""
    return F.when(F.size(counts) == 0, 1.0).otherwise(F.size(F.filter(counts, lambda c: (c["x"] > 0) & (c["y"] > 0))) / F.size(counts))


def score(pairs: DataFrame, threshold: float = 0.85, a: str = "baseline", b: str = "compressed") -> DataFrame:
    """``pairs`` with their similarities, divergence and whether they are stable; a null text is empty.  No shuffle."""
    x, y = F.coalesce(F.col(a), F.lit("")), F.coalesce(F.col(b), F.lit(""))
    both = let(paired_counts(words(x), words(y)), lambda c: F.struct(cosine(c).alias("cosine"), jaccard(c).alias("jaccard")))
    (name,) = fresh(pairs, "_both")
    out = pairs.withColumn(name, both).withColumns({"cosine_similarity": F.col(name)["cosine"], "jaccard_similarity": F.col(name)["jaccard"], "length_ratio": length_ratio(x, y)}).drop(name)
    total = 0.5 * F.col("cosine_similarity") + 0.3 * F.col("jaccard_similarity") + 0.2 * F.col("length_ratio")
    return out.withColumns({"composite": total, "divergence_score": F.round(1 - total, 4), "is_stable": total >= threshold})


def adjusted_levels(rows: DataFrame, step: float = 0.1, least: float = 0.2) -> DataFrame:
    """The level each unstable row leaves its model at: a step down from the first unstable row's level, once for each.

    A model stands at ``least`` after a few unstable rows, so only so many of its first ones are found (a limited rank, not a
    sort of its log), and every row counts those up to it.
    """
    few, rank = ceil((1 - least) / step) + 1, Window.partitionBy("model").orderBy("ts", "request_id")
    bad = rows.where(~F.col("is_stable"))
    row, firsts = fresh(bad, "_row", "_firsts")
    first = bad.select("model", "ts", "request_id", "level").withColumn(row, F.row_number().over(rank)).where(F.col(row) <= few)
    held = first.groupBy("model").agg(F.sort_array(F.collect_list(F.struct("ts", "request_id", "level"))).alias(firsts))
    steps = F.size(F.filter(firsts, lambda x: F.struct(x["ts"], x["request_id"]) <= F.struct("ts", "request_id")))
    level = F.round(F.greatest(F.get(firsts, F.lit(0))["level"] - step * steps, F.lit(least)), 2)
    return bad.join(held, "model").withColumn("adjusted_level", level).drop(firsts)


def levels_in_force(requests: DataFrame, adjusted: DataFrame) -> DataFrame:
    """Each request's level, or the model's latest adjusted one before it if lower.

    Adjusted levels of a model never rise and are few, so the first row of each is all that is needed: an as-of join with a
    handful of rows a model.
    """
    first = adjusted.groupBy("model", "adjusted_level").agg(F.min(F.struct("ts", "request_id")).alias("since"))
    held = first.groupBy("model").agg(F.collect_list(F.struct("since", "adjusted_level")).alias("levels"))
    before = F.filter("levels", lambda x: F.struct(x["since"]["ts"], x["since"]["request_id"]) < F.struct("ts", "request_id"))
    seen = F.array_min(F.transform(before, lambda x: x["adjusted_level"]))
    return requests.join(held, "model", "left").select("request_id", "model", "ts", "level", F.least("level", seen).alias("level_in_force"))


def summary(rows: DataFrame) -> DataFrame:
    n, good = F.count("*"), F.sum(F.col("is_stable").cast("int"))
    return rows.agg(n.alias("n"), good.alias("stable"), (n - good).alias("divergent"), F.round(good / n * 100, 1).alias("stability_rate"), F.round(F.sum(F.coalesce("cosine_similarity", F.lit(0.0))) / n, 4).alias("avg_cosine_similarity"), F.round(F.sum(F.coalesce("divergence_score", F.lit(0.0))) / n, 4).alias("avg_divergence_score"))
