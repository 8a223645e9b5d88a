"""Analytics over the request log: one row a request."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def savings(df: DataFrame, before: str = "original_tokens", after: str = "optimized_tokens") -> DataFrame:
    """Adds tokens saved (never below 0), their percentage, and the ratio kept."""
    saved = F.greatest(F.lit(0), F.col(before) - F.col(after))
    return df.withColumns({"token_savings": saved, "savings_percent": F.when(F.col(before) > 0, saved / F.col(before) * 100).otherwise(0.0), "compression_ratio": F.col(after) / F.greatest(F.col(before), F.lit(1))})


def last_rows(log: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The last ``n`` rows by arrival: a top-k, not a sort of the whole log."""
    return log.orderBy(*[F.desc(c) for c in order]).limit(n)


def summary(log: DataFrame, n: int, order: list[str]) -> DataFrame:
    recent = last_rows(log, n, order).agg(
        F.avg("savings_percent").alias("avg_savings_percent"), F.when(F.sum("original_tokens") == 0, 1.0).otherwise(F.avg("compression_ratio")).alias("avg_compression_ratio"), F.max("savings_percent").alias("max_savings_percent"),
        F.min("savings_percent").alias("min_savings_percent"), F.sum("token_savings").alias("total_tokens_saved"), F.sum("original_tokens").alias("total_tokens_processed"),
        F.coalesce(F.avg(F.when(F.col("latency_ms") > 0, F.col("latency_ms"))), F.lit(0.0)).alias("avg_latency_ms"), F.count("*").alias("window_size"),
    )
    return log.agg(F.count("*").alias("total_requests")).crossJoin(recent)  # one row each


def by(log: DataFrame, *keys: str) -> DataFrame:
    """Totals and savings by the keys."""
    sums = log.groupBy(*keys).agg(F.count("*").alias("requests"), F.sum("original_tokens").alias("original_tokens"), F.sum("optimized_tokens").alias("optimized_tokens"))
    return sums.withColumn("savings_percent", F.when(F.col("original_tokens") > 0, F.round(F.greatest(F.lit(0), F.col("original_tokens") - F.col("optimized_tokens")) / F.col("original_tokens") * 100, 4)).otherwise(0.0))


def ranked_with_total(log: DataFrame, key: str) -> DataFrame:
    """Savings by key with their rank, and a grand total row (key null)."""
    both = log.rollup(key).agg(F.sum("original_tokens").alias("original_tokens"), F.sum("optimized_tokens").alias("optimized_tokens"), F.grouping(key).alias("is_total"))
    percent = both.withColumn("savings_percent", F.round((F.col("original_tokens") - F.col("optimized_tokens")) / F.greatest(F.col("original_tokens"), F.lit(1)) * 100, 4))
    # as many rows as keys
    return percent.withColumn("rank", F.when(F.col("is_total") == 0, F.rank().over(Window.partitionBy("is_total").orderBy(F.desc("savings_percent")))))


def bands(log: DataFrame) -> DataFrame:
    """Requests by model short name and savings band."""
    x = F.col("savings_percent")
    band = F.when(x > 25, ">25").when(x > 15, ">15").when(x > 5, ">5").when(x > 0, ">0").otherwise("none")
    return log.groupBy(F.element_at(F.split("model", "/"), -1).alias("model_name"), band.alias("band")).agg(F.count("*").alias("requests"))


def cost(log: DataFrame, prices: DataFrame, default: float = 3.0) -> DataFrame:
    """Money saved by model; ``prices(model, per_million)`` is the price list, small by nature."""
    saved = log.groupBy("model").agg(F.sum("token_savings").alias("token_savings"))
    return saved.join(F.broadcast(prices), "model", "left").select("model", "token_savings", F.round(F.col("token_savings") * F.coalesce("per_million", F.lit(default)) / 1e6, 6).alias("saved_usd"))


def reuse(texts: DataFrame, text: str, keys: list[str], longest: int = 65536, within: tuple[str, ...] = ()) -> DataFrame:
    """Lookups, distinct keys and reuse rate of texts that a cache would hold (not empty, at most ``longest`` bytes).

    A text counts as another one for each value of ``within`` (mode, profile, level) that it comes with.
    """
    held = texts.where((F.octet_length(text) > 0) & (F.octet_length(text) <= longest))
    found = held.groupBy(*keys).agg(F.count("*").alias("lookups"), F.count_distinct(F.sha2(text, 256), *within).alias("distinct_texts"))
    return found.withColumn("reuse_rate", F.round(1 - F.col("distinct_texts") / F.col("lookups"), 6))


def rule_hits(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """Hits of every rule, those that never fired with 0; ``rules(rule_id, category)`` is a fixed list."""
    counts = hits.groupBy("rule_id").agg(F.sum("hits").alias("hits"))
    return rules.join(counts, "rule_id", "left").select("rule_id", "category", F.coalesce("hits", F.lit(0)).alias("hits"))


def snapshot(log: DataFrame) -> DataFrame:
    """Totals since the log began: requests, tokens before, after and saved, savings, tokens saved in answers and rule hits.

    ``log``: original_tokens, optimized_tokens, response_tokens_saved, rule_hits (array of category and hits).
    """
    hits = F.aggregate("rule_hits", F.lit(0).cast("long"), lambda n, x: n + x["hits"])
    out = log.agg(F.count("*").alias("requests"), F.coalesce(F.sum(hits), F.lit(0)).alias("rule_hits"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("original_tokens", "optimized_tokens", "response_tokens_saved")])
    saved = F.greatest(F.lit(0).cast("long"), F.col("original_tokens") - F.col("optimized_tokens"))
    return out.withColumns({"token_savings": saved, "savings_percent": F.when(F.col("original_tokens") > 0, F.round(saved / F.col("original_tokens") * 100, 4)).otherwise(0.0)})


def category_hits(log: DataFrame, *keys: str) -> DataFrame:
    """Hits of each category by the keys, with the place of the category in the declared order (``nth``)."""
    each = log.select(*keys, F.posexplode("rule_hits").alias("nth", "x"))
    return each.groupBy(*keys, "nth", F.col("x.category").alias("category")).agg(F.sum("x.hits").cast("long").alias("hits"))


def top_categories(hits: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` categories with the most hits, none without; ties keep the declared order."""
    return hits.where("hits > 0").orderBy(F.desc("hits"), "nth").limit(n)
