"""Readers of JSON-lines logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS = "timestamp double, original_tokens bigint, optimized_tokens bigint, compression_ratio double, token_savings bigint, savings_percent double, compression_level double, latency_ms double, model string, request_id string, total_rule_hits bigint, top_categories array<array<string>>"
REQUIRED = ("timestamp", "original_tokens", "optimized_tokens", "compression_ratio", "token_savings", "savings_percent", "compression_level")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The metrics log: malformed and incomplete lines have ``valid`` false and are still rows, so that all lines can be counted."""
    rows = spark.read.text(path).select(F.from_json("value", METRICS).alias("m")).select("m.*")
    valid = F.lit(True)
    for c in REQUIRED:
        valid = valid & F.col(c).isNotNull()
    filled = rows.withColumn("valid", valid & (F.col("original_tokens") >= 0) & (F.col("optimized_tokens") >= 0)).fillna({"latency_ms": 0.0, "model": "", "request_id": "", "total_rule_hits": 0})
    return filled.withColumn("top_categories", F.transform(F.coalesce("top_categories", F.array()), lambda x: F.struct(x[0].alias("name"), x[1].cast("bigint").alias("hits"))))


def append_metrics(log: DataFrame, path: str) -> None:
    pairs = F.transform("top_categories", lambda x: F.array(x["name"], x["hits"].cast("string")))
    log.withColumn("top_categories", pairs).write.mode("append").json(path)


STABILITY = "request_id string, timestamp double, model string, compression_level double, baseline_response string, compressed_response string, baseline_tokens bigint, compressed_tokens bigint, cosine_similarity double, jaccard_similarity double, length_ratio double, divergence_score double, is_stable boolean, threshold double, action_taken string"


def read_stability(spark: SparkSession, path: str) -> DataFrame:
    """The stability log without malformed lines: those that lack a field."""
    rows = spark.read.text(path).select(F.from_json("value", STABILITY).alias("m")).select("m.*")
    return rows.dropna(subset=[c for c in rows.columns])


def append_stability(log: DataFrame, path: str, longest: int = 200) -> None:
    """Append rows of the stability log, both answers cut to ``longest`` characters."""
    short = {c: F.substring(c, 1, longest) for c in ("baseline_response", "compressed_response")}
    log.withColumns(short).write.mode("append").json(path)
