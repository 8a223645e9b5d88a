"""Streams over files that come one by one, with exact results."""

import random
import time

from pyspark.sql import functions as F

from tersely.functions.program import DECLARED, request_program, run, tallied
from tersely.functions.routing import profile
from tersely.jobs.compress import compress_requests
from tersely.operators.reuse import reuse_report
from tersely.streaming.metrics import adjusted_levels, category_totals, compressed, keep_latest, latest, reuse, windowed


def feed(spark, folder, schema, *batches):
    for rows in batches:
        spark.createDataFrame(rows, schema.replace("timestamp", "string")).select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in schema.split(", ")]).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # files are taken in order of their time, which has seconds


def drain(df, folder, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", folder).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "ts timestamp, original_tokens long, optimized_tokens long"
    feed(spark, str(tmp_path / "in"), schema, [("2024-01-01 00:00:01", 10, 8)], [("2024-01-01 01:00:00", 5, 5)], [("2024-01-01 01:30:00", 7, 5)], [("2024-01-01 00:00:02", 90, 9), ("2024-01-01 02:30:00", 1, 1)])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(str(r.start), r.original_tokens) for r in drain(windowed(stream), str(tmp_path / "c"), "late")}
    assert got == {("2024-01-01 00:00:00", 10), ("2024-01-01 01:00:00", 5), ("2024-01-01 01:30:00", 7)}


def test_levels_are_kept_by_model(spark, tmp_path):
    schema = "model string, request_id long, ts double, level double, is_stable boolean"
    feed(spark, str(tmp_path / "in"), schema, [("m", 2, 2.0, 0.5, False), ("m", 1, 1.0, 0.9, False), ("n", 3, 1.0, 0.3, True)], [("m", 4, 3.0, 0.1, False), ("n", 5, 4.0, 0.25, False), ("n", 6, 5.0, 0.9, False)])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = {r.request_id: r.adjusted_level for r in drain(adjusted_levels(stream), str(tmp_path / "c"), "levels")}
    assert got == {1: 0.8, 2: 0.7, 4: 0.6, 5: 0.2, 6: 0.2}


def test_reuse_is_that_of_the_batch(spark, tmp_path):
    """Rows out of order within and over batches, batches over an hour apart: hits are judged by event time alone."""
    schema, rng = "key string, ts timestamp, latency_ms double", random.Random(5)
    at = lambda s: f"2024-01-01 {s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}"
    uses = [(rng.choice("kkkj"), at(rng.randrange(4000)), float(n)) for n in range(120)] + [("k", at(18000 + s), 500.0 + s) for s in (0, 299, 300, 599, 601)]
    early, late = uses[:120], uses[120:]
    rng.shuffle(early)
    feed(spark, str(tmp_path / "in"), schema, early[:60], early[60:], late[::-1], [("flush", "2024-01-02 12:00:00", 0.0)], [("flush", "2024-01-02 12:00:01", 0.0)])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = sorted((r.key, r.ts, r.hit, r.saved_ms) for r in drain(reuse(stream, late="70 minutes"), str(tmp_path / "c"), "reuse") if r.key != "flush")
    batch = reuse_report(spark.createDataFrame(uses, schema.replace("timestamp", "string")).withColumn("ts", F.col("ts").cast("timestamp")))
    assert got == sorted((r.key, r.ts.timestamp(), r.hit, r.saved_ms) for r in batch.withColumn("ts", F.col("ts")).collect()) and len(got) == 125


def test_latest_counters_of_categories(spark, tmp_path):
    schema = "id long, text string, level double, profile string"
    texts = [[(1, "Please note that it is very useful.", 1.0, "aggressive"), (2, "kindly go", 0.0, "balanced")], [(3, "In order to go, kindly.", 0.3, "balanced")], [(4, "very, very far", 1.0, "aggressive"), (5, "kindly", 0.5, "x")]]
    feed(spark, str(tmp_path / "in"), schema, *texts)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    hits = lambda df: df.select(tallied(run(request_program(), F.col("text"), F.col("level"), F.col("profile"))["hits"], DECLARED).alias("rule_hits"))
    q = keep_latest(category_totals(hits(stream)), str(tmp_path / "out"), str(tmp_path / "c"))
    q.awaitTermination(180)
    assert len([p for p in (tmp_path / "out").iterdir() if p.name.startswith("batch=")]) == 3
    got = {r.category: (r.hits, r.requests) for r in latest(spark, str(tmp_path / "out"), "category").collect()}
    every = hits(spark.createDataFrame(sum(texts, []), schema)).select(F.explode("rule_hits").alias("x")).where("x.hits > 0").groupBy("x.category").agg(F.sum("x.hits"), F.count("*"))
    assert got == {r[0]: (r[1], r[2]) for r in every.collect()} and got["filler_phrases"] == (4, 3)


def test_stream_of_requests(spark, tmp_path):
    schema = "request_id long, text string, level double, model string"
    rows = [(1, "Please note that it is very useful in order to see.", 1.0, "claude-sonnet-4"), (2, "in order to go", 0.0, "x")]
    feed(spark, str(tmp_path / "in"), schema, rows)
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("profile", profile(F.col("model")))
    got = {r.request_id: r.compressed for r in drain(compressed(stream), str(tmp_path / "c"), "compressed")}
    batch = spark.createDataFrame(rows, schema).withColumn("profile", profile(F.col("model")))
    assert got == {r.request_id: r.compressed for r in compress_requests(batch).collect()} and got[2] == "in order to go"
