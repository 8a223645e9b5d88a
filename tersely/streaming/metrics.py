"""Counters over a stream of request-log rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from tersely.jobs.compress import compress_requests


def running_totals(log: DataFrame) -> DataFrame:
    """Totals since the stream began, by model; for the complete or update mode."""
    return log.groupBy("model").agg(F.count("*").alias("requests"), F.sum("original_tokens").alias("original_tokens"), F.sum("optimized_tokens").alias("optimized_tokens"))


def windowed(log: DataFrame, time: str = "ts", length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Totals by tumbling window; rows later than the watermark are dropped."""
    return log.withWatermark(time, late).groupBy(F.window(time, length)).agg(F.count("*").alias("requests"), F.sum("original_tokens").alias("original_tokens"), F.sum("optimized_tokens").alias("optimized_tokens")).select("window.start", "requests", "original_tokens", "optimized_tokens")


def first_uses(requests: DataFrame, key: str, time: str = "ts", ttl: str = "300 seconds") -> DataFrame:
    """The rows that a cache with this time to live would miss, approximately: one a key within the watermark."""
    return requests.withWatermark(time, ttl).dropDuplicatesWithinWatermark([key])


class _Levels(StatefulProcessor):
    """The level that a model is left at: a step down for each unstable answer, never under the least."""

    def __init__(self, step: float, least: float):
        self.step, self.least = step, least

    def init(self, handle):
        self.level = handle.getValueState("level", "first double, steps long")

    def handleInputRows(self, key, rows, timerValues):
        frame = pd.concat(list(rows))
        frame = frame[~frame["is_stable"].astype(bool)].sort_values(["ts", "request_id"], kind="stable")
        first, steps = self.level.get() if self.level.exists() else (None, 0)
        out = []
        for row in frame.itertuples():
            first, steps = (float(row.level) if first is None else first), steps + 1
            out.append((key[0], row.request_id, round(max(first - steps * self.step, self.least), 2)))
        if out:
            self.level.update((first, steps))
        yield pd.DataFrame(out, columns=["model", "request_id", "adjusted_level"]).astype({"adjusted_level": float})

    def close(self):
        pass


def adjusted_levels(log: DataFrame, step: float = 0.1, least: float = 0.2) -> DataFrame:
    """``model, request_id, adjusted_level`` of each unstable row of a stream (``model, request_id, ts, level, is_stable``).

    Rows that come together are taken in order of time; the state of a model is two numbers.
    """
    kind = dict(log.dtypes)["request_id"]
    return log.groupBy("model").transformWithStateInPandas(_Levels(step, least), f"model string, request_id {kind}, adjusted_level double", "Append", "None")


class _Reuse(StatefulProcessor):
    """When a key's entry was made and what that took; a use within ``ttl`` seconds of it is a hit.

    Uses wait until the watermark has passed them and are then judged in order of event time.
    """

    def __init__(self, ttl: float):
        self.ttl = int(round(ttl * 1_000_000))

    def init(self, handle):
        self.handle = handle
        self.entry = handle.getValueState("entry", "since long, cost double")
        self.waiting = handle.getListState("waiting", "us long, latency_ms double")

    def handleInputRows(self, key, rows, timerValues):
        first = None
        for frame in rows:  # one Arrow batch after the other, none are gathered
            times = frame["ts"].astype("datetime64[us]").astype("int64")
            self.waiting.appendList([(int(t), float(ms)) for t, ms in zip(times, frame["latency_ms"].fillna(0.0))])
            first = min(int(times.min()), first) if first is not None else int(times.min())
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        yield pd.DataFrame({"key": [], "ts": [], "hit": [], "saved_ms": []}).astype({"key": str, "ts": float, "hit": bool, "saved_ms": float})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        uses = sorted(self.waiting.get())
        ready = [u for u in uses if u[0] < passed]
        since, cost = self.entry.get() if self.entry.exists() else (None, 0.0)
        out = []
        for t, ms in ready:
            hit = since is not None and t - since < self.ttl
            if not hit:
                since, cost = t, ms
            out.append((key[0], t / 1e6, hit, cost if hit else 0.0))
        if ready:
            self.entry.update((since, cost))
            rest = uses[len(ready) :]
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
        if len(uses) > len(ready):
            self.handle.registerTimer(uses[len(ready)][0] // 1000 + 1)
        yield pd.DataFrame(out, columns=["key", "ts", "hit", "saved_ms"]).astype({"key": str, "ts": float, "hit": bool, "saved_ms": float})

    def close(self):
        pass


def reuse(uses: DataFrame, ttl: float = 300.0, late: str = "1 hour") -> DataFrame:
    """``key, ts, hit, saved_ms`` of each use of a stream (``key, ts timestamp, latency_ms``), as ``reuse_report`` has them.

    A use is judged when the watermark, ``late`` behind the newest row, has passed it, so the order in which rows come makes no
    difference; rows that come later than that are dropped.  A key's state is its entry and the uses that still wait.
    """
    rows = uses.withWatermark("ts", late)
    return rows.groupBy("key").transformWithStateInPandas(_Reuse(ttl), "key string, ts double, hit boolean, saved_ms double", "Append", "EventTime")


def category_totals(log: DataFrame) -> DataFrame:
    """``category, hits, requests`` since the stream began, from rows with ``rule_hits`` (array of category and hits); for the update mode."""
    each = log.select(F.explode("rule_hits").alias("x")).where("x.hits > 0")
    return each.groupBy(F.col("x.category").alias("category")).agg(F.sum("x.hits").cast("long").alias("hits"), F.count("*").alias("requests"))


def keep_latest(totals: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start a query that writes the rows of an update-mode stream to ``path``, a folder a batch; a batch that is run again replaces its own."""
    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return totals.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """The last row of each key that ``keep_latest`` wrote."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("x")).select(*keys, "x.*")


def compressed(requests: DataFrame, text: str = "text", level: str = "level", profile: str = "profile") -> DataFrame:
    """A stream of requests with their texts compressed; no state."""
    return compress_requests(requests, text, level, profile)
