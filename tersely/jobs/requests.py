"""Whole requests compressed: every text once, by its level, profile and kind, and put back in its place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tersely.functions.names import fresh, once
from tersely.functions.normalize import normalize_requests
from tersely.functions.program import DECLARED
from tersely.functions.routing import profile
from tersely.functions.structured import compact_json
from tersely.jobs.compress import compress_requests, compress_responses
from tersely.operators.requests import message_tokens, request_tokens, tools_json
from tersely.operators.wire import written_messages

#: A fixed value: roles whose messages are compressed as requests.
ROLES = ("user", "system", "tool")


def places(requests: DataFrame, key: str = "request_id", age: int = 2, responses: bool = True) -> DataFrame:
    """``key, level, profile, mode, place, text``: every text that may change, with where it stands.

    Texts of users, systems and tools are of mode ``request``, strings of tool results ``result``, old assistant texts
    ``response``; tool calls and images are never among them.
    """
    head = requests.select(key, "level", "profile", F.posexplode("system").alias("i", "b")).where("b.text is not null").select(key, "level", "profile", F.lit("request").alias("mode"), F.concat(F.lit("s"), F.col("i").cast("string")).alias("place"), F.col("b.text").alias("text"))
    each = requests.select(key, "level", "profile", F.size("messages").alias("n"), F.posexplode("messages").alias("i", "m"))
    old = (F.col("m.role") == "assistant") & (F.col("i") < F.col("n") - 2 * age) & F.lit(responses)
    mode = F.when(old, "response").when(F.col("m.role").isin(*ROLES), "request")
    rows = each.select(key, "level", "profile", mode.alias("mode"), "i", F.posexplode("m.blocks").alias("j", "b")).where("mode is not null")
    at = F.concat(F.col("i").cast("string"), F.lit("."), F.col("j").cast("string"))
    item = lambda mode, place, text: F.struct(mode.alias("mode"), place.alias("place"), text.alias("text"))
    own = F.when(F.col("b.type") == "text", F.array(item(F.col("mode"), at, F.col("b.text"))))
    parts = F.transform("b.parts", lambda p, k: item(F.col("mode"), F.concat(at, F.lit("."), k.cast("string")), F.when(p["type"] == "text", p["text"])))
    result = F.when((F.col("b.type") == "tool_result") & (F.col("mode") == "request"), F.when(F.col("b.result").isNotNull(), F.array(item(F.lit("result"), at, F.col("b.result")))).otherwise(parts))
    body = rows.select(key, "level", "profile", F.explode(F.coalesce(own, result)).alias("x")).select(key, "level", "profile", "x.mode", "x.place", "x.text")
    return head.unionByName(body.where("text is not null"))


def compress_texts(texts: DataFrame) -> DataFrame:
    """Distinct ``text, level, profile, mode`` with ``compressed`` and ``rule_hits``; results that are one JSON value are also compacted."""
    asked = compress_requests(texts.where("mode <> 'response'"), hits=True)
    json = F.when((F.col("mode") == "result") & (F.col("level") >= 0.5), compact_json(F.col("compressed"))).otherwise(F.col("compressed"))
    return asked.withColumn("compressed", json).unionByName(compress_responses(texts.where("mode = 'response'"), hits=True))


def compress_whole(requests: DataFrame, key: str = "request_id", age: int = 2, responses: bool = True, hits: bool = False, normalized: bool = False, bound: bool = True) -> DataFrame:
    """``requests`` (``key, model, level, system, system_is_string, messages`` and maybe ``tools`` and ``tools_json``) with their texts compressed.

    Adds the tokens before and after, and the tokens saved in old answers and how many of these became shorter.  A text is
    compressed once however many requests hold it; only its hash travels with the places, and Spark splits a hash that very many
    share.  With ``hits`` comes ``rule_hits``, the rules that matched by category, each as it was applied: none at level 0, and a text
    that stands twice counts twice.  ``normalized`` requests have their prompts put in order first, with the boundary if ``bound``.
    """
    tools = tools_json(requests)
    count = lambda: request_tokens(F.col("system"), F.col("system_is_string"), F.col("messages"), tools)
    rows = requests.withColumn("original_tokens", count())
    if normalized:
        (held,) = fresh(rows, "_held")
        own = ("system", "system_is_string", "messages")
        rows = once(normalize_requests(rows, bound), held, F.struct(*own)).withColumns({c: F.col(held)[c] for c in own}).drop(held)
    held = places(rows.select(key, "level", profile(F.col("model")).alias("profile"), "system", "messages"), key, age, responses)
    held = held.withColumn("h", F.sha2(F.concat_ws("\u001f", "mode", "profile", F.col("level").cast("string"), "text"), 256))
    texts = held.groupBy("h").agg(*[F.first(c).alias(c) for c in ("text", "level", "profile", "mode")])
    # no filter on what is compressed: pushed down, it would repeat the whole chain of rules
    done = compress_texts(texts).select("h", F.col("compressed").alias("new"), F.transform("rule_hits", lambda x: x["hits"]).alias("n"))
    new = held.select(key, "place", "h").join(done, "h").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("place", "new"))).alias("news"), F.array(*[F.sum(F.get("n", F.lit(k))) for k in range(len(DECLARED))]).alias("sums"))
    news, sums = fresh(rows, "_news", "_sums")
    out = rows.join(new.withColumnsRenamed({"news": news, "sums": sums}), key, "left")
    found = lambda place, old: F.coalesce(F.try_element_at(news, place), old)

    def block(b: Column, at: Column) -> Column:
        parts = F.transform(b["parts"], lambda p, k: p.withField("text", found(F.concat(at, F.lit("."), k.cast("string")), p["text"])))
        return F.when(b["type"] == "text", b.withField("text", found(at, b["text"]))).when(b["type"] == "tool_result", b.withField("result", F.when(b["result"].isNotNull(), found(at, b["result"]))).withField("parts", parts)).otherwise(b)

    at = lambda i, j: F.concat(i.cast("string"), F.lit("."), j.cast("string"))
    body = F.transform("messages", lambda m, i: m.withField("blocks", F.transform(m["blocks"], lambda b, j: block(b, at(i, j)))))
    head = F.transform("system", lambda b, i: b.withField("text", found(F.concat(F.lit("s"), i.cast("string")), b["text"])))
    old = fresh(out, "_old")[0]
    out = out.withColumn(old, F.col("messages")).withColumns({"messages": F.when(F.col(news).isNull(), F.col("messages")).otherwise(body), "system": F.when(F.col(news).isNull(), F.col("system")).otherwise(head)})
    cutoff = F.size("messages") - 2 * age
    saved = F.transform(F.zip_with(old, "messages", lambda x, y: F.struct(x["role"].alias("role"), (message_tokens(x) - message_tokens(y)).alias("n"))), lambda x, i: F.when((x["role"] == "assistant") & (i < cutoff) & F.lit(responses), F.greatest(x["n"], F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long")))
    out = out.withColumns({"optimized_tokens": count(), "response_tokens_saved": F.aggregate(saved, F.lit(0).cast("long"), lambda n, x: n + x), "responses_compressed": F.size(F.filter(saved, lambda x: x > 0))}).drop(old, news)
    if hits:
        out = out.withColumn("rule_hits", F.array(*[F.struct(F.lit(c).alias("category"), F.coalesce(F.get(sums, F.lit(k)), F.lit(0).cast("long")).alias("hits")) for k, c in enumerate(DECLARED)]))
    return out.drop(sums)


def compressed_lines(done: DataFrame) -> DataFrame:
    """``line``: for each request ``{messages, model, optimized_tokens, original_tokens}`` in the shape in which requests come.

    Messages that were not changed are those of the request's line (``raw``), byte for byte but for the order of their keys.
    """
    raw = F.try_parse_json("raw") if "raw" in done.columns else F.lit(None).cast("variant")
    messages = F.coalesce(written_messages(raw, F.col("messages")), F.parse_json(F.lit("null")))
    values = {"messages": messages, "model": F.coalesce("model", F.lit("unknown")).cast("variant"), "optimized_tokens": F.col("optimized_tokens").cast("variant"), "original_tokens": F.col("original_tokens").cast("variant")}
    return done.select(F.to_json(F.to_variant_object(F.create_map(*[y for k, v in values.items() for y in (F.lit(k), v)]))).alias("line"))


def write_compressed(done: DataFrame, path: str) -> None:
    """The requests' ``compressed_lines`` as a text file a task."""
    compressed_lines(done).write.mode("append").text(path)


def metrics_rows(done: DataFrame, time: str = "ts", most: int = 5) -> DataFrame:
    """The metrics log's row of each request: tokens, savings, and the ``most`` categories that hit most, ties in declared order."""
    saved = F.greatest(F.lit(0).cast("long"), F.col("original_tokens") - F.col("optimized_tokens"))
    top = lambda hits: F.slice(F.transform(F.array_sort(F.transform(hits, lambda x, i: F.struct((-x["hits"]).alias("n"), i.alias("i"), x.alias("x")))), lambda y: F.struct(y["x"]["category"].alias("name"), y["x"]["hits"].cast("bigint").alias("hits"))), 1, most)
    n = F.aggregate("rule_hits", F.lit(0).cast("long"), lambda n, x: n + x["hits"])
    return done.select(
        F.col(time).cast("double").alias("timestamp"), "original_tokens", "optimized_tokens", (F.col("optimized_tokens") / F.greatest("original_tokens", F.lit(1))).alias("compression_ratio"), saved.alias("token_savings"),
        F.when(F.col("original_tokens") > 0, saved / F.col("original_tokens") * 100).otherwise(0.0).alias("savings_percent"), F.col("level").alias("compression_level"), F.lit(0.0).alias("latency_ms"), "model", F.col("request_id").cast("string").alias("request_id"), n.alias("total_rule_hits"), top("rule_hits").alias("top_categories"),
    )
