"""Payloads of the two chat formats, from one to the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Reasons to stop, and what a body without a limit or a model gets.
FINISH = {"end_turn": "stop", "max_tokens": "length", "tool_use": "tool_calls"}
LIMIT = 4096


def split_system(requests: DataFrame) -> DataFrame:
    """Requests whose system texts stand among the messages: those are joined by blank lines into ``system``, the rest stay.

    ``max_tokens`` falls back to ``max_completion_tokens``, then to ``LIMIT``; other columns stay.
    """
    texts = F.flatten(F.transform(F.filter("messages", lambda m: m["role"] == "system"), lambda m: F.transform(F.filter(m["blocks"], lambda b: b["text"].isNotNull()), lambda b: b["text"])))
    joined = F.array_join(texts, "\n\n")
    system = F.when(F.size(texts) > 0, F.array(F.struct(F.lit("text").alias("type"), joined.alias("text"), F.lit(False).alias("cached"))))
    limit = [F.col(c) for c in ("max_tokens", "max_completion_tokens") if c in requests.columns]
    out = requests.withColumns({"system": system, "system_is_string": F.size(texts) > 0, "messages": F.filter("messages", lambda m: ~m["role"].eqNullSafe("system")), "max_tokens": F.coalesce(*limit, F.lit(LIMIT))})
    return out.drop("max_completion_tokens")


def chat_response(responses: DataFrame) -> DataFrame:
    """Answers of blocks (``id, model, blocks, stop_reason, input_tokens, output_tokens``) as chat completions.

    Texts are joined by line ends (null if there are none), tool calls become functions, usage is summed.
    """
    texts = F.filter("blocks", lambda b: (b["type"] == "text") & b["text"].isNotNull())
    calls = F.transform(F.filter("blocks", lambda b: b["type"] == "tool_use"), lambda b: F.struct(F.coalesce(b["id"], F.lit("")).alias("id"), F.lit("function").alias("type"), F.struct(F.coalesce(b["name"], F.lit("")).alias("name"), F.coalesce(b["input"], F.lit("null")).alias("arguments")).alias("function")))
    finish = F.lit("stop")
    for a, b in FINISH.items():
        finish = F.when(F.col("stop_reason") == a, b).otherwise(finish)
    n, m = (F.coalesce(c, F.lit(0)).cast("long") for c in ("input_tokens", "output_tokens"))
    return responses.select(
        F.concat(F.lit("chatcmpl-"), F.coalesce("id", F.lit("unknown"))).alias("id"), F.coalesce("model", F.lit("")).alias("model"), F.when(F.size(texts) > 0, F.array_join(F.transform(texts, lambda b: b["text"]), "\n")).alias("content"),
        F.when(F.size(calls) > 0, F.to_json(calls)).alias("tool_calls"), finish.alias("finish_reason"), n.alias("prompt_tokens"), m.alias("completion_tokens"), (n + m).alias("total_tokens"),
    )


def stream_lines(chunk: Column, model: Column) -> Column:
    """Lines of a stream of events as lines of chat chunks: deltas and the end, what isn't understood as it came."""
    data = lambda line: F.substring(line, F.lit(7), F.length(line))
    field = lambda line, path: F.get_json_object(data(line), path)

    def piece(delta: Column, finish: Column) -> Column:
        body = F.struct(F.array(F.struct(delta.alias("delta"), finish.alias("finish_reason"), F.lit(0).alias("index"))).alias("choices"), F.lit("chatcmpl-stream").alias("id"), model.alias("model"), F.lit("chat.completion.chunk").alias("object"))
        return F.concat(F.lit("data: "), F.to_json(body, {"ignoreNullFields": "false"}), F.lit("\n\n"))

    def one(line: Column) -> Column:
        kind = field(line, "$.type")
        text = (kind == "content_block_delta") & (field(line, "$.delta.type") == "text_delta")
        known = F.when(F.trim(data(line)) == "[DONE]", "data: [DONE]\n\n")
        known = known.when(F.try_parse_json(data(line)).isNull(), F.concat(line, F.lit("\n")))
        known = known.when(text, piece(F.struct(F.coalesce(field(line, "$.delta.text"), F.lit("")).alias("content")), F.lit(None).cast("string")))
        known = known.when(kind == "message_stop", F.concat(F.regexp_replace(piece(F.struct(F.lit("").alias("content")), F.lit("stop")), F.lit(r'\{"content":""\}'), F.lit("{}")), F.lit("data: [DONE]\n\n"))).otherwise("")
        return F.when(line.startswith("data: "), known).when(line.startswith("event:") | (line == ""), "").otherwise(F.concat(line, F.lit("\n")))

    return F.array_join(F.transform(F.split(F.regexp_replace(chunk, r"\r?\n\z", ""), r"\r?\n"), one), "")


def answer_text(status: Column, blocks: Column) -> Column:
    """The texts of an answer joined by spaces; empty unless its status is 200."""
    texts = F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"])
    return F.when(status == 200, F.coalesce(F.array_join(texts, " "), F.lit(""))).otherwise("")


def with_endpoint(requests: DataFrame, endpoints: DataFrame, default: str = "openai", overrides: DataFrame | None = None) -> DataFrame:
    """Requests (``provider``) with their provider's row of ``endpoints(provider, base_url, ...)``, of the default where there is none.

    ``overrides(provider, base_url)`` wins; slashes at the end of a url go.  Both are lists of providers, a few rows each.
    """
    known = endpoints
    if overrides is not None:
        known = known.join(F.broadcast(overrides.select("provider", F.col("base_url").alias("override"))), "provider", "left").withColumn("base_url", F.coalesce("override", "base_url")).drop("override")
    known = known.withColumn("base_url", F.regexp_replace("base_url", "/+$", ""))
    rest = [c for c in known.columns if c != "provider"]
    usual = known.where(F.col("provider") == default).select(*[F.col(c).alias(f"{c}_default") for c in rest])
    out = requests.join(F.broadcast(known), "provider", "left").join(F.broadcast(usual), F.lit(True), "left")
    return out.withColumns({c: F.coalesce(c, f"{c}_default") for c in rest}).drop(*[f"{c}_default" for c in rest])


