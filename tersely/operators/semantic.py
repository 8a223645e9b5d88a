"""Long system prompts and histories for a condenser of the user's, and what a store of its answers would have saved."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tersely.functions.names import fresh
from tersely.functions.text import text_tokens
from tersely.operators.context import ANSWER
from tersely.operators.requests import message

# Tokens from which on a system prompt and a history are condensed, and what stays of a history.
SYSTEM, HISTORY, LEAST, KEEP = 4000, 8000, 6, 4


def message_line(m: Column) -> Column:
    """A message's text for a transcript: tool blocks named, images left out."""
    line = lambda b: F.when(b["type"] == "text", b["text"]).when(b["type"] == "tool_use", F.concat(F.lit("[called: "), F.coalesce(b["name"], F.lit("?")), F.lit("]"))).when(b["type"] == "tool_result", F.when(b["result"].isNotNull(), F.concat(F.lit("[tool_result: "), F.substring(b["result"], 1, 100), F.lit("]"))).otherwise("[tool_result]"))
    return F.array_join(F.filter(F.transform(m["blocks"], line), lambda x: x.isNotNull()), "\n")


def transcript(messages: Column) -> Column:
    lines = F.transform(messages, lambda m, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), F.coalesce(m["role"], F.lit("unknown")), F.lit(": "), message_line(m)))
    return F.array_join(lines, "\n\n")


def isolation_key(kind: str, text: Column, workspace: Column, user: Column) -> Column:
    """``kind:`` and the digest of the text, whatever its case and spacing, with its workspace and user."""
    low = F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))
    return F.concat(F.lit(f"{kind}:"), F.sha2(F.concat_ws("\u001f", low, F.coalesce(workspace, F.lit("")), F.coalesce(user, F.lit(""))), 256))


def candidates(requests: DataFrame, system: int = SYSTEM, history: int = HISTORY) -> DataFrame:
    """``requests`` with ``system_text`` where the system prompt is to be condensed, and ``n_condensed`` and ``history_text`` where
    the messages but the last ``KEEP`` are (system messages never)."""
    text = F.array_join(F.transform("system", lambda b: b["text"]), "\n")
    talk = F.filter("messages", lambda m: ~m["role"].eqNullSafe("system"))
    plain = F.aggregate(F.transform(talk, lambda m: F.when(m["is_string"], text_tokens(F.get(m["blocks"], F.lit(0))["text"])).otherwise(0)), F.lit(0).cast("long"), lambda n, x: n + x)
    long = (plain >= history) & (F.size(talk) > LEAST)
    n = F.size(talk) - KEEP
    return requests.withColumns({"system_text": F.when(text_tokens(text) >= system, text), "n_condensed": F.when(long, n).otherwise(0), "history_text": F.when(long, transcript(F.slice(talk, F.lit(1), F.greatest(n, F.lit(0)))))})


def condense(requests: DataFrame, function: Callable[[str], str], system: int = SYSTEM, history: int = HISTORY) -> DataFrame:
    """``requests`` with long system prompts and histories as ``function`` condenses them, where that has fewer tokens.

    The function sees each different text once; if it fails or gives null, the text stays.
    """
    def run(batches):
        for frame in batches:
            def one(text):
                try:
                    return function(text)
                except Exception:  # the user's code: its failure leaves the text as it is
                    return None
            yield pd.DataFrame({"text": frame["text"], "new": [one(t) for t in frame["text"]]})

    rows = candidates(requests, system, history)
    texts = rows.select("system_text").unionByName(rows.select(F.col("history_text").alias("system_text"))).where("system_text is not null").select(F.col("system_text").alias("text")).distinct()
    done = texts.mapInPandas(run, "text string, new string").where("new is not null").where(text_tokens(F.col("new")) < text_tokens(F.col("text"))).select(F.sha2("text", 256).alias("h"), "new")
    a, b = fresh(rows, "_a", "_b")
    out = rows.join(done.select(F.col("h").alias(f"{a}h"), F.col("new").alias(a)), F.sha2("system_text", 256) == F.col(f"{a}h"), "left")
    out = out.join(done.select(F.col("h").alias(f"{b}h"), F.col("new").alias(b)), F.sha2("history_text", 256) == F.col(f"{b}h"), "left")
    first = F.filter("messages", lambda m: m["role"].eqNullSafe("system"))
    talk = F.filter("messages", lambda m: ~m["role"].eqNullSafe("system"))
    head = F.concat(F.lit("[Semantic Summary of "), F.col("n_condensed").cast("string"), F.lit(" messages]\n"), F.col(b))
    short = F.concat(F.slice(first, 1, 1), F.array(message("user", head), message("assistant", F.lit(ANSWER))), F.slice(talk, F.col("n_condensed") + 1, F.lit(KEEP)))
    block = F.array(F.struct(F.lit("text").alias("type"), F.col(a).alias("text"), F.lit(False).alias("cached")))
    out = out.withColumns({"messages": F.when(F.col(b).isNotNull(), short).otherwise(F.col("messages")), "system": F.when(F.col(a).isNotNull(), block).otherwise(F.col("system")), "system_is_string": F.col("system_is_string") | F.col(a).isNotNull()})
    return out.drop(a, b, f"{a}h", f"{b}h", "system_text", "history_text", "n_condensed")
