"""Long conversations cut down to a summary of the older messages and the recent ones.

Requests are nested rows, so all is functions of arrays.  A row that doesn't reach the trigger stays as it is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tersely.functions.names import fresh, let
from tersely.functions.text import strip
from tersely.operators.requests import message, request_tokens, tools_json

# What makes a sentence worth keeping, and what makes it worthless.
HIGH = [
    r"(?iU)\b(?:decided|agreed|confirmed|conclusion|result|answer|solution)\b", r"(?iU)\b(?:error|bug|fix|issue|problem|warning)\b", r"(?iU)\b(?:must|shall|require|critical|important)\b", r"(?iU)https?://\S+",
    r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", r"(?s)```.*?```", r"\b\d{4}[-/]\d{2}[-/]\d{2}\b", r"\$[\d,.]+\b",
]
LOW = [r"(?i)\A(?:hi|hello|hey|thanks|thank you|ok|okay|sure|great|perfect|got it|sounds good)[\s.!]*\z", r"(?i)\A(?:can you|could you|would you|please)\s"]
CODE = r"(?s)(```.*?```)"
# Bounds of a summary.
FACTS, TOOLS, FACT, CODE_BYTES, SAME = 30, 10, 200, 500, 80
ANSWER = "Understood. I have the context from our earlier conversation."


def sentences(text: Column) -> Column:
    """Sentences that end in ``.!?`` before white space, trimmed, of ten bytes or more."""
    parts = F.split(text, r"(?<=[.!?])(?U)\s")
    return F.filter(F.transform(parts, strip), lambda s: F.octet_length(s) >= 10)


def _any(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns])


def facts(role: Column, text: Column) -> Column:
    """The key sentences and small code blocks of a text, in order."""
    head = lambda s: F.concat(F.when(role == "user", "User stated: ").otherwise(""), F.substring(s, 1, FACT))
    kept = F.filter(sentences(text), lambda s: ~_any(s, LOW))
    code = lambda s: F.filter(F.regexp_extract_all(s, F.lit(CODE), 1), lambda c: F.octet_length(c) < CODE_BYTES)
    return F.flatten(F.transform(kept, lambda s: F.concat(F.when(_any(s, HIGH), F.array(head(s))).otherwise(F.array().cast("array<string>")), code(s))))


def all_facts(messages: Column) -> Column:
    of = lambda m: F.flatten(F.transform(F.filter(m["blocks"], lambda b: b["type"] == "text"), lambda b: facts(m["role"], F.coalesce(b["text"], F.lit("")))))
    return F.flatten(F.transform(messages, of))


def tool_lines(messages: Column) -> Column:
    """``Tool result: ...`` and ``Called tool: ...`` in order."""
    text = lambda b: F.coalesce(b["result"], F.array_join(F.transform(F.filter(b["parts"], lambda p: p["type"] == "text"), lambda p: p["text"]), " "), F.lit(""))
    line = lambda b: F.when(b["type"] == "tool_use", F.concat(F.lit("Called tool: "), F.coalesce(b["name"], F.lit("?")))).when((b["type"] == "tool_result") & (strip(text(b)) != ""), F.concat(F.lit("Tool result: "), F.substring(text(b), 1, FACT)))
    return F.filter(F.flatten(F.transform(messages, lambda m: F.transform(m["blocks"], line))), lambda x: x.isNotNull())


def first_of_each(xs: Column, size: int = SAME) -> Column:
    """The strings but those that begin, in any case, as an earlier one does."""
    key = lambda x: F.substring(F.lower(x), 1, size)
    return let(xs, lambda ys: let(F.transform(ys, key), lambda keys: F.filter(ys, lambda y, i: F.array_position(keys, F.get(keys, i)) == i + 1)))


def cut_bytes(text: Column, size: int, mark: str = "\n[...truncated]") -> Column:
    """At most ``size`` bytes, never half a character, and the mark if something went."""
    raw = text.cast("binary")
    follows = lambda k: (F.conv(F.hex(F.substring(raw, k + 1, 1)), 16, 10).cast("int").bitwiseAND(F.lit(0xC0))) == 0x80
    end = F.when(~follows(size), size).when(~follows(size - 1), size - 1).when(~follows(size - 2), size - 2).otherwise(size - 3)
    return F.when(F.octet_length(text) <= size, text).otherwise(F.concat(F.substring(raw, F.lit(1), end).cast("string"), F.lit(mark)))


def summary(older: Column, most: int = 2000) -> Column:
    """The key points and tool interactions of some messages as text."""
    lines = lambda head, xs: F.when(F.size(xs) > 0, F.concat(F.lit(head + "\n"), F.array_join(F.transform(xs, lambda x: F.concat(F.lit("- "), x)), "\n")))
    points = lines("Key points:", F.slice(first_of_each(all_facts(older)), 1, FACTS))
    tools = lines("Tool interactions:", F.slice(tool_lines(older), 1, TOOLS))
    return cut_bytes(F.concat_ws("\n\n", points, tools), most)


def repaired(older: Column, recent: Column) -> Column:
    """``recent`` with a call for every tool result: the older message that made it, else the result goes.

    Recovered messages come first, each once, in their order; of several calls with one id the last counts.
    """
    ids = lambda ms, kind, field: F.flatten(F.transform(ms, lambda m: F.transform(F.filter(m["blocks"], lambda b: (b["type"] == kind) & b[field].isNotNull()), lambda b: b[field])))
    orphans = F.array_except(ids(recent, "tool_result", "tool_use_id"), ids(recent, "tool_use", "id"))
    return let(orphans, lambda o: _recovered(older, recent, o))


def _recovered(older: Column, recent: Column, orphans: Column) -> Column:
    calls = lambda m: F.transform(F.filter(m["blocks"], lambda b: (b["type"] == "tool_use") & b["id"].isNotNull()), lambda b: b["id"])
    asked = F.transform(older, lambda m: F.when(m["role"] == "assistant", F.array_intersect(calls(m), orphans)).otherwise(F.array().cast("array<string>")))
    # the last older message of each id
    last = lambda i: F.exists(F.get(asked, i), lambda x: ~F.exists(F.slice(asked, i + 2, F.size(asked)), lambda later: F.array_contains(later, x)))
    found = F.filter(older, lambda m, i: F.coalesce(last(i), F.lit(False)))
    lost = F.array_except(orphans, F.flatten(asked))
    keep = lambda m: m.withField("blocks", F.filter(m["blocks"], lambda b: ~F.coalesce((b["type"] == "tool_result") & F.array_contains(lost, b["tool_use_id"]), F.lit(False))))
    kept = F.filter(F.transform(recent, keep), lambda m: m["is_string"] | (F.size(m["blocks"]) > 0))
    return F.concat(found, F.when(F.size(lost) > 0, kept).otherwise(recent))


def summarize_requests(requests: DataFrame, min_messages: int = 6, max_tokens: int = 50_000, preserve: int = 4, most: int = 2000) -> DataFrame:
    """``requests`` with the older messages of long conversations replaced by their summary, and ``n_older`` (0: untouched).

    Conversations of fewer than ``min_messages`` messages or at most ``max_tokens`` tokens stay, and so do those whose older
    messages hold nothing to keep.
    """
    older, recent, text = fresh(requests, "_older", "_recent", "_summary")
    n = F.size("messages")
    long = (n >= min_messages) & (request_tokens(F.col("system"), F.col("system_is_string"), F.col("messages"), tools_json(requests)) > max_tokens)
    kept = F.least(F.lit(2 * preserve), n - 2)
    parts = requests.withColumn(older, F.when(long, F.slice("messages", F.lit(1), n - kept))).withColumn(recent, F.when(long, F.slice("messages", n - kept + 1, F.greatest(kept, F.lit(0)))))
    told = parts.withColumn(text, summary(F.col(older), most))
    fires = F.coalesce(F.col(older).isNotNull() & (strip(F.col(text)) != ""), F.lit(False))
    head = F.concat(F.lit("[Context Summary of "), F.size(older).cast("string"), F.lit(" earlier messages]\n"), F.col(text))
    new = F.concat(F.array(message("user", head), message("assistant", F.lit(ANSWER))), repaired(F.col(older), F.col(recent)))
    return told.withColumn("n_older", F.when(fires, F.size(older)).otherwise(0)).withColumn("messages", F.when(fires, new).otherwise(F.col("messages"))).drop(older, recent, text)
