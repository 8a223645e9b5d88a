"""Logs of agents: old tool results, reasoning, repeated errors and file views shortened, long sessions cut to a window.

Each step takes requests as nested rows and returns them with what it did counted; a step is a function of the request's arrays, so
none needs a shuffle.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tersely.functions.names import fresh, let
from tersely.functions.structured import FENCED_JSON, signature, typed
from tersely.functions.text import strip
from tersely.operators.conversation import THOUGHT
from tersely.operators.requests import content_text, each_block, is_tool, message, request_tokens, tools_json, with_result, with_text

# Error traces, paths of libraries in them, docstrings, comments and blank lines of file views.
TRACE = r"(?s)Traceback \(most recent call last\):.*?(?:\n\S|\z)"
PATHS = r'(?Umd)^\s*File "(?:/usr/lib/|/usr/local/lib/|/lib/python|<frozen |/home/\w+/\.local/lib/).*$'
DOCSTRING = r"""(?s)\"{3}.*?\"{3}|'{3}.*?'{3}"""
COMMENT = r"(?Umd)(?<=\S)\s+#\s+(?!type:|noqa|pylint|pragma).*$"
CUT, SAME, WINDOW = "[tool output of {n} bytes cut]", "[the same error trace as before]", "[older tool output cut]"
THOUGHT_CUT = "<thought>[earlier reasoning cut]</thought>"


def result_text(block: Column) -> Column:
    parts = F.array_join(F.transform(F.filter(block["parts"], lambda p: p["type"] == "text"), lambda p: p["text"]), "\n")
    return F.coalesce(block["result"], parts, F.lit(""))


def _old(i: Column, fresh_turns: int) -> Column:
    """Whether message ``i`` comes before the last ``fresh_turns`` pairs."""
    return i < F.greatest(F.size("messages") - 2 * fresh_turns, F.lit(0))


def _where(kind: str, condition, change):
    """A change of the blocks of a kind where a condition on them holds."""
    return lambda b: F.when((b["type"] == kind) & condition(b), change(b)).otherwise(b)


def _changed(before: Column, after: Column) -> Column:
    """Blocks that differ between two arrays of messages of one shape."""
    each = F.zip_with(before, after, lambda x, y: F.size(F.filter(F.zip_with(x["blocks"], y["blocks"], lambda p, q: ~p.eqNullSafe(q)), lambda d: d)))
    return F.coalesce(F.aggregate(each, F.lit(0), lambda n, x: n + x), F.lit(0))


def _step(requests: DataFrame, new: Column, count: str) -> DataFrame:
    (name,) = fresh(requests, "_messages")
    out = requests.withColumn(name, new)
    return out.withColumn(count, _changed(F.col("messages"), F.col(name))).withColumn("messages", F.col(name)).drop(name)


def prune_results(requests: DataFrame, fresh_turns: int = 2, short: int = 200, long: int = 2000, note: str = CUT) -> DataFrame:
    """Tool results over ``short`` bytes in old messages, over ``long`` in others, replaced by a note; so are texts of role ``tool``."""
    put = lambda size: F.replace(F.lit(note), F.lit("{n}"), size.cast("string"))
    limit = lambda i: F.when(_old(i, fresh_turns), short).otherwise(long)
    results = lambda i: _where("tool_result", lambda b: F.octet_length(result_text(b)) > limit(i), lambda b: with_result(b, put(F.octet_length(result_text(b)))))
    plain = lambda i: _where("text", lambda b: F.octet_length(b["text"]) > limit(i), lambda b: with_text(b, put(F.octet_length(b["text"]))))
    new = F.transform("messages", lambda m, i: F.when((m["role"] == "tool") & m["is_string"], each_block(m, plain(i))).otherwise(each_block(m, results(i))))
    return _step(requests, new, "n_results")


def prune_thoughts(requests: DataFrame, fresh_turns: int = 3, note: str = THOUGHT_CUT) -> DataFrame:
    """Reasoning in the texts of old assistant messages replaced by a note where that is shorter."""
    bare = lambda b: F.regexp_replace(b["text"], F.lit(THOUGHT), F.lit(note))
    change = _where("text", lambda b: F.octet_length(bare(b)) < F.octet_length(b["text"]), lambda b: with_text(b, bare(b)))
    return _step(requests, F.transform("messages", lambda m, i: F.when((m["role"] == "assistant") & _old(i, fresh_turns), each_block(m, change)).otherwise(m)), "n_thoughts")


def dedup_errors(requests: DataFrame, note: str = SAME) -> DataFrame:
    """Error traces seen before in the request replaced by a note, library paths cut from those seen first.

    A message with ``k`` traces seen before has its first ``k`` traces replaced; traces in tool results count, but only texts change.
    """
    keys, again = fresh(requests, "_keys", "_again")
    digest = lambda m: F.transform(F.regexp_extract_all(content_text(m), F.lit(TRACE), 0), lambda t: F.substring(F.md5(strip(t)), 1, 12))
    out = requests.withColumn(keys, F.transform("messages", digest))
    seen = lambda k, i: let(F.flatten(F.slice(keys, F.lit(1), i)), lambda before: F.size(F.filter(k, lambda x, j: F.array_contains(before, x) | (F.array_position(k, x) <= j))))
    out = out.withColumn(again, F.transform(keys, seen))
    # the first trace that is left, once for each one seen before
    first = F.lit(r"\A(.*?)" + TRACE.removeprefix("(?s)"))
    swap = lambda t, n: F.aggregate(F.sequence(F.lit(1), n), t, lambda acc, _: F.regexp_replace(acc, F.concat(F.lit("(?s)"), first), F.lit("$1" + note)))
    bare = lambda t, i: F.when(F.size(F.get(keys, i)) > F.get(again, i), F.regexp_replace(t, F.lit(PATHS), F.lit(""))).otherwise(t)
    text = lambda t, i: F.when(F.get(again, i) > 0, swap(bare(t, i), F.get(again, i))).otherwise(bare(t, i))
    new = F.transform("messages", lambda m, i: F.when(F.size(F.get(keys, i)) > 0, each_block(m, lambda b: F.when(b["type"] == "text", with_text(b, text(b["text"], i))).otherwise(b))).otherwise(m))
    return out.withColumn("messages", new).withColumn("n_errors", F.aggregate(again, F.lit(0), lambda n, x: n + x)).drop(keys, again)


def compact_fences(text: Column) -> Column:
    """``text`` with the JSON of its ``json`` fences compact and with keys in order; what is no JSON stays."""
    found = F.zip_with(F.regexp_extract_all(text, F.lit(FENCED_JSON), 0), F.regexp_extract_all(text, F.lit(FENCED_JSON), 1), lambda whole, body: F.struct(whole.alias("whole"), F.to_json(F.try_parse_json(body)).alias("body")))
    put = lambda t, x: F.replace(t, x["whole"], F.concat(F.lit("```json\n"), x["body"], F.lit("\n```")))
    return F.when(text.contains("```json"), F.aggregate(F.filter(found, lambda x: x["body"].isNotNull()), text, put)).otherwise(text)


def condense_views(requests: DataFrame, least: int = 100) -> DataFrame:
    """Docstrings, trailing comments and blank lines cut from tool results of ``least`` bytes or more, JSON in fences compact, where that is shorter."""
    def bare(b: Column) -> Column:
        text = F.regexp_replace(result_text(b), F.lit(DOCSTRING), F.lit('""""'))
        return compact_fences(F.regexp_replace(F.regexp_replace(text, F.lit(COMMENT), F.lit("")), r"\n{3,}", "\n\n"))

    def put(b: Column) -> Column:
        at = F.array_position(F.transform(b["parts"], lambda p: p["type"]), F.lit("text"))
        parts = F.transform(b["parts"], lambda p, i: F.when(i + 1 == at, p.withField("text", bare(b))).otherwise(p))
        return F.when(b["result"].isNotNull(), b.withField("result", bare(b))).otherwise(b.withField("parts", parts))

    change = _where("tool_result", lambda b: (F.octet_length(result_text(b)) >= least) & (F.octet_length(bare(b)) < F.octet_length(result_text(b))), put)
    return _step(requests, F.transform("messages", lambda m: F.when(m["is_string"], m).otherwise(each_block(m, change))), "n_views")


def mark_cached(system: Column) -> Column:
    """System blocks with the last one marked for the prompt cache."""
    return F.transform(system, lambda b, i: F.when(i == F.size(system) - 1, b.withField("cached", F.lit(True))).otherwise(b))


def sliding_window(requests: DataFrame, max_tokens: int = 200_000, share: float = 0.8, preserve: int = 5, result_age: int = 10, thought_age: int = 5, note: str = WINDOW) -> DataFrame:
    """Requests over ``share`` of ``max_tokens``: old results and reasoning go, and all but the last messages become a summary."""
    (purged,) = fresh(requests, "_purged")
    n = F.size("messages")
    over = request_tokens(F.col("system"), F.col("system_is_string"), F.col("messages"), tools_json(requests)) > int(max_tokens * share)
    results = lambda m: F.when((m["role"] == "tool") & m["is_string"], each_block(m, lambda b: with_text(b, F.lit(note)))).otherwise(each_block(m, _where("tool_result", lambda b: F.lit(True), lambda b: with_result(b, F.lit(note)))))
    thoughts = lambda m: each_block(m, lambda b: with_text(b, F.regexp_replace(b["text"], F.lit(THOUGHT), F.lit(""))))
    one = F.transform("messages", lambda m, i: F.when(_old(i, result_age), results(m)).otherwise(m))
    two = F.transform(purged, lambda m, i: F.when((m["role"] == "assistant") & m["is_string"] & _old(i, thought_age), thoughts(m)).otherwise(m))
    out = requests.withColumn(purged, F.when(over, one)).withColumn(purged, two)
    keep = F.least(F.lit(2 * preserve), n)
    last = F.slice(F.slice(purged, F.lit(1), n - keep), -6, 6)
    short = F.when(n - keep >= 6, last).otherwise(F.slice(purged, F.lit(1), F.greatest(n - keep, F.lit(0))))
    lines = F.filter(F.transform(short, lambda m: F.when(strip(F.substring(content_text(m), 1, 100)) != "", F.concat(F.coalesce(m["role"], F.lit("?")), F.lit(": "), F.substring(content_text(m), 1, 100)))), lambda x: x.isNotNull())
    recent = F.slice(purged, n - keep + 1, F.greatest(keep, F.lit(1)))
    head = F.concat(F.lit("[Window: older messages cut]\nRecent context summary:\n"), F.array_join(lines, "\n"))
    summed = F.when(F.size(lines) > 0, F.concat(F.array(message("user", head), message("assistant", F.lit("Understood. Continuing with current task context."))), recent)).otherwise(recent)
    new = F.when(F.col(purged).isNull(), F.col("messages")).when(n > keep + 4, summed).otherwise(F.col(purged))
    return out.withColumn("windowed", F.col(purged).isNotNull()).withColumn("messages", new).drop(purged)


@F.pandas_udf(StringType())
def _bare_schema(schema: pd.Series) -> pd.Series:
    def one(text):
        try:
            value = json.loads(text)
            for prop in value["properties"].values():
                for key in ("description", "examples", "default"):
                    prop.pop(key, None)
        except (TypeError, ValueError, KeyError, AttributeError):
            return text
        return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)

    return pd.Series([one(t) for t in schema], dtype=object)


def minimize_tools(tools: DataFrame) -> DataFrame:
    """Tools (``name, description, schema``) with one sentence and their signature as description, and a schema without prose."""
    text = F.coalesce("description", F.lit(""))
    short = F.when(F.instr(text, ". ") > 0, F.substring(text, F.lit(1), F.instr(text, ". "))).when(F.octet_length(text) > 80, F.substring(text, 1, 80)).otherwise(text)
    sig = F.when(F.col("schema").isNotNull(), F.concat(short, F.lit(" Sig: "), signature(F.coalesce("name", F.lit("fn")), F.col("schema")))).otherwise(short)
    return tools.withColumn("description", sig).withColumn("schema", _bare_schema("schema"))


def _sentence(text: str) -> str:
    at = text.find(". ")
    return text[: at + 1] if at >= 0 else text.encode()[:80].decode("utf-8", "ignore")


@F.pandas_udf(StringType())
def _minimized(tools: pd.Series) -> pd.Series:
    """Lists of tools as JSON, each tool with one sentence and its signature as description and a schema without prose."""
    def tool(t):
        if not isinstance(t, dict):
            return t
        name = t["name"] if isinstance(t.get("name"), str) else "fn"
        if isinstance(t.get("description"), str):
            t["description"] = _sentence(t["description"])
        key = "input_schema" if "input_schema" in t else "parameters"
        if key in t:
            told = t["description"] if isinstance(t.get("description"), str) else ""
            t["description"] = f"{told} Sig: {typed(name, t[key])}"
            props = t[key].get("properties") if isinstance(t[key], dict) else None
            for prop in props.values() if isinstance(props, dict) else ():
                for x in ("description", "examples", "default") if isinstance(prop, dict) else ():
                    prop.pop(x, None)
        return t

    return pd.Series([None if x is None else json.dumps([tool(t) for t in json.loads(x)], sort_keys=True, separators=(",", ":"), ensure_ascii=False) for x in tools], dtype=object)


def minimize_used_tools(requests: DataFrame) -> DataFrame:
    """Requests whose messages already call tools or bring results, with their tools minimized; a first call keeps them whole."""
    told = tools_json(requests)
    if told is None:
        return requests
    (used,) = fresh(requests, "_used")
    out = requests.withColumn("tools_json", told).withColumn(used, F.exists("messages", is_tool))
    out = out.withColumn("tools_json", F.coalesce(_minimized(F.when(F.col(used), F.col("tools_json"))), F.col("tools_json")))
    if "tools" in requests.columns:
        read = F.from_json("tools_json", "array<struct<name:string,description:string,input_schema:string,parameters:string>>")
        new = F.transform(read, lambda t: F.struct(t["name"].alias("name"), t["description"].alias("description"), F.coalesce(t["input_schema"], t["parameters"]).alias("schema")))
        out = out.withColumn("tools", F.when(F.col(used), new).otherwise(F.col("tools")))
    return out.drop(used)


def optimize(requests: DataFrame) -> DataFrame:
    """All steps in order, for requests of two messages or more; counts by step and the characters saved."""
    (before,) = fresh(requests, "_bytes")
    size = lambda: F.aggregate(F.transform("messages", lambda m: F.octet_length(content_text(m))), F.lit(0), lambda n, x: n + x)
    few = requests.where(F.size("messages") < 2)
    out = sliding_window(requests.where(F.size("messages") >= 2).withColumn(before, size()))
    for step in (prune_results, prune_thoughts, dedup_errors, condense_views, minimize_used_tools):
        out = step(out)
    out = out.withColumn("system", mark_cached(F.col("system"))).withColumn("system_is_string", F.lit(False))
    out = out.withColumn("bytes_saved", F.greatest(F.col(before) - size(), F.lit(0))).drop(before)
    return out.unionByName(few, allowMissingColumns=True)
