"""Registered queries over whole requests, made from the given conversations, documents and events by the same rules in Spark and SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tersely.functions import normalize, program, routing, text
from tersely.functions.rules import rules
from tersely.jobs.requests import compress_whole, metrics_rows
from tersely.operators import agent, context, formats, logs, requests, reuse, semantic
from tersely.operators.wire import wire
from tersely.queries import LOG, MODELS, _lead, _table, _tokens_sql, log, query
from tersely.sources.requests import parsed

#: An assistant's odd turns call a tool, a user's turns 2 and 6 bring its result (of a lost call in every fifth conversation),
#: and every seventh conversation begins with an image.
CALLS, RESULTS, IMAGES = "role = 'assistant' AND turn % 2 = 1", "role = 'user' AND turn % 4 = 2", "conv_id % 7 = 0 AND turn = 0"
CALL_ID, RESULT_OF = "concat(conv_id, '-', turn)", "CASE WHEN conv_id % 5 = 0 THEN concat('lost', conv_id) ELSE concat(conv_id, '-', turn - 1) END"
INPUT, RESULT = """concat('{"q":', turn, '}')""", "concat(text, ' ', text)"
_NUMBERED = "(SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)"


def _conversations(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "conversations").withColumn("text", F.coalesce("text", F.lit("")))


def whole(spark: SparkSession, sf: str) -> DataFrame:
    """``request_id, model, level, system, system_is_string, messages, tools`` of each conversation."""
    held = F.expr(f"""filter(array(
        named_struct('type', 'text', 'text', text, 'id', string(null), 'name', string(null), 'input', string(null), 'tool_use_id', string(null), 'result', string(null), 'parts', cast(null AS array<struct<type:string,text:string>>), 'raw', string(null)),
        if({CALLS}, named_struct('type', 'tool_use', 'text', string(null), 'id', {CALL_ID}, 'name', 'search', 'input', {INPUT}, 'tool_use_id', string(null), 'result', string(null), 'parts', cast(null AS array<struct<type:string,text:string>>), 'raw', string(null)), null),
        if({RESULTS}, named_struct('type', 'tool_result', 'text', string(null), 'id', string(null), 'name', string(null), 'input', string(null), 'tool_use_id', {RESULT_OF}, 'result', {RESULT}, 'parts', cast(null AS array<struct<type:string,text:string>>), 'raw', string(null)), null),
        if({IMAGES}, named_struct('type', 'image', 'text', string(null), 'id', string(null), 'name', string(null), 'input', string(null), 'tool_use_id', string(null), 'result', string(null), 'parts', cast(null AS array<struct<type:string,text:string>>), 'raw', string(null)), null)), b -> b is not null)""")
    rows = _conversations(spark, sf).withColumn("blocks", held)
    each = F.struct("turn", F.struct("role", (F.size("blocks") == 1).alias("is_string"), "blocks").alias("m"))
    out = rows.groupBy(F.col("conv_id").alias("request_id")).agg(F.transform(F.sort_array(F.collect_list(each)), lambda x: x["m"]).alias("messages"))
    k = F.col("request_id")
    return out.select(
        "request_id", _lead(k % 6, MODELS).alias("model"), F.when(k % 3 == 0, 0.3).when(k % 3 == 1, 0.6).otherwise(1.0).alias("level"), F.array(F.struct(F.lit("text").alias("type"), F.concat(F.lit("You are a guide. Please note that it is very useful to be "), k.cast("string"), F.lit(".")).alias("text"), F.lit(False).alias("cached"))).alias("system"),
        F.lit(True).alias("system_is_string"), "messages", F.array(F.struct(F.lit("search").alias("name"), F.lit("Finds things. Quickly.").alias("description"), F.lit('{"properties":{"q":{"type":"string","description":"what"}},"required":["q"]}').alias("schema"))).alias("tools"),
    )


def _message_sql(result: str = RESULT) -> str:
    return f"4 + {_tokens_sql('text')} + CASE WHEN {CALLS} THEN {_tokens_sql(chr(39) + 'search' + chr(39))} + {_tokens_sql(INPUT)} + 10 ELSE 0 END + CASE WHEN {RESULTS} THEN {_tokens_sql(result)} + 8 ELSE 0 END + CASE WHEN {IMAGES} THEN 1600 ELSE 0 END"


@query("request_block_tokens", f"SELECT conv_id AS request_id, CAST(sum({_message_sql()}) + max(6 + {_tokens_sql(chr(39) + 'You are a guide. Please note that it is very useful to be ' + chr(39) + ' || conv_id || ' + chr(39) + '.' + chr(39))}) AS BIGINT) AS tokens, count(*) AS messages FROM conversations GROUP BY conv_id")
def request_block_tokens(spark, sf):
    r = whole(spark, sf)
    return r.select("request_id", requests.request_tokens(F.col("system"), F.col("system_is_string"), F.col("messages")).alias("tokens"), F.size("messages").cast("long").alias("messages"))


_BLOCKS = f"""SELECT conv_id, i, 0 AS j, 'text' AS type, text AS body FROM {_NUMBERED} UNION ALL SELECT conv_id, i, 1, 'tool_use', concat({CALL_ID}, {INPUT}) FROM {_NUMBERED} WHERE {CALLS}
    UNION ALL SELECT conv_id, i, 1, 'tool_result', concat({RESULT_OF}, {RESULT}) FROM {_NUMBERED} WHERE {RESULTS} UNION ALL SELECT conv_id, i, CASE WHEN ({CALLS}) OR ({RESULTS}) THEN 2 ELSE 1 END, 'image', '' FROM {_NUMBERED} WHERE {IMAGES}"""


@query("request_blocks", f"SELECT conv_id AS request_id, i AS msg_idx, CAST(j AS INT) AS block_idx, type, md5(body) AS body_md5 FROM ({_BLOCKS})")
def request_blocks(spark, sf):
    """The blocks of requests that were taken apart and put together again."""
    back = requests.assemble(requests.blocks(whole(spark, sf)))
    body = F.concat(*[F.coalesce(c, F.lit("")) for c in ("text", "id", "input", "tool_use_id", "result")])
    return requests.blocks(back).select("request_id", "msg_idx", "block_idx", "type", F.md5(body).alias("body_md5"))


_CUT = agent.CUT.replace("{n}", f"', strlen({RESULT}), '")


@query("agent_tool_results", f"SELECT conv_id AS request_id, i AS msg_idx, md5(CASE WHEN strlen({RESULT}) > CASE WHEN i < greatest(n - 4, 0) THEN 200 ELSE 2000 END THEN concat('{_CUT}') ELSE {RESULT} END) AS result_md5 FROM {_NUMBERED} WHERE {RESULTS}")
def agent_tool_results(spark, sf):
    out = requests.blocks(agent.prune_results(whole(spark, sf))).where("type = 'tool_result'")
    return out.select("request_id", "msg_idx", F.md5("result").alias("result_md5"))


_TRACES = "concat('Traceback (most recent call last):', chr(10), '  File \"a.py\", line ', turn % 3, chr(10), 'ValueError: x', chr(10), text)"


@query("agent_repeated_errors", "SELECT conv_id AS request_id, CAST(count(*) - count(DISTINCT turn % 3) AS INT) AS n_errors FROM conversations GROUP BY conv_id")
def agent_repeated_errors(spark, sf):
    rows = _conversations(spark, sf).withColumn("text", F.expr(_TRACES.replace("chr(10)", "'\\n'")))
    one = F.struct("turn", requests.message(F.col("role"), F.col("text")).alias("m"))
    nested = rows.groupBy(F.col("conv_id").alias("request_id")).agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["m"]).alias("messages"))
    return agent.dedup_errors(nested).select("request_id", "n_errors")


@query("agent_windows", f"SELECT conv_id AS request_id, t > 80 AS windowed, CAST(CASE WHEN t > 80 AND n > 2 + 4 THEN 2 + 2 ELSE n END AS BIGINT) AS messages FROM (SELECT conv_id, max(n) AS n, sum({_message_sql()}) AS t FROM {_NUMBERED} GROUP BY conv_id)")
def agent_windows(spark, sf):
    r = whole(spark, sf).drop("tools").withColumn("system", F.lit(None).cast(requests.SYSTEM))
    return agent.sliding_window(r, max_tokens=100, preserve=1).select("request_id", "windowed", F.size("messages").cast("long").alias("messages"))


@query("agent_passes")
def agent_passes(spark, sf):
    """All steps on agent logs, with what each of them did."""
    out = agent.optimize(whole(spark, sf))
    return out.select("request_id", "n_results", "n_thoughts", "n_errors", "n_views", "windowed", "bytes_saved", F.element_at("system", -1)["cached"].alias("cached"))


@query("minimized_tools", "SELECT conv_id AS request_id, 'Finds things. Sig: search({  q: string})' AS description, '{\"properties\":{\"q\":{\"type\":\"string\"}},\"required\":[\"q\"]}' AS schema FROM conversations GROUP BY conv_id")
def minimized_tools(spark, sf):
    return agent.minimize_tools(whole(spark, sf).select("request_id", F.explode("tools").alias("t")).select("request_id", "t.*")).select("request_id", "description", "schema")


_RECENT = f"(SELECT *, n - i <= least(2, n - 2) AS recent FROM {_NUMBERED})"
_ORPHANS = f"(SELECT r.conv_id, r.result_of FROM (SELECT conv_id, {RESULT_OF} AS result_of FROM {_RECENT} WHERE recent AND {RESULTS}) r ANTI JOIN (SELECT conv_id, {CALL_ID} AS id FROM {_RECENT} WHERE recent AND {CALLS}) c ON r.conv_id = c.conv_id AND r.result_of = c.id)"


@query("tool_pairs", f"""SELECT m.conv_id AS request_id, CAST(count(*) FILTER (WHERE recent) + coalesce(max(found), 0) AS BIGINT) AS messages, CAST(count(*) FILTER (WHERE recent AND {RESULTS}) - coalesce(max(lost), 0) AS BIGINT) AS results
    FROM {_RECENT} m LEFT JOIN (SELECT o.conv_id, count(c.id) AS found, count(*) - count(c.id) AS lost FROM {_ORPHANS} o LEFT JOIN (SELECT conv_id, {CALL_ID} AS id FROM {_RECENT} WHERE NOT recent AND {CALLS}) c ON o.conv_id = c.conv_id AND o.result_of = c.id GROUP BY o.conv_id) x ON m.conv_id = x.conv_id GROUP BY m.conv_id""")
def tool_pairs(spark, sf):
    """Recent messages with a call for every result."""
    n = F.size("messages")
    keep = F.least(F.lit(2), n - 2)
    older = F.slice("messages", F.lit(1), F.greatest(n - keep, F.lit(0)))
    recent = F.when(keep > 0, F.slice("messages", n - keep + 1, F.greatest(keep, F.lit(1)))).otherwise(F.slice("messages", 1, 0))
    out = whole(spark, sf).select("request_id", context.repaired(older, recent).alias("m"))
    results = F.aggregate("m", F.lit(0), lambda k, m: k + F.size(F.filter(m["blocks"], lambda b: b["type"] == "tool_result")))
    return out.select("request_id", F.size("m").cast("long").alias("messages"), results.cast("long").alias("results"))


@query("context_summaries")
def context_summaries(spark, sf):
    """Conversations of six messages or more with their older messages summarized."""
    out = context.summarize_requests(whole(spark, sf), max_tokens=100, preserve=1)
    first = F.get(F.get("messages", F.lit(0))["blocks"], F.lit(0))["text"]
    return out.select("request_id", "n_older", F.size("messages").alias("messages"), F.md5(first).alias("first_md5"))


@query("condenser_candidates", f"""SELECT conv_id AS request_id, CAST(CASE WHEN t >= 60 AND k > 6 THEN k - 4 ELSE 0 END AS INT) AS n_condensed FROM (
    SELECT conv_id, count(*) FILTER (WHERE role <> 'system') AS k, sum(CASE WHEN role <> 'system' AND NOT ({CALLS}) AND NOT ({RESULTS}) AND NOT ({IMAGES}) THEN {_tokens_sql('text')} ELSE 0 END) AS t FROM conversations GROUP BY conv_id)""")
def condenser_candidates(spark, sf):
    return semantic.candidates(whole(spark, sf), history=60).select("request_id", F.col("n_condensed").cast("int").alias("n_condensed"))


@query("split_systems", "SELECT conv_id AS request_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE role = 'system')) AS system_md5, count(*) FILTER (WHERE role <> 'system') AS messages, 4096 AS max_tokens FROM conversations GROUP BY conv_id")
def split_systems(spark, sf):
    out = formats.split_system(whole(spark, sf))
    return out.select("request_id", F.md5(F.get("system", F.lit(0))["text"]).alias("system_md5"), F.size("messages").cast("long").alias("messages"), "max_tokens")


_STOPS = "CASE event_id % 4 WHEN 0 THEN 'end_turn' WHEN 1 THEN 'max_tokens' WHEN 2 THEN 'tool_use' ELSE 'other' END"


@query("chat_responses", """SELECT concat('chatcmpl-', event_id) AS id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat(event_type, chr(10), 'end') END AS content, CASE WHEN event_id % 2 = 0 THEN concat('[{"id":"c', event_id, '","type":"function","function":{"name":"search","arguments":"{}"}}]') END AS tool_calls,
    CASE event_id % 4 WHEN 1 THEN 'length' WHEN 2 THEN 'tool_calls' ELSE 'stop' END AS finish_reason, user_id + event_id AS total_tokens FROM events""")
def chat_responses(spark, sf):
    e = _table(spark, sf, "events")
    none = F.lit(None).cast("string")
    block = lambda kind, body, k, name, arg: F.struct(F.lit(kind).alias("type"), body.alias("text"), k.alias("id"), name.alias("name"), arg.alias("input"))
    written, called = F.col("event_id") % 3 != 0, F.col("event_id") % 2 == 0
    call = block("tool_use", none, F.concat(F.lit("c"), F.col("event_id").cast("string")), F.lit("search"), F.lit("{}"))
    held = F.filter(F.array(F.when(written, block("text", F.col("event_type"), none, none, none)), F.when(written, block("text", F.lit("end"), none, none, none)), F.when(called, call)), lambda b: b.isNotNull())
    rows = e.select(F.col("event_id").cast("string").alias("id"), F.lit("m").alias("model"), held.alias("blocks"), F.expr(_STOPS).alias("stop_reason"), F.col("user_id").alias("input_tokens"), F.col("event_id").alias("output_tokens"))
    return formats.chat_response(rows).select("id", "content", "tool_calls", "finish_reason", "total_tokens")


@query("stream_chunks", """SELECT conv_id, turn, md5(concat('data: {"choices":[{"delta":{"content":"t', turn, '"},"finish_reason":null,"index":0}],"id":"chatcmpl-stream","model":"m","object":"chat.completion.chunk"}', chr(10), chr(10), 'kept', chr(10),
    'data: {"choices":[{"delta":{},"finish_reason":"stop","index":0}],"id":"chatcmpl-stream","model":"m","object":"chat.completion.chunk"}', chr(10), chr(10), 'data: [DONE]', chr(10), chr(10))) AS lines_md5 FROM conversations""")
def stream_chunks(spark, sf):
    n = F.lit("\n")
    chunk = F.concat(F.lit('event: x\ndata: {"type":"content_block_delta","delta":{"type":"text_delta","text":"t'), F.col("turn").cast("string"), F.lit('"}}'), n, n, F.lit("kept"), n, F.lit('data: {"type":"message_stop"}'), n)
    return _table(spark, sf, "conversations").select("conv_id", "turn", F.md5(formats.stream_lines(chunk, F.lit("m"))).alias("lines_md5"))


@query("endpoints", f"""SELECT event_id, provider, CASE provider WHEN 'anthropic' THEN 'https://a.test' WHEN 'xai' THEN 'https://own.test/v2' ELSE 'https://o.test/v1' END AS base_url FROM (
    SELECT event_id, CASE WHEN model LIKE '%grok%' THEN 'xai' WHEN model LIKE '%claude%' THEN 'anthropic' WHEN model LIKE '%gemini%' THEN 'gemini' WHEN model LIKE '%gpt-%' THEN 'openai' WHEN model LIKE '%/%' THEN 'openrouter' ELSE 'openai' END AS provider FROM ({LOG}))""")
def endpoints(spark, sf):
    known = spark.createDataFrame([("anthropic", "https://a.test/"), ("openai", "https://o.test/v1//"), ("xai", "https://x.test")], "provider string, base_url string")
    own = spark.createDataFrame([("xai", "https://own.test/v2/")], "provider string, base_url string")
    rows = log(spark, sf).select("event_id", routing.provider(F.col("model")).alias("provider"))
    return formats.with_endpoint(rows, known, overrides=own).select("event_id", "provider", "base_url")


@query("reuse_by_key", "SELECT lang, count(*) AS lookups, count(DISTINCT (sha256(text), doc_id % 2, doc_id % 3)) AS distinct_texts, round(1 - count(DISTINCT (sha256(text), doc_id % 2, doc_id % 3)) / count(*), 6) AS reuse_rate FROM documents WHERE strlen(text) > 0 AND strlen(text) <= 65536 GROUP BY lang")
def reuse_by_key(spark, sf):
    """A text counts anew for each mode and level that it comes with."""
    d = _table(spark, sf, "documents").withColumns({"mode": F.col("doc_id") % 2, "level": F.col("doc_id") % 3})
    return logs.reuse(d, "text", ["lang"], within=("mode", "level"))


_TOLD = [(c, k, p) for c in ("adverb_strip", "clause_collapse") for k, (p, _) in enumerate(rules(c))]


@query("rule_telemetry", " UNION ALL ".join(f"SELECT '{c}.{k:03d}' AS rule_id, '{c}' AS category, CAST(count(*) FILTER (WHERE regexp_matches(text, '(?i){p.replace(chr(39), chr(39) * 2)}')) AS BIGINT) AS hits FROM documents" for c, k, p in _TOLD))
def rule_telemetry(spark, sf):
    """Texts that each rule of two categories matches, those that match none included."""
    known = spark.createDataFrame([(f"{c}.{k:03d}", c) for c, k, _ in _TOLD], "rule_id string, category string")
    d = _table(spark, sf, "documents")
    d = d.select("text", text.held_as_is(F.col("text"), "adverb_strip", "clause_collapse").alias("w"))
    found = d.select(F.explode(F.concat(*[text.matching_rules(F.col("text"), c, F.col("w")) for c in ("adverb_strip", "clause_collapse")])).alias("rule_id"))
    return logs.rule_hits(found.groupBy("rule_id").agg(F.count("*").alias("hits")), known)


@query("whole_requests")
def whole_requests(spark, sf):
    """Whole requests compressed by their own levels and profiles, with tokens and rule hits."""
    done = compress_whole(whole(spark, sf), hits=True)
    return metrics_rows(done.withColumn("ts", F.lit(0.0))).select("request_id", "original_tokens", "optimized_tokens", "token_savings", "compression_level", "total_rule_hits", F.array_join(F.transform("top_categories", lambda x: F.concat(x["name"], F.lit("="), x["hits"].cast("string"))), ",").alias("top_categories"))


#: Openings of texts that rules of every category match.
FIRING = [
    "user: [[reply_to_current]] Please note that in order to utilize this, it is able to act. You should verify ,  all .. parts. In situations where you need to, do not stop. January 4th, 2025. ",
    "Your task is to write a function that sorts both cats and dogs. You are a helpful guide with over 10 years of experience in law. Thanks a lot! I hope this helps! Could you please look into it. ",
    "#### Head\n* **bold** *it*<br/>[here](u)\nSee /usr/share/lib/python/pkg/ and 123e4567-e89b-12d3-a456-426614174000. Legal, tax, and privacy concerns while maintaining clear form, very briefly. ",
    "```python\nimport os\nx = {  1, }\n# a comment line\n```\nThanks!\nThis is not legal advice. Please consult a qualified professional before making any decisions. ",
    "As an AI language model, I cannot provide medical advice. Furthermore, it depends on several factors that help so as to win, without getting overly technical. ",
]
#: Patterns with look-around as DuckDB can say them; they differ only on texts that these queries don't have.
_PLAIN = {
    r"(?<!\*)\*(?!\*)([^*]+)(?<!\*)\*(?!\*)": (r"(^|[^*])\*([^*]+)\*([^*]|$)", r"\1\2\3"), r"(?m)^\s*//(?!\s*TODO)[^\n]{2,}$": (r"(?m)^\s*//[^\n]{2,}$", ""), r"(?m)^\s*#\s+(?!TODO|!|\s*$)[^\n]{3,}$": (r"(?m)^\s*#\s+[^\n]{3,}$", ""),
    r"(?s)/\*(?!\*/).*?\*/": (r"(?s)/\*.*?\*/", ""), r'(?s)"{3}(?!.*(?:TODO|FIXME|NOTE)).*?"{3}': (r'(?s)"{3}.*?"{3}', ""), r"(?s)'{3}(?!.*(?:TODO|FIXME|NOTE)).*?'{3}": (r"(?s)'{3}.*?'{3}", ""),
    r"(?m)^\s*\n(?=\s*\n)": (r"\n[^\S\n]*\n[^\S\n]*\n", ""), r"(?m)(^.{30,}$)\n(?:\1\n){2,}+": None, r"(?s)(U: .{200,}?)\n+\1": None,
}


def _rule_sql(step: program.Step, column: str) -> tuple[str, str]:
    """Whether a rule matches, and what it leaves."""
    found = _PLAIN.get(step.pattern, (step.pattern, re.sub(r"\$(\d)", r"\\\1", step.replacement)))
    if found is None:
        return "false", column
    pattern, to = found
    if pattern.endswith(r"(?=\.)"):
        pattern, to = pattern.replace(r"(?=\.)", r"\."), to + "."
    case, quoted = "i" if step.ignore_case else "", lambda x: "'" + x.replace("'", "''") + "'"
    if r"(?!\s+\w+\s+the)" in pattern:  # the words to keep are broken, then put together again
        column = rf"regexp_replace({column}, '\b(p)(lease\s+\w+\s+the)', concat('\1', chr(1), '\2'), 'gi')"
        return rf"regexp_matches({column}, '\bplease\b', 'i')", rf"replace(regexp_replace({column}, '\bplease\b', '', 'gi'), chr(1), '')"
    return f"regexp_matches({column}, {quoted(pattern)}, '{case or 'c'}')", f"regexp_replace({column}, {quoted(pattern)}, {quoted(to)}, 'g{case}')"


def _hits_sql() -> str:
    """The request chain in SQL, one step a category: ``id, t`` and its rules that matched."""
    parts, names, last = [f"s0 AS (SELECT id, lvl, prof, t, false AS code FROM ({_FIRING_SQL}))"], [], 0
    steps = [x for x in program.request_steps() if x.reads != "words"]
    at = 0
    while at < len(steps):
        if steps[at].reads:
            if steps[at].reads == "code":
                parts.append(f"s{last + 1} AS MATERIALIZED (SELECT id, lvl, prof, t, starts_with(trim(t, chr(10) || ' '), '```') AS code FROM s{last})")
                last += 1
            at += 1
            continue
        group = [steps[at]]
        while at + len(group) < len(steps) and not steps[at + len(group)].reads and (steps[at + len(group)].category, steps[at + len(group)].at, steps[at + len(group)].tested) == (group[0].category, group[0].at, group[0].tested):
            group.append(steps[at + len(group)])
        at += len(group)
        columns, hits = ["t AS t0"], []
        for k, step in enumerate(group):
            match, left = _rule_sql(step, f"t{k}")
            columns.append(f"{left} AS t{k + 1}")
            hits.append(f"CAST({match} AS INT)")
        when = "lvl > 0" if not group[0].at else "lvl > 0 AND lvl >= CASE prof " + " ".join(f"WHEN '{p}' THEN {t}" for p, t in group[0].at.items()) + " END"
        when += " AND code" if group[0].category == "source_code_compression" else ""
        parts.append(f"s{last + 1} AS MATERIALIZED (SELECT id, lvl, prof, code, CASE WHEN {when} THEN t{len(group)} ELSE t END AS t, CASE WHEN {when} THEN {' + '.join(hits)} ELSE 0 END AS hits FROM (SELECT *, {', '.join(columns)} FROM (SELECT id, lvl, prof, code, t FROM s{last})))")
        last += 1
        if group[0].category:
            names.append((last, group[0].category))
    counted = " UNION ALL ".join(f"SELECT '{c}' AS category, sum(hits) AS hits FROM s{k}" for k, c in names)
    return f"WITH {', '.join(parts)} SELECT category, CAST(sum(hits) AS BIGINT) AS hits FROM ({counted}) GROUP BY category"


_FIRING_SQL = "SELECT conv_id || '-' || turn AS id, CASE conv_id % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 0.6 ELSE 1.0 END AS lvl, CASE turn % 3 WHEN 0 THEN 'aggressive' WHEN 1 THEN 'balanced' ELSE 'conservative' END AS prof, CASE turn % 5 " + " ".join("WHEN {} THEN '{}'".format(k, x.replace("'", "''").replace("\n", "' || chr(10) || '")) for k, x in enumerate(FIRING)) + " END || coalesce(text, '') AS t FROM conversations"


def firing_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of the conversations, at three levels (one of them 0) and in three profiles, that rules of every category match."""
    level = F.when(F.col("conv_id") % 3 == 0, 0.0).when(F.col("conv_id") % 3 == 1, 0.6).otherwise(1.0)
    profile = F.when(F.col("turn") % 3 == 0, "aggressive").when(F.col("turn") % 3 == 1, "balanced").otherwise("conservative")
    return _conversations(spark, sf).select("conv_id", "turn", level.alias("level"), profile.alias("profile"), F.concat(_lead(F.col("turn") % 5, FIRING), "text").alias("text"))


@query("category_snapshot", _hits_sql())
def category_snapshot(spark, sf):
    """Rules that matched, by category, as a request's chain applies them: each on what the rules before it left."""
    done = firing_texts(spark, sf).select(program.run(program.request_program(), F.col("text"), F.col("level"), F.col("profile"))["hits"].alias("hits"))
    return logs.category_hits(done.select(program.tallied(F.col("hits"), program.DECLARED).alias("rule_hits"))).select("category", "hits")


_OWN_RULES = [("greetings", 1, r"\bdear\s+team\b,?\s*", "", True), ("greetings", 2, r"\bkind\s+regards\b", "KR", True), ("marks", 1, r"([!?]){2,}", "$1", False), ("marks", 2, r"#(\d+)", "no. $1", False)]
_OWN_AT = [("greetings", "balanced", 0.2), ("greetings", "conservative", 0.8), ("marks", "balanced", 0.5)]
_OWN_SQL = {c: [(p, re.sub(r"\$(\d)", r"\\\1", r), "gi" if i else "g") for k, _, p, r, i in _OWN_RULES if k == c] for c in ("greetings", "marks")}


def _own_sql() -> str:
    t, hits = "t", []
    for category, at in (("greetings", "CASE prof WHEN 'conservative' THEN 0.8 ELSE 0.2 END"), ("marks", "0.5")):
        for p, r, options in _OWN_SQL[category]:
            hits.append(f"CASE WHEN lvl > 0 AND lvl >= {at} AND regexp_matches({t}, '{p}', '{'i' if 'i' in options else 'c'}') THEN 1 ELSE 0 END")
            t = f"CASE WHEN lvl > 0 AND lvl >= {at} THEN regexp_replace({t}, '{p}', '{r}', '{options}') ELSE {t} END"
    return f"SELECT conv_id, turn, md5({t}) AS text_md5, CAST({' + '.join(hits)} AS BIGINT) AS hits FROM (SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 0.6 ELSE 1.0 END AS lvl, CASE turn % 3 WHEN 0 THEN 'aggressive' WHEN 1 THEN 'balanced' ELSE 'conservative' END AS prof, concat('Dear  Team, see #', turn, '!!! ', coalesce(text, ''), CASE conv_id % 2 WHEN 0 THEN ' Kind regards' ELSE '' END) AS t FROM conversations)"


@query("user_rules", _own_sql())
def user_rules(spark, sf):
    """A user's own rules and thresholds over the texts of the conversations."""
    own = program.user_program(spark.createDataFrame(_OWN_RULES, "category string, rule_idx int, pattern string, replacement string, ignore_case boolean"), spark.createDataFrame(_OWN_AT, "category string, profile string, threshold double"))
    rows = firing_texts(spark, sf).select("conv_id", "turn", "level", "profile")
    texts = _conversations(spark, sf).select("conv_id", "turn", F.concat(F.lit("Dear  Team, see #"), F.col("turn").cast("string"), F.lit("!!! "), "text", F.when(F.col("conv_id") % 2 == 0, " Kind regards").otherwise("")).alias("text"))
    done = rows.join(texts, ["conv_id", "turn"]).withColumn("x", program.run(own, F.col("text"), F.col("level"), F.col("profile")))
    return done.select("conv_id", "turn", F.md5("x.text").alias("text_md5"), F.size("x.hits").cast("bigint").alias("hits"))


_EXTRA = """concat('{"text":', CASE turn % 2 WHEN 0 THEN concat('"t', turn, '"') ELSE 'null' END, ',"type":"text","cache_control":{"ttl":"5m","type":"ephemeral"},"x":[1,2.5,{"b":null,"a":true}]}')"""
_SORTED = """concat('{"cache_control":{"ttl":"5m","type":"ephemeral"},"text":', CASE turn % 2 WHEN 0 THEN concat('"t', turn, '"') ELSE 'null' END, ',"type":"text","x":[1,2.5,{"a":true,"b":null}]}')"""


@query("wire_requests", f"""SELECT conv_id, md5(concat('{{"a":{{"y":', conv_id, ',"z":[]}},"messages":[', string_agg(CASE turn % 3 WHEN 0 THEN concat('{{"content":"m', turn, '","name":"n","role":"', role, '"}}') ELSE concat('{{"content":[', {_SORTED}, ',{{"content":[{{"text":"part","type":"text"}},{{"source":{{"a":1,"b":2}},"type":"image"}}],"tool_use_id":"t","type":"tool_result"}}],"role":"', role, '"}}') END, ',' ORDER BY turn), '],"model":"x","system":[{{"cache_control":{{"type":"ephemeral"}},"text":"s","type":"text"}}],"tools":[{{"description":"d","name":"f"}}]}}')) AS line_md5, CAST(round(strlen('[{{"description":"d","name":"f"}}]') / 3.5) + 8 AS BIGINT) AS tool_tokens FROM conversations GROUP BY conv_id""")
def wire_requests(spark, sf):
    """Requests read from JSON, compressed at level 0 and written back: what they were, with keys in order, unknown ones too."""
    message = F.expr(f"""CASE turn % 3 WHEN 0 THEN concat('{{"role":"', role, '","content":"m', turn, '","name":"n"}}') ELSE concat('{{"role":"', role, '","content":[', {_EXTRA}, ',{{"type":"tool_result","tool_use_id":"t","content":[{{"type":"text","text":"part"}},{{"type":"image","source":{{"b":2,"a":1}}}}]}}]}}') END""")
    rows = _conversations(spark, sf).groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", message.alias("m")))), lambda x: x["m"]), ",").alias("ms"))
    line = F.concat(F.lit('{"model":"x","tools":[{"name":"f","description":"d"}],"system":[{"type":"text","text":"s","cache_control":{"type":"ephemeral"}}],"messages":['), "ms", F.lit('],"a":{"z":[],"y":'), F.col("conv_id").cast("string"), F.lit("}}"))
    asked = rows.select("conv_id", parsed(line).alias("r")).select("conv_id", "r.*").withColumn("level", F.lit(0.0))
    done = compress_whole(asked, key="conv_id")
    tools = text.text_tokens(F.col("tools_json")) + requests.TOOL_EACH * F.json_array_length("tools_json")
    return wire(done).select("conv_id", F.md5("line").alias("line_md5"), tools.cast("bigint").alias("tool_tokens"))


_USES = "SELECT event_id, CAST(user_id % 50 AS VARCHAR) AS key, epoch_us(ts) AS t, CAST(event_id % 5 AS DOUBLE) AS c FROM events"


@query("ttl_reuse", f"""WITH RECURSIVE u AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, c, event_id) AS i FROM ({_USES})),
    m AS (SELECT key, t, c, i FROM u WHERE i = 1 UNION ALL SELECT key, x.t, x.c, x.i FROM (SELECT m.key AS key, min_by({{'t': u.t, 'c': u.c, 'i': u.i}}, u.i) AS x FROM m JOIN u ON u.key = m.key AND u.t >= m.t + 3600000000 GROUP BY m.key))
    SELECT u.event_id, u.key, u.i <> m.i AS hit, CASE WHEN u.i <> m.i THEN m.c ELSE 0 END AS saved_ms FROM u ASOF JOIN m ON u.key = m.key AND u.i >= m.i""")
def ttl_reuse(spark, sf):
    """Uses of a key within an hour of the miss that made its entry, with the time saved."""
    uses = _table(spark, sf, "events").select((F.col("user_id") % 50).cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 5).cast("double").alias("latency_ms"), "event_id")
    return reuse.reuse_report(uses, ttl=3600.0).select("event_id", "key", "hit", "saved_ms")


@query("reuse_by_sketches", """SELECT lang, count(*) AS lookups, true AS is_close, count(DISTINCT doc_id % 30) AS days FROM documents WHERE strlen(text) > 0 AND strlen(text) <= 65536 AND doc_id % 30 BETWEEN 3 AND 20 GROUP BY lang""")
def reuse_by_sketches(spark, sf):
    """Reuse of texts over a stretch of days from the sketches of single days; held against the exact count, within 2 %."""
    texts = _table(spark, sf, "documents").withColumn("day", F.col("doc_id") % 30)
    sketches = reuse.reuse_sketches(texts, "text", ["lang"], "day")
    told = reuse.reuse_over(sketches, ["lang"], F.lit(3), F.lit(20))
    exact = logs.reuse(texts.where("day between 3 and 20"), "text", ["lang"]).select("lang", F.col("distinct_texts").alias("exact"))
    days = sketches.where("day between 3 and 20").groupBy("lang").agg(F.count("*").alias("days"))
    return told.join(exact, "lang").join(days, "lang").select("lang", "lookups", (F.abs(F.col("distinct_texts") - F.col("exact")) <= 0.02 * F.col("exact")).alias("is_close"), "days")


@query("effective_levels", "SELECT event_id, round(CASE WHEN h IS NULL THEN 0.5 ELSE least(1.0, greatest(0.0, h)) END, 6) AS level FROM (SELECT event_id, CASE user_id % 5 WHEN 0 THEN CAST(value AS DOUBLE) / 100 WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN -1.0 ELSE 0.7 END AS h FROM events)")
def effective_levels(spark, sf):
    """Levels that requests ask for in a header: numbers are brought to 0 to 1, all else leaves the configured one."""
    e, n = _table(spark, sf, "events"), F.col("user_id") % 5
    header = F.when(n == 0, (F.col("value").cast("double") / 100).cast("string")).when(n == 1, "high").when(n == 3, "-1").when(n == 4, " 0.7 ")
    return e.select("event_id", F.round(routing.effective_level(header, F.lit(0.5)), 6).alias("level"))


_FORMS = ["", "```python\n", "import a\nclass B:\n", '{"a": "', "const x = () => 1\n", "def "]


@query("code_texts", "SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN false WHEN 5 THEN false WHEN 3 THEN true ELSE true END AS is_code FROM conversations")
def code_texts(spark, sf):
    """Which texts are code or JSON as a whole."""
    rows = _conversations(spark, sf)
    text_ = F.concat(_lead(F.col("turn") % 6, _FORMS), F.when(F.col("turn") % 6 == 3, F.regexp_replace("text", r'[\\"\n]', " ")).otherwise(F.col("text")), F.when(F.col("turn") % 6 == 3, '"}').otherwise(""))
    return rows.select("conv_id", "turn", F.coalesce(normalize.code_or_json(text_), F.lit(False)).alias("is_code"))


@query("answer_texts", "SELECT conv_id, md5(CASE WHEN conv_id % 4 = 0 THEN '' ELSE string_agg(text, ' ' ORDER BY turn) FILTER (role <> 'system') END) AS text_md5 FROM conversations GROUP BY conv_id")
def answer_texts(spark, sf):
    """The texts of answers of many blocks; those of failed requests are empty."""
    block = F.struct(F.when(F.col("role") == "system", "image").otherwise("text").alias("type"), F.col("text"))
    rows = _conversations(spark, sf).groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", block.alias("b")))), lambda x: x["b"]).alias("blocks"))
    return rows.select("conv_id", F.md5(formats.answer_text(F.when(F.col("conv_id") % 4 == 0, 500).otherwise(200), F.col("blocks"))).alias("text_md5"))


@query("sorted_tools", "SELECT conv_id, string_agg(concat(name, '.', turn), ',' ORDER BY name, turn) AS names FROM (SELECT conv_id, turn, concat('t', (turn * 7 + conv_id) % 5) AS name FROM conversations) GROUP BY conv_id")
def sorted_tools(spark, sf):
    """Tools by name; equal names stay in their order."""
    tool = F.struct(F.concat(F.lit("t"), ((F.col("turn") * 7 + F.col("conv_id")) % 5).cast("string")).alias("name"), F.col("turn").alias("nth"))
    rows = _conversations(spark, sf).groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", tool.alias("t")))), lambda x: x["t"]).alias("tools"))
    return rows.select("conv_id", F.array_join(F.transform(normalize.sort_tools(F.col("tools")), lambda t: F.concat(t["name"], F.lit("."), t["nth"].cast("string"))), ",").alias("names"))


@query("isolation_keys", "SELECT doc_id, concat('sys:', sha256(concat(lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))), chr(31), CASE doc_id % 3 WHEN 0 THEN '' ELSE 'ws' || (doc_id % 3) END, chr(31), CASE doc_id % 2 WHEN 0 THEN '' ELSE source END))) AS isolation_key FROM documents WHERE text IS NOT NULL")
def isolation_keys(spark, sf):
    """Keys under which condensed prompts are kept: a text whatever its case and spacing, apart by workspace and user."""
    d = _table(spark, sf, "documents").where("text is not null")
    workspace = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("ws"), (F.col("doc_id") % 3).cast("string")))
    return d.select("doc_id", semantic.isolation_key("sys", F.col("text"), workspace, F.when(F.col("doc_id") % 2 != 0, F.col("source"))).alias("isolation_key"))


@query("snapshot_totals", f"SELECT count(*) AS requests, CAST(sum(event_id % 4) AS BIGINT) AS rule_hits, CAST(sum(original_tokens) AS BIGINT) AS original_tokens, CAST(sum(optimized_tokens) AS BIGINT) AS optimized_tokens, CAST(sum(event_id % 7) AS BIGINT) AS response_tokens_saved, CAST(sum(original_tokens) - sum(optimized_tokens) AS BIGINT) AS token_savings, round((sum(original_tokens) - sum(optimized_tokens)) / sum(original_tokens) * 100, 4) AS savings_percent FROM ({LOG})")
def snapshot_totals(spark, sf):
    """All that a log has counted since it began."""
    hits = F.array(F.struct(F.lit("filler_phrases").alias("category"), (F.col("event_id") % 4).alias("hits")))
    return logs.snapshot(log(spark, sf).select("original_tokens", "optimized_tokens", (F.col("event_id") % 7).alias("response_tokens_saved"), hits.alias("rule_hits")))


@query("used_tools", """SELECT conv_id AS request_id, CASE WHEN count(*) FILTER ((role = 'assistant' AND turn % 2 = 1) OR (role = 'user' AND turn % 4 = 2)) > 0
    THEN '[{"description":"Finds things. Sig: search({  q: string})","input_schema":{"properties":{"q":{"type":"string"}},"required":["q"]},"name":"search"}]'
    ELSE '[{"description":"Finds things. Quickly.","input_schema":{"properties":{"q":{"description":"what","type":"string"}},"required":["q"]},"name":"search"}]' END AS tools_json FROM conversations GROUP BY conv_id""")
def used_tools(spark, sf):
    """Tools of requests, minimized where the request's messages already use them."""
    return agent.minimize_used_tools(whole(spark, sf)).select("request_id", "tools_json")


@query("compression_sweep")
def compression_sweep(spark, sf):
    """The messages of the conversations at five levels in three profiles: tokens, and how many texts grew or rose from a level to the next."""
    from tersely.jobs.compress import monotony, sweep

    rows = _conversations(spark, sf).where("role <> 'assistant'").select("conv_id", "turn", F.concat(_lead(F.col("turn") % 5, FIRING), "text").alias("text"))
    done = monotony(sweep(rows, [0.0, 0.3, 0.5, 0.8, 1.0]), "conv_id", "turn")
    return done.groupBy("profile", "level").agg(F.count("*").alias("texts"), F.sum("original_tokens").alias("original_tokens"), F.sum("optimized_tokens").alias("optimized_tokens"), F.count_if("inflated").alias("inflated"), F.count_if("rises").alias("rises"))
