"""Whole requests: reading, tokens, context, agent logs, formats, condensing and compression, against plain Python."""

import json
import re

import pytest
from pyspark.sql import functions as F

from tersely import request_queries
from tersely.functions import text as T
from tersely.functions.normalize import distinct_lines, normalize_requests
from tersely.functions.program import DECLARED
from tersely.functions.rules import CATEGORIES
from tersely.jobs import requests as jobs
from tersely.jobs.compress import compress_requests, compress_responses
from tersely.operators import agent, context, formats, logs, requests, reuse, semantic
from tersely.queries import LEADS
from tersely.sources.logs import append_stability, read_stability
from tersely.sources.requests import read_requests

TRACE = 'Traceback (most recent call last):\n  File "/usr/lib/python3/x.py", line 1\n  File "a.py"\nValueError: x\nnext'
REQUESTS = [
    {"request_id": "a", "model": "claude-sonnet-4", "level": 1.0, "system": "You are a guide. Please note that it is very useful.", "tools": [{"name": "search", "description": "Finds. Things.", "input_schema": {"properties": {"q": {"type": "string", "description": "d"}}}}], "messages": [
        {"role": "user", "content": "We decided to use 10.0.0.1 in order to fix the bug. Hello."},
        {"role": "assistant", "content": [{"type": "text", "text": "<thinking>" + "long " * 30 + "</thinking> I hope this helps! The answer is 42 in this case."}, {"type": "tool_use", "id": "t1", "name": "search", "input": {"b": 1, "a": 2}}]},
        {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": "r" * 300}, {"type": "image", "source": {"x": 1}}]},
        {"role": "assistant", "content": "[not a list]"},
        {"role": "user", "content": TRACE},
        {"role": "assistant", "content": [{"type": "text", "text": "ok " + TRACE}]},
        {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": [{"type": "text", "text": "part one"}]}, {"type": "tool_result", "tool_use_id": "zz", "content": "lost"}]},
        {"role": "assistant", "content": "done"},
    ]},
    {"request_id": "b", "model": "x", "level": 0.0, "system": [{"type": "text", "text": "sys", "cache_control": {"type": "ephemeral"}}], "messages": [{"role": "user", "content": "hi"}]},
    {"request_id": "c", "model": "x", "level": 0.5, "messages": []},
]


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("log") / "requests.jsonl"
    path.write_text("\n".join(map(json.dumps, REQUESTS)) + '\nnot json\n{"x": 1}\n')
    return read_requests(spark, str(path)).cache()


def slow_tokens(text):
    code = sum(len(x.encode()) for x in re.findall(r"(?s)```.*?```", text))
    return max(1, int((len(text.encode()) - code) / 3.5 + code / 3 + 0.5)) if text else 0


def texts(m):
    return [b.text for b in m.blocks if b.type == "text"]


def test_reading_keeps_shapes_and_tokens_add_up(rows):
    got = {r.request_id: r for r in rows.collect()}
    assert set(got) == {"a", "b", "c"} and got["a"].system_is_string and not got["b"].system_is_string and got["b"].system[0].cached
    m = got["a"].messages
    assert [x.is_string for x in m] == [True, False, False, True, True, False, False, True] and texts(m[3]) == ["[not a list]"]
    assert m[1].blocks[1].input == '{"b":1,"a":2}' and m[6].blocks[0].parts[0].text == "part one" and m[6].blocks[1].result == "lost"
    tokens = {r.request_id: r.t for r in rows.select("request_id", requests.request_tokens(F.col("system"), F.col("system_is_string"), F.col("messages")).alias("t")).collect()}
    n = 6 + slow_tokens(REQUESTS[0]["system"])
    for x in REQUESTS[0]["messages"]:
        n += 4
        for b in [{"type": "text", "text": x["content"]}] if isinstance(x["content"], str) else x["content"]:
            if b["type"] == "text":
                n += slow_tokens(b["text"])
            elif b["type"] == "tool_use":
                n += slow_tokens(b["name"]) + slow_tokens('{"b":1,"a":2}') + 10
            elif b["type"] == "tool_result":
                n += slow_tokens(b["content"] if isinstance(b["content"], str) else b["content"][0]["text"]) + 8
            else:
                n += 1600
    assert tokens == {"a": n, "b": 6 + 1 + 4 + 1, "c": 0}


def test_taking_apart_and_putting_together(rows):
    back = requests.assemble(requests.blocks(rows).repartition(3)).join(rows.select("request_id", F.col("messages").alias("m")), "request_id")
    assert back.count() == 2 and back.where(~F.col("messages").eqNullSafe(F.col("m"))).count() == 0


def test_context_is_summarized_and_tool_pairs_are_repaired(rows):
    got = {r.request_id: r for r in context.summarize_requests(rows, max_tokens=10, preserve=1).collect()}
    a = got["a"].messages
    assert got["a"].n_older == 6 and got["b"].n_older == got["c"].n_older == 0 and len(got["b"].messages) == 1
    assert texts(a[0])[0] == "[Context Summary of 6 earlier messages]\nKey points:\n- User stated: We decided to use 10.0.0.1 in order to fix the bug.\n- The answer is 42 in this case.\n\nTool interactions:\n- Called tool: search\n- Tool result: " + "r" * 200
    assert texts(a[1]) == [context.ANSWER] and a[2].blocks[1].id == "t1"  # the call that the recent result needs
    assert [b.tool_use_id for b in a[3].blocks] == ["t1"] and texts(a[4]) == ["done"] and len(a) == 5


def test_cut_bytes_never_splits_a_character(spark):
    for size in range(4, 12):
        text = "aé日🎉b" * 3
        got = spark.range(1).select(context.cut_bytes(F.lit(text), size).alias("t")).first().t
        want = text.encode()[:size].decode("utf-8", "ignore")
        assert got == want + "\n[...truncated]"


def test_agent_steps(rows):
    r = agent.optimize(rows).where("request_id = 'a'").first()
    assert (r.n_results, r.n_thoughts, r.n_errors, r.windowed) == (1, 1, 1, False) and r.system[-1].cached and r.bytes_saved > 300
    m = r.messages
    assert texts(m[1]) == [agent.THOUGHT_CUT + " I hope this helps! The answer is 42 in this case."] and m[2].blocks[0].result == "[tool output of 300 bytes cut]"
    assert "/usr/lib" not in texts(m[4])[0] and texts(m[5]) == ["ok " + agent.SAME + "alueError: x\nnext"]
    w = agent.sliding_window(rows, max_tokens=10, preserve=1, result_age=1, thought_age=1).where("request_id = 'a'").first().messages
    assert len(w) == 4 and texts(w[0])[0].startswith("[Window: older messages cut]") and texts(w[0])[0].count("user: ") == 3
    view = 'x = 1  # note\n"""doc"""\n\n\n\n' + "y = 2  # type: int\n" * 8
    one = rows.where("request_id = 'b'").withColumn("messages", F.transform("messages", lambda m: F.struct(F.lit("user").alias("role"), F.lit(False).alias("is_string"), F.transform(m["blocks"], lambda b: b.withField("type", F.lit("tool_result")).withField("result", F.lit(view))).alias("blocks"))))
    assert agent.condense_views(one).first().messages[0].blocks[0].result == 'x = 1\n""""\n\n' + "y = 2  # type: int\n" * 8
    tool = agent.minimize_tools(rows.select(F.explode("tools").alias("t")).select("t.*")).first()
    assert tool.description == "Finds. Sig: search({  q?: string})" and tool.schema == '{"properties":{"q":{"type":"string"}}}'


def test_normalized_requests(spark, rows):
    r = {x.request_id: x for x in normalize_requests(rows).collect()}
    assert r["a"].system[0].text.endswith("unverified claims.") and r["b"].system[0].text.startswith("sys\nIf information") and r["c"].system is None
    text = "Always be kind.\nplease be kind\n\nBe brave!\n\nbe  BRAVE"
    assert spark.range(1).select(distinct_lines(F.lit(text)).alias("t")).first().t == "Always be kind.\n\nBe brave!\n"


def test_condensing_and_reuse(spark, rows):
    calls = {r.request_id: r for r in semantic.condense(rows, lambda t: None if t.startswith("sys") else "short", system=1, history=1).collect()}
    assert calls["a"].system[0].text == "short" and calls["b"].system[0].text == "sys" and len(calls["a"].messages) == 6
    assert texts(calls["a"].messages[0]) == ["[Semantic Summary of 4 messages]\nshort"]
    assert semantic.condense(rows, lambda t: t + " and longer", system=1, history=1).where("request_id = 'a'").first().system[0].text == REQUESTS[0]["system"]
    uses = [("k", 0.0, 5.0), ("k", 299.0, 1.0), ("k", 300.0, 7.0), ("k", 599.9, 1.0), ("j", 10.0, 2.0), (None, 1.0, 1.0)]
    got = reuse.reuse_report(spark.createDataFrame(uses, "key string, ts double, latency_ms double").repartition(3)).collect()
    assert sorted((r.key, r.ts, r.hit, r.saved_ms) for r in got) == [("j", 10.0, False, 0.0), ("k", 0.0, False, 0.0), ("k", 299.0, True, 5.0), ("k", 300.0, False, 0.0), ("k", 599.9, True, 7.0)]


def test_formats(spark):
    assert spark.range(1).select(formats.answer_text(F.lit(500), F.lit(None).cast("array<struct<type:string,text:string>>")).alias("t")).first().t == ""
    chunk = 'event: x\ndata: {"type":"content_block_delta","delta":{"type":"text_delta","text":"h\\"é"}}\n\ndata: {"type":"ping"}\nraw\ndata: nojson\ndata: [DONE]\n'
    out = spark.range(1).select(formats.stream_lines(F.lit(chunk), F.lit("m")).alias("t")).first().t
    first, rest = out.split("\n\n", 1)
    assert json.loads(first[6:])["choices"] == [{"delta": {"content": 'h"é'}, "finish_reason": None, "index": 0}] and rest == "raw\ndata: nojson\ndata: [DONE]\n\n"


def test_whole_requests_are_their_texts_compressed(spark, rows):
    done = jobs.compress_whole(rows, hits=True).cache()
    got = {r.request_id: r for r in done.collect()}
    one = lambda t, f: f(spark.createDataFrame([(t, 1.0, "aggressive")], "text string, level double, profile string")).first().compressed
    before, m = {r.request_id: r.messages for r in rows.collect()}, got["a"].messages
    assert texts(m[0]) == [one(texts(before["a"][0])[0], compress_requests)] and texts(m[1]) == [one(texts(before["a"][1])[0], compress_responses)]
    assert m[1].blocks[1] == before["a"][1].blocks[1] and m[2].blocks[1] == before["a"][2].blocks[1]  # calls and images stay
    assert texts(m[5]) == texts(before["a"][5]) and got["b"].messages == before["b"] and got["c"].messages == []
    assert got["a"].optimized_tokens < got["a"].original_tokens and got["a"].responses_compressed == 1 and [x.category for x in got["a"].rule_hits] == list(DECLARED)
    metrics = {r.request_id: r for r in jobs.metrics_rows(done.withColumn("ts", F.lit(1.0))).collect()}
    assert len(metrics["a"].top_categories) == 5 and metrics["a"].total_rule_hits == sum(x.hits for x in got["a"].rule_hits)
    total = logs.snapshot(done).first()
    assert total.requests == 3 and total.token_savings == sum(r.original_tokens - r.optimized_tokens for r in got.values())


def test_gated_rules_equal_all_rules(spark):
    base = " ".join(LEADS)
    odd = ["ıs ıt ımportant to note that KINDLY ſo as to utilİze", "**".join(base[k : k + 3] for k in range(0, len(base), 3)), None, ""]
    df = spark.createDataFrame([(x,) for x in [base, base.upper(), base.title(), *odd, *LEADS]], "t string").cache()
    for c in CATEGORIES:
        gated = T.apply_gated(F.col("t"), c, T.held(F.col("t"), c))
        assert df.where(~gated.eqNullSafe(T.apply_folded(F.col("t"), c))).count() == 0, c


def test_match_counts_equal_a_plain_count(spark):
    df = spark.createDataFrame([(x,) for x in LEADS[:4]], "t string")
    for r in df.select("t", T.match_counts(F.col("t"), T.held_as_is(F.col("t"), *CATEGORIES)).alias("c")).collect():
        for c in r.c:
            if c.category in ("adverb_strip", "filler_phrases"):
                assert c.hits == sum(bool(re.search(p, r.t, re.I)) for p, _ in T.rules(c.category))


def test_stability_log(spark, tmp_path):
    row = ("r", 1.0, "m", 0.5, "b" * 300, "c" * 300, 1, 2, 0.1, 0.2, 0.3, 0.4, True, 0.85, "none")
    kinds = "request_id string, timestamp double, model string, compression_level double, baseline_response string, compressed_response string, baseline_tokens bigint, compressed_tokens bigint, cosine_similarity double, jaccard_similarity double, length_ratio double, divergence_score double, is_stable boolean, threshold double, action_taken string"
    append_stability(spark.createDataFrame([row], kinds), f"{tmp_path}/log")
    (tmp_path / "log" / "more.json").write_text('not json\n{"request_id": "x"}\n')
    got = read_stability(spark, f"{tmp_path}/log").collect()
    assert [(r.request_id, len(r.baseline_response)) for r in got] == [("r", 200)]


def test_queries_have_rows(spark):
    for name in ("agent_passes", "context_summaries", "ttl_reuse"):
        assert getattr(request_queries, name)(spark, "/root/testdata/sf0.001").count() > 0
