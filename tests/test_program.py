"""Rule programs against a plain loop over the rules, users' rules, and requests written back as they came."""

import json
import re

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tersely.functions import program, text
from tersely.functions.rules import THRESHOLDS
from tersely.jobs.requests import compress_whole, compressed_lines, metrics_rows, write_compressed
from tersely.operators import agent
from tersely.operators.requests import TOOL_EACH, message, request_tokens, tools_json
from tersely.operators.wire import wire
from tersely.queries import LEADS
from tersely.request_queries import FIRING
from tersely.sources.requests import read_requests

CODE = '```python\nimport os\nimport sys\ndef f(x):\n    # a comment line\n    return {  1, }  // not TODO\n"""doc"""\n```'
TEXTS = [*LEADS, *FIRING, "".join(LEADS), "\n".join(FIRING) * 3, CODE, "const a = { b: 1, }; let c = () => 2\n// a comment\n# TODO keep\n", '{"a":  1, "b": { }, "c": [ ]}', "aé kindly ſtep ıs KINDLY", "January 4th, 2025 and 14 march 1999 may 5 2001", "x" * 600 + " data:image/png;base64," + "A" * 200, ("the same line of an error log again\n") * 5, "", " ", "U: " + "q" * 220 + "\n" + "U: " + "q" * 220]
PROFILES = [*THRESHOLDS, "no such profile"]


def plain(value, level, profile, is_code):
    """The chain as it is told: every rule in order, no gates."""
    hits = dict.fromkeys(program.DECLARED, 0)
    on = False
    for step in program.request_steps() if level and level > 0 else []:
        at = (step.at or {}).get(profile if profile in THRESHOLDS else "balanced", 0.0)
        if level < at:
            continue
        if step.reads:
            on = is_code(value) if step.reads == "code" else True
            continue
        if step.tested and not on:
            continue
        pattern = re.compile(step.pattern.replace(r"\z", r"\Z"), re.I if step.ignore_case else 0)
        new = pattern.sub(re.sub(r"\$(\d)", r"\\\1", step.replacement), value)
        if pattern.search(value) and step.category:
            hits[step.category] += 1
        value = new
    return value, hits


@pytest.mark.parametrize("level", [0.0, 0.3, 0.6, 0.85, 1.0])
def test_programs_equal_a_plain_loop(spark, level):
    rows = [(i, t, level, p) for i, t in enumerate(TEXTS) for p in PROFILES]
    df = spark.createDataFrame([*rows, (-1, None, level, "balanced"), (-2, "kindly", None, "balanced")], "i int, t string, level double, p string")
    x = program.run(program.request_program(), F.col("t"), F.col("level"), F.col("p"))
    got = {(r.i, r.p): r for r in df.select("i", "p", x.alias("x")).select("i", "p", "x.text", program.tallied(F.col("x.hits"), program.DECLARED).alias("h")).collect()}
    is_code = lambda t: t.lstrip().startswith("```") or t.startswith("{") or "const" in t
    for i, t, _, p in rows:
        want, hits = plain(t, level, p, is_code)
        assert got[i, p].text == want, (i, p)
        assert {h.category: h.hits for h in got[i, p].h} == hits, (i, p)
    assert got[-1, "balanced"].text is None and got[-2, "balanced"].text == "kindly"


def test_literals_are_in_every_match():
    assert program.literal(r"a+b*cd?e\.f", False) == "e.f" and program.literal(r"\n{3,}", False) == "\n\n\n" and program.literal("a|b", False) is None
    assert program.literal(r"(?i)abc:", False) == ":" and program.literal(r"[[]x", False) == "x" and program.literal(r"(ab)?cc{0}d", False) == "c"
    for step in program.request_steps():
        found = program.literal(step.pattern, step.ignore_case)
        for t in TEXTS:
            for m in re.finditer(step.pattern.replace(r"\z", r"\Z"), t, re.I if step.ignore_case else 0) if found and step.pattern else ():
                assert found in m[0] or found.strip() == "" and found in t, (step.pattern, found)


def test_user_rules(spark):
    table = lambda *rows: spark.createDataFrame(rows, "category string, rule_idx int, pattern string, replacement string, ignore_case boolean")
    at = spark.createDataFrame([("b", "balanced", 0.5), ("b", "aggressive", 0.1)], "category string, profile string, threshold double")
    own = program.user_program(table(("b", 2, r"(\w+)@(\w+)", "$2 at $1", False), ("b", 1, r"\bdear\s+(?:sir|madam)\b", None, True), ("a", 1, r"\$\d+", "money", None)), at)
    df = spark.createDataFrame([("DEAR  Sir, x@y $5 $66", 0.3, "aggressive"), ("Dear sir x@y", 0.3, "balanced"), ("dear madam $1", 1.0, "other"), ("a", 0.0, "balanced")], "t string, l double, p string")
    got = [(r.x.text, [own.categories[k] for k in r.x.hits]) for r in df.select(program.run(own, F.col("t"), F.col("l"), F.col("p")).alias("x")).collect()]
    assert got == [(", y at x money money", ["a", "b", "b"]), ("Dear sir x@y", []), (" money", ["a", "b"]), ("a", [])]
    for bad, name in ((("c", 7, "(unclosed", "", False), "c.7"), (("c", 8, "(a)", "$2", False), "c.8"), (("c", 9, None, "", False), "c.9")):
        with pytest.raises(ValueError, match=re.escape(name)):
            program.user_program(table(bad), at)
    with pytest.raises(ValueError, match="category z"):
        program.user_program(table(("z", 1, "a", "", False)), spark.createDataFrame([("z", "aggressive", 0.1)], at.schema))
    none = program.user_program(table().limit(0), at)
    assert df.select(program.run(none, F.col("t"), F.col("l"), F.col("p"))["text"].alias("t")).first().t == "DEAR  Sir, x@y $5 $66"


LINES = [
    {"request_id": "a", "z": [1, {"y": None, "x": 1.5}], "model": "claude-sonnet-4", "level": 1.0, "metadata": {"user_id": "u"}, "system": [{"type": "text", "text": "Please note that it is very useful.", "cache_control": {"type": "ephemeral", "ttl": "1h"}}], "tools": [{"name": "f", "input_schema": {"type": "object", "properties": {}}, "description": "dé"}], "messages": [
        {"role": "user", "name": "bob", "content": "In order to go, it is very far."},
        {"role": "assistant", "content": [{"type": "thinking", "thinking": "hm", "signature": "s"}, {"type": "tool_use", "id": "t1", "name": "f", "input": {"b": 2, "a": "in order to"}}]},
        {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "is_error": False, "content": [{"type": "text", "text": "in order to see", "n": 1}, {"type": "image", "source": {"data": "x"}}]}, {"type": "tool_result", "tool_use_id": "t2", "content": "please note that yes"}, {"type": "text", "text": "kindly go", "cache_control": {"type": "ephemeral"}}]},
    ]},
    {"request_id": "b", "model": "x", "level": 0.0, "system": "in order to", "messages": [{"role": "user", "content": "in order to", "x": {}}, {"role": "user"}, {"role": "user", "content": None}, {"role": "user", "content": []}], "stop": None},
    {"request_id": "c", "level": 0.7, "messages": []},
]


def dumped(x):
    return json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@pytest.fixture(scope="module")
def read(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("wire") / "log.jsonl"
    path.write_text("\n".join(map(json.dumps, LINES)) + "\nno json\n[1]\n\n" + '{"model": "no messages"}\n')
    seen = Observation("read")
    rows = read_requests(spark, str(path), seen).collect()
    return spark.createDataFrame(rows, read_requests(spark, str(path)).schema), seen.get


def test_rejected_lines_are_counted_in_the_same_pass(read):
    rows, seen = read
    assert rows.count() == 3 and seen == {"lines": 7, "rejected": 3, "without_messages": 1}


def test_json_in_is_json_out_at_level_0(read):
    rows = read[0].withColumn("level", F.lit(0.0))
    got = {r.request_id: r.line for r in wire(compress_whole(rows)).collect()}
    assert got == {x["request_id"]: re.sub(r"(\d)\.0\b", r"\1", dumped(x)) for x in LINES}  # numbers in their shortest form


def test_only_texts_change(read, tmp_path):
    done = compress_whole(read[0], hits=True).cache()
    got = {r.request_id: json.loads(r.line) for r in wire(done).collect()}
    want = json.loads(json.dumps(LINES[0]))
    want["system"][0]["text"] = "it is useful."
    want["messages"][0]["content"] = "to go, it is far."
    want["messages"][2]["content"][0]["content"][0]["text"] = "to see"
    want["messages"][2]["content"][1]["content"] = "yes"
    want["messages"][2]["content"][2]["text"] = "go"
    assert got["a"] == want and got["b"] == LINES[1] and got["c"] == LINES[2]
    hits = {r.request_id: {h.category: h.hits for h in r.rule_hits if h.hits} for r in done.collect()}
    assert hits["b"] == hits["c"] == {} and list({h.category: 0 for h in done.first().rule_hits}) == list(program.DECLARED)
    sums = dict.fromkeys(program.DECLARED, 0)
    for t in ("Please note that it is very useful.", "In order to go, it is very far.", "in order to see", "please note that yes", "kindly go"):
        for c, n in plain(t, 1.0, "aggressive", lambda _: False)[1].items():
            sums[c] += n
    assert hits["a"] == {c: n for c, n in sums.items() if n}
    row = metrics_rows(done.where("request_id = 'a'").withColumn("ts", F.lit(1.0))).first()
    assert row.total_rule_hits == sum(sums.values()) and row.top_categories[0].hits == max(sums.values())
    write_compressed(done, f"{tmp_path}/out")
    lines = [json.loads(x) for f in (tmp_path / "out").glob("part*") for x in f.read_text().splitlines()]
    assert {x["model"]: x["messages"] for x in lines} == {"claude-sonnet-4": want["messages"], "x": LINES[1]["messages"], "unknown": []}
    assert all(set(x) == {"messages", "model", "original_tokens", "optimized_tokens"} and x["optimized_tokens"] <= x["original_tokens"] for x in lines)


def test_messages_without_a_line_are_made_from_their_blocks(read):
    made = read[0].withColumns({"raw": F.lit(None).cast("string"), "original_tokens": F.lit(1), "optimized_tokens": F.lit(1)})
    got = json.loads(compressed_lines(made.where("request_id = 'a'")).first().line)["messages"]
    assert got == [{"role": "user", "content": LINES[0]["messages"][0]["content"]}, *LINES[0]["messages"][1:]]
    more = read[0].where("request_id = 'a'").withColumns({"messages": F.concat(F.array(message("user", F.lit("summary"))), F.slice("messages", 3, 1)), "original_tokens": F.lit(1), "optimized_tokens": F.lit(1)})
    assert json.loads(compressed_lines(more).first().line)["messages"] == [{"role": "user", "content": "summary"}, LINES[0]["messages"][2]]


def test_tools_count_as_they_are_sent(spark, read):
    rows = read[0]
    with_tools, without = (request_tokens(F.col("system"), F.col("system_is_string"), F.col("messages"), x) for x in (tools_json(rows), None))
    got = {r.request_id: r.a - r.b for r in rows.select("request_id", with_tools.alias("a"), without.alias("b")).collect()}
    n = spark.range(1).select(text.text_tokens(F.lit(dumped(LINES[0]["tools"]))).alias("n")).first().n
    assert got == {"a": n + TOOL_EACH, "b": 0, "c": 0}
    made = rows.drop("tools_json")
    assert made.where("request_id = 'a'").select(tools_json(made).alias("t")).first().t == dumped(LINES[0]["tools"])


def test_normalized_requests_are_compressed(read):
    got = {r.request_id: r for r in compress_whole(read[0].withColumn("level", F.lit(0.0)), normalized=True).collect()}
    assert got["b"].system[0].text.startswith("in order to\nIf information")


def test_tools_are_minimized_once_they_are_used(read):
    got = {r.request_id: r for r in wire(agent.minimize_used_tools(read[0])).collect()}
    assert json.loads(got["a"].line)["tools"] == [{"description": "dé Sig: f({})", "input_schema": {"properties": {}, "type": "object"}, "name": "f"}] and got["a"].tools[0].description == "dé Sig: f({})"
    first = read[0].withColumn("messages", F.slice("messages", 1, 1)).where("request_id = 'a'")
    assert json.loads(wire(agent.minimize_used_tools(first)).first().tools_json) == LINES[0]["tools"]
    done = {r.request_id: r for r in agent.optimize(read[0]).collect()}
    assert done["a"].tools[0].description == "dé Sig: f({})" and done["c"].tools_json is None and len(done) == 3


def test_fenced_json_in_views_is_compact(spark):
    text = 'see\n```json\n{"b": 1,\n "a": [1, 2]}\n```\nand ```json\nno json\n``` end'
    assert spark.range(1).select(agent.compact_fences(F.lit(text)).alias("t")).first().t == 'see\n```json\n{"a":[1,2],"b":1}\n```\nand ```json\nno json\n``` end'


def test_rules_are_tried_where_a_phrase_of_theirs_stands():
    assert program.literals(r"\bso\s+as\s+to\b", True) == (True, ["so as to"]) and program.literals(r"(?i)\bI\s+will\s+look", False)[0]
    assert program.literals(r"\b(ensure|note)\s+that\b", True) == (True, ["ensure that", "note that"]) and program.literals(r"(?:---+|___+)x?", False) == (False, ["---", "___"])
    assert program.literals(" +\n", False) == (False, [" \n"]) and program.literals(r"(?:ab|c)*\w+", False) is None and program.literals(r"[a&&[b]]cc", False) is None
    low = lambda t: re.sub(r"\s+", " ", t.translate(str.maketrans("ſİıK", "siik")).lower())
    for step in program.request_steps():
        folded, found = (program.literals(step.pattern, step.ignore_case) if step.pattern else None) or (False, None)
        for t in TEXTS if found else ():
            if re.search(step.pattern.replace(r"\z", r"\Z"), t, re.I if step.ignore_case else 0):
                assert any(x in (low(t) if folded else t) for x in found), (step.pattern, found, t)
