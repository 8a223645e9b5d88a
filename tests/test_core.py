import json

from pyspark.sql import functions as F

from tersely.functions import normalize, routing, text
from tersely.functions.rules import CATEGORIES, THRESHOLDS, rules
from tersely.jobs.compress import compress, compress_requests
from tersely.operators import conversation, stability
from tersely.sources.logs import append_metrics, read_metrics
from tersely.streaming.metrics import running_totals, windowed


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'long' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


def test_rule_counts():
    counts = {"filler_phrases": 61, "imperative_conversions": 40, "clause_collapse": 26, "credential_strip": 8, "disclaimer_collapse": 6, "adverb_strip": 10, "whitespace_cleanup": 6,
              "conversational_strip": 46, "ai_output_noise": 24, "markdown_minification": 18, "source_code_compression": 11, "context_deduplication": 5, "semantic_formatting": 33, "anti_noise": 20, "agent_metadata": 16, "verbose_phrases": 131, "developer_boilerplate": 31, "adjective_collapse": 17, "clause_simplify": 21}
    assert {c: len(rules(c)) for c in counts} == counts
    assert [len(t) for t in THRESHOLDS.values()] == [21, 21, 21]


def test_rules(spark):
    rewrite = lambda s, c: one(spark, text.apply_category(F.col("s"), c), s=s)
    assert rewrite("Due to the fact that it rains", "filler_phrases") == "because it rains"
    assert rewrite("please open the door", "filler_phrases") == "please open the door"
    assert rewrite("a  b , c .", "whitespace_cleanup") == "a b, c."
    assert rewrite("You are a helpful guide with 10 years of experience.", "credential_strip") == "guide ."
    assert rewrite("I hope this helps! As an AI language model, I think", "ai_output_noise") == "think"
    assert rewrite("#### A\n* **b**<br/>[here](u)", "markdown_minification") == "# A\n- b\nu"
    assert rewrite("# a comment\nx = {  1, }", "source_code_compression") == "\nx = {1}"
    assert rewrite("Thanks!\n" + "Ab1" * 200, "context_deduplication") == "\n[BASE64_TRUNCATED]"
    assert rewrite("You should not see Cats and Dogs at http://x?utm_source=q", "semantic_formatting") == "You shouldn't see Cats & Dogs at http://x"
    assert rewrite("user: [[reply_to_7]] hi", "agent_metadata") == "U: hi"
    assert rewrite("can you please look, recognizing that it may rain soon. Go", "conversational_strip") == " look, since it may rain soon. Go"
    assert rewrite("It is able to join both cats and dogs, specifically", "verbose_phrases") == "It can join cats/dogs, "
    assert rewrite("Your task is to write a script that runs", "developer_boilerplate") == "Task: Program: runs"
    assert rewrite("legal, tax, and privacy concerns", "adjective_collapse") == "legal/tax/privacy concerns"
    assert rewrite("answer while maintaining good form now", "clause_simplify") == "answer (keep good form) now"
    line = "the same line of an error log again\n"
    assert rewrite(line * 5000, "anti_noise") == line + "[repeated]\n"
    got = one(spark, text.apply_counted(F.col("s"), "adverb_strip"), s="very, very good and work hard; carefully review")
    assert (got["text"], got["hits"]) == ("very, good and work; ", 3)


def test_dates_keep_four_digit_years(spark):
    for year in ("1999", "2000", "2025", "2099", "2100"):
        assert one(spark, text.compress_dates(F.col("s")), s=f"on January 14th, {year} or 3 may {year}") == f"on {year}-01-14 or {year}-05-03"


def test_tokens_and_similarity(spark):
    assert one(spark, text.text_tokens(F.col("s")), s="") == 0
    assert one(spark, text.text_tokens(F.col("s")), s="a") == 1
    assert one(spark, text.text_tokens(F.col("s")), s="x" * 35 + "```" + "y" * 24 + "```") == 20
    assert one(spark, text.word_jaccard(F.col("a"), F.col("b")), a="A b c", b="b, C d") == 0.5
    assert one(spark, text.word_jaccard(F.col("a"), F.col("b")), a="", b=".") == 1.0
    assert one(spark, text.length_ratio(F.col("a"), F.col("b")), a="ab", b="") == 0.0
    pairs = spark.createDataFrame([(1, "a b b", "b a b"), (2, "", "x")], "id long, baseline string, compressed string")
    got = {r.id: round(r.cosine_similarity, 6) for r in stability.score(pairs).collect()}
    assert got == {1: 1.0, 2: 0.0}


def test_routing(spark):
    for model, want in {"claude-sonnet-4-6-mini": "conservative", "claude-opus-4": "aggressive", "gpt-4o": "aggressive", "gpt-3.5-turbo": "conservative", "some-model": "balanced"}.items():
        assert one(spark, routing.profile(F.col("m")), m=model) == want
    for model, want in {"azure_ai/x": "hpc", "grok-3": "xai", "a/b": "openrouter", "o3-x": "openai", "Gemini": "gemini"}.items():
        assert one(spark, routing.provider(F.col("m")), m=model) == want
    assert one(spark, routing.provider(F.col("m"), F.col("h")), m="grok", h="OpenAI") == "openai"
    assert one(spark, routing.effective_level(F.col("h"), F.lit(0.5)), h="7") == 1.0
    assert one(spark, routing.effective_level(F.col("h"), F.lit(0.5)), h="no") == 0.5
    assert one(spark, routing.auto_level(F.col("l"), F.lit(50), F.lit("x")), l=1.0) == 0.5
    assert one(spark, routing.auto_level(F.col("l"), F.lit(190_000), F.lit("sonnet")), l=0.5) == 1.0


def test_compression_never_inflates(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    done = compress(docs, "text", ["filler_phrases", "adverb_strip"], hits=True)
    assert done.where("octet_length(compressed) > octet_length(text)").count() == 0


def test_repeated_lines_and_pairs(spark):
    t = spark.createDataFrame([(1, "Do it.\n\nPlease  do it!\nelse\n"), (2, None)], "id long, text string")
    assert {r.id: r.text for r in conversation.drop_repeated_lines(t, "id").collect()} == {1: "Do it.\n\nelse\n", 2: ""}
    m = spark.createDataFrame([(1, 0, "a b c"), (1, 1, "a b d"), (2, 0, "a b c")], "conv_id long, turn long, text string")
    assert [(r.turn_a, r.turn_b, r.confidence) for r in conversation.redundant_pairs(m).collect()] == [(0, 1, 0.5)]


def test_log_round_trip(spark, tmp_path):
    line = {"timestamp": 1.0, "original_tokens": 10, "optimized_tokens": 8, "compression_ratio": 0.8, "token_savings": 2, "savings_percent": 20.0, "compression_level": 0.5, "top_categories": [["a", 3]]}
    (tmp_path / "log.jsonl").write_text(json.dumps(line) + "\nnot json\n" + json.dumps({"timestamp": 2}) + "\n")
    rows = read_metrics(spark, str(tmp_path / "log.jsonl"))
    assert rows.count() == 3 and rows.where("valid").count() == 1
    append_metrics(rows.where("valid").drop("valid"), str(tmp_path / "out"))
    again = read_metrics(spark, str(tmp_path / "out")).where("valid").first()
    assert again["top_categories"][0]["hits"] == 3 and again["latency_ms"] == 0.0


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:00:01", "a", 10, 8), ("2024-01-01 00:06:00", "a", 5, 5), ("2024-01-01 01:00:00", "b", 1, 1)], "ts string, model string, original_tokens long, optimized_tokens long")
    rows.withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("ts timestamp, model string, original_tokens long, optimized_tokens long").parquet(str(tmp_path / "in"))
    q = running_totals(stream()).writeStream.format("memory").queryName("totals").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(60)
    assert {r.model: r.original_tokens for r in spark.table("totals").collect()} == {"a": 15, "b": 1}
    q = windowed(stream()).writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(60)
    assert {(str(r.start), r.original_tokens) for r in spark.table("windows").collect()} == {("2024-01-01 00:00:00", 10), ("2024-01-01 00:05:00", 5)}


def test_normalized_prompts(spark):
    assert one(spark, normalize.resolve_conflicts(F.col("s")), s="Be brief. Be very thorough! Go on.") == "Be brief. Go on."
    assert one(spark, normalize.bound_speculation(F.col("s")), s="Never guess.") == "Never guess."
    assert one(spark, normalize.bound_speculation(F.col("s")), s="Go.").startswith("Go.\nIf information")
    assert [b.text for b in one(spark, normalize.order_blocks(normalize.system_blocks(F.col("s"))), s="Base\n\n---\n\nToday")] == ["Base", "Today"]
    assert one(spark, normalize.block_stability(F.col("s"), F.lit(False)), s="You are as of today updated recently, latest") == 30
    assert one(spark, normalize.language(F.col("s")), s="import os\ndef f(x):\n    return x") == "python"
    for s, want in (("```x", True), ('{"a": 1}', True), ("{a}", False), ("plain", False)):
        assert one(spark, normalize.code_or_json(F.col("s")), s=s) is want
    tools = spark.sql("SELECT array(named_struct('name', 'b', 'n', 1), named_struct('name', 'a', 'n', 2), named_struct('name', 'b', 'n', 3)) AS t").select(normalize.sort_tools(F.col("t")).alias("t")).first()["t"]
    assert [(t.name, t.n) for t in tools] == [("a", 2), ("b", 1), ("b", 3)]


def test_requests_by_level_and_profile(spark):
    s = "You should utilize it in order to do the very best. **Note:** I hope this helps!"
    rows = [(s, 0.0, "balanced"), (s, 0.3, "balanced"), (s, 0.5, "aggressive"), (s, 1.0, "aggressive"), (None, 1.0, "balanced"), ("", 1.0, "x"), (s, None, "balanced")]
    got = [r.compressed for r in compress_requests(spark.createDataFrame(rows, "text string, level double, profile string").coalesce(1)).collect()]
    assert got[0] == got[6] == s and got[4] is None and got[5] == ""
    assert got[1] == "You should use it to do the very best. **Note:** I hope this helps!"
    assert len(got[3]) < len(got[2]) < len(got[1])


def test_folded_rules_equal_plain_ones(spark):
    from tersely.queries import LEADS

    texts = spark.createDataFrame([(x,) for x in [*LEADS, " ".join(LEADS), "\u017fpecifically IT I\u0131 \u00e9t\u00e9 and X", ""]], "s string").coalesce(1)
    for c in CATEGORIES:
        for row in texts.select(text.apply_category(F.col("s"), c).alias("a"), text.apply_folded(F.col("s"), c).alias("b")).collect():
            assert row.a == row.b


def test_rule_queries_equal_their_sql_on_any_letters(spark, tmp_path):
    import duckdb

    from tersely.queries import LEADS, ORACLE_SQL, QUERIES

    odd = ["la ou aiierç And onndonth and Zürich and Köln", "évery good, écannot do noté ékindlyé", "ſpecifically ſtep and Kin, ıs not, İs not; cats and dogs; in\u000border to",
           "Iİand one hundredé, à and b̀ and café and thé and x", "baſically, kiſſ and KK and inſightſ", None, ""]
    texts = [*odd, *[f"{x} {a}" for x in LEADS for a in odd if a], *[x.replace(" ", "é ") for x in LEADS], *[x.replace("s", "ſ").replace("k", "K") for x in LEADS], *[x.replace(" ", " é") for x in LEADS]]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts * len(LEADS))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for c in CATEGORIES:
        if sql := ORACLE_SQL.get(f"rules_{c}"):
            want = dict(con.execute(f"SELECT doc_id, text_md5 FROM ({sql})").fetchall())
            got = {r.doc_id: r.text_md5 for r in QUERIES[f"rules_{c}"](spark, str(tmp_path)).collect()}
            assert [(c, rows[k][1], k % len(LEADS)) for k in want if want[k] != got[k]] == []
