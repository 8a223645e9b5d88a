"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Token weights are summed into cells (source, language, topic).  Raking scales the cells in turn to the target share of
each margin until all margins hold.  A document's probability is its cell's new weight over its old one, brought to the
token budget, and a document stays if a number made from its id's digest lies under that probability.

Defined results: a null source, language or topic is a category of its own (``<none>``); a document without tokens has no
weight to give and keeps its cell's probability; a category with no target keeps weight 0 and its documents go;
repeated rows are weighed and drawn alike; an empty table gives an empty result.  A cell that holds too few tokens for its
share is to be copied ``_copies`` > 1 times: the stage gives each of its documents whole copies and a chance of one more, so
margins and budget hold; the query's SQL has one row a document and cuts its probability to 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tersely.llm.common import cut, table

MARGINS = ("source", "lang", "topic")
#: Rounds over all margins, the power of the natural shares that the targets are, and the share of tokens to keep.
ROUNDS, POWER, BUDGET = 12, 0.5, 0.6
#: Rounds between two cuts of the lineage.
BETWEEN = 4

# Topics by what a text holds, the first that applies; patterns are common to Spark and DuckDB.
TOPICS = {"licence": "(?i)licen[sc]e|copyright", "contact": "[A-Za-z0-9._]+@[A-Za-z0-9]+[.]", "secret": "[0-9a-f]{32}", "question": "[?]", "long": "(?s)^.{8000}"}
TOKEN = r"[^\x09-\x0D\x20]+"


def topic(text: Column) -> Column:
    out = F.lit("prose")
    for name, pattern in reversed(TOPICS.items()):
        found = F.length(text) >= 8000 if name == "long" else text.rlike(pattern)
        out = F.when(found, name).otherwise(out)
    return out


def chance(id_col: str | Column) -> Column:
    """A number in [0, 1) made from the id's digest."""
    return F.conv(F.substring(F.md5((F.col(id_col) if isinstance(id_col, str) else id_col).cast("string").cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def tempered(cells: DataFrame, margin: str, power: float = POWER) -> DataFrame:
    """Target shares of a margin: its natural shares to ``power``, scaled to sum to 1."""
    sums = cells.groupBy(margin).agg(F.sum("w").alias("s")).where("s > 0").withColumn("s", F.pow("s", F.lit(power)))
    return sums.select(F.col(margin), (F.col("s") / F.sum("s").over(Window.partitionBy())).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """``cells(<margins>, w)`` with ``x``: shares that match every margin's ``targets(<margin>, target)``.

    The cells are one row for each combination of categories, however many documents there are.
    """
    total = Window.partitionBy()
    cells = cells.withColumn("x", F.col("w") / F.sum("w").over(total))
    for margin, target in targets.items():
        cells = cells.join(target.withColumnRenamed("target", f"to_{margin}"), margin, "left")
    for k in range(rounds):
        for margin in targets:
            held = F.sum("x").over(Window.partitionBy(margin))
            cells = cells.withColumn("x", F.when(held > 0, F.col("x") * F.coalesce(f"to_{margin}", F.lit(0.0)) / held).otherwise(0.0))
        if k % BETWEEN == BETWEEN - 1:
            cells = cut(cells)
    return cells.drop(*[f"to_{m}" for m in targets])


def mark_of(docs: DataFrame) -> str:
    """Underscores with which no column begins."""
    mark = "_"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    return mark


def weighed(docs: DataFrame, margins: tuple[str, ...] = MARGINS, mark: str = "_") -> DataFrame:
    """``docs`` with ``n_tokens`` and the margins' categories, under names of their own that begin with ``mark``."""
    text = F.coalesce("text", F.lit(""))
    known = {"topic": topic(text)} if "topic" in margins else {}
    held = [F.coalesce((known[m] if m in known else F.col(m)).cast("string"), F.lit("<none>")).alias(f"{mark}{m}") for m in margins]
    return docs.select("*", F.regexp_count(text, F.lit(TOKEN)).cast("long").alias(f"{mark}n_tokens"), *held)


def probabilities(docs: DataFrame, targets: dict[str, DataFrame] | None = None, margins: tuple[str, ...] = MARGINS, budget: float = BUDGET, rounds: int = ROUNDS, mark: str = "_") -> DataFrame:
    """``docs`` with ``_n_tokens``, the categories, ``_copies`` and ``_p`` (after ``mark``); targets not given are tempered natural shares."""
    return drawn(weighed(docs, margins, mark), targets, margins, budget, rounds, mark)


def drawn(rows: DataFrame, targets: dict[str, DataFrame] | None = None, margins: tuple[str, ...] = MARGINS, budget: float = BUDGET, rounds: int = ROUNDS, mark: str = "_") -> DataFrame:
    """``weighed`` rows with ``_copies``, the expected number in the draw, and ``_p``, the same up to 1; they are read twice."""
    cells = cut(rows.groupBy(*[F.col(f"{mark}{m}").alias(m) for m in margins]).agg(F.sum(f"{mark}n_tokens").cast("double").alias("w")))
    targets = {m: (targets or {}).get(m, tempered(cells, m)) for m in margins}
    x = rake(cells, targets, rounds)
    scale = F.lit(budget) * F.sum("w").over(Window.partitionBy())
    factors = x.select(*[F.col(m).alias(f"{mark}{m}") for m in margins], F.when(F.col("w") > 0, F.col("x") * scale / F.col("w")).otherwise(0.0).alias(f"{mark}copies"))
    factors = factors.withColumn(f"{mark}p", F.round(F.least(F.lit(1.0), f"{mark}copies"), 6))
    return rows.join(cut(factors), [f"{mark}{m}" for m in margins])


def op8_mixing_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the texts are read once: what they weigh is written down
    found = drawn(cut(weighed(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")).drop("text", "source", "lang")))
    return found.select("doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), F.col("_n_tokens").alias("n_tokens"), F.col("_p").alias("probability"), (chance("doc_id") < F.col("_p")).alias("sampled"))


def mixing_sql(documents: str = "documents") -> str:
    """The same result in DuckDB's SQL."""
    cases = " ".join(f"WHEN length(coalesce(text, '')) >= 8000 THEN '{n}'" if n == "long" else f"WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{n}'" for n, p in TOPICS.items())
    steps = [
        f"""rows AS (SELECT doc_id, coalesce(source, '<none>') AS source, coalesce(lang, '<none>') AS lang, CASE {cases} ELSE 'prose' END AS topic,
            CAST(len(regexp_extract_all(coalesce(text, ''), '{TOKEN}')) AS BIGINT) AS n_tokens FROM {documents})""",
        "cells AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS w FROM rows GROUP BY ALL)",
    ]
    for m in MARGINS:
        steps.append(f"to_{m} AS (SELECT {m}, s / sum(s) OVER () AS target FROM (SELECT {m}, pow(sum(w), {POWER}) AS s FROM cells GROUP BY {m} HAVING sum(w) > 0))")
    steps.append("x0 AS (SELECT *, w / sum(w) OVER () AS x FROM cells)")
    k = 0
    for _ in range(ROUNDS):
        for m in MARGINS:
            steps.append(f"x{k + 1} AS MATERIALIZED (SELECT source, lang, topic, w, CASE WHEN h > 0 THEN x * coalesce(target, 0) / h ELSE 0 END AS x FROM (SELECT *, sum(x) OVER (PARTITION BY {m}) AS h FROM x{k}) LEFT JOIN to_{m} USING ({m}))")
            k += 1
    steps.append(f"p AS (SELECT source, lang, topic, CASE WHEN w > 0 THEN round(least(1.0, x * ({BUDGET} * sum(w) OVER ()) / w), 6) ELSE 0 END AS probability FROM x{k})")
    return "WITH " + ", ".join(steps) + """ SELECT doc_id, source, lang, topic, n_tokens, probability,
        CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0 < probability AS sampled FROM rows JOIN p USING (source, lang, topic)"""


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the draw takes, each as often as it takes them; columns stay as they are, whatever their names.

    A row without an id is drawn by its text; rows that agree in both are drawn alike.
    """
    mark = mark_of(docs)
    copies = F.col(f"{mark}copies")
    drawn_by = F.coalesce(chance("doc_id"), chance(F.coalesce("text", F.lit(""))))
    times = (F.floor(copies) + (drawn_by < copies - F.floor(copies)).cast("int")).cast("int")
    rows = probabilities(docs, mark=mark).withColumn(f"{mark}times", times).where(F.col(f"{mark}times") > 0)
    return rows.withColumn(f"{mark}k", F.explode(F.sequence(F.lit(1), F.col(f"{mark}times")))).select(*docs.columns)
