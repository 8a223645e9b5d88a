"""Message tables: tokens by request, windows of older and recent turns, repeated instructions and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tersely.functions.lineage import written
from tersely.functions.normalize import distinct_lines
from tersely.functions.text import text_tokens, words

MESSAGE_OVERHEAD, SYSTEM_OVERHEAD = 4, 6


def request_tokens(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """Tokens of each request: its messages with their overhead, system texts with theirs."""
    tokens = text_tokens(F.coalesce("text", F.lit("")))
    each = F.when(F.col("role") != "system", tokens + MESSAGE_OVERHEAD).when(tokens > 0, tokens + SYSTEM_OVERHEAD).otherwise(0)
    return messages.groupBy(key).agg(F.sum(each).alias("tokens"), F.count("*").alias("messages"))


def windows(messages: DataFrame, preserve: int = 4, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """``messages`` with ``n_messages``, their position from the end, and whether they are among the recent ones."""
    per = Window.partitionBy(key)
    n = F.count("*").over(per)
    back = F.row_number().over(per.orderBy(F.desc(order)))
    return messages.withColumns({"n_messages": n, "from_end": back}).withColumn("recent", F.col("from_end") <= F.least(F.lit(2 * preserve), F.greatest(F.col("n_messages") - 2, F.lit(0))))


def compressible(messages: DataFrame, age: int = 2) -> DataFrame:
    """Messages that may be rewritten: all but assistant turns among the last ``2 * age``."""
    seen = windows(messages)
    return seen.where(F.col("role").isin("user", "system", "tool") | ((F.col("role") == "assistant") & (F.col("from_end") > 2 * age)))


def prune_results(messages: DataFrame, fresh: int = 2, long: int = 2000, short: int = 200) -> DataFrame:
    """Long assistant texts (as tool results) replaced by a placeholder: over ``short`` bytes if old, else over ``long``."""
    seen = windows(messages)
    size = F.octet_length("text")
    limit = F.when(F.col("from_end") > 2 * fresh, short).otherwise(long)
    return seen.withColumn("pruned", F.when((F.col("role") == "assistant") & (size > limit), F.concat(F.lit("[pruned: "), size.cast("string"), F.lit(" bytes]"))).otherwise(F.col("text")))


THOUGHT = r"(?s)<(?:thought|thinking|inner_monologue)>.*?</(?:thought|thinking|inner_monologue)>"


def prune_thoughts(messages: DataFrame, fresh: int = 3, placeholder: str = "[earlier reasoning cut]") -> DataFrame:
    """Reasoning blocks of assistant messages before the last ``2 * fresh``, replaced where that is shorter."""
    seen = windows(messages)
    cut = F.regexp_replace("text", F.lit(THOUGHT), F.lit(f"<thought>{placeholder}</thought>"))
    old = (F.col("role") == "assistant") & (F.col("from_end") > 2 * fresh) & (F.octet_length(cut) < F.octet_length("text"))
    return seen.withColumn("pruned", F.when(old, cut).otherwise(F.col("text")))


def drop_repeated_lines(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, text`` with lines dropped that repeat an earlier one of the same text; blank lines stay, a null text is empty.

    A function of each text alone: no shuffle.
    """
    return texts.select(key, distinct_lines(F.coalesce(text, F.lit(""))).alias(text))


def redundant_pairs(messages: DataFrame, threshold: float = 0.3, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """``key, turn_a, turn_b, confidence`` of messages in one conversation whose word sets overlap by more than ``threshold`` (Jaccard).

    Two sets that overlap so much share one of their ``n - ceil(threshold * n) + 1`` rarest words, so only messages meet that have
    such a word of a conversation in common; of these, pairs of too unlike sizes and pairs whose words left over are too few
    go before their words are compared.  Words are ordered by how many messages hold them.  Texts without words meet none.
    """
    told = messages.select(F.col(key).alias("k"), F.col(order).alias("turn"), F.array_distinct(words(F.coalesce("text", F.lit("")))).alias("ws")).where(F.size("ws") > 0)
    told = told.withColumn("id", F.monotonically_increasing_id())
    each = told.select("k", "turn", "id", F.size("ws").alias("n"), F.explode("ws").alias("word"))
    held = each.groupBy("word").agg(F.count("*").alias("df"))
    ranked = each.join(held, "word").groupBy("k", "turn", "id", "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("df", "word"))), lambda x: x["word"]).alias("ws"))
    rows = written(ranked)
    prefix = F.slice("ws", F.lit(1), F.col("n") - F.ceil(F.col("n") * threshold).cast("int") + 1)
    first = rows.select("k", "id", "n", F.posexplode(prefix).alias("at", "word"))
    a, b = first.alias("a"), first.alias("b")
    need = (F.col("a.n") + F.col("b.n")) * (threshold / (1 + threshold))
    left = F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at"))
    near = a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.word") == F.col("b.word")) & (F.col("a.id") < F.col("b.id")) & (left >= need - 1e-9) & (F.col("a.n") >= F.col("b.n") * threshold) & (F.col("b.n") >= F.col("a.n") * threshold))
    pairs = near.select(F.col("a.id").alias("x"), F.col("b.id").alias("y")).distinct()
    side = lambda name: rows.select(F.col("id").alias(name), F.col("k"), F.col("turn").alias(f"t{name}"), F.col("ws").alias(f"w{name}"))
    both = pairs.join(side("x"), "x").join(side("y").drop("k"), "y")
    common = F.size(F.array_intersect("wx", "wy"))
    share = common / (F.size("wx") + F.size("wy") - common)
    found = both.withColumn("confidence", share).where(F.col("confidence") > threshold)
    return found.select(F.col("k").alias(key), F.least("tx", "ty").alias("turn_a"), F.greatest("tx", "ty").alias("turn_b"), F.round("confidence", 6).alias("confidence"))


def transcript(messages: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """``[i] role: content`` of each conversation, joined by blank lines, and its isolation key."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct(order, "role", "text"))), lambda x, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), x["role"], F.lit(": "), F.coalesce(x["text"], F.lit(""))))
    out = messages.groupBy(key).agg(F.array_join(parts, "\n\n").alias("transcript"))
    return out.withColumn("isolation_key", F.concat(F.lit("hist:"), F.sha2(F.lower(F.regexp_replace("transcript", r"[\s]+", " ")), 256)))
