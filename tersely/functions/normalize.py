"""System prompts: conflicting instructions, speculation boundaries, static and dynamic parts, order for prompt caches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tersely.functions.names import let
from tersely.functions.text import strip

# Instructions that exclude each other; of two that both occur, sentences with the second go.
CONFLICTS = [
    (r"(?i)be\s+(?:very\s+)?(?:concise|brief|short)", r"(?i)be\s+(?:very\s+)?(?:detailed|thorough|comprehensive|verbose)"),
    (r"(?i)(?:always|must)\s+(?:include|provide)\s+(?:examples|code)", r"(?i)(?:do\s+not|don't|never)\s+(?:include|provide)\s+(?:examples|code)"),
    (r"(?i)(?:use|respond\s+in)\s+(?:formal|professional)", r"(?i)(?:use|respond\s+in)\s+(?:casual|informal|friendly)"),
]
# Any of these is a boundary, and the text added where there is none.
BOUNDARIES = [
    r"(?i)(?:do\s+not|don't|never)\s+(?:guess|speculate|assume|invent|fabricate|make\s+up|hallucinate)",
    r"(?i)(?:only|stick\s+to)\s+(?:facts|verified|known|confirmed|provided)\s+(?:information|data)",
    r"(?i)(?:if|when)\s+(?:unsure|uncertain|not\s+sure|don't\s+know)",
]
BOUNDARY = "\nIf information is unavailable or uncertain, state that explicitly. Do not speculate, infer, or generate unverified claims."
SEPARATOR = "\n\n---\n\n"
# Words that mark a block as one that changes.
DYNAMIC = ["today", "current date", "current time", "right now", "as of", "recently", "latest", "updated"]
# Signals of a source language (two or more tell it), and its fences.
FENCES = {"python": ["```python", "```py"], "javascript": ["```javascript", "```js", "```typescript", "```ts"], "shell": ["```bash", "```sh", "```shell"]}
# Words that make no difference between instructions; marks of emphasis and of order.
FILLERS = r"(?U)\b(?:please|always|make sure to|ensure that|remember to)\b"
EMPHASIS = r"(?i)\*{1,2}(?:Important|Note|Warning|Caution)\*{1,2}:?\s*"
LIST_WORDS = r"(?i)(\d+\.)\s*(?:First|Second|Third|Fourth|Fifth|Next|Then|Finally|Lastly)\s*,?\s*"


def cut_sentences(text: Column) -> Column:
    """Sentences that end in ``.!?`` before white space, trimmed, none empty."""
    parts = F.split(F.regexp_replace(text, r"([.!?])(\s)", "$1\u0001$2"), "\u0001")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"\A\s+|\s+\z", "")), lambda s: s != "")


def _lacks(pattern: str):
    return lambda sentence: ~sentence.rlike(pattern)


def resolve_conflicts(text: Column) -> Column:
    """``text`` without the sentences that contradict another instruction; untouched if none do."""
    for first, second in CONFLICTS:
        kept = F.array_join(F.filter(cut_sentences(text), _lacks(second)), " ")
        text = F.when(text.rlike(first) & text.rlike(second), kept).otherwise(text)
    return text


def bound_speculation(text: Column) -> Column:
    """``text`` with the boundary added unless it holds one."""
    held = reduce(lambda a, b: a | b, [text.rlike(p) for p in BOUNDARIES])
    return F.when(held, text).otherwise(F.concat(text, F.lit(BOUNDARY)))


def system_blocks(text: Column) -> Column:
    """``array<struct<text, cached>>``: the static part before the first separator is cached, what follows is not; one uncached block without a separator."""
    at = F.instr(text, SEPARATOR)
    block = lambda t, cached: F.struct(t.alias("text"), F.lit(cached).alias("cached"))
    both = F.array(block(F.substring(text, F.lit(1), at - 1), True), block(F.substring(text, at + len(SEPARATOR), F.length(text)), False))
    return F.when(at > 0, both).otherwise(F.array(block(text, False)))


def block_stability(text: Column, cached: Column) -> Column:
    """How likely a block stays the same between requests; larger comes first."""
    low, size = F.lower(text), F.octet_length(text)
    marks = reduce(lambda a, b: a + b, [low.contains(m).cast("int") for m in DYNAMIC])
    base = F.greatest(F.lit(0), F.lit(50) + F.when(cached, 100).otherwise(0) - 20 * marks)
    return base + F.when(low.startswith("you are") | low.contains("your role"), 30).otherwise(0) + F.when(size > 500, 10).otherwise(0) + F.when(size > 2000, 10).otherwise(0)


def order_blocks(blocks: Column) -> Column:
    """Blocks by falling stability; ties stay in their order."""
    keyed = F.transform(blocks, lambda b, i: F.struct((-block_stability(b["text"], b["cached"])).alias("k"), i.alias("i"), b.alias("b")))
    return F.transform(F.array_sort(keyed), lambda x: x["b"])


def sort_tools(tools: Column) -> Column:
    """``array<struct<name, ...>>`` by name; equal names stay in their order."""
    keyed = F.transform(tools, lambda t, i: F.struct(F.coalesce(t["name"], F.lit("")).alias("k"), i.alias("i"), t.alias("t")))
    return F.transform(F.array_sort(keyed), lambda x: x["t"])


def dedup_key(line: Column) -> Column:
    """What makes two instruction lines the same: lower case, without fillers, spacing and end punctuation."""
    bare = F.regexp_replace(F.lower(strip(line)), FILLERS, "")
    return F.regexp_replace(strip(F.regexp_replace(bare, r"(?U)\s+", " ")), "[.,;:!]+$", "")


def strip_emphasis(text: Column) -> Column:
    return F.regexp_replace(text, EMPHASIS, "")


def plain_lists(text: Column) -> Column:
    """``1. First, do`` to ``1. do``."""
    return F.regexp_replace(text, LIST_WORDS, "$1 ")


def language(text: Column) -> Column:
    """``python``, ``javascript`` or ``shell`` by fence or by two signals of it; else null."""
    return let(strip(text), _language)


def _language(t: Column) -> Column:
    has = lambda *xs: reduce(lambda a, b: a | b, [t.contains(x) for x in xs])
    two = lambda *signals: reduce(lambda a, b: a + b, [s.cast("int") for s in signals]) >= 2
    python = two(has("def ") & has(":\n"), has("import "), has("class ") & has(":\n"), has("    self."), has("if __name__"))
    script = two(has("function ", "const ", "let "), has("=>", "async "), has("require(", "import "))
    fenced = [(reduce(lambda a, b: a | b, [t.startswith(f) for f in fs]), name) for name, fs in FENCES.items()]
    out = F.when(python, "python").when(script, "javascript")
    for found, name in reversed(fenced):
        out = F.when(found, name).otherwise(out)
    return out


def code_or_json(text: Column) -> Column:
    """Whether a whole text is a fenced block, one JSON value in brackets, or of a known language."""
    def told(t: Column) -> Column:
        json = ((t.startswith("{") & t.endswith("}")) | (t.startswith("[") & t.endswith("]"))) & F.try_parse_json(t).isNotNull()
        return t.startswith("```") | json | _language(t).isNotNull()

    return let(strip(text), told)


def distinct_lines(text: Column) -> Column:
    """``text`` without lines that repeat an earlier one but for case, fillers, spacing and end punctuation; blank lines stay."""
    both = F.transform(F.split(text, "\n"), lambda line: F.struct(line.alias("line"), dedup_key(line).alias("key"), (strip(line) == "").alias("blank")))
    kept = let(both, lambda xs: let(xs["key"], lambda keys: F.filter(xs, lambda x, i: x["blank"] | (F.array_position(keys, x["key"]) == i + 1))))
    return F.array_join(F.transform(kept, lambda x: x["line"]), "\n")


def normalize_system(text: Column, bound: bool = True) -> Column:
    """A system prompt without repeated lines and contradictions, with a boundary to speculation if ``bound``."""
    out = resolve_conflicts(distinct_lines(text))
    return bound_speculation(out) if bound else out


def normalize_requests(requests: DataFrame, bound: bool = True) -> DataFrame:
    """Requests as nested rows with their system texts normalized, lines repeated in user texts dropped, a plain system prompt
    split at its separator, and tools in order of their names."""
    block = lambda b: F.when((b["type"] == "text") & (F.coalesce(b["text"], F.lit("")) != ""), b.withField("text", normalize_system(b["text"], bound))).otherwise(b)
    user = lambda b: F.when(b["type"] == "text", b.withField("text", distinct_lines(b["text"]))).otherwise(b)
    out = requests.withColumns({"system": F.transform("system", block), "messages": F.transform("messages", lambda m: F.when(m["role"] == "user", m.withField("blocks", F.transform(m["blocks"], user))).otherwise(m))})
    parts = F.transform(system_blocks(F.get("system", F.lit(0))["text"]), lambda b: F.struct(F.lit("text").alias("type"), b["text"].alias("text"), b["cached"].alias("cached")))
    two = F.col("system_is_string") & (F.size(parts) > 1)
    out = out.withColumns({"system": F.when(two, parts).otherwise(F.col("system")), "system_is_string": F.col("system_is_string") & ~F.coalesce(two, F.lit(False))})
    return out.withColumn("tools", sort_tools(F.col("tools"))) if "tools" in requests.columns else out
