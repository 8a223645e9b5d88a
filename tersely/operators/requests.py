"""Whole requests as nested rows: model, system blocks, messages of blocks, tools.

A request is one row, so steps within it are functions of arrays and need no shuffle.  Content that is one string is a single
text block with ``is_string`` set, so it is written back in the shape it had.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tersely.functions.text import text_tokens
from tersely.operators.conversation import MESSAGE_OVERHEAD, SYSTEM_OVERHEAD

BLOCK = "struct<type:string,text:string,id:string,name:string,input:string,tool_use_id:string,result:string,parts:array<struct<type:string,text:string>>,raw:string>"
MESSAGE = f"struct<role:string,is_string:boolean,blocks:array<{BLOCK}>>"
SYSTEM = "array<struct<type:string,text:string,cached:boolean>>"
TOOL = "struct<name:string,description:string,schema:string>"
# Tokens that a block has besides its texts.
TOOL_USE, TOOL_RESULT, IMAGE, TOOL_EACH = 10, 8, 1600, 8


def text_block(text: Column) -> Column:
    empty = {name: F.lit(None).cast(kind).alias(name) for name, kind in (("id", "string"), ("name", "string"), ("input", "string"), ("tool_use_id", "string"), ("result", "string"), ("parts", "array<struct<type:string,text:string>>"), ("raw", "string"))}
    return F.struct(F.lit("text").alias("type"), text.alias("text"), *empty.values())


def message(role: Column | str, text: Column) -> Column:
    """A message whose content is one string."""
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), F.lit(True).alias("is_string"), F.array(text_block(text)).alias("blocks"))


def total(xs: Column, f: Callable[[Column], Column]) -> Column:
    return F.aggregate(F.coalesce(xs, F.array().cast("array<string>")) if xs is None else xs, F.lit(0).cast("long"), lambda n, x: n + F.coalesce(f(x), F.lit(0).cast("long")))


def block_tokens(block: Column) -> Column:
    kind, none = block["type"], F.lit(0).cast("long")
    result = F.when(block["result"].isNotNull(), text_tokens(block["result"])).otherwise(F.coalesce(total(block["parts"], lambda p: F.when(p["type"] == "text", text_tokens(p["text"]))), none))
    return (
        F.when(kind == "text", text_tokens(block["text"]))
        .when(kind == "tool_use", text_tokens(block["name"]) + text_tokens(block["input"]) + TOOL_USE)
        .when(kind == "tool_result", result + TOOL_RESULT).when(kind == "image", F.lit(IMAGE).cast("long"))
        .when(kind.isNotNull(), text_tokens(block["raw"])).otherwise(none)
    )


def message_tokens(m: Column) -> Column:
    return F.coalesce(total(m["blocks"], block_tokens), F.lit(0).cast("long")) + MESSAGE_OVERHEAD


def tools_json(requests: DataFrame) -> Column | None:
    """The tools of requests as the JSON list that is sent: the one they came with, else made from their fields; None without tools."""
    if "tools_json" in requests.columns:
        return F.col("tools_json")
    if "tools" not in requests.columns:
        return None
    value = lambda x: x.cast("variant")
    known = lambda t: F.map_from_arrays(F.array(*map(F.lit, ("name", "description", "input_schema"))), F.array(value(t["name"]), value(t["description"]), F.coalesce(F.try_parse_json(t["schema"]), value(t["schema"]))))
    return F.to_json(F.to_variant_object(F.transform("tools", lambda t: F.to_variant_object(F.map_filter(known(t), lambda _, v: v.isNotNull())))))


def request_tokens(system: Column, system_is_string: Column, messages: Column, tools_json: Column | None = None) -> Column:
    """Tokens of a request: its system text, messages and tools with their overhead; the tools are their JSON list as it is sent."""
    texts = F.coalesce(total(system, lambda b: F.when(b["type"] == "text", text_tokens(b["text"]))), F.lit(0).cast("long"))
    head = F.when(system.isNull() | (system_is_string & (texts == 0)), 0).otherwise(texts + SYSTEM_OVERHEAD)
    out = head + F.coalesce(total(messages, message_tokens), F.lit(0).cast("long"))
    if tools_json is not None:
        out = out + F.when(tools_json.isNull(), 0).otherwise(text_tokens(tools_json) + TOOL_EACH * F.coalesce(F.json_array_length(tools_json), F.lit(0)))
    return out.cast("long")


def content_text(m: Column) -> Column:
    """All text of a message, one line a block: texts and results."""
    inner = lambda b: F.coalesce(b["result"], F.array_join(F.transform(F.filter(b["parts"], lambda p: p["type"] == "text"), lambda p: p["text"]), "\n"), F.lit(""))
    return F.array_join(F.transform(F.filter(m["blocks"], lambda b: b["type"].isin("text", "tool_result")), lambda b: F.when(b["type"] == "text", b["text"]).otherwise(inner(b))), "\n")


def blocks(requests: DataFrame, key: str = "request_id") -> DataFrame:
    """One row a block: ``key, msg_idx, role, is_string, n_messages, block_idx`` and the block's fields."""
    each = requests.select(key, F.size("messages").alias("n_messages"), F.posexplode("messages").alias("msg_idx", "m"))
    return each.select(key, "n_messages", "msg_idx", "m.role", "m.is_string", F.posexplode_outer("m.blocks").alias("block_idx", "b")).select(key, "n_messages", "msg_idx", "role", "is_string", "block_idx", "b.*")


def assemble(rows: DataFrame, key: str = "request_id") -> DataFrame:
    """``key, messages`` from ``blocks``: the inverse, whatever the order of the rows."""
    fields = [f.split(":", 1)[0] for f in ("type:", "text:", "id:", "name:", "input:", "tool_use_id:", "result:", "parts:", "raw:")]
    one = rows.groupBy(key, "msg_idx", "role", "is_string").agg(F.sort_array(F.collect_list(F.when(F.col("block_idx").isNotNull(), F.struct("block_idx", F.struct(*fields).alias("b"))))).alias("bs"))
    told = one.select(key, "msg_idx", F.struct("role", "is_string", F.transform("bs", lambda x: x["b"]).alias("blocks")).alias("m"))
    return told.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("msg_idx", "m"))), lambda x: x["m"]).alias("messages"))


def is_tool(m: Column) -> Column:
    return F.exists(m["blocks"], lambda b: b["type"].isin("tool_use", "tool_result"))


def with_text(block: Column, text: Column) -> Column:
    return block.withField("text", text)


def with_result(block: Column, text: Column) -> Column:
    """A tool result whose content is ``text``."""
    return block.withField("result", text).withField("parts", F.lit(None).cast("array<struct<type:string,text:string>>"))


def each_block(m: Column, f: Callable[[Column], Column]) -> Column:
    return m.withField("blocks", F.transform(m["blocks"], f))
