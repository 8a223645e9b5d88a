"""Requests written back as the JSON that they came as.

A request's line is kept as it was read; what changed in its texts is put into it by place, as VARIANT values, so keys that
this library does not know, cache marks, tool inputs and parts of results stay.  Keys come out in alphabetical order, numbers in
their shortest form.  Messages that a step made or moved have no place in the line and are written from their blocks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tersely.functions.names import let

OBJECT, LIST = "map<string,variant>", "array<variant>"


def is_list(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("ARRAY"), F.lit(False))


def is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def is_text(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def with_field(fields: Column, name: str, value: Column) -> Column:
    """``fields`` with another value of ``name``, or as they are if ``value`` is null."""
    new = F.map_concat(F.map_filter(fields, lambda k, _: k != name), F.create_map(F.lit(name), value))
    return F.when(value.isNotNull(), new).otherwise(fields)


def _text(value: Column) -> Column:
    return value.cast("variant")


def _object(fields: Column) -> Column:
    return F.to_variant_object(fields)


def _each(values: Column, edit: Callable[[Column, Column], Column]) -> Column:
    return F.to_variant_object(F.transform(values.cast(LIST), edit))


def edited_block(old: Column, b: Column) -> Column:
    """A content block's JSON value with the texts of ``b``."""
    def part(p: Column, k: Column) -> Column:
        text = F.get(b["parts"], k)["text"]
        return F.when(is_object(p), let(p.cast(OBJECT), lambda m: F.when(is_text(m["text"]), _object(with_field(m, "text", _text(text)))).otherwise(p))).otherwise(p)

    def one(m: Column) -> Column:
        content = F.when(b["result"].isNotNull(), _text(b["result"])).when(b["parts"].isNotNull() & is_list(m["content"]), _each(m["content"], part))
        return F.when((b["type"] == "text") & is_text(m["text"]), _object(with_field(m, "text", _text(b["text"])))).when((b["type"] == "tool_result") & (is_text(m["content"]) | is_list(m["content"])), _object(with_field(m, "content", content))).otherwise(old)

    return F.when(is_object(old), let(old.cast(OBJECT), one)).otherwise(old)


def made_block(b: Column) -> Column:
    """The JSON value of a block, from its own JSON where it has that, else from its fields."""
    known = lambda *names: F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[_text(b[n]) for n in names])), lambda _, v: v.isNotNull())
    parts = F.transform(b["parts"], lambda p: _object(F.map_filter(F.map_from_arrays(F.array(F.lit("type"), F.lit("text")), F.array(_text(p["type"]), _text(p["text"]))), lambda _, v: v.isNotNull())))
    content = F.when(b["result"].isNotNull(), _text(b["result"])).otherwise(F.to_variant_object(parts))
    call = with_field(known("type", "id", "name"), "input", F.try_parse_json(b["input"]))
    fresh = F.when(b["type"] == "tool_use", call).when(b["type"] == "tool_result", with_field(known("type", "tool_use_id"), "content", content)).otherwise(known("type", "text"))
    return F.when(b["raw"].isNotNull(), edited_block(F.try_parse_json(b["raw"]), b)).otherwise(_object(fresh))


def edited_message(old: Column, m: Column) -> Column:
    """A message's JSON value with the texts of ``m``."""
    def one(fields: Column) -> Column:
        content = fields["content"]
        plain = F.when(m["is_string"] & is_text(content), _text(F.get(m["blocks"], F.lit(0))["text"]))
        same = ~m["is_string"] & is_list(content) & (F.size(m["blocks"]) == F.size(content.cast(LIST)))
        new = plain.when(same, _each(content, lambda b, j: edited_block(b, F.get(m["blocks"], j))))
        return _object(with_field(fields, "content", new))

    return F.when(is_object(old), let(old.cast(OBJECT), one)).otherwise(old)


def made_message(m: Column) -> Column:
    content = F.when(m["is_string"], _text(F.get(m["blocks"], F.lit(0))["text"])).otherwise(F.to_variant_object(F.transform(m["blocks"], made_block)))
    return _object(with_field(F.map_filter(F.create_map(F.lit("role"), _text(m["role"])), lambda _, v: v.isNotNull()), "content", content))


def written_messages(raw: Column, messages: Column) -> Column:
    """The messages as one JSON value: those of the line, edited, if there are as many; else made from their blocks; else the line's."""
    old = F.try_variant_get(raw, "$.messages", "variant")
    edited = _each(old, lambda x, i: edited_message(x, F.get(messages, i)))
    aligned = is_list(old) & (F.size(old.cast(LIST)) == F.size(messages))
    return F.when(messages.isNull(), old).when(aligned, edited).otherwise(F.to_variant_object(F.transform(messages, made_message)))


def written_system(raw: Column, system: Column, is_string: Column) -> Column:
    """The system prompt as one JSON value, null if there is none."""
    old = F.try_variant_get(raw, "$.system", "variant")

    def block(b: Column, i: Column) -> Column:
        text = F.get(system, i)["text"]
        return F.when(is_object(b), let(b.cast(OBJECT), lambda m: F.when(is_text(m["text"]), _object(with_field(m, "text", _text(text)))).otherwise(b))).otherwise(b)

    marked = F.transform(system, lambda b: _object(F.map_filter(F.map_from_arrays(F.array(F.lit("type"), F.lit("text"), F.lit("cache_control")), F.array(_text(F.lit("text")), _text(b["text"]), F.when(b["cached"], F.parse_json(F.lit('{"type":"ephemeral"}'))))), lambda _, v: v.isNotNull())))
    aligned = is_list(old) & (F.size(old.cast(LIST)) == F.size(system))
    return F.when(system.isNull(), old).when(is_string, _text(F.get(system, F.lit(0))["text"])).when(aligned, _each(old, block)).otherwise(F.to_variant_object(marked))


def wire(requests: DataFrame, raw: str = "raw", name: str = "line") -> DataFrame:
    """``requests`` with the JSON line of each: the one it came as (``raw``), with its system prompt, messages and tools as they are now.

    Without changes the line is what it was but for the order of its keys; a line that is no JSON object gives null.
    """
    body = F.try_parse_json(raw)
    tools = F.try_parse_json("tools_json") if "tools_json" in requests.columns else F.lit(None).cast("variant")
    fields = lambda v: with_field(with_field(with_field(v.cast(OBJECT), "messages", written_messages(v, F.col("messages"))), "system", written_system(v, F.col("system"), F.col("system_is_string"))), "tools", tools)
    return requests.withColumn(name, let(body, lambda v: F.when(is_object(v), F.to_json(_object(fields(v))))))


def tools_text(line: Column) -> Column:
    """The tools of a request's line as compact JSON with keys in order; null if it has none."""
    found = F.try_variant_get(F.try_parse_json(line), "$.tools", "variant")
    return F.when(is_list(found), F.to_json(found))
