"""Readers of request logs: JSON lines with content that is a string or a list of blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tersely.operators.requests import text_block
from tersely.operators.wire import tools_text

_BLOCK = "type:string,text:string,id:string,name:string,input:string,tool_use_id:string,content:string"
#: Content is read as text first: a list of blocks comes as its JSON.
LINE = "request_id string, ts timestamp, model string, level double, headers map<string,string>, system string, messages array<struct<role:string,content:string>>, tools array<struct<name:string,description:string,input_schema:string,parameters:string>>"
#: The same with content as lists, null where it is a string.
LISTS = "system array<string>, messages array<struct<content:array<string>>>"


def block(raw: Column) -> Column:
    """A content block from its JSON; results are a string or a list of parts."""
    b = F.from_json(raw, f"struct<{_BLOCK}>")
    parts = F.from_json(raw, "struct<content:array<struct<type:string,text:string>>>")["content"]
    fields = [b[n].alias(n) for n in ("type", "text", "id", "name", "input", "tool_use_id")]
    return F.struct(*fields, F.when(parts.isNull(), b["content"]).alias("result"), parts.alias("parts"), raw.alias("raw"))


def parsed(line: Column) -> Column:
    """A request as a nested row from its JSON; null if the line is none."""
    flat, lists = F.from_json(line, LINE), F.from_json(line, LISTS)
    some = lambda m, i: F.get(lists["messages"], i)["content"]
    message = lambda m, i: F.struct(m["role"].alias("role"), some(m, i).isNull().alias("is_string"), F.when(some(m, i).isNull(), F.array(text_block(F.coalesce(m["content"], F.lit(""))))).otherwise(F.transform(some(m, i), block)).alias("blocks"))
    parts = F.transform(lists["system"], lambda raw: F.from_json(raw, "struct<type:string,text:string,cache_control:string>"))
    held = F.transform(parts, lambda b: F.struct(b["type"].alias("type"), b["text"].alias("text"), b["cache_control"].isNotNull().alias("cached")))
    plain = F.when(flat["system"].isNotNull(), F.array(F.struct(F.lit("text").alias("type"), flat["system"].alias("text"), F.lit(False).alias("cached"))))
    tools = F.transform(flat["tools"], lambda t: F.struct(t["name"].alias("name"), t["description"].alias("description"), F.coalesce(t["input_schema"], t["parameters"]).alias("schema")))
    row = F.struct(
        *[flat[n].alias(n) for n in ("request_id", "ts", "model", "level", "headers")], F.coalesce(held, plain).alias("system"), (lists["system"].isNull() & flat["system"].isNotNull()).alias("system_is_string"),
        F.transform(flat["messages"], message).alias("messages"), tools.alias("tools"), tools_text(line).alias("tools_json"), line.alias("raw"),
    )
    return F.when(flat["messages"].isNotNull(), row)


def read_requests(spark: SparkSession, path: str, seen: Observation | None = None) -> DataFrame:
    """The requests of a log, with the line that each came as (``raw``); lines without messages are left out.

    ``seen`` counts, in the same pass, all ``lines``, those ``rejected`` that are no JSON object and those ``without_messages``; it
    can be read after an action on the rows.  Read nested tables with ``spark.read.parquet``.
    """
    rows = spark.read.text(path).select("value", parsed(F.col("value")).alias("r"))
    if seen is not None:
        known = F.try_parse_json("value")
        broken = known.isNull() | ~F.schema_of_variant(known).startswith("OBJECT")
        rows = rows.observe(seen, F.count(F.lit(1)).alias("lines"), F.count_if(broken).alias("rejected"), F.count_if(~broken & F.col("r").isNull()).alias("without_messages"))
    return rows.where("r is not null").select("r.*")
