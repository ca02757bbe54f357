"""Canonical JSON, calls in canonical order, and calls as objects of a protocol."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from toolspark.functions import lenient
from toolspark.operators.parse import text_map


def canonical_json(text: Column) -> Column:
    """Compact JSON with sorted keys of a text that is an object or array, else the trimmed text. Rows whose numbers or characters the built-in
    functions would print otherwise, and repeated keys, go to Python; the rest stays in expressions."""
    t = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    shaped = t.rlike(r"(?s)^(?:\{.*\}|\[.*\])$")
    odd = F.when(shaped & (t.rlike(r"[\d][.eE]|[\x{10000}-\x{10FFFF}]|\\") | F.try_parse_json(t).isNull()), t)
    slow = text_map(lenient.canonical_text, StringType())(odd)
    return F.when(~shaped, t).otherwise(F.coalesce(slow, F.to_json(F.try_parse_json(t))))


def sorted_calls(calls: Column) -> Column:
    """array<struct<id, name, arguments>> in the order of name and id, arguments canonical text."""
    plain = F.transform(calls, lambda c: F.struct(c["name"].alias("name"), F.coalesce(c["id"], F.lit("")).alias("id"), c["arguments"].alias("arguments")))
    return F.array_sort(plain)


def openai_call(name: Column, args_json: Column, call_id: Column | None = None) -> Column:
    i = F.coalesce(call_id, F.concat(F.lit("call_"), name)) if call_id is not None else F.concat(F.lit("call_"), name)
    return F.to_json(F.named_struct(F.lit("id"), i, F.lit("type"), F.lit("function"), F.lit("function"), F.named_struct(F.lit("name"), name, F.lit("arguments"), args_json)))


def anthropic_call(name: Column, args_json: Column, call_id: Column) -> Column:
    return F.to_json(F.named_struct(F.lit("type"), F.lit("tool_use"), F.lit("id"), call_id, F.lit("name"), name, F.lit("input"), F.parse_json(args_json)))


def gemini_call(name: Column, args_json: Column) -> Column:
    return F.to_json(F.named_struct(F.lit("functionCall"), F.named_struct(F.lit("name"), name, F.lit("args"), F.parse_json(args_json))))


def mcp_call(name: Column, args_json: Column) -> Column:
    return F.to_json(F.named_struct(F.lit("jsonrpc"), F.lit("2.0"), F.lit("method"), F.lit("tools/call"), F.lit("params"), F.named_struct(F.lit("name"), name, F.lit("arguments"), F.parse_json(args_json))))
