"""Payload columns (JSON texts) between protocols. A row that cannot be read gives null and an error, never a failed query."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from toolspark.config import ParserConfig
from toolspark.functions import convert, protocols, schemas
from toolspark.operators.parse import may_hold_calls, text_map

OUT = StructType([StructField("payload", StringType()), StructField("error", StringType())])


def _json(fn: Callable[[Any], Any]) -> Callable[[Column], Column]:
    def one(text: str) -> dict[str, str | None]:
        try:
            return {"payload": json.dumps(fn(json.loads(text)), ensure_ascii=False), "error": None}
        except Exception as e:  # a row's own fault becomes its error column
            return {"payload": None, "error": f"{type(e).__name__}: {e}"}

    return text_map(one, OUT)


def translated_request(payload: Column, source: str | protocols.Protocol, target: str | protocols.Protocol, model: str | None = None) -> Column:
    a, b = protocols.registry.get(source), protocols.registry.get(target)
    return _json(lambda p: protocols.translate_request(p, a, b, model))(payload)


def translated_response(payload: Column, source: str | protocols.Protocol, target: str | protocols.Protocol, model: str | None = None) -> Column:
    a, b = protocols.registry.get(source), protocols.registry.get(target)
    return _json(lambda p: protocols.translate_response(p, a, b, model))(payload)


def converted_definitions(tools: Column, source: str = "auto", target: str = "openai") -> Column:
    return _json(lambda t: convert.definitions(t if isinstance(t, list) else [t], source, target))(tools)


def converted_calls(calls: Column, source: str = "auto", target: str = "openai") -> Column:
    return _json(lambda c: convert.calls(c, source, target))(calls)


def converted_results(results: Column, source: str = "auto", target: str = "openai", names: dict[str, str] | None = None) -> Column:
    return _json(lambda r: convert.results(r, source, target, names))(results)


def mcp_results(content: Column, is_error: bool = False) -> Column:
    """MCP results of contents (JSON texts): typed parts stay as they are, other values become a text part."""
    return _json(lambda c: convert.mcp_result(c, is_error))(content)


def text_calls(text: Column, target: str = "openai") -> Column:
    """array<string>: the calls of model texts as objects of a format; empty for null, no call, or a text that cannot be read."""

    def one(t: str) -> list[str]:
        try:
            return [json.dumps(c, ensure_ascii=False) for c in convert.calls(t, "raw", target)]
        except Exception:  # one row never fails the query
            return []

    found = text_map(one, ArrayType(StringType()))(F.when(may_hold_calls(text, ParserConfig()), text))
    return F.coalesce(found, F.array().cast("array<string>"))


def gemini_schema(schema: Column) -> Column:
    return _json(schemas.for_gemini)(schema)


def openai_schema(schema: Column, strict: bool = False) -> Column:
    return _json(lambda s: schemas.for_openai(s, strict))(schema)
