"""SQL names for the operators, and facts about the engine."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from toolspark.functions import clean, convert, dialects, lenient
from toolspark.operators.parse import CALL, text_map


@F.udtf(returnType="call_index int, name string, args_json string, raw_source string, dialect string", useArrow=True)
class ParseToolCalls:
    def eval(self, text: str) -> Iterator[tuple[Any, ...]]:
        try:
            found = dialects.parse(text)
        except (RecursionError, ValueError):
            found = []
        for i, c in enumerate(found):
            yield i, c.name, lenient.canonical(c.args), c.source, c.dialect


def _calls(text: str) -> list[dict[str, str]]:
    try:
        return [{"name": c.name, "args_json": lenient.canonical(c.args), "raw_source": c.source, "dialect": c.dialect} for c in dialects.parse(text)]
    except (RecursionError, ValueError):
        return []


def register(spark: SparkSession) -> None:
    """tool_calls(text), an array of structs for inline(), is read in batches; parse_tool_calls(text) is the same as a table function, row by row.
    tool_strip_thinking, tool_repair_json, tool_canonical_json, tool_mcp_call as functions."""
    spark.udtf.register("parse_tool_calls", ParseToolCalls)
    spark.udf.register("tool_calls", text_map(_calls, ArrayType(CALL)))
    for name, fn in {"tool_strip_thinking": clean.strip_thinking, "tool_repair_json": lenient.repaired, "tool_canonical_json": lenient.canonical_text, "tool_mcp_call": lambda t: lenient.canonical(convert.mcp_call(t))}.items():
        spark.udf.register(name, text_map(fn, StringType()))


def engine_info(spark: SparkSession) -> DataFrame:
    get = spark.conf.get
    return spark.createDataFrame([(spark.version, get("spark.sql.codegen.wholeStage"), get("spark.sql.adaptive.enabled"), get("spark.sql.execution.arrow.maxRecordsPerBatch"))], "spark string, codegen string, adaptive string, arrow_rows string")
