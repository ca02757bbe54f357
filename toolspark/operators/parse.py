"""Tool calls of a text column. Narrow: no shuffle. Only rows with a mark of some dialect reach Python."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from toolspark.config import CALL_PREFIXES, CALL_TAGS, GROUP_TAGS, PARAM_TAGS, ParserConfig
from toolspark.functions import clean, dialects, lenient, raw

CALL = StructType([StructField(n, StringType()) for n in ("name", "args_json", "raw_source", "dialect")])
RAW = StructType([StructField(n, StringType()) for n in ("name", "raw_args", "raw_source", "call_id", "args_json", "error")])


def _structs(rows: list[dict | None], names: list[str]) -> pa.StructArray:
    columns = [pa.array([None if r is None else r[n] for r in rows], pa.string()) for n in names]
    return pa.StructArray.from_arrays(columns, fields=[pa.field(n, pa.string()) for n in names], mask=pa.array([r is None for r in rows], pa.bool_()))


def _lists(rows: list[list], values) -> pa.ListArray:
    """values(all items) as lists; a null row gives a null list."""
    ends = [0]
    for r in rows:
        ends.append(ends[-1] + len(r or ()))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values([x for r in rows for x in r or ()]), mask=pa.array([r is None for r in rows], pa.bool_()))


def text_map(fn, returns):
    """A vectorised UDF that maps fn over a text column; null stays null. fn gives a text, a dict for a struct of texts, or a list of either."""
    item = returns.elementType if isinstance(returns, ArrayType) else returns
    values = (lambda rows: _structs(rows, item.names)) if isinstance(item, StructType) else (lambda rows: pa.array(rows, pa.string()))

    def run(s: pa.Array) -> pa.Array:
        out = [None if x is None else fn(x) for x in s.to_pylist()]
        return _lists(out, values) if isinstance(returns, ArrayType) else values(out)

    # said to vary so that no rule evaluates it twice (a filter inferred from an explode would)
    run.__annotations__ = {"s": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, returns).asNondeterministic()


def _any(words) -> str:
    return "|".join(re.escape(w) for w in words)


#: One expression for all guards: a tag or token, an object, a labelled line, a key or colon that lost its brace, a call at a line's start or after a word that
#: announces it, a thought (what stands around it may join to a mark).
MARKS = "|".join(
    [
        rf"<[｜|]*(?:dsml[｜|]*)?(?:{_any([*CALL_TAGS, *GROUP_TAGS, *PARAM_TAGS, 'tool_name', 'function_name', 'action_name', 'python_tag'])}|tool\s)",
        r"\{|\[tool_call|action:|function",
        r""":\s*["'][\w-]+["']\s*,|(?:tool|name|action|tool_name)["']?\s*:|^\s*"?\s*:""",
        rf"(?:^|\n|`|{_any(CALL_PREFIXES)})[\s*`>-]*(?:call:\s*)?[^\W\d][\w.]*\s*\(",
        r"<[｜|]?(?:think|thought|reasoning)",
    ]
)


def may_hold_calls(text: Column, cfg: ParserConfig) -> Column:
    """False for rows in which no dialect finds a call."""
    marks = text.rlike(f"(?iU){MARKS}")
    return marks | text.rlike(r"(?m)^\s*(?:[$#] |python |git |pytest |(?i:submit)\s*$)") if cfg.allow_shell_fallback else marks


def calls(text: Column, cfg: ParserConfig | None = None) -> Column:
    """array<struct<name, args_json, raw_source, dialect>>; empty for null or no call."""
    cfg = cfg or ParserConfig()

    def one(t: str) -> list[dict[str, str]]:
        try:
            return [{"name": c.name, "args_json": lenient.canonical(c.args), "raw_source": c.source, "dialect": c.dialect} for c in dialects.parse(t, cfg)]
        except (RecursionError, ValueError):
            return []

    found = text_map(one, ArrayType(CALL))(F.when(may_hold_calls(text, cfg), text))
    return F.coalesce(found, F.array().cast(ArrayType(CALL)))


def added(df: DataFrame, prefix: str, *names: str) -> list[str]:
    """Names of the columns that an operator adds; ValueError if df has one of them."""
    out = [prefix + n for n in names]
    if clash := sorted({c.lower() for c in df.columns} & {n.lower() for n in out}):
        raise ValueError(f"the table already has columns named {clash}; give a prefix for the new ones")
    return out


def _exploded(df: DataFrame, found: Column, names: list[str], fields: list[str]) -> DataFrame:
    rows = df.select(F.struct(*df.columns).alias("row"), F.posexplode(found).alias("at", "call"))
    return rows.select("row.*", F.col("at").alias(names[0]), *[F.col(f"call.{f}").alias(n) for f, n in zip(fields, names[1:], strict=True)])


def parse_tool_calls(df: DataFrame, text_col: str = "text", cfg: ParserConfig | None = None, strict: bool = False, prefix: str = "") -> DataFrame:
    """df's rows once for each call, with call_index, name, args_json, raw_source, dialect (after ``prefix``); a row without a call goes, or fails the query if
    strict. A table that has columns of these names needs a prefix."""
    names = added(df, prefix, "call_index", *CALL.names)
    found = calls(F.col(text_col), cfg)
    if strict:
        text = F.col(text_col)
        message = F.concat(F.lit("No recognized tool call found in LLM response: "), F.left(text, F.lit(clean.PREVIEW)), F.when(F.length(text) > clean.PREVIEW, "...").otherwise(""))
        inner = F.transform(F.array(found), lambda c: F.when(F.size(c) == 0, F.raise_error(F.coalesce(message, F.lit("No text"))).cast(ArrayType(CALL))).otherwise(c))
        found = F.element_at(inner, 1)
    return _exploded(df, found, names, CALL.names)


def first_call(df: DataFrame, text_col: str = "text", cfg: ParserConfig | None = None, prefix: str = "") -> DataFrame:
    """df with the first call of each text, nulls where there is none."""
    names = added(df, prefix, *CALL.names)
    rows = df.select(F.struct(*df.columns).alias("row"), F.get(calls(F.col(text_col), cfg), F.lit(0)).alias("call"))
    return rows.select("row.*", *[F.col(f"call.{f}").alias(n) for f, n in zip(CALL.names, names, strict=True)])


def raw_calls(df: DataFrame, text_col: str = "text", prefix: str = "", first: bool = False) -> DataFrame:
    """df's rows once for each raw call (or its first), with its argument text and what it reads as (or the error)."""
    names = added(df, prefix, "call_index", *RAW.names)

    def one(t: str) -> list[dict[str, str | None]]:
        out = []
        for c in raw.extract(t)[: 1 if first else None]:
            row: dict[str, str | None] = c._asdict() | {"args_json": None, "error": None}
            try:
                row["args_json"] = lenient.canonical(raw.parse_args(c))
            except ValueError as e:
                row["error"] = str(e)
            out.append(row)
        return out

    found = text_map(one, ArrayType(RAW))(F.when(may_hold_calls(F.col(text_col), ParserConfig()), F.col(text_col)))
    return _exploded(df, found, names, RAW.names)


def _listed(df: DataFrame, allowed: DataFrame, text_col: str, name_col: str, prefix: str, how: str) -> DataFrame:
    found = parse_tool_calls(df, text_col, prefix=prefix)
    listed = allowed.select(F.col(name_col).alias("listed"))
    return found.join(listed, found[f"{prefix}name"] == listed["listed"], how)


def rejected_calls(df: DataFrame, allowed: DataFrame, text_col: str = "text", name_col: str = "name", prefix: str = "") -> DataFrame:
    """Calls whose tool is not in allowed(name): an anti join, so the list may be of any size."""
    return _listed(df, allowed, text_col, name_col, prefix, "left_anti")


def permitted_calls(df: DataFrame, allowed: DataFrame, text_col: str = "text", name_col: str = "name", prefix: str = "") -> DataFrame:
    return _listed(df, allowed, text_col, name_col, prefix, "left_semi")


_PAIR = r"(?is)<[｜|]?(?:think|thought|reasoning)[｜|]?>.*?</[｜|]?(?:think|thought|reasoning)[｜|]?>"
_OPEN = r"(?i)<[｜|]?(?:think|thought|reasoning)[｜|]?>"


def strip_thinking(text: Column) -> Column:
    """Text without thoughts: closed ones by an expression; only rows with an open one left go to Python."""
    closed = F.regexp_replace(F.regexp_replace(text, _PAIR, ""), r"(?U)^\s+|\s+$", "")
    out = F.when(text.rlike(_PAIR), closed).otherwise(text)
    odd = F.when(text.rlike(_OPEN) & out.rlike(_OPEN), text)
    return F.coalesce(text_map(clean.strip_thinking, StringType())(odd), out)


def repair_json(text: Column) -> Column:
    """JSON for what a text stands for; texts that are JSON stay as they are and stay out of Python."""
    bad = F.when(F.try_parse_json(text).isNull(), text)
    return F.coalesce(text_map(lenient.repaired, StringType())(bad), text)


def json_objects(text: Column) -> Column:
    """array<string> of the outermost objects in a text."""
    return F.coalesce(text_map(lenient.objects, ArrayType(StringType()))(F.when(F.contains(text, F.lit("{")) | text.rlike(r"^\s*(?:\"?\w+\":|\"?:)"), text)), F.array().cast("array<string>"))
