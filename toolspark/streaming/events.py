"""Streams of text chunks to streams of events, and streams of SSE lines to another protocol's.

Chunks carry (stream_id, seq, chunk, is_last). Spark gives no order within a key, so a chunk waits in the state until all before it came.
A stream ends with its last chunk, or when its timer runs out. Spark runs batches without end for such timers, so a query that is to stop by
itself (trigger availableNow) takes timeout_ms=None; streams without a last chunk then wait in the state for the next run.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from toolspark.config import ParserConfig
from toolspark.functions.events import Event, StreamParser
from toolspark.functions.lenient import canonical
from toolspark.functions.protocols import State, StreamTranslator

EVENTS = "stream_id string, seq long, event_index int, event_type string, text string, name string, args_json string"
LINES = "stream_id string, seq long, line_index int, line string"
_STATE = "next long, waiting string, inner string, emitted int"
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
TIMEOUT = 600_000


def _rows(key: str, seq: int, first: int, events: list[Event]) -> list[tuple[Any, ...]]:
    return [(key, seq, first + i, e.kind, e.text or None, e.name, canonical(e.call.args) if e.call else None) for i, e in enumerate(events)]


def _in_order(df: DataFrame, schema: str, start: Callable[[Any], Any], step: Callable[[Any, str], list[Any]], end: Callable[[Any], list[Any]], row: Callable[[Any, int, int, Any], tuple[Any, ...]]) -> DataFrame:
    """Whole streams of a static table, each read in order of seq. Streams lie one after the other in sorted partitions, so a task holds one stream's parser and never its chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        kinds = [_ARROW[c.split()[1]] for c in schema.split(", ")]
        key, state, last, made, out = None, None, 0, 0, []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

        for b in batches:
            for sid, seq, chunk in zip(*[b.column(c).to_pylist() for c in ("stream_id", "seq", "chunk")], strict=True):
                if state is None or sid != key:
                    if state is not None:
                        out += [row(key, last, made + i, x) for i, x in enumerate(end(state))]
                    key, state, made = sid, start(sid), 0
                new = [row(key, seq, made + i, x) for i, x in enumerate(step(state, chunk or ""))]
                made, last = made + len(new), seq
                out += new
                if len(out) >= 4096:
                    yield batch()
                    out = []
        if state is not None:
            out += [row(key, last, made + i, x) for i, x in enumerate(end(state))]
        yield batch()

    return df.select("stream_id", "seq", "chunk").repartition("stream_id").sortWithinPartitions("stream_id", "seq").mapInArrow(run, schema)


def parsed_batch(df: DataFrame, cfg: ParserConfig | None = None) -> DataFrame:
    """Events of whole streams in a static table."""
    return _in_order(df, EVENTS, lambda _: StreamParser(cfg), lambda p, c: p.feed(c), lambda p: p.finish(), lambda k, s, i, e: _rows(k, s, i, [e])[0])


def _timer(timeout_ms: int | None) -> str:
    return GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout


def _ordered(chunks: Iterator[pd.DataFrame], state: GroupState, empty: str) -> tuple[int, dict[int, list[Any]], str, int]:
    nxt, waiting, inner, emitted = state.get if state.exists else (0, "{}", empty, 0)
    held = {int(k): v for k, v in json.loads(waiting).items()}
    for t in chunks:
        held |= {int(s): [c, bool(z)] for s, c, z in zip(t.seq, t.chunk, t.is_last, strict=True) if s >= nxt}
    return nxt, held, inner, emitted


def parsed_stream(df: DataFrame, cfg: ParserConfig | None = None, timeout_ms: int | None = TIMEOUT) -> DataFrame:
    """Events of a streaming table; seq counts from 0 in each stream."""

    def run(key: tuple[Any, ...], chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        p = StreamParser(cfg)
        nxt, held, inner, emitted = _ordered(() if state.hasTimedOut else chunks, state, json.dumps(p.state()))
        p.restore(json.loads(inner))
        out: list[tuple[Any, ...]] = []
        ended = state.hasTimedOut
        while nxt in held and not ended:
            chunk, ended = held.pop(nxt)
            out += _rows(key[0], nxt, emitted + len(out), p.feed(chunk or ""))
            nxt += 1
        if ended:
            out += _rows(key[0], max(nxt - 1, 0), emitted + len(out), p.finish())
            state.remove()
        else:
            state.update((nxt, json.dumps(held), json.dumps(p.state()), emitted + len(out)))
            if timeout_ms is not None:
                state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in EVENTS.split(", ")])

    return df.groupBy("stream_id").applyInPandasWithState(run, EVENTS, _STATE, "append", _timer(timeout_ms))


def translated_stream(df: DataFrame, source: str, target: str, timeout_ms: int | None = TIMEOUT) -> DataFrame:
    """SSE lines (chunk holds a line) of a streaming table from one protocol to another."""

    def run(key: tuple[Any, ...], chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t = StreamTranslator(source, target, stream_id=f"msg_{key[0]}")
        nxt, held, inner, emitted = _ordered(() if state.hasTimedOut else chunks, state, json.dumps(vars(t.state)))
        t.state = State(**json.loads(inner))
        out: list[tuple[Any, ...]] = []
        ended = state.hasTimedOut
        while nxt in held and not ended:
            line, ended = held.pop(nxt)
            out += [(key[0], nxt, emitted + len(out) + i, x) for i, x in enumerate(t.line(line or ""))]
            nxt += 1
        if ended:
            state.remove()
        else:
            state.update((nxt, json.dumps(held), json.dumps(vars(t.state)), emitted + len(out)))
            if timeout_ms is not None:
                state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in LINES.split(", ")])

    return df.groupBy("stream_id").applyInPandasWithState(run, LINES, _STATE, "append", _timer(timeout_ms))


def translated_batch(df: DataFrame, source: str, target: str) -> DataFrame:
    """SSE lines of whole streams in a static table from one protocol to another."""
    return _in_order(df, LINES, lambda k: StreamTranslator(source, target, stream_id=f"msg_{k}"), lambda t, c: t.line(c), lambda _: [], lambda k, s, i, x: (k, s, i, x))
