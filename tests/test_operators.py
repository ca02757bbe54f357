"""DataFrame operators and queries, against SQL over the same tables and against the row functions."""

import glob
import os
import random
import time

import duckdb
import pandas as pd
import pytest

from pyspark.sql import functions as F

import __spark_entry__ as entry
from toolspark.config import ParserConfig
from toolspark.functions import clean, dialects, lenient
from toolspark.operators import canonical, parse, payloads
from toolspark.plans import queries as library
from toolspark.plans import render
from toolspark.sources import texts
from toolspark.streaming import events as streams

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


def rows(t: pd.DataFrame) -> list[tuple]:
    return sorted(tuple("NULL" if v is None or v is pd.NA or v != v else str(v) for v in r) for r in t[sorted(t.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(library.ORACLES))
def test_query_equals_its_sql(spark, db, name):
    assert rows(library.QUERIES[name](spark, DATA).toPandas()) == rows(db.execute(library.ORACLES[name]).fetchdf())


def test_entry(spark):
    assert entry.entry(spark).count() == 2
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_parsing_is_narrow(spark):
    e = spark.range(100, numPartitions=4).selectExpr("concat('{\"tool\": \"f\", \"a\": ', id, '}') text")
    plan = parse.parse_tool_calls(e)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1


TEXTS = ["a <think>x</think> b", "<think>open <tool_call>", "plain", "", None, "<thought>a</thought><think>b", "<think>x</think>"]


def test_strip_thinking_agrees_with_the_row_function(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    got = {r.i: r.t for r in df.select("i", parse.strip_thinking(df.text).alias("t")).collect()}
    assert got == {i: None if t is None else clean.strip_thinking(t) for i, t in enumerate(TEXTS)}


def test_canonical_json_agrees_with_the_row_function(spark):
    texts = ['{"b":1,"a":2}', "[1, 2]", '{"a":1.0}', '{"a":1,"a":2}', " x ", "{bad", '{"é":"ü","z":null}', '{"a":"\\u00e9"}', ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.t for r in df.select("i", canonical.canonical_json(df.text).alias("t")).collect()}
    assert got == {i: lenient.canonical_text(t) for i, t in enumerate(texts)}


def test_strict_parsing_fails(spark):
    df = spark.createDataFrame([(1, "no call")], "i int, text string")
    assert parse.parse_tool_calls(df).count() == 0
    with pytest.raises(Exception, match="No recognized tool call"):
        parse.parse_tool_calls(df, strict=True).collect()


CHUNK = "stream_id string, seq long, chunk string, is_last boolean"


def _chunks(ends=True):
    body = render.TEMPLATES["dsml"].replace("NAME", "lookup").replace("USER", "7").replace("PROPS", '{"k": 3}')
    cut = [body[i : i + 9] for i in range(0, len(body), 9)]
    return [(f"s{s}", i, c, ends and i == len(cut) - 1) for s in range(3) for i, c in enumerate(cut)]


CALLS = [(f"s{s}", "lookup", '{"props":{"k":3},"user":"7"}') for s in range(3)]


def _completed(spark, name):
    return sorted((r.stream_id, r.name, r.args_json) for r in spark.sql(f"select * from {name} where event_type = 'tool_call_completed'").collect())


def test_stream_waits_for_order_and_ends_by_itself_without_a_timer(spark, tmp_path):
    data, src = _chunks(), tmp_path / "in"
    for part in (data[1::2], data[::2]):  # odd chunks come first
        spark.createDataFrame(part, CHUNK).coalesce(1).write.mode("append").json(str(src))
    chunks = spark.readStream.schema(CHUNK).option("maxFilesPerTrigger", 1).json(str(src))
    q = streams.parsed_stream(chunks, timeout_ms=None).writeStream.format("memory").queryName("tool_events").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(120)
    finally:
        q.stop()
    assert _completed(spark, "tool_events") == CALLS


def test_stream_without_a_last_chunk_ends_by_its_timer(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame(_chunks(ends=False)[:-1], CHUNK).coalesce(1).write.json(str(src))
    chunks = spark.readStream.schema(CHUNK).json(str(src))
    q = streams.parsed_stream(chunks, timeout_ms=500).writeStream.format("memory").queryName("late_events").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        until = time.time() + 90
        while len(_completed(spark, "late_events")) < 3 and time.time() < until:
            assert q.isActive, q.exception()
            time.sleep(0.5)
    finally:
        q.stop()
    assert _completed(spark, "late_events") == CALLS


def test_batches_of_chunks_agree_with_the_parser_and_are_read_in_order(spark):
    from toolspark.functions.events import StreamParser

    rows = [*reversed(_chunks()), ("empty", 0, None, True), (None, 0, "plain", True)]
    got = streams.parsed_batch(spark.createDataFrame(rows, CHUNK)).collect()
    for key in ("s0", "s1", "s2", "empty", None):
        p, events = StreamParser(None), []
        for _, _, c, _ in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            events += p.feed(c or "")
        events += p.finish()
        mine = sorted((r for r in got if r.stream_id == key), key=lambda r: r.event_index)
        assert [(r.event_index, r.event_type, r.text, r.name) for r in mine] == [(i, e.kind, e.text or None, e.name) for i, e in enumerate(events)]
    assert streams.parsed_batch(spark.createDataFrame([], CHUNK)).collect() == []


def test_columns_of_the_same_names_are_refused_or_set_apart(spark):
    df = spark.createDataFrame([("mine", 7, '{"tool": "f", "a": 1}'), ("f", 8, '{"tool": "g"}'), ("x", 9, None)], "name string, call_index int, text string")
    allowed = spark.createDataFrame([("f",)], "name string")
    for made in (lambda: parse.parse_tool_calls(df), lambda: parse.raw_calls(df), lambda: parse.first_call(df), lambda: parse.rejected_calls(df, allowed)):
        with pytest.raises(ValueError, match="prefix"):
            made()
    got = parse.parse_tool_calls(df, prefix="c_").orderBy("call_index").collect()
    assert [(r["name"], r.call_index, r.c_call_index, r.c_name, r.c_args_json) for r in got] == [("mine", 7, 0, "f", '{"a":1}'), ("f", 8, 0, "g", "{}")]
    assert [(r["name"], r.c_name) for r in parse.rejected_calls(df, allowed, prefix="c_").collect()] == [("f", "g")]
    assert [(r["name"], r.c_name) for r in parse.permitted_calls(df, allowed, prefix="c_").collect()] == [("mine", "f")]
    assert [r.c_name for r in parse.first_call(df, prefix="c_").orderBy("call_index").collect()] == ["f", "g", None]
    assert [r.c_name for r in parse.raw_calls(df, prefix="c_", first=True).orderBy("call_index").collect()] == ["f", "g"]


ODD = ["w < x and <b>bold</b> (a: b)", "std::vector<int> v; f(x)", "see foo (bar), e.g. \"quoted\": yes", '"name" : "x"', ': "bash", "command": "ls"}', "tool: 'x', 'a': 1", "call: f(x=1)", "- run(1)", "> go(a=2)", "`f(1)`", "Вызов: f(1)", "```json\n[{\"name\": \"f\"}]\n```", "[{'name': 'f'}]", "na<think>x</think>me(a=1)", "ACTION: f\nAction Input: 2", "✿FUNCTION✿: f ✿ARGS✿: {}", "<ИНСТРУМЕНТ name=f>", "<tool_name>f</tool_name>"]


def test_guard_lets_every_call_through(spark):
    rng = random.Random(4)
    base = [t.replace("NAME", "look").replace("USER", "7").replace("PROPS", '{"k": "v"}') for t in render.TEMPLATES.values()] + ODD
    marks = ["<", ">", '"', "{", "}", "(", ")", "\n", " ", ":", "</", "```", "Action: q\nAction Input: 3", "<think>", "｜", "f(", "Ж"]
    made = list(base)
    for _ in range(3000):
        t = rng.choice(base)
        for _ in range(rng.randint(1, 4)):
            i = rng.randrange(len(t) + 1)
            t = t[:i] + rng.choice(marks) + t[i:] if rng.random() < 0.5 else t[:i] + t[i + rng.randint(1, 5) :]
        made.append(t)
    df = spark.createDataFrame(list(enumerate(made)), "i int, text string")
    passed = {r.i for r in df.where(parse.may_hold_calls(df.text, ParserConfig())).select("i").collect()}
    assert not [t for i, t in enumerate(made) if i not in passed and dialects.parse(t)]
    prose = ["He said: it is (as we know) fine [1].", "a < b > c", "Note: x", "x = f(y)", "p{"]
    assert spark.createDataFrame([(t,) for t in prose], "text string").where(parse.may_hold_calls(F.col("text"), ParserConfig())).count() == 1


def test_strict_names_what_it_could_not_read(spark):
    df = spark.createDataFrame([("a" * 250,)], "text string")
    with pytest.raises(Exception, match="response: a{200}\\.\\.\\."):
        parse.parse_tool_calls(df, strict=True).collect()
    assert parse.parse_tool_calls(spark.createDataFrame([('{"tool": "f"}',)], "text string"), strict=True).count() == 1


def test_calls_of_texts_that_cannot_be_read(spark):
    df = spark.createDataFrame([(0, '{"tool": "f", "a": 1}'), (1, "[" * 5000 + "{"), (2, None), (3, "prose")], "i int, text string")
    got = {r.i: r.c for r in df.select("i", payloads.text_calls(df.text).alias("c")).collect()}
    assert len(got[0]) == 1 and got[1] == got[2] == got[3] == []


def test_sse_lines(spark):
    df = spark.createDataFrame([('data: {"a": 1}',), ("data: [DONE]",), (": note",), ("data: {bad",)], "value string")
    assert [(r.data, r.done) for r in texts.sse_events(df).collect()] == [('{"a": 1}', False), (None, True), (None, False), (None, False)]
    e = spark.createDataFrame([("ping", "{}")], "event string, data string")
    assert e.select(texts.sse_text("anthropic").alias("t")).first().t == "event: ping\ndata: {}\n\n" and e.select(texts.sse_text("openai").alias("t")).first().t == "data: {}\n\n"


def test_chunk_files_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"stream_id": "s", "seq": 1, "chunk": "b", "is_last": true}\n{"stream_id": "s", "seq": 0, "chunk": "a", "is_last": false}\n')
    q = texts.chunk_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("chunks_seen").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    assert sorted((r.seq, r.chunk) for r in spark.table("chunks_seen").collect()) == [(0, "a"), (1, "b")]
