"""The queries of the library and the same in SQL over the source columns."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from toolspark import sql
from toolspark.functions import protocols
from toolspark.operators import canonical, parse, payloads, relational, semantics
from toolspark.plans import render
from toolspark.sources.texts import spread
from toolspark.streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    def add(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if oracle:
            ORACLES[key] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "events"), f"{d}/events.parquet")


def _args(c: str = "args_json") -> list:
    return [F.get_json_object(c, "$.user").alias("user_text"), F.get_json_object(c, "$.props.k").alias("k")]


_NAME = "case event_type when 'view' then 'read_file' else event_type end"
_SOURCE = f"select event_id, 0 call_index, {_NAME} as name, cast(user_id as varchar) user_text, json_extract_string(props, '$.k') k from events"


def _dialect_query(dialect: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        e = _events(spark, d).select("event_id", render.rendered(dialect, F.col("event_type"), F.col("user_id"), F.col("props")).alias("text"))
        return parse.parse_tool_calls(e).select("event_id", "call_index", "name", *_args())

    return run


for _d in render.DIALECTS:
    query(_SOURCE, f"parse_{_d}")(_dialect_query(_d))


def _mixed(spark: SparkSession, d: str, think: bool = False) -> DataFrame:
    text = render.mixed(F.col("event_id"), F.col("event_type"), F.col("user_id"), F.col("props"))
    if think:
        text = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('<think>maybe {"tool": "bash", "command": "rm"}</think>\n'), text)).otherwise(text)
    return _events(spark, d).select("event_id", "user_id", text.alias("text"))


_CATEGORY = "case event_type when 'view' then 'read' else 'unknown' end"


@query(f"select {_CATEGORY} category, count(*) calls, count(distinct user_id) users from events group by 1")
def mixed_dialect_category_counts(spark, d):
    calls = parse.parse_tool_calls(_mixed(spark, d, True))
    return calls.groupBy(semantics.category(F.col("name"), semantics.command_of(F.col("args_json"))).alias("category")).agg(F.count("*").alias("calls"), F.countDistinct("user_id").alias("users"))


@query(f"select {_NAME} as name, {_CATEGORY} category, case when event_id % 12 is null then 'all' else cast(event_id % 12 as varchar) end dialect_no, count(*) calls from events group by grouping sets ((event_type, event_id % 12), (event_type), ())".replace(f"select {_NAME} as name, {_CATEGORY} category", f"select case when event_type is null then null else {_NAME} end as name, case when event_type is null then null else {_CATEGORY} end category"))
def rollup_by_dialect(spark, d):
    calls = parse.parse_tool_calls(_mixed(spark, d)).withColumn("dialect_no", F.col("event_id") % 12)
    out = calls.rollup("name", "dialect_no").agg(F.count("*").alias("calls"))
    return out.select("name", F.when(F.col("name").isNotNull(), semantics.category(F.col("name"))).alias("category"), F.coalesce(F.col("dialect_no").cast("string"), F.lit("all")).alias("dialect_no"), "calls")


@query(f"select {_NAME} as name, count(*) calls from events group by 1 order by calls desc, name limit 3")
def topk_tools(spark, d):
    return parse.parse_tool_calls(_mixed(spark, d)).groupBy("name").agg(F.count("*").alias("calls")).orderBy(F.desc("calls"), "name").limit(3)


@query(f"select event_id, {_NAME} as name from events")
def first_call(spark, d):
    return parse.first_call(_mixed(spark, d, True)).select("event_id", "name")


_TRIM = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


@query(f"select doc_id, length({_TRIM})::bigint n, md5({_TRIM}) digest from documents")
def strip_thinking_docs(spark, d):
    t = table(spark, d, "documents").select("doc_id", parse.strip_thinking(F.concat(F.lit("<think>plan\nmore</think>"), "text")).alias("t"))
    return t.select("doc_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("digest"))


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), f"{d}/orders.parquet")


def _damage(name: str, text: Callable, oracle_extra: str = ""):
    def run(spark: SparkSession, d: str) -> DataFrame:
        o = _orders(spark, d).select("o_orderkey", text(F.col("o_custkey").cast("string"), F.col("o_orderpriority")).alias("text"))
        return parse.parse_tool_calls(o).select("o_orderkey", "name", F.get_json_object("args_json", "$.customer").alias("customer"), F.get_json_object("args_json", "$.note").alias("note"))

    query(f"select o_orderkey, 'lookup' as name, cast(o_custkey as varchar) customer, o_orderpriority{oracle_extra} note from orders", name)(run)


_damage("headless_recovery", lambda c, p: F.concat(F.lit('tool": "lookup", "customer": '), c, F.lit(', "note": "'), p, F.lit('"}')))
_damage("headless_colon_recovery", lambda c, p: F.concat(F.lit(': "lookup", "customer": '), c, F.lit(', "note": "'), p, F.lit('"}')))
_damage("truncated_recovery", lambda c, p: F.concat(F.lit('{"tool": "lookup", "customer": '), c, F.lit(', "note": "'), p))
_damage("trailing_comma", lambda c, p: F.concat(F.lit('```json\n{"tool": "lookup", "customer": '), c, F.lit(', "note": "'), p, F.lit('",}\n```')))
_damage("single_quotes", lambda c, p: F.concat(F.lit("{'tool': 'lookup', 'customer': "), c, F.lit(", 'note': '"), p, F.lit("'}")))
_damage("unescaped_quotes", lambda c, p: F.concat(F.lit('{"tool": "lookup", "customer": '), c, F.lit(', "note": "say "'), p, F.lit('" now"}')), "")
ORACLES["unescaped_quotes"] = "select o_orderkey, 'lookup' as name, cast(o_custkey as varchar) customer, 'say \"' || o_orderpriority || '\" now' note from orders"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"))


@query("select l_orderkey, cast(l_partkey as varchar) part, cast(l_quantity::int as varchar) quantity from lineitem")
def multi_call_explode(spark, d):
    one = F.format_string('{"name": "pick", "arguments": {"part": %d, "quantity": %d}}', "l_partkey", "q")
    t = _lines(spark, d).groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(one)), ", ").alias("body"))
    calls = parse.parse_tool_calls(t.select("l_orderkey", F.concat(F.lit("```json\n["), "body", F.lit("]\n```")).alias("text")))
    return calls.select("l_orderkey", F.get_json_object("args_json", "$.part").alias("part"), F.get_json_object("args_json", "$.quantity").alias("quantity"))


@query("select l_orderkey, count(*) calls, sum(l_partkey)::bigint parts from lineitem group by 1")
def openai_tool_calls_array(spark, d):
    one = F.format_string('{"id": "c", "type": "function", "function": {"name": "pick", "arguments": "{\\"part\\": %d}"}}', "l_partkey")
    t = _lines(spark, d).groupBy("l_orderkey").agg(F.array_join(F.collect_list(one), ",").alias("body"))
    calls = parse.parse_tool_calls(t.select("l_orderkey", F.concat(F.lit('{"tool_calls": ['), "body", F.lit("]}")).alias("text")))
    return calls.groupBy("l_orderkey").agg(F.count("*").alias("calls"), F.sum(F.get_json_object("args_json", "$.part").cast("long")).alias("parts"))


@query(f"select event_id, {_NAME} as name from events where event_type in ('view', 'error', 'click')")
def allowed_tools_semi(spark, d):
    allowed = spark.createDataFrame([("read_file",), ("error",), ("click",)], "name string")
    return parse.permitted_calls(_mixed(spark, d), allowed).select("event_id", "name")


@query(f"select event_id, {_NAME} as name from events where event_type not in ('view', 'error', 'click')")
def rejected_tools_anti(spark, d):
    allowed = spark.createDataFrame([("read_file",), ("error",), ("click",)], "name string")
    return parse.rejected_calls(_mixed(spark, d), allowed).select("event_id", "name")


_RAW_NAMES = ["Grep", " view ", "EDIT", "sh", "custom_tool", "run_bash", "ls"]
_PICK = "case event_id % 7 when 0 then 'Grep' when 1 then ' view ' when 2 then 'EDIT' when 3 then 'sh' when 4 then 'custom_tool' when 5 then 'run_bash' else 'ls' end"


def _picked(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).withColumn("raw", F.element_at(F.array(*map(F.lit, _RAW_NAMES)), (F.col("event_id") % 7 + 1).cast("int")))


@query(f"""select event_id, case {_PICK} when 'Grep' then 'search' when ' view ' then 'read_file' when 'EDIT' then 'str_replace' when 'sh' then 'bash' else {_PICK} end parser_name,
       case {_PICK} when 'Grep' then 'grep' when ' view ' then 'read' when 'EDIT' then 'edit' when 'run_bash' then 'bash' when 'ls' then 'list_dir' else {_PICK} end canonical_name from events""")
def normalize_names(spark, d):
    return _picked(spark, d).select("event_id", semantics.parser_name(F.col("raw")).alias("parser_name"), semantics.canonical_name(F.col("raw")).alias("canonical_name"))


@query("select event_id, cast(user_id as varchar) path, event_type old_str, cast(event_id as varchar) other from events")
def normalize_args(spark, d):
    m = F.create_map(F.lit("file"), F.lit("first"), F.lit("file_path"), F.col("user_id").cast("string"), F.lit("old_text"), F.col("event_type"), F.lit("other"), F.col("event_id").cast("string"))
    out = _events(spark, d).select("event_id", semantics.canonical_args(m).alias("m"))
    return out.select("event_id", *[F.element_at("m", k).alias(k) for k in ("path", "old_str", "other")])


@query("select event_id, user_id::bigint as n, true as left_alone from events")
def int_coercion(spark, d):
    m = F.create_map(F.lit("limit"), F.concat(F.lit(" "), F.col("user_id").cast("string")), F.lit("offset"), F.concat(F.lit("x"), F.col("event_type")))
    out = _events(spark, d).select("event_id", semantics.int_args(m).alias("m"))
    return out.select("event_id", F.element_at("m", "limit").alias("n"), F.element_at("m", "offset").isNull().alias("left_alone"))


_CMD = "case event_id % 4 when 0 then 'PyTest -q ' || event_type when 1 then 'echo x > ' || event_type when 2 then 'ls ' || event_type else 'cargo test > log' end"


@query(f"""with c as (select event_id, lower({_CMD}) c from events) select event_id, case when c like '%pytest%' or c like '%cargo test%' then 'test' when c like '%>%' then 'edit' else 'exec' end category,
       c like '%>%' and c not like '%cargo test%' is_mutation, true is_execution, c like '%pytest%' or c like '%cargo test%' is_verification, false is_read, false is_search, false is_submit from c""")
def categorize_commands(spark, d):
    n, e = F.col("event_id") % 4, F.col("event_type")
    cmd = F.when(n == 0, F.concat(F.lit("PyTest -q "), e)).when(n == 1, F.concat(F.lit("echo x > "), e)).when(n == 2, F.concat(F.lit("ls "), e)).otherwise("cargo test > log")
    c = _events(spark, d).select("event_id", cmd.alias("cmd"))
    return c.select("event_id", semantics.category(F.lit("bash"), F.col("cmd")).alias("category"), *[p.alias(k) for k, p in semantics.predicates(F.lit("bash"), F.col("cmd")).items()])


@query("""select event_id, '{"a":' || user_id || ',"b":{"x":"' || event_type || '","y":[2,1]}}' canonical from events""")
def canonical_json(spark, d):
    raw = F.concat(F.lit(' { "b" : {"y": [2, 1], "x": "'), "event_type", F.lit('"}, "a": '), F.col("user_id").cast("string"), F.lit("} "))
    return _events(spark, d).select("event_id", canonical.canonical_json(raw).alias("canonical"))


@query("select o_orderkey, string_agg(cast(l_partkey as varchar), ',' order by 'part' || (l_partkey % 3), cast(l_partkey as varchar)) parts from (select distinct l_orderkey o_orderkey, l_partkey from lineitem) group by 1")
def canonicalize_calls_sorted(spark, d):
    c = F.struct(F.col("l_partkey").cast("string").alias("id"), F.concat(F.lit("part"), F.col("l_partkey") % 3).alias("name"), F.lit("{}").alias("arguments"))
    t = _lines(spark, d).select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey").distinct().groupBy("o_orderkey").agg(F.collect_list(c).alias("calls"))
    return t.select("o_orderkey", F.array_join(F.transform(canonical.sorted_calls(F.col("calls")), lambda x: x["id"]), ",").alias("parts"))


def _negative(name: str, key: str, text: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        t = table(spark, d, name).select(F.size(parse.calls(F.col(text))).alias("c"))
        return t.agg(F.count("*").alias("n"), F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("calls"))

    query(f"select count(*) n, 0::bigint calls from {name}", f"negative_{name}")(run)


_negative("conversations", "conv_id", "text")
_negative("documents", "doc_id", "text")
_negative("pages", "page_id", "html")

_RUNS = "with m as (select conv_id, turn, case when turn % 3 = 0 then 'user' else role end as role, text from conversations)"


def _conversation(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").withColumn("role", F.when(F.col("turn") % 3 == 0, "user").otherwise(F.col("role")))


@query(f"""{_RUNS}, f as (select *, case when lag(role) over (partition by conv_id order by turn) is not distinct from role then 0 else 1 end new from m),
       g as (select *, sum(new) over (partition by conv_id order by turn) island from f) select conv_id, island::bigint as turn, role, string_agg(text, chr(10) order by turn) as text, count(*) messages from g group by 1, 2, 3""")
def merge_turns(spark, d):
    return relational.merged_turns(_conversation(spark, d), "conv_id", "turn")


@query("select conv_id, string_agg(text, chr(10) || chr(10) order by turn) system from conversations where role = 'system' group by 1")
def system_concat(spark, d):
    return relational.system_text(table(spark, d, "conversations"), "conv_id", "turn")


_PAIRS = "with c as (select distinct l_orderkey, l_partkey from lineitem), r as (select l_orderkey, 'c' || l_partkey call_id, case when l_partkey % 2 = 0 then 'pick' || l_partkey end called from c)"


@query(f"{_PAIRS} select l_orderkey, call_id, coalesce(called, call_id) tool_name from r")
def result_name_resolution(spark, d):
    base = _lines(spark, d).select("l_orderkey", "l_partkey").distinct().withColumn("call_id", F.concat(F.lit("c"), F.col("l_partkey")))
    made = base.where("l_partkey % 2 = 0").withColumns({"name": F.concat(F.lit("pick"), F.col("l_partkey")), "call_index": F.lit(0)})
    return relational.named_results(base, made, "l_orderkey").select("l_orderkey", "call_id", "tool_name")


@query(f"{_PAIRS} select l_orderkey, call_id from r where called is null")
def calls_without_result(spark, d):
    base = _lines(spark, d).select("l_orderkey", "l_partkey").distinct().withColumn("call_id", F.concat(F.lit("c"), F.col("l_partkey")))
    return relational.unanswered_calls(base, base.where("l_partkey % 2 = 0"), "l_orderkey").select("l_orderkey", "call_id")


@query("select l_orderkey, string_agg(l_returnflag, '' order by l_partkey, l_suppkey, l_linenumber, l_returnflag) content, bool_or(l_returnflag = 'R') is_error from lineitem group by 1")
def mcp_results_collapse(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_partkey", "l_suppkey", "l_linenumber", "l_returnflag").alias("o"), "l_returnflag", (F.col("l_returnflag") == "R").alias("is_error"))
    out = relational.mcp_results(t, "l_orderkey", "o", "l_returnflag")
    return out.select("l_orderkey", F.array_join("content", "").alias("content"), "is_error")


@query("""with f as (select user_id, event_type, min(event_id) s from events group by 1, 2), g as (select user_id, event_type, dense_rank() over (partition by user_id order by s, event_type) - 1 tool_index from f)
       select e.event_id, g.tool_index::bigint tool_index from events e join g using (user_id, event_type)""")
def tool_index_in_stream(spark, d):
    return relational.first_seen_index(_events(spark, d), "user_id", "event_id", "event_type").select("event_id", F.col("tool_index").cast("long").alias("tool_index"))


def _convert_query(target: str, name_path: str, args_path: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        t = _mixed(spark, d).select("event_id", F.explode(payloads.text_calls(F.col("text"), target)).alias("c"))
        args = F.get_json_object("c", args_path)
        return t.select("event_id", F.get_json_object("c", name_path).alias("name"), F.get_json_object(args, "$.user").alias("user_text"))

    query(f"select event_id, {_NAME} as name, cast(user_id as varchar) user_text from events", f"convert_calls_{target}")(run)


_convert_query("openai", "$.function.name", "$.function.arguments")
_convert_query("anthropic", "$.name", "$.input")
_convert_query("gemini", "$.functionCall.name", "$.functionCall.args")
_convert_query("mcp", "$.params.name", "$.params.arguments")


@query("""select event_id, '{"jsonrpc":"2.0","method":"tools/call","params":{"arguments":{"user":' || user_id || '},"name":"' || event_type || '"}}' canonical from events""")
def mcp_call_columns(spark, d):
    args = F.concat(F.lit('{"user":'), F.col("user_id").cast("string"), F.lit("}"))
    return _events(spark, d).select("event_id", canonical.canonical_json(canonical.mcp_call(F.col("event_type"), args)).alias("canonical"))


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    body = F.to_json(F.named_struct(F.lit("model"), F.lit("m"), F.lit("messages"), F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))))
    return m.groupBy("conv_id").agg(body.alias("payload"))


def _round_trip(target: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        there = _payloads(spark, d).select("conv_id", payloads.translated_request(F.col("payload"), "openai", target)["payload"].alias("p"))
        back = there.select("conv_id", payloads.translated_request(F.col("p"), target, "openai")["payload"].alias("p"))
        m = back.select("conv_id", F.explode(F.from_json(F.get_json_object("p", "$.messages"), "array<struct<role:string,content:string>>")).alias("m"))
        return m.groupBy("conv_id").agg(F.count("*").alias("messages"), F.sum(F.length("m.content")).cast("long").alias("chars"), F.count_if(F.col("m.role") == "user").alias("users"))

    query("""with s as (select conv_id, string_agg(text, chr(10) || chr(10) order by turn) t, 1 users from conversations where role = 'system' group by 1),
          x as (select conv_id, role, text from conversations where role <> 'system' union all select conv_id, 'system', t from s)
          select conv_id, count(*) messages, sum(length(text))::bigint chars, count(*) filter (where role = 'user') users from x group by 1""", f"translate_roundtrip_{target}")(run)


_round_trip("anthropic")
_round_trip("gemini")


@query("select conv_id, count(*) filter (where role = 'assistant') calls, bool_and(true) as ok from conversations group by 1")
def translate_responses(spark, d):
    m = table(spark, d, "conversations")
    r = F.to_json(F.named_struct(F.lit("model"), F.lit("m"), F.lit("choices"), F.array(F.named_struct(F.lit("message"), F.named_struct(F.lit("content"), F.col("text")), F.lit("finish_reason"), F.lit("stop")))))
    t = m.select("conv_id", "role", "text", payloads.translated_response(r, "openai", "claude")["payload"].alias("p"))
    same = (F.coalesce(F.get_json_object("p", "$.content[0].text"), F.lit("")) == F.col("text")) & (F.get_json_object("p", "$.stop_reason") == "end_turn")
    return t.groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("calls"), F.bool_and(same).alias("ok"))


def _schemas(spark: SparkSession, d: str) -> DataFrame:
    s = F.concat(F.lit('{"$schema": "x", "title": "'), "p_brand", F.lit('", "properties": {"size": {"anyOf": [{"type": "null"}, {"type": "integer"}], "default": '), F.col("p_size").cast("string"), F.lit('}, "kind": {"$ref": "#/$defs/K"}}, "$defs": {"K": {"type": ["null", "string"], "description": "'), "p_type", F.lit('"}}}'))
    return table(spark, d, "part").select("p_partkey", s.alias("schema"))


@query("""select p_partkey, 'object' as type, 'integer' size_type, 'string' kind_type, p_type description, false has_title, false has_default from part""")
def schema_sanitize_gemini(spark, d):
    t = _schemas(spark, d).select("p_partkey", payloads.gemini_schema(F.col("schema"))["payload"].alias("s"))
    g = lambda p: F.get_json_object("s", p)
    return t.select("p_partkey", g("$.type").alias("type"), g("$.properties.size.type").alias("size_type"), g("$.properties.kind.type").alias("kind_type"), g("$.properties.kind.description").alias("description"), g("$.title").isNotNull().alias("has_title"), g("$.properties.size.default").isNotNull().alias("has_default"))


@query("""select p_partkey, 'false' closed, '["size","kind"]' required, false has_schema from part""")
def schema_sanitize_openai(spark, d):
    t = _schemas(spark, d).select("p_partkey", payloads.openai_schema(F.col("schema"), True)["payload"].alias("s"))
    return t.select("p_partkey", F.get_json_object("s", "$.additionalProperties").alias("closed"), F.get_json_object("s", "$.required").alias("required"), F.contains("s", F.lit("$schema")).alias("has_schema"))


@query("""select p_partkey, p_brand as name, cast(p_size as varchar) size from part""")
def convert_definitions(spark, d):
    tool = F.concat(F.lit('[{"name": "'), "p_brand", F.lit('", "input_schema": {"type": "object", "size": '), F.col("p_size").cast("string"), F.lit("}}]"))
    t = table(spark, d, "part").select("p_partkey", payloads.converted_definitions(tool, "auto", "mcp")["payload"].alias("c"))
    return t.select("p_partkey", F.get_json_object("c", "$[0].name").alias("name"), F.get_json_object("c", "$[0].inputSchema.size").alias("size"))


@query("""select o_orderkey, o_orderpriority as text, o_orderstatus = 'F' is_error from orders""")
def convert_results(spark, d):
    r = F.to_json(F.named_struct(F.lit("type"), F.lit("tool_result"), F.lit("tool_use_id"), F.lit("t"), F.lit("content"), F.col("o_orderpriority"), F.lit("is_error"), F.col("o_orderstatus") == "F"))
    t = table(spark, d, "orders").select("o_orderkey", payloads.converted_results(r, "auto", "mcp")["payload"].alias("c"))
    return t.select("o_orderkey", F.get_json_object("c", "$[0].content[0].text").alias("text"), (F.get_json_object("c", "$[0].isError") == "true").alias("is_error"))


@query("select c_custkey, c_name caller_agent, c_mktsegment category, null::varchar task_id, cast(c_nationkey as varchar) nation from customer")
def headers_roundtrip(spark, d):
    h = relational.to_headers({"caller_agent": F.col("c_name"), "category": F.col("c_mktsegment"), "task_id": F.lit(None)}, F.create_map(F.lit("Nation"), F.col("c_nationkey").cast("string")))
    t = table(spark, d, "customer").select("c_custkey", h.alias("h"))
    return t.select("c_custkey", *relational.from_headers(F.col("h"), ["caller_agent", "category", "task_id", "meta-nation"])).withColumnRenamed("meta-nation", "nation")


@query("select o_orderkey, 'bash' as name, '{\"command\":\"git show ' || o_custkey || '\"}' args_json, 'shell' dialect from orders")
def shell_fallback(spark, d):
    from toolspark.config import ParserConfig

    o = _orders(spark, d).select("o_orderkey", F.concat(F.lit("I would run\n$ git show "), F.col("o_custkey")).alias("text"))
    return parse.parse_tool_calls(o, cfg=ParserConfig(allow_shell_fallback=True)).select("o_orderkey", "name", "args_json", "dialect")


@query("select event_id, event_type as name, cast(user_id as varchar) user_text from events")
def raw_extraction(spark, d):
    e = _events(spark, d).select("event_id", render.rendered("qwen_xml", F.col("event_type"), F.col("user_id"), F.col("props")).alias("text"))
    return parse.raw_calls(e).select("event_id", "name", F.get_json_object("args_json", "$.user").alias("user_text"))


@query("""select event_id, '{"a":' || user_id || '}' as repaired from events""")
def repair_json(spark, d):
    bad = F.concat(F.lit("{'a': "), F.col("user_id").cast("string"), F.when(F.col("event_id") % 2 == 0, ",}").otherwise(""))
    return _events(spark, d).select("event_id", canonical.canonical_json(parse.repair_json(bad)).alias("repaired"))


@query(f"select {_NAME} as name, count(*) calls from events group by 1")
def sql_table_function(spark, d):
    sql.register(spark)
    _mixed(spark, d).createOrReplaceTempView("toolspark_texts")
    return spark.sql("select c.name, count(*) calls from toolspark_texts t, lateral parse_tool_calls(t.text) c group by c.name")


def _chunks(spark: SparkSession, d: str, size: int = 11) -> DataFrame:
    text = render.mixed(F.col("event_id"), F.col("event_type"), F.col("user_id"), F.col("props"), render.STREAMED)
    return _pieces(_events(spark, d).select("event_id", text.alias("text")), size)


def _pieces(t: DataFrame, size: int) -> DataFrame:
    n = F.ceil(F.length("text") / size).cast("int")
    c = t.select(F.col("event_id").cast("string").alias("stream_id"), "text", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    return c.select("stream_id", F.col("i").cast("long").alias("seq"), F.substr("text", F.col("i") * size + 1, F.lit(size)).alias("chunk"), (F.col("i") == F.col("n") - 1).alias("is_last"))


@query(f"select cast(event_id as varchar) stream_id, {_NAME} as name, cast(user_id as varchar) user_text from events")
def stream_events_batch(spark, d):
    e = streams.parsed_batch(_chunks(spark, d)).where("event_type = 'tool_call_completed'")
    return e.select("stream_id", "name", F.get_json_object("args_json", "$.user").alias("user_text"))


@query("select conv_id, count(*) chunks, sum(length(text))::bigint chars from conversations where role = 'assistant' group by 1")
def stream_translation_batch(spark, d):
    t = table(spark, d, "conversations").where("role = 'assistant'")
    c = F.concat(F.lit("data: "), F.to_json(F.named_struct(F.lit("choices"), F.array(F.named_struct(F.lit("delta"), F.named_struct(F.lit("content"), F.col("text")))))))
    w = Window.partitionBy("conv_id").orderBy("turn")
    lines = t.select(F.col("conv_id").cast("string").alias("stream_id"), (F.row_number().over(w) - 1).cast("long").alias("seq"), c.alias("chunk"))
    out = streams.translated_batch(lines, "openai", "gemini").select("stream_id", F.get_json_object(F.substr("line", F.lit(7), F.length("line")), "$.candidates[0].content.parts[0].text").alias("t"))
    return out.groupBy(F.col("stream_id").cast("long").alias("conv_id")).agg(F.count("*").alias("chunks"), F.sum(F.length("t")).cast("long").alias("chars"))


_PAIRS = f"select event_id, 0 call_index, {_NAME} as name, cast(user_id as varchar) user_text, json_extract_string(props, '$.k') k from events"


def _written_as(text: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        k = F.get_json_object("props", "$.k")
        e = _events(spark, d).select("event_id", text(F.col("event_type"), F.col("user_id").cast("string"), k).alias("text"))
        return parse.parse_tool_calls(e).select("event_id", "call_index", "name", F.get_json_object("args_json", "$.user").alias("user_text"), F.get_json_object("args_json", "$.k").alias("k"))

    return run


query(_PAIRS, "arguments_in_child_tags")(_written_as(lambda n, u, k: F.concat(F.lit("<tool_call><name>"), n, F.lit("</name><arguments><user>"), u, F.lit("</user><k>"), k, F.lit("</k></arguments></tool_call>"))))
query(_PAIRS, "parameters_without_a_call")(_written_as(lambda n, u, k: F.concat(*[F.concat(F.lit(f'<｜DSML｜parameter name="{key}">'), v, F.lit("</｜DSML｜parameter>")) for key, v in (("tool", n), ("user", u), ("k", k))], F.lit("</｜DSML｜function_calls>"))))


@query("""select cast(event_id as varchar) stream_id, '{"user": ' || user_id || ', "props": ' || props || '}' arguments from events""")
def stream_argument_deltas(spark, d):
    e = _events(spark, d)
    c = _pieces(e.select("event_id", render.rendered("deepseek", F.col("event_type"), F.col("user_id"), F.col("props")).alias("text")), 11)
    out = streams.parsed_batch(c).where("event_type = 'tool_call_argument_chunk'")
    parts = F.sort_array(F.collect_list(F.struct("event_index", "text")))
    return out.groupBy("stream_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("arguments"))


@query("select conv_id, count(*) chunks, sum(length(text))::bigint chars from conversations where role = 'assistant' group by 1")
def stream_from_anthropic_batch(spark, d):
    t = table(spark, d, "conversations").where("role = 'assistant'")
    delta = F.named_struct(F.lit("type"), F.lit("text_delta"), F.lit("text"), F.col("text"))
    c = F.concat(F.lit("data: "), F.to_json(F.named_struct(F.lit("type"), F.lit("content_block_delta"), F.lit("index"), F.lit(0), F.lit("delta"), delta)))
    w = Window.partitionBy("conv_id").orderBy("turn")
    lines = t.select(F.col("conv_id").cast("string").alias("stream_id"), (F.row_number().over(w) - 1).cast("long").alias("seq"), c.alias("chunk"))
    out = streams.translated_batch(lines, "anthropic", "openai").select("stream_id", F.get_json_object(F.substr("line", F.lit(7), F.length("line")), "$.choices[0].delta.content").alias("t"))
    return out.groupBy(F.col("stream_id").cast("long").alias("conv_id")).agg(F.count("*").alias("chunks"), F.sum(F.length("t")).cast("long").alias("chars"))


@query("select conv_id, turn, text, 'true' failed from conversations where role = 'user'")
def mcp_results_of_texts(spark, d):
    t = table(spark, d, "conversations").where("role = 'user'")
    made = payloads.mcp_results(F.to_json(F.array(F.struct(F.lit("text").alias("type"), "text"))), True)
    return t.select("conv_id", "turn", made.alias("m")).select("conv_id", "turn", F.get_json_object("m.payload", "$.content[0].text").alias("text"), F.get_json_object("m.payload", "$.isError").alias("failed"))


@query("select conv_id, turn, length(text) chars from conversations where role = 'user'")
def own_protocol(spark, d):
    """A protocol that only the driver knows: requests are written as the number of characters said."""
    base = protocols.registry.get("openai")
    own = dataclasses.replace(base, name="counting", write_request=lambda r: {"chars": sum(len(b["text"]) for t in r["turns"] for b in t["blocks"])})
    t = table(spark, d, "conversations").where("role = 'user'")
    payload = F.to_json(F.struct(F.lit("m").alias("model"), F.array(F.struct("role", F.col("text").alias("content"))).alias("messages")))
    out = t.select("conv_id", "turn", payloads.translated_request(payload, "openai", own).alias("r"))
    return out.select("conv_id", "turn", F.get_json_object("r.payload", "$.chars").cast("long").alias("chars"))


@query("select '4.1.2' spark, true parses")
def engine_info(spark, d):
    return sql.engine_info(spark).select("spark", (F.size(parse.calls(F.lit('{"tool": "f"}'))) == 1).alias("parses"))
