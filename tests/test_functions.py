"""Row functions: facts about single texts and payloads."""

import json
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from toolspark.config import ParserConfig
from toolspark.functions import clean, convert, events, lenient, protocols, raw, schemas
from toolspark.functions.dialects import parse
from toolspark.plans.render import TEMPLATES


def calls(text, **cfg):
    return [(c.name, c.args) for c in parse(text, ParserConfig(**cfg))]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ('<｜DSML｜tool name=search>\n<｜DSML｜parameter name="query">foo</｜DSML｜parameter>\n<｜DSML｜parameter name="path">src/a', [("search", {"pattern": "foo", "path": "src/a"})]),
        ('<tool_name>search</tool_name><query>abc</query>', [("search", {"pattern": "abc"})]),
        ('<invoke name="write_file"><parameter name="content"><![CDATA[\n  x = 1\n]]></parameter><parameter name="path">a</parameter></invoke>', [("write_file", {"content": "  x = 1", "path": "a"})]),
        ('{"tool_calls":[{"type":"function","function":{"name":"bash","arguments":"{\\"command\\": \\"ls\\"}"}}]}', [("bash", {"command": "ls"})]),
        ('[{"name":"bash","cmd":"a"},{"name":"search","query":"b"}]', [("bash", {"command": "a"}), ("search", {"pattern": "b"})]),
        ('bash("git diff")', [("bash", {"command": "git diff"})]),
        ("Action: bash\nAction Input: pytest -v", [("bash", {"command": "pytest -v"})]),
        ("Action: lookup\nAction Input: plain words", [("lookup", {})]),
        ('{"name": "str_replace", "arguments": {"new_str": "print("Hello")", "path": "a"}}', [("str_replace", {"new_str": 'print("Hello")', "path": "a"})]),
        ('{"name":"bash","arguments":{"command":"ls -', [("bash", {"command": "ls -"})]),
        ('tool": "bash", "command": "ls"}', [("bash", {"command": "ls"})]),
        ("I'll run {\"tool\": \"bash\", \"command\": \"ls\"}", [("bash", {"command": "ls"})]),
        ('<think>{"name":"bash"}</think>{"name":"search","pattern":"q"}', [("search", {"pattern": "q"})]),
        ('<tool name="bash"><command>ls &amp; pwd</command></tool>', [("bash", {"command": "ls & pwd"})]),
        ('{"name":"read_file","path":"a","limit":"10","offset":"x"}', [("read_file", {"path": "a", "limit": 10, "offset": "x"})]),
        ('{"name":"f","a":1,"a":2}', [("f", {"a": 2})]),
    ],
)
def test_calls(text, expected):
    assert calls(text) == expected


@pytest.mark.parametrize("text", ["", "  ", "x < 3 and y > 2", "std::vector<int> v;", "Action:", "{}", "[]", "<tool_call>", '{"name": 5}', '{"name": " "}', '{"name": null}', "x = f(1)", "print(1)", '<think>{"name":"bash"}</think>hello', "p{margin:0}", None])
def test_no_calls(text):
    assert calls(text) == []


def test_config():
    assert calls('{"name":"bash","x":1}', allowed_tools=("search",)) == []
    assert calls('{"name":"Foo","k":1}', tool_aliases={"foo": "bar"}, param_aliases={"K": "key"}) == [("bar", {"key": 1})]
    assert calls("$ ls -l\nsubmit", allow_shell_fallback=True) == [("bash", {"command": "ls -l"}), ("submit", {})]
    assert calls("Action: lookup\nAction Input: plain words", keep_input=True) == [("lookup", {"input": "plain words"})]


def test_long_texts_take_bounded_time():
    began = time.time()
    assert calls('<invoke name="w"><parameter name="content">' + "a<" * 25_000 + "</parameter></invoke>")[0][0] == "w"
    calls("<tool_call>" + "<a>" * 20_000)
    calls('{"name":"bash","command":"' + "a" * 50_000)
    calls("<tool " * 20_000), calls("<invoke name=x>" * 3_000), calls("```json\n" * 5_000), calls("Action: f\nAction Input: 1\n" * 3_000), calls("<｜tool sep｜>" * 5_000)
    lenient.loads('{"a": "' + 'x" ' * 100_000 + '"}')
    assert time.time() - began < 10


def test_thinking():
    assert clean.strip_thinking("a <think>x</think> b <reasoning>y</think> c") == "a  b  c"
    assert clean.strip_thinking("<think>plan <tool_call>x") == "<tool_call>x"
    assert clean.strip_thinking("kept <think>open") == "kept"
    assert clean.strip_thinking("<think>only") == "<think>only"


json_values = st.recursive(st.none() | st.booleans() | st.integers(-(10**9), 10**9) | st.text(st.characters(exclude_categories=["Cs"]), max_size=8), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("abcd", min_size=1, max_size=3), x, max_size=3), max_leaves=8)


@given(json_values)
@settings(max_examples=60, deadline=None)
def test_json_reads_back(value):
    text = json.dumps(value, ensure_ascii=False)
    assert lenient.loads(text, "none") == value
    assert lenient.repaired(text) == text
    assert json.loads(lenient.canonical(value)) == value


def test_repairs():
    assert lenient.loads("{'a': True, 'b': None,}") == {"a": True, "b": None}
    assert lenient.objects('x {"a": {"b": 1}} y {"c": [1, 2') == ['{"a": {"b": 1}}', '{"c": [1, 2]}']
    assert lenient.canonical_text(' {"b":1,"a":[2]} ') == '{"a":[2],"b":1}'
    assert lenient.canonical_text(" {x ") == "{x"


PAYLOAD = {"model": "m", "temperature": 0.5, "messages": [{"role": "system", "content": "S"}, {"role": "user", "content": [{"type": "text", "text": "t"}, {"type": "image_url", "image_url": {"url": "data:image/png;base64,QQ=="}}]}, {"role": "assistant", "content": None, "tool_calls": [{"id": "c1", "type": "function", "function": {"name": "bash", "arguments": '{"command": "ls"}'}}]}, {"role": "tool", "tool_call_id": "c1", "content": "ok"}], "tools": [{"type": "function", "function": {"name": "bash", "description": "d", "parameters": {"type": "object"}}}]}


def test_requests():
    a = protocols.translate_request(PAYLOAD, "openai", "claude")
    assert [m["role"] for m in a["messages"]] == ["user", "assistant", "user"] and a["max_tokens"] == 4096 and a["system"] == "S"
    assert a["messages"][0]["content"][1]["source"] == {"type": "base64", "media_type": "image/png", "data": "QQ=="}
    g = protocols.translate_request(a, "anthropic", "vertex")
    assert g["contents"][2]["parts"][0]["functionResponse"]["name"] == "bash" and g["tools"][0]["function_declarations"][0]["name"] == "bash"
    back = protocols.translate_request(a, "anthropic", "openai", model="other")
    assert back["model"] == "other" and back["messages"][2]["tool_calls"][0]["function"]["name"] == "bash"
    assert protocols.translate_request(PAYLOAD, "openai", "azure") is PAYLOAD
    with pytest.raises(ValueError, match="unknown protocol"):
        protocols.registry.get("nobody")


def test_responses():
    r = {"model": "m", "choices": [{"message": {"content": "hi", "tool_calls": [{"id": "x", "function": {"name": "f", "arguments": "{}"}}]}, "finish_reason": "stop"}], "usage": None}
    a = protocols.translate_response(r, "openai", "anthropic")
    assert a["stop_reason"] == "tool_use" and [b["type"] for b in a["content"]] == ["text", "tool_use"]
    assert protocols.translate_response(a, "anthropic", "gemini")["candidates"][0]["finishReason"] == "STOP"
    assert protocols.translate_response({"error": {"message": "no", "type": "t"}}, "openai", "anthropic") == {"type": "error", "error": {"message": "no", "type": "t"}}


def test_stream_translation():
    t = protocols.StreamTranslator("gemini", "anthropic")
    lines = t.line('data: {"candidates":[{"content":{"parts":[{"text":"hi"}]}}]}') + t.line('data: {"candidates":[{"content":{"parts":[{"functionCall":{"name":"f","args":{"a":1}}}]},"finishReason":"STOP"}]}')
    kinds = [json.loads(x.split("data: ")[1])["type"] for x in lines]
    assert kinds == ["message_start", "content_block_start", "content_block_delta", "content_block_stop", "content_block_start", "content_block_delta", "content_block_stop", "message_delta", "message_stop"]
    assert t.line(": comment") == [": comment"] and t.line("data: {bad") == ["data: {bad"] and t.line("data: [DONE]") == []


def test_conversion():
    assert convert.calls('bash("ls")', "raw", "mcp") == [{"jsonrpc": "2.0", "method": "tools/call", "params": {"name": "bash", "arguments": {"command": "ls"}}}]
    assert convert.results([{"content": [{"type": "text", "text": "a"}], "isError": True}, {"tool_call_id": "x", "content": "b"}], target="mcp") == [{"content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}], "isError": True}]
    assert convert.results({"type": "tool_result", "tool_use_id": "c1", "content": "x"}, target="gemini", names={"c1": "bash"})[0]["functionResponse"]["name"] == "bash"
    assert convert.definitions([{"name": "a", "inputSchema": {"x": 1}}], target="openai")[0]["function"]["parameters"] == {"x": 1}
    assert convert.mcp_call("nothing")["params"]["name"] == "" and convert.mcp_call({"name": "f", "arguments": {}})["params"]["name"] == "f"
    m = convert.Metadata(owner_agent="o", is_mutation=True, artifact_ids=["a", "b"], custom_annotations={"k": "v"})
    h = m.to_headers()
    assert h["x-a2a-caller-agent"] == "o" and convert.Metadata.from_headers({k.upper(): v for k, v in h.items()}) == m


def test_schemas():
    s = {"$defs": {"N": {"type": "object", "properties": {"next": {"$ref": "#/$defs/N"}}}}, "properties": {"a": {"anyOf": [{"type": "null"}, {"type": "integer"}], "default": 1}, "title": {"type": ["null", "string"]}, "n": {"$ref": "#/$defs/N"}}}
    g = schemas.for_gemini(s)
    assert g["type"] == "object" and g["properties"]["a"] == {"type": "integer"} and g["properties"]["title"] == {"type": "string"}
    assert schemas.for_openai({"$id": "x", "type": "object", "properties": {"a": {}}}, True) == {"type": "object", "properties": {"a": {}}, "additionalProperties": False, "required": ["a"]}


def test_raw():
    (c,) = raw.extract("<function=bash><parameter=n>100</parameter></function>")
    assert raw.parse_args(c) == {"n": 100}
    (c,) = raw.extract('{"name":"Grep","arguments":{"x":1}}')
    assert c.name == "Grep" and raw.parse_args(c) == {"x": 1}
    with pytest.raises(ValueError, match="not JSON"):
        raw.parse_args(raw.RawCall("a", "{]", ""))
    (c,) = raw.extract("<tool_call><function=f>{}</function></tool_call>")
    assert c.name == "f"
    body = '<name>go</name><arguments>{"x": 1}</arguments>'
    (c,) = raw.extract(f"<tool_use>{body}</tool_use>")
    assert (c.name, c.raw_args) == ("go", body)
    assert raw.to_call(raw.RawCall("f", "[1, 2]", "")).args == {"input": [1, 2]}
    assert raw.first("nothing") is None and raw.first('{"name": "f", "x": 2}').raw_args == '{"name": "f", "x": 2}'


def test_event_names():
    p = events.StreamParser()
    out = p.feed('a<tool_call>{"name": "f", "arguments": {"x": 1}}</tool_call> b <tool_call>{"name": "g"}</tool_call>') + p.finish()
    assert [(e.call_id, e.tool_name) for e in out if e.is_tool_call and e.kind != "tool_call_argument_chunk"] == [("call_1", "f"), ("call_1", "f"), ("call_2", "g"), ("call_2", "g")]
    assert "".join(e.delta for e in out if e.delta and e.call_id == "call_1") == '{"name": "f", "arguments": {"x": 1}}'
    assert [e.content for e in out if e.kind == "text"] == ["a", " b "] and all(e.thinking is None for e in out)


def test_streams_agree_with_texts_however_cut():
    rng = random.Random(1)
    for d in ("fenced_json", "hermes", "dsml", "qwen_agent", "deepseek", "qwen_xml", "anthropic"):
        body = TEMPLATES[d].replace("NAME", "lookup").replace("USER", "7").replace("PROPS", '{"k": 3}')
        text = "before <think>plan</think>" + body
        for _ in range(6):
            p, out, at = events.StreamParser(), [], 0
            while at < len(text):
                n = rng.randint(1, 12)
                out += p.feed(text[at : at + n])
                at += n
            out += p.finish()
            assert [(e.call.name, e.call.args) for e in out if e.call] == calls(body), d
            assert "".join(e.text for e in out if e.kind == "thinking") == "plan"
            assert "".join(e.text for e in out if e.kind == "text").startswith("before ")
