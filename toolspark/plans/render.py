"""Table rows written as model texts in each dialect: inputs of queries, tests and the bench."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts by dialect; NAME, USER and PROPS (an object as JSON text) stand for a row's values.
TEMPLATES = {
    "fenced_json": 'Let me see.\n```json\n{"tool": "NAME", "user": USER, "props": PROPS}\n```',
    "hermes": '<tool_call>\n{"name": "NAME", "arguments": {"user": USER, "props": PROPS}}\n</tool_call>',
    "dsml": '<｜DSML｜invoke name="NAME">\n<｜DSML｜parameter name="user">USER</｜DSML｜parameter>\n<｜DSML｜parameter name="props">PROPS</｜DSML｜parameter>\n</｜DSML｜invoke>',
    "react": 'Thought: next\nAction: NAME\nAction Input: {"user": USER, "props": PROPS}',
    "qwen_agent": '<|action_start|><|action_name|>NAME<|action_args|>{"user": USER, "props": PROPS}<|action_end|>',
    "deepseek": "<｜tool calls begin｜><｜tool call begin｜>function=NAME<｜tool sep｜>{\"user\": USER, \"props\": PROPS}<｜tool call end｜><｜tool calls end｜>",
    "qwen_xml": "<tool_call>\n<function=NAME>\n<parameter=user>\nUSER\n</parameter>\n<parameter=props>\nPROPS\n</parameter>\n</function>\n</tool_call>",
    "anthropic": '<tool_use><name>NAME</name><arguments>{"user": USER, "props": PROPS}</arguments></tool_use>',
    "mistral": '[TOOL_CALLS] [{"name": "NAME", "arguments": {"user": USER, "props": PROPS}}]',
    "chatglm": '✿FUNCTION✿: NAME\n✿ARGS✿: {"user": USER, "props": PROPS}',
    "python_tag": '<|python_tag|>{"name": "NAME", "parameters": {"user": USER, "props": PROPS}}',
    "python_call": "NAME(user=USER, props=PROPS)",
}
DIALECTS = list(TEMPLATES)
#: Dialects that a stream shows while it runs; the others are found at its end.
STREAMED = ["fenced_json", "hermes", "dsml", "qwen_agent", "deepseek", "qwen_xml"]


def rendered(dialect: str, name: Column, user: Column, props: Column) -> Column:
    out = F.lit(TEMPLATES[dialect])
    for mark, value in (("NAME", name), ("USER", user.cast("string")), ("PROPS", props)):
        out = F.replace(out, F.lit(mark), value)
    return out


def mixed(number: Column, name: Column, user: Column, props: Column, dialects: list[str] = DIALECTS) -> Column:
    """The dialect of a row is its number modulo their count."""
    out = F
    for i, d in enumerate(dialects):
        out = out.when(number % len(dialects) == i, rendered(d, name, user, props))
    return out
