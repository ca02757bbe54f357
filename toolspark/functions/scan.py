"""Finding marks in model texts by position, and reading the fields next to them.

Four kinds of marks are read in one way wherever they are used: tags of calls and parameters, tokens between bars, code fences and labelled lines.
All readers are linear in the text. Names of tags and tokens are fixed values.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

from toolspark.config import CALL_TAGS, GROUP_TAGS, PARAM_TAGS

BARS = "｜|"
CALLS, PARAMS, GROUPS = frozenset(CALL_TAGS), frozenset(PARAM_TAGS), frozenset(GROUP_TAGS)
#: fixed values: children of a call that name it, and that hold its arguments
NAMES, ARGUMENTS = frozenset(["name", "tool_name", "function_name", "tool", "function"]), frozenset(["arguments", "parameters"])
_KNOWN = CALLS | PARAMS | GROUPS | NAMES | ARGUMENTS | {"dsml"}
#: fixed values: tokens between bars, without their white space
TOKENS = {"toolcallbegin": "begin", "toolcallend": "end", "toolcallsend": "end", "toolsep": "sep", "action_start": "start", "action_name": "name", "action_args": "args", "action_end": "stop", "python_tag": "python", "eom_id": "over", "eot_id": "over"}
#: fixed values: words that white space in a token may part
_PARTS = frozenset(["tool", "call", "calls", "toolcall", "toolcalls", "callbegin", "callend", "callsend", "begin", "end", "sep"])
_TOKEN_SIZE = 48
_head = re.compile(rf"<(/?)([{BARS}]*)(dsml[{BARS}]*)?(\w[\w-]*)?", re.I)
_value = re.compile(r"[^<>\s'\"]+")
_word = re.compile(r"[\w-]+")
_space = re.compile(r"\s*")
_eq = re.compile(r"\s*([:=])\s*['\"]?([^<>\s'\"]+)['\"]?")
_plain = re.compile(r"[^<>\s]+")
_action = re.compile("action:", re.I)
_language = re.compile(r"[\w-]*")


def spaces(text: str, at: int) -> int:
    """The index behind the white space at ``at``."""
    return _space.match(text, at).end()


def word(text: str, at: int) -> str:
    m = _word.match(text, at)
    return m[0] if m else ""


def bare(text: str, at: int) -> tuple[str, int]:
    """A value that may stand behind white space and a quote, and the index behind it and its quote; none: empty."""
    at = spaces(text, at)
    at += text[at : at + 1] in ("'", '"')
    m = _value.match(text, at)
    return (m[0], m.end() + (text[m.end() : m.end() + 1] in ("'", '"'))) if m else ("", at)


class Tag(NamedTuple):
    """A tag as it stands; stop is -1 if it has no >. eq: the value that follows the name after : or = (after = alone for parameters)."""

    start: int
    stop: int
    closing: bool
    marked: bool  # with bars or the dsml prefix
    name: str
    eq: str | None
    attrs: str

    @property
    def plain(self) -> bool:
        """<name>, and nothing else in it."""
        return not self.closing and not self.marked and self.stop - self.start == len(self.name) + 2

    @property
    def ends(self) -> bool:
        """A closing tag with its >, and no attributes."""
        return self.closing and self.stop >= 0 and (not self.attrs or self.attrs.isspace())


def tags(text: str, at: int = 0) -> Iterator[Tag]:
    """All tags of calls, parameters and their parts, and all between bars."""
    last = text.rfind(">")
    for m in _head.finditer(text, at):
        slash, bars, prefix, name = m.groups()
        if name is None or ((name := name.lower()) not in _KNOWN and not bars and not prefix):
            continue
        end, eq = m.end(), None
        if (sign := _eq.match(text, end)) and (name not in PARAMS or (sign[1] == "=" and sign.start(1) == end)):
            eq, end = sign[2], sign.end()
        stop = text.find(">", end) if end <= last else -1
        yield Tag(m.start(), stop + 1, bool(slash), bool(bars or prefix), name, eq, text[end:stop]) if stop >= 0 else Tag(m.start(), -1, bool(slash), bool(bars or prefix), name, eq, "")


def between(marks: list[Tag], a: int, z: int) -> list[Tag]:
    """The tags that stand in text[a:z]; those that end behind z count as without an end."""
    i, j = bisect_left(marks, a, key=_begin), bisect_left(marks, z, key=_begin)
    part = marks[i:j]
    return part if not part or part[-1].stop <= z else [t if t.stop <= z else t._replace(stop=-1) for t in part]


def _begin(t: Tag) -> int:
    return t.start


class Token(NamedTuple):
    start: int
    stop: int
    kind: str


def tokens(text: str) -> list[Token]:
    """All tokens of `TOKENS`, with bars around them or without."""
    out, at = [], text.find("<")
    while at >= 0:
        stop = text.find(">", at + 1, at + _TOKEN_SIZE)
        if stop >= 0:
            inner = text[at + 1 : stop].strip(BARS)
            if inner and not inner[0].isspace() and not inner[-1].isspace():
                parts = inner.lower().split()
                kind = TOKENS.get("".join(parts))
                if kind and (len(parts) == 1 or _PARTS.issuperset(parts)):
                    out.append(Token(at, stop + 1, kind))
        at = text.find("<", at + 1)
    return out


_attribute = re.compile(r"(\w+)\s*=\s*['\"]?([^<>\s'\"]+)")


def attribute(text: str, labels: frozenset[str]) -> str | None:
    """Value of the first attribute with one of the names."""
    return next((m[2] for m in _attribute.finditer(text) if m[1].lower() in labels), None) if "=" in text else None


def labelled(text: str, labels: tuple[str, ...]) -> str | None:
    """The word that follows the first label and a colon or equals sign."""
    for m in re.finditer("[:=]", text):
        if text[: m.start()].rstrip().lower().endswith(labels):
            at = spaces(text, m.end())
            found = word(text, at + (text[at : at + 1] in ("'", '"')))
            if found:
                return found
    return None


def child_name(text: str, marks: list[Tag], z: int) -> str | None:
    """The word inside the first child element that names a call."""
    for t in marks:
        if t.plain and t.name in NAMES:
            at = spaces(text, t.stop)
            m = _plain.match(text, at, z)
            if m and (m.end() == z or text[m.end()].isspace() or text.startswith("</", m.end())):
                return m[0]
    return None


def closed_name(text: str, marks: list[Tag], names: frozenset[str]) -> tuple[int, str] | None:
    """Where the first element <name>word</name> begins, and its word."""
    for t, after in zip(marks, marks[1:], strict=False):
        if t.plain and t.name in names and after.closing and not after.marked and after.name in names and after.stop - after.start == len(after.name) + 3 and word(text, t.stop) == text[t.stop : after.start] != "":
            return t.start, text[t.stop : after.start]
    return None


def content(text: str, marks: list[Tag], z: int) -> str | None:
    """What stands in the first element of arguments, up to an end tag of such an element or z."""
    for i, t in enumerate(marks):
        if t.plain and t.name in ARGUMENTS:
            return text[t.stop : next((e.start for e in marks[i + 1 :] if e.ends and not e.marked and e.name in ARGUMENTS), z)]
    return None


def fences(text: str, opens: str = "", closes: str = "", json_only: bool = True) -> Iterator[tuple[int, str, int]]:
    """(index of the fence, its content, index behind it). With opens and closes only contents that begin and end so; other ends are passed over."""
    at = text.find("```")
    while at >= 0:
        begin = at + 3
        if json_only:
            begin += 4 * text.startswith("json", begin)
        else:
            begin = _language.match(text, begin).end()
        begin = spaces(text, begin)
        stop = text.find("```", begin) if text.startswith(opens, begin) else -1
        while stop >= 0:
            inner = text[begin:stop].rstrip()
            if not closes or (len(inner) >= 2 and inner.endswith(closes)):
                yield at, inner, stop + 3
                break
            stop = text.find("```", stop + 3)
        at = text.find("```", stop + 3 if stop >= 0 else at + 1)


def fenced_json(text: str, opens: str = "{", closes: str = "}") -> str | None:
    return next((inner for _, inner, _ in fences(text, opens, closes)), None) if "```" in text else None


def unfenced(text: str) -> str:
    """The content of the first fence, or the text."""
    return next((inner for _, inner, _ in fences(text, json_only=False)), text) if "```" in text else text


class Action(NamedTuple):
    """A step of the form Action: name / Action Input: value. The value ends before the next step."""

    start: int
    name: str
    inside: int
    stop: int


def _next_line(text: str, at: int, labels: tuple[str, ...]) -> int:
    """Index of the line break before the next line that begins with one of the labels and a colon; the text's length if there is none."""
    while (at := text.find("\n", at)) >= 0:
        begin = spaces(text, at)
        for label in labels:
            end = begin + len(label)
            if text[begin:end].lower() == label and text.startswith(":", spaces(text, end)):
                return at
        at += 1
    return len(text)


def actions(text: str) -> Iterator[Action]:
    at = 0
    while m := _action.search(text, at):
        at = m.end()
        begin = spaces(text, at)
        name = word(text, begin)
        after = begin + len(name)
        line = spaces(text, after)
        if not name or "\n" not in text[after:line] or text[line : line + 6].lower() != "action":
            continue
        label = spaces(text, line + 6)
        if label == line + 6 or text[label : label + 6].lower() != "input:":
            continue
        inside = spaces(text, label + 6)
        stop = _next_line(text, max(label + 5, inside - 1 if inside and text[inside - 1] == "\n" else inside), ("action", "thought"))
        yield Action(m.start(), name, inside, max(stop, inside))
        at = max(stop, inside)


def _whole(text: str, at: int, label: str) -> bool:
    """Whether the label stands at ``at`` as a word."""
    edge = lambda i: not (0 <= i < len(text)) or not (text[i].isalnum() or text[i] == "_")
    return text[at : at + len(label)].lower() == label and edge(at - 1) and edge(at + len(label))


def flowers(text: str) -> tuple[int, str, str] | None:
    """(start, name, arguments) of a call labelled FUNCTION and ARGS, each perhaps between flower signs; the arguments go to the text's end."""
    sign = "✿"
    for m in re.finditer("function", text, re.I):
        if not _whole(text, m.start(), "function"):
            continue

        def behind(at: int) -> int:
            at = spaces(text, at + text.startswith(sign, at))
            return spaces(text, at + text.startswith(":", at))

        at = behind(m.end())
        name = word(text, at)
        label = spaces(text, at + len(name))
        label += text.startswith(sign, label)
        if name and _whole(text, label, "args"):
            return m.start() - text.startswith(sign, m.start() - 1), name, text[behind(label + 4) :]
    return None


def bracketed(text: str) -> Iterator[tuple[int, str, int]]:
    """(start, value, stop) of what follows a [TOOL_CALLS] mark: from an opening bracket or brace to the first closing one of its kind."""
    for m in re.finditer(re.escape("[tool_call"), text, re.I):
        at = m.end() + (text[m.end() : m.end() + 1] in ("s", "S"))
        if not text.startswith("]", at):
            continue
        begin = spaces(text, at + 1)
        stop = text.find({"[": "]", "{": "}"}.get(text[begin : begin + 1], "\0"), begin)
        if stop >= 0:
            yield m.start(), text[begin : stop + 1], stop + 1
