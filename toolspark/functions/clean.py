"""Cleaning model text: thoughts, and parameter values inside tags."""

from __future__ import annotations

import html
import re

from toolspark.config import TOOL_MARKS

_open = re.compile(r"<[｜|]?(?:think|thought|reasoning)[｜|]?>", re.I)
_close = re.compile(r"</[｜|]?(?:think|thought|reasoning)[｜|]?>", re.I)
_marks = re.compile("|".join(map(re.escape, sorted(TOOL_MARKS, key=len, reverse=True))))


def strip_thinking(text: str) -> str:
    """Text without its thoughts. An unfinished thought ends where a tool call may start; without one, what stands before it is kept, or all."""
    changed = False
    while "<" in text and (a := _open.search(text)):
        z = _close.search(text, a.end())
        if z is None:
            after = text[a.end() :]
            mark = _marks.search(after.lower())
            if mark:
                return (text[: a.start()] + after[mark.start() :]).strip()
            before = text[: a.start()].strip()
            return before or text
        text, changed = text[: a.start()] + text[z.end() :], True
    return text.strip() if changed else text


def param_value(value: str, code: bool = False) -> str:
    """A parameter's text: CDATA unwrapped, else character references decoded; code loses one bounding line break at each end, other text its outer white space."""
    head, mark, rest = value.partition("<![CDATA[")
    if mark:
        value = rest.partition("]]>")[0]
    elif "&" in value:
        value = html.unescape(value)
    return re.sub(r"\A(?:\r?\n)|(?:\r?\n)\Z", "", value) if code else value.strip()


#: fixed value: characters of a text that an error message shows
PREVIEW = 200


def preview(text: str, size: int = PREVIEW) -> str:
    return text[:size] + ("..." if len(text) > size else "")
