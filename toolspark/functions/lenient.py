"""Reading JSON as models write it: one recursive reader that mends as it goes, and a scan for objects in prose.

The reader accepts single quotes, trailing commas, Python literals, raw control characters, quotes left unescaped inside a string
(a quote closes only where what follows can follow a string) and texts that stop early, whose open parts it closes.
"""

from __future__ import annotations

import json
import re
from typing import Any

MISSING = object()
_number = re.compile(r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?")
_word = re.compile(r"[A-Za-z_]\w*")
_literals = {"true": True, "false": False, "null": None, "True": True, "False": False, "None": None, "NaN": float("nan"), "Infinity": float("inf")}
_escapes = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "/": "/", "\\": "\\", '"': '"', "'": "'"}
_next_key = re.compile(r"""\s*,\s*(?:\}|$|"(?:[^"\\]|\\.)*"\s*:|'(?:[^'\\]|\\.)*'\s*:)""", re.S)
_space = re.compile(r"\s*")
_hex = re.compile(r"[0-9a-fA-F]{4}")
#: What a string in either quotes cannot run over.
_stops = {"'": re.compile(r"[\\']"), '"': re.compile(r'[\\"]')}
_prefix_key = re.compile(r'\s*(?:(tool|name|action)":|"(?:tool|name|action)":)')
_prefix_colon = re.compile(r'\s*(?:\{\s*)?"\s*:\s*|\s*:\s*')


class _Broken(ValueError):
    pass


class _Reader:
    def __init__(self, text: str) -> None:
        self.s, self.i = text, 0

    def skip(self) -> str:
        self.i = _space.match(self.s, self.i).end()
        return self.s[self.i : self.i + 1]

    def value(self) -> Any:
        c = self.skip()
        if c == "{":
            return self.object()
        if c == "[":
            return self.array()
        if c in ("'", '"') and c:
            return self.string(c, "value")
        if m := _number.match(self.s, self.i):
            self.i = m.end()
            return float(m[0]) if any(x in m[0] for x in ".eE") else int(m[0])
        if (m := _word.match(self.s, self.i)) and m[0] in _literals:
            self.i = m.end()
            return _literals[m[0]]
        raise _Broken

    def object(self) -> dict[str, Any]:
        self.i += 1
        out: dict[str, Any] = {}
        while True:
            c = self.skip()
            if c == "":
                return out
            if c == "}":
                self.i += 1
                return out
            if c == ",":
                self.i += 1
                continue
            if c not in "'\"":
                raise _Broken
            key = self.string(c, "key")
            c = self.skip()
            if c == "":
                return out
            if c != ":":
                raise _Broken
            self.i += 1
            out[key] = "" if self.skip() == "" else self.value_in("object")
            if self.skip() not in (",", "}", ""):
                raise _Broken

    def value_in(self, inside: str) -> Any:
        self.inside = inside
        return self.value()

    def array(self) -> list[Any]:
        self.i += 1
        out: list[Any] = []
        while True:
            c = self.skip()
            if c == "":
                return out
            if c == "]":
                self.i += 1
                return out
            if c == ",":
                self.i += 1
                continue
            out.append(self.value_in("array"))
            if self.skip() not in (",", "]", ""):
                raise _Broken

    inside = "object"

    def closes(self, at: int, role: str) -> bool:
        after = _space.match(self.s, at + 1).end()
        c = self.s[after : after + 1]
        if not c:
            return True
        if role == "key":
            return c == ":"
        return c in "}]" or (c == "," and (self.inside == "array" or bool(_next_key.match(self.s, after))))

    def string(self, quote: str, role: str) -> str:
        out, i, s, stop = [], self.i + 1, self.s, _stops[quote]
        while m := stop.search(s, i):
            at = m.start()
            out.append(s[i:at])
            if s[at] != quote:
                n = s[at + 1 : at + 2]
                if n == "u" and _hex.fullmatch(s, at + 2, at + 6):
                    out.append(chr(int(s[at + 2 : at + 6], 16)))
                    i = at + 6
                else:
                    out.append(_escapes.get(n, n and "\\" + n))
                    i = at + 2
            elif self.closes(at, role):
                i = at
                break
            else:
                out.append(quote)
                i = at + 1
        else:
            out.append(s[i:])
            i = len(s)
        self.i = i + 1
        text = "".join(out)
        return text if text.isascii() or not any("\ud800" <= c <= "\udfff" for c in text) else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def mend_prefix(s: str) -> str:
    """A text that lost the start of its object gets one: tool": x, "tool": x, ": x and : x. White space before it stays."""
    body = s.lstrip()
    white = s[: len(s) - len(body)]
    if m := _prefix_key.match(body):
        return white + ('{"' if m[1] else "{") + body
    if (m := _prefix_colon.match(body)) and m.end():
        return white + '{"tool": ' + body[m.end() :]
    return s


def quick(s: str) -> Any:
    """The value of a text that is JSON, or would be if its single quotes were double ones and it has no others; else MISSING."""
    try:
        return json.loads(s, strict=False)
    except (ValueError, RecursionError):
        if "'" not in s or '"' in s or "\\" in s:
            return MISSING
    try:
        return json.loads(s.replace("'", '"'), strict=False)
    except (ValueError, RecursionError):
        return MISSING


def loads(s: Any, default: Any = None) -> Any:
    """The value a text stands for, mended where strict reading fails; default if it stands for none."""
    if not isinstance(s, str) or not s:
        return default
    if (out := quick(s)) is not MISSING:
        return out
    for text in dict.fromkeys((mend_prefix(s), s)):
        r = _Reader(text)
        try:
            out = r.value()
            if r.skip() == "":
                return out
        except (_Broken, RecursionError):
            continue
    return default


def repaired(s: str) -> str:
    """The text itself if it is JSON, else JSON for what it stands for, else the text."""
    try:
        json.loads(s)
        return s
    except (ValueError, RecursionError):
        out = loads(s, MISSING)
        return s if out is MISSING else json.dumps(out, ensure_ascii=False)


_scan = re.compile(r"""\\.|["'{}\[\]]""", re.S)


def objects(text: str) -> list[str]:
    """The outermost {...} of a text. Quotes of either kind count everywhere, so an apostrophe before an object can hide it; an object
    that the text leaves open is closed."""
    text = mend_prefix(text)
    if "{" not in text:
        return []
    whole = text.strip()
    if whole[0] == "{" and whole[-1] == "}" and quick(whole) is not MISSING:
        return [whole]
    found: list[str] = []
    open_: list[str] = []
    quote, start, at = "", -1, 0
    while m := _scan.search(text, at):
        c, at = m[0], m.end()
        if c[0] == "\\":
            if not quote:
                at = m.start() + 1  # outside strings a backslash is a character like any other
            continue
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "{":
            start = m.start() if not open_ else start
            open_.append(c)
        elif c == "[" and open_:
            open_.append(c)
        elif c == "]" and open_ and open_[-1] == "[":
            open_.pop()
        elif c == "}" and open_:
            while open_.pop() != "{":
                pass
            if not open_:
                found.append(text[start : m.end()])
    if open_:
        tail = text[start:]
        if quote:
            tail = tail.rstrip("\\") + quote
        cut = tail.rstrip()
        tail = cut + '""' if cut.endswith(":") else cut[:-1] if cut.endswith(",") else tail
        found.append(tail + "".join("]" if b == "[" else "}" for b in reversed(open_)))
    return found


def sort_keys(value: Any) -> Any:
    """value with all objects' keys in order."""
    if isinstance(value, dict):
        return {k: sort_keys(value[k]) for k in sorted(value, key=str)}
    return [sort_keys(v) for v in value] if isinstance(value, list | tuple) else value


def plain(value: Any) -> Any:
    """value as JSON can hold it: tuples are lists; sets, bytes and complex numbers their source text."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [plain(v) for v in value]
    return value if value is None or isinstance(value, str | int | float | bool) else repr(value)


def canonical(value: Any) -> str:
    """Compact JSON with sorted keys and text as it is."""
    return json.dumps(sort_keys(plain(value)), ensure_ascii=False, separators=(",", ":"))


def canonical_text(s: str) -> str:
    """Canonical JSON of a text that is an object or array, else the text without outer white space."""
    t = s.strip()
    if t[:1] + t[-1:] not in ("{}", "[]"):
        return t
    try:
        return canonical(json.loads(t))
    except (ValueError, RecursionError):
        return t
