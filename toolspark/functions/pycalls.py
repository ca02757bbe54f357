"""Tool calls written as Python call expressions, alone on a line or inside prose."""

from __future__ import annotations

import ast
import keyword
import re
import warnings
from typing import Any

from toolspark.config import BUILTINS, CALL_PREFIXES

_start = re.compile(r"(?P<name>[^\W\d]\w*(?:\.[^\W\d]\w*)*)\s*\(")
_block = re.compile(r"```(?:python|py)?[ \t]*\n?(.*?)```", re.S | re.I)
_name_hosts = {"tool", "tools", "action", "functions"}
_methods = {"call", "run", "execute", "invoke"}
_lead = re.compile(r"(?:" + "|".join(map(re.escape, CALL_PREFIXES)) + r")\s*[*`]*\Z", re.I)


def short_name(dotted: str) -> str:
    """x.call -> x, tools.x -> x, a.b.c -> c."""
    head, _, last = dotted.rpartition(".")
    return head if last in _methods and head and "." not in head else last


def closing(text: str, at: int) -> int:
    """Index after the parenthesis that closes the one at ``at``; -1 if it stays open. Strings, also triple-quoted ones, are stepped over."""
    depth, i = 0, at
    while i < len(text):
        c = text[i]
        if c in "'\"":
            q = text[i : i + 3] if text[i : i + 3] in ('"""', "'''") else c
            i += len(q)
            while i < len(text) and not text.startswith(q, i):
                i += 2 if text[i] == "\\" else 1
            i += len(q)
            continue
        depth += (c in "([{") - (c in ")]}")
        i += 1
        if not depth:
            return i
    return -1


def _value(node: ast.expr) -> Any:
    try:
        return ast.literal_eval(node)
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        if isinstance(node, ast.Name) and node.id in ("true", "false", "null"):
            return {"true": True, "false": False, "null": None}[node.id]
        return ast.unparse(node)


def _expression(source: str) -> ast.Call | None:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            body = ast.parse(source, mode="eval").body
        except (SyntaxError, ValueError, MemoryError, RecursionError):
            return None
    return body if isinstance(body, ast.Call) else None


def arguments(call: ast.Call) -> dict[str, Any]:
    out = {k.arg: _value(k.value) for k in call.keywords if k.arg}
    return out | {f"arg{i}": _value(a) for i, a in enumerate(call.args)}


def kwargs(text: str) -> dict[str, Any]:
    """Arguments of a text like ``a=1, b="x"``; empty if it is none."""
    call = _expression(f"f({text})")
    return arguments(call) if call else {}


def _stands_alone(text: str, at: int) -> bool:
    line = text[text.rfind("\n", 0, at) + 1 : at]
    bare = line.strip()
    return not bare or bare.endswith("`") or bool(_lead.search(line)) or bare in ("-", "*", ">", ">>>")


def calls(text: str, known: frozenset[str] | None = None) -> list[tuple[str, dict[str, Any], str]]:
    """(name, arguments, source) of all calls; fenced Python first, else the whole text, else its lines with ends mended."""
    if "(" not in text:
        return []
    fenced = [b for b in _block.findall(text) if "(" in b]
    for part in ([*fenced], [text]):
        out = []
        for body in part:
            at = 0
            while m := _start.search(body, at):
                at = m.end()
                name = short_name(m["name"])
                if not _stands_alone(body, m.start()) or any(keyword.iskeyword(p) for p in m["name"].split(".")) or (known is None and name.lower() in BUILTINS):
                    continue
                end = closing(body, m.end() - 1)
                if end < 0:
                    continue
                call = _expression(m["name"] + body[m.end() - 1 : end])
                if call is not None:
                    out.append((name, arguments(call), body[m.start() : end]))
                    at = end
        if out:
            return out
    out = []
    for line in text.splitlines():
        source = line.strip().removeprefix("call:").strip()
        m = _start.match(source)
        if not m or (known is None and short_name(m["name"]).lower() in BUILTINS) or keyword.iskeyword(m["name"]):
            continue
        for end in ("", ")", '")', '"))', "}"):
            call = _expression(source + end)
            if call is not None and isinstance(call.func, ast.Name | ast.Attribute):
                out.append((short_name(m["name"]), arguments(call), line.strip()))
                break
    return out
