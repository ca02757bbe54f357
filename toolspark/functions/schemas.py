"""JSON Schemas of tool parameters made fit for a provider."""

from __future__ import annotations

from typing import Any

#: fixed values: keywords the Gemini API rejects
GEMINI_DROPS = frozenset(["$schema", "$id", "$defs", "definitions", "additionalProperties", "default", "examples", "title", "$comment"])
DEPTH = 40


def for_gemini(schema: Any) -> Any:
    """References put in place, alternatives reduced to the first that is not null, lists of types to their first, rejected keywords dropped. References that lead in a circle end as objects."""
    root = schema if isinstance(schema, dict) else {}
    defs = {f"#/{k}/{n}": d for k in ("$defs", "definitions") for n, d in (root.get(k) or {}).items()}

    def walk(node: Any, depth: int) -> Any:
        if isinstance(node, list):
            return [walk(x, depth) for x in node]
        if not isinstance(node, dict):
            return node
        if "$ref" in node:
            if depth > DEPTH:
                return {"type": "object"}
            return walk({**defs.get(node["$ref"], {}), **{k: v for k, v in node.items() if k != "$ref"}}, depth + 1)
        for key in ("anyOf", "oneOf"):
            if isinstance(node.get(key), list):
                real = [b for b in node[key] if not (isinstance(b, dict) and b.get("type") == "null")]
                rest = {k: v for k, v in node.items() if k != key}
                return walk({**rest, **(real[0] if real and isinstance(real[0], dict) else {"type": "string"})}, depth + 1)
        out = {}
        for k, v in node.items():
            if k == "properties" and isinstance(v, dict):
                out[k] = {n: walk(p, depth + 1) for n, p in v.items()}
            elif k == "type" and isinstance(v, list):
                out[k] = next((t for t in v if t != "null"), "string")
            elif k not in GEMINI_DROPS:
                out[k] = walk(v, depth + 1) if isinstance(v, dict | list) and k not in ("enum", "required") else v
        if "properties" in out and "type" not in out:
            out["type"] = "object"
        return out

    return walk(schema, 0)


def for_openai(schema: Any, strict: bool = False) -> Any:
    """Without $schema and $id; strict: every object closed and all its properties required."""
    if not isinstance(schema, dict):
        return schema
    out = {k: v for k, v in schema.items() if k not in ("$schema", "$id")}
    if strict:
        if isinstance(out.get("properties"), dict):
            out["properties"] = {n: for_openai(p, True) for n, p in out["properties"].items()}
        if out.get("type") == "object" or "properties" in out:
            out |= {"additionalProperties": False, "required": list(out.get("properties", {}))}
        if isinstance(out.get("items"), dict):
            out["items"] = for_openai(out["items"], True)
    return out
