"""Names, arguments and categories of calls as plain expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from toolspark.config import ARG_ALIASES, CATEGORIES, CHANGE_MARKS, INT_PARAMS, NAME_HINTS, PARAM_ALIASES, TEST_COMMANDS, TOOL_ALIASES, VERIFY_TOOLS


def lookup(key: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def parser_name(name: Column, aliases: dict[str, str] | None = None) -> Column:
    """The name under which a call is reported by the parser."""
    clean = F.lower(trimmed(name))
    return F.coalesce(lookup(clean, TOOL_ALIASES | {k.lower(): v.lower() for k, v in (aliases or {}).items()}), clean)


def canonical_name(name: Column) -> Column:
    clean = F.lower(trimmed(name))
    return F.coalesce(lookup(clean, {n: c for names in CATEGORIES.values() for n, c in names.items()}), clean, F.lit(""))


def _has(text: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts])


def category(name: Column, command: Column | None = None) -> Column:
    """Category of a tool; for tools that run commands the command decides between test, edit and exec."""
    clean = F.coalesce(F.lower(trimmed(name)), F.lit(""))
    known = lookup(clean, {n: k for k, names in CATEGORIES.items() for n in names})
    guess = reduce(lambda w, k: w.when(_has(clean, NAME_HINTS[k]), k), list(NAME_HINTS)[1:], F.when(_has(clean, NAME_HINTS["edit"]), "edit")).otherwise("unknown")
    if command is not None:
        cmd = F.coalesce(F.lower(command), F.lit(""))
        known = F.when((known == "exec") & _has(cmd, TEST_COMMANDS), "test").when((known == "exec") & _has(cmd, CHANGE_MARKS), "edit").otherwise(known)
    return F.when(clean == "", "unknown").otherwise(F.coalesce(known, guess))


def predicates(name: Column, command: Column | None = None) -> dict[str, Column]:
    """The six questions about a call, by name."""
    cat, plain = category(name, command), category(name)
    return {
        "is_mutation": cat == "edit",
        "is_execution": plain.isin("exec", "test"),
        "is_verification": (cat == "test") | canonical_name(name).isin(VERIFY_TOOLS),
        "is_read": plain == "read",
        "is_search": plain == "search",
        "is_submit": plain == "submit",
    }


def command_of(args_json: Column) -> Column:
    return F.coalesce(F.nullif(F.get_json_object(args_json, "$.command"), F.lit("")), F.get_json_object(args_json, "$.cmd"))


def renamed(args: Column, table: dict[str, str], fold: bool) -> Column:
    """A map with its keys renamed; of two keys that become one the later wins."""
    key = lambda k: F.coalesce(lookup(F.lower(k) if fold else k, table), k)
    pairs = F.transform(F.map_entries(args), lambda e: F.struct(key(e["key"]).alias("key"), e["value"].alias("value")))
    later = lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda o: o["key"] == e["key"])
    return F.map_from_entries(F.filter(pairs, later))


def canonical_args(args: Column) -> Column:
    return renamed(args, ARG_ALIASES, False)


def parser_args(args: Column) -> Column:
    return renamed(args, PARAM_ALIASES, True)


def int_args(args: Column) -> Column:
    """map<string, bigint> of the arguments that count as integers."""
    whole = F.map_filter(args, lambda k, v: k.isin(*INT_PARAMS) & trimmed(v).rlike(r"^-?\d+$"))
    return F.transform_values(whole, lambda k, v: trimmed(v).try_cast("bigint"))
