"""What loops over one payload do, as set operations over exploded messages, calls and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged_turns(messages: DataFrame, key: str, order: str, role: str = "role", text: str = "text") -> DataFrame:
    """Neighbouring messages of one role joined by line breaks: key, turn, role, text, messages."""
    w = Window.partitionBy(key).orderBy(order)
    new = F.when(F.lag(role).over(w).eqNullSafe(F.col(role)), 0).otherwise(1)
    marked = messages.withColumn("new_", new).withColumn("turn_", F.sum("new_").over(w))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return marked.groupBy(key, F.col("turn_").alias("turn"), role).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n").alias("text"), F.count("*").alias("messages"))


def system_text(messages: DataFrame, key: str, order: str, role: str = "role", text: str = "text") -> DataFrame:
    """The system messages of each key joined by empty lines."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return messages.where(F.col(role) == "system").groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n").alias("system"))


def named_results(results: DataFrame, calls: DataFrame, key: str, call_id: str = "call_id", name: str = "name", order: str = "call_index") -> DataFrame:
    """results with the name of the call they answer: the last of calls with the id, else the id itself."""
    last = calls.groupBy(key, call_id).agg(F.max_by(name, order).alias("called_"))
    return results.join(last, [key, call_id], "left").withColumn("tool_name", F.coalesce("called_", call_id)).drop("called_")


def unanswered_calls(calls: DataFrame, results: DataFrame, key: str, call_id: str = "call_id") -> DataFrame:
    return calls.join(results.select(key, call_id), [key, call_id], "left_anti")


def mcp_results(results: DataFrame, key: str, order: str, text: str = "content", error: str = "is_error") -> DataFrame:
    """One result for each key: the texts in order, an error if any is."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return results.groupBy(key).agg(F.transform(parts, lambda p: p["t"]).alias("content"), F.bool_or(error).alias("is_error"))


def first_seen_index(calls: DataFrame, key: str, order: str, name: str = "name") -> DataFrame:
    """calls with tool_index: names numbered from 0 by where they first appear in their stream."""
    first = calls.withColumn("first_", F.min(order).over(Window.partitionBy(key, name)))
    return first.withColumn("tool_index", F.dense_rank().over(Window.partitionBy(key).orderBy("first_", name)) - 1).drop("first_")


def to_headers(columns: dict[str, Column], annotations: Column | None = None, prefix: str = "x-a2a-") -> Column:
    """map of headers for the given metadata that is not null; annotations get their own prefix."""
    pairs = F.array(*[F.struct(F.lit(prefix + n.replace("_", "-")).alias("key"), c.cast("string").alias("value")) for n, c in columns.items()])
    own = F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))
    if annotations is None:
        return own
    return F.map_concat(own, F.transform_keys(annotations, lambda k, v: F.concat(F.lit(prefix + "meta-"), k)))


def from_headers(headers: Column, names: list[str], prefix: str = "x-a2a-") -> list[Column]:
    low = F.transform_keys(headers, lambda k, v: F.lower(k))
    return [F.element_at(low, F.lit(prefix + n.replace("_", "-"))).alias(n) for n in names]
