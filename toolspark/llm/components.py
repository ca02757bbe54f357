"""Connected components of an edge table by alternating star contraction; nothing is gathered on the driver.

Each round is two joins or aggregations over the edges left, and its result is written to the shared checkpoint folder, which
cuts the lineage. A hub with very many links never meets in one task: only least neighbours are aggregated.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toolspark.llm.common import shared_dir


def contracted(edges: DataFrame, most: int = 1 << 20) -> DataFrame:
    """edges(a, b) -> (u, v) with v the least node that the edges of one batch connect to u: each task shortens its own paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[int, int] = {}

        def head(x: int) -> int:
            path = []
            while (up := top.setdefault(x, x)) != x:
                path.append(x)
                x = up
            for y in path:
                top[y] = x
            return x

        def stars() -> pa.RecordBatch:
            pairs = [(x, head(x)) for x in top]
            return pa.RecordBatch.from_arrays([pa.array([x for x, r in pairs if x != r], pa.int64()), pa.array([r for x, r in pairs if x != r], pa.int64())], ["u", "v"])

        for b in batches:
            for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
                x, y = head(x), head(y)
                if x != y:
                    top[max(x, y)] = min(x, y)
            if len(top) > most:
                yield stars()
                top.clear()
        yield stars()

    return edges.select("a", "b").where("a <> b").mapInArrow(run, "u long, v long")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(a long, b long) -> (node, root), root the least node of the component; nodes without an edge are left out.

    Loops, repeated and reversed edges do no harm. Least-neighbour hooking with pointer jumping: the number of rounds grows with
    the logarithm of the largest diameter. Raises if ``max_rounds`` do not suffice."""
    shared_dir(edges.sparkSession)
    e = contracted(edges).distinct().checkpoint()
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # every node with its least neighbour or itself
    parent = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("p")).checkpoint()
    for _ in range(max_rounds):
        # jump: each node takes its parent's parent
        jump = parent.join(parent.select(F.col("node").alias("p"), F.col("p").alias("g")), "p", "left").select("node", F.coalesce("g", "p").alias("p"))
        # edges seen from their roots, and a root hooks to the least root next to it
        r = e.join(jump.select(F.col("node").alias("u"), F.col("p").alias("ru")), "u").join(jump.select(F.col("node").alias("v"), F.col("p").alias("rv")), "v")
        r = r.select(F.greatest("ru", "rv").alias("u"), F.least("ru", "rv").alias("v")).where("u <> v").distinct().checkpoint()
        hook = r.groupBy("u").agg(F.min("v").alias("h"))
        new = jump.join(hook.withColumnRenamed("u", "node"), "node", "left").select("node", F.least("p", F.coalesce("h", "p")).alias("p")).checkpoint()
        done = r.isEmpty()
        e = r
        if done:
            # no edge joins two roots: follow parents to the end
            while True:
                up = new.join(new.select(F.col("node").alias("p"), F.col("p").alias("g")), "p", "left").select("node", F.coalesce("g", "p").alias("p"), (F.coalesce("g", "p") != F.col("p")).alias("moved")).checkpoint()
                new = up.select("node", "p")
                if up.where("moved").isEmpty():
                    return new.select("node", F.col("p").alias("root"))
        parent = new
    raise RuntimeError(f"components not found in {max_rounds} rounds")
