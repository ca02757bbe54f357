"""Operator 8, mixing sources to target weights.

The words of a source, its documents end to end, are packed into blocks of a fixed number of words (fewer in sources so small that whole blocks could not meet
a target). Each output shard draws how many of its slots go to each source (multinomial, by what the source's quota still lacks, so totals come out as asked).
The k-th slot of a source takes block p(k mod blocks), p a keyed permutation of block numbers: every block is taken k/blocks times, rounded down or up, and
slots meet blocks in a join by number.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from toolspark.llm.common import WORD, free, read, refuse, row_key, written

BLOCK = 32
#: Blocks that a source should have at least; smaller sources get shorter blocks.
FINE = 64
SEED = 8
WEIGHTS = (1, 2, 3)
MOST = 3
#: Slots of a shard, until there are MAX_SHARDS; then shards grow. Small mixes still have MIN_SHARDS.
SLOTS = 4096
MIN_SHARDS, MAX_SHARDS = 8, 4096
#: Counts by shard and source, which the driver holds: with many sources there are fewer and larger shards.
MAX_COUNTS = 1 << 20
#: Rows of the table of sources, which the driver holds.
MAX_SOURCES = 1_000_000
#: Documents in a part of a source over which one running sum goes, and parts in a chunk, whose sums are added up the same way.
PART, CHUNK = 500, 1000


def n_words(text: str | Column) -> Column:
    """Words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Shares of the sum of sizes by weight; none above ``most`` times its size, the excess shared out again by weight."""
    out, open_ = [0.0] * len(sizes), {i for i, s in enumerate(sizes) if s}
    left = float(sum(sizes))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if weights[i] * unit > most * sizes[i]}
        if not over:
            for i in open_:
                out[i] = weights[i] * unit
            break
        for i in over:
            out[i] = float(most * sizes[i])
            left -= out[i]
        open_ -= over
    return out


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A permutation of 0..n-1 for each key: a four-round Feistel network over the next even number of bits, walked until inside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo].astype(np.uint64)
        left, right = out[todo] >> h, out[todo] & m
        for r in range(4):
            x = (right + np.uint64(r + 1)) * np.uint64(0x9E3779B97F4A7C15) ^ k * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((x >> np.uint64(32)) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def shard_counts(quotas: list[int], slots: int, max_shards: int, seed: int, max_counts: int = MAX_COUNTS) -> np.ndarray:
    """A row for each shard, a column for each source; columns add up to the quotas."""
    left = np.array(quotas, np.int64)
    shards = max(1, min(max(MIN_SHARDS, math.ceil(left.sum() / slots)), max_shards, max_counts // len(left))) if len(left) else 0
    rng, out = np.random.default_rng(seed), np.zeros((shards, len(left)), np.int64)
    for s in range(shards):
        size = math.ceil(left.sum() / (shards - s))
        if s == shards - 1:
            out[s] = left
            break
        if left.sum():
            out[s] = np.minimum(rng.multinomial(size, left / left.sum()), left)
        lack = size - out[s].sum()
        for i in np.argsort(out[s] - left, kind="stable"):  # what a used-up source could not give
            if not lack:
                break
            more = min(lack, left[i] - out[s, i])
            out[s, i] += more
            lack -= more
        left -= out[s]
    return out


@dataclass
class Mix:
    sources: pd.DataFrame  # source, index, source_size, target, block (its words), blocks, quota
    spans: DataFrame  # every row with words: id, rid, src, at (its words before it in the source), size, source, words (of a block)
    slots: DataFrame  # shard, slot, src, block
    rows: DataFrame  # all rows: id, rid, source, size


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mix:
    spark = docs.sparkSession
    rows = written(docs.select(row_key(id_col, text_col)[0], F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size")), "sizes")
    found = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [int(r.source_size) for r in found]
    target = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], most)
    words = [max(1, min(block, s // FINE)) for s in sizes]
    blocks = [-(-s // w) for s, w in zip(sizes, words, strict=True)]
    quota = [min(most * b, round(t * b / s)) if s else 0 for s, t, b in zip(sizes, target, blocks, strict=True)]
    table = pd.DataFrame({"source": [r.source for r in found], "src": range(len(found)), "source_size": sizes, "target": target, "block": words, "blocks": blocks, "quota": quota})
    counts = shard_counts(quota, SLOTS, MAX_SHARDS, seed)
    before = np.cumsum(counts, 0) - counts
    s, i = np.nonzero(counts)
    drawn = [(int(a), int(b), int(before[a, b]), int(counts[a, b]), int(blocks[b])) for a, b in zip(s, i, strict=True)]
    drawn = spark.createDataFrame(drawn, "shard int, src int, first long, n long, blocks long")
    step = 8192
    slots = drawn.select("shard", "src", "first", "n", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {step}"))).alias("part"))
    slots = slots.repartition("shard", "src", "part").select("shard", "src", "blocks", F.expr(f"explode(sequence(first + part * {step}, first + least(n, (part + 1) * {step}) - 1))").alias("slot"))

    @F.pandas_udf("long")
    def choose(slot: pd.Series, n: pd.Series, src: pd.Series) -> pd.Series:
        return pd.Series(permute((slot % n).to_numpy(), n.to_numpy(), src.to_numpy() + (seed << 20)))

    slots = slots.select("shard", "slot", "src", choose("slot", "blocks", "src").alias("block"))

    # where each document's words start in its source: running sums over parts of a source, over the parts of a chunk and over the chunks
    parts = max(1, math.ceil(sum(r.n for r in found) / PART))
    numbered = spark.createDataFrame([(r.source, k, w) for k, (r, w) in enumerate(zip(found, words, strict=True))], "s string, src int, words int")
    own = rows.where("size > 0").join(numbered, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    own = own.withColumn("part", F.pmod(F.xxhash64("id", "rid"), F.lit(parts)))
    before_ = lambda value, *keys: F.sum(value).over(Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    sums = written(own.groupBy("src", "part").agg(F.sum("size").alias("sum")).withColumn("chunk", F.expr(f"part div {CHUNK}")), "parts")
    chunks_ = sums.groupBy("src", "chunk").agg(F.sum("sum").alias("all")).withColumn("base", before_("all", "src", "chunk")).drop("all")
    sums = sums.withColumn("inside", before_("sum", "src", "chunk", "part")).join(chunks_, ["src", "chunk"]).select("src", "part", (F.col("base") + F.col("inside")).alias("base"))
    w = Window.partitionBy("src", "part").orderBy("id", "rid").rowsBetween(Window.unboundedPreceding, 0)
    spans = own.withColumn("at", F.sum("size").over(w) - F.col("size")).join(sums, ["src", "part"]).withColumn("at", F.col("at") + F.col("base")).drop("base", "part")
    return Mix(table, spans, slots, rows)


def taken_blocks(mix: Mix) -> DataFrame:
    """(id, rid, src, at, size, source, block, first, last, times): for each document and block of it, the words of the document in the block and how often it is taken."""
    times = mix.slots.groupBy("src", "block").agg(F.count("*").alias("times"))
    cover = mix.spans.withColumn("block", F.explode(F.expr("sequence(at div words, (at + size - 1) div words)")))
    cover = cover.withColumn("first", F.greatest(F.col("block") * F.col("words") - F.col("at"), F.lit(0).cast("long"))).withColumn("last", F.least((F.col("block") + 1) * F.col("words") - F.col("at"), F.col("size")))
    # a row for every block: Spark's estimate, from before slots are listed, may be small enough to gather and broadcast it through the driver
    return cover.join(times.hint("merge"), ["src", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0).cast("long")))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each document: id, source, size, source_size, target (of its source), taken (words, repeats counted).

    Null or empty text: size 0. Null source: a source of its own, last. Texts are read whole; an empty table gives an empty result; other columns are not looked at. Rows that are alike in all columns count one by one. The same rows, seed and block give the same mix,
    however they are partitioned."""
    mix = plan(docs, weights, most, block, seed, id_col, text_col, source_col)
    sums = taken_blocks(mix).groupBy("src", "at", "id", "size", "source").agg(F.sum(F.col("times") * (F.col("last") - F.col("first"))).alias("taken")).select("id", "source", "size", "taken")
    rows = sums.unionByName(mix.rows.where("size = 0").select("id", "source", "size", F.lit(0).cast("long").alias("taken")))
    about = docs.sparkSession.createDataFrame([(r.source, int(r.source_size), float(r.target)) for r in mix.sources.itertuples()], "s string, source_size long, target double")
    return rows.join(about, F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "taken")


def mixed_texts(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents as the mix takes them: a column ``mixed_`` with the words taken (once more on a line of its own for each
    further time), and only documents of which something is taken. Neighbouring blocks stay as they stand in the text. Null and empty texts give no row;
    alike rows are mixed one by one; an empty table gives an empty result. A column named ``mixed_`` is refused, others pass through."""
    refuse(docs, "mixed_")
    mix = plan(docs, weights, most, block, seed, id_col, text_col, source_col)
    # rows alike in id, text and source stand side by side in the source; they are told apart by their turn
    turn = Window.partitionBy("rid", "id", "source").orderBy("at")
    mix.spans = mix.spans.withColumn("turn", F.row_number().over(turn))
    cover = taken_blocks(mix).where("times > 0").groupBy("rid", "id", "source", "turn").agg(F.sort_array(F.collect_list(F.struct("first", "last", "times"))).alias("blocks_"))
    import re

    word = re.compile(r"[^\x20\x09-\x0D]+")

    @F.pandas_udf("string")
    def cut(text: pd.Series, blocks: pd.Series) -> pd.Series:
        out = []
        for t, b in zip(text, blocks, strict=True):
            at = [m.span() for m in word.finditer(t)]
            lines = []
            for time in range(1, max(x["times"] for x in b) + 1):
                spans: list[list[int]] = []
                for x in b:
                    if x["times"] >= time:
                        if spans and spans[-1][1] == x["first"]:
                            spans[-1][1] = x["last"]
                        else:
                            spans.append([x["first"], x["last"]])
                lines.append(" ".join(t[at[a][0] : at[z - 1][1]] for a, z in spans))
            out.append("\n".join(lines))
        return pd.Series(out)

    row, rid, turn_ = (free(docs, n) for n in ("row", "rid", "turn"))
    keyed = docs.select(F.struct(*docs.columns).alias(row), row_key(id_col, text_col)[0].alias(rid))
    own, source = F.col(f"{row}.{id_col}"), F.col(f"{row}.{source_col}").cast("string")
    keyed = keyed.withColumn(turn_, F.row_number().over(Window.partitionBy(rid, own, source).orderBy(rid)))
    cover = cover.select(F.col("rid").alias("rid2"), F.col("id").alias("id2"), F.col("source").alias("source2"), F.col("turn").alias("turn2"), "blocks_")
    both = keyed.join(cover, (keyed[rid] == cover["rid2"]) & own.eqNullSafe(F.col("id2")) & source.eqNullSafe(F.col("source2")) & (keyed[turn_] == cover["turn2"]))
    return both.select(f"{row}.*", cut(F.col(f"{row}.{text_col}"), F.col("blocks_")).alias("mixed_"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
