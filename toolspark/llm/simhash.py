"""Operator 7, SimHash near-dedup with covering locality-sensitive hashing.

Fingerprints within radius r differ in r bits at most. Every bit position gets a random vector of r + 1 bits; table v (each
nonzero vector of r + 1 bits) looks at the positions whose vector has an odd product with v. The vectors of r differing positions
span r dimensions at most, so some v is orthogonal to all of them: in that table the two fingerprints agree. No pair is missed.
Only distinct fingerprints are compared, and a bucket yields a spanning forest of its links, never its pairs. A bucket with very
many fingerprints is divided by blocks of the bits its table does not look at (r differing bits leave one of r + 1 blocks equal), as often as needed.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toolspark.llm.common import chunks, read, written
from toolspark.llm.components import components

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Fingerprints in a bucket up to which it is compared as it is.
BUCKET = 2048


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    whole = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(whole[a:z], seed) for a, z in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        # sums of bits, eight bit positions at a time in the bytes of a word
        for b in range(8):
            spread = (part >> np.uint64(b)) & np.uint64(0x0101010101010101)
            pad = -len(spread) % 255
            block = np.concatenate([spread, np.zeros(pad, np.uint64)]).reshape(-1, 255).sum(1, dtype=np.uint64)
            ones[b::8] += block.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return int(sum(1 << i for i in range(64) if 2 * ones[i] > len(hashes)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, fp long). Null and blank texts: zero."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros(b.num_rows, np.uint64)
            for c in chunks(b.column("text")):
                for i, t in enumerate(c.texts(), c.first):
                    out[i] = fingerprint(t, shingle, seed)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def covering_masks(radius: int, bits: int = 64, seed: int = SEED) -> list[int]:
    rng = random.Random(seed)
    vectors = [rng.randrange(1, 1 << (radius + 1)) for _ in range(bits)]
    return [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() & 1) for v in range(1, 1 << (radius + 1))]


def forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Index pairs that connect what links at the radius connect; one pair less than members for each connected part."""
    n = len(values)
    left = np.ones(n, bool)
    out: list[tuple[int, int]] = []
    for root in range(n):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        while queue:
            i = queue.pop()
            rest = np.flatnonzero(left)
            if not len(rest):
                return out
            near = rest[np.bitwise_count(values[rest] ^ values[i]) <= radius]
            left[near] = False
            out += [(i, j) for j in near.tolist()]
            queue += near.tolist()
    return out


def divided(mask: int, parts: int) -> list[int]:
    """The mask with one of ``parts`` blocks of the positions it does not look at."""
    free = [i for i in range(64) if not mask >> i & 1]
    return [mask | sum(1 << i for i in free[j::parts]) for j in range(parts)]


def links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """distinct(fp long) -> (a, b): enough links between fingerprints within the radius to connect all that are connected."""
    spark = distinct.sparkSession
    signed = lambda m: m - (1 << 64) if m >> 63 else m

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []

        def flush() -> pa.RecordBatch:
            v = np.array(held, np.int64)
            pairs = forest(v.view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array([int(v[i]) for i, _ in pairs], pa.int64()), pa.array([int(v[j]) for _, j in pairs], pa.int64())], ["a", "b"])

        for b in batches:
            for mask, key, fp in zip(*[b.column(c).to_pylist() for c in ("mask", "key", "fp")], strict=True):
                if (mask, key) != group:
                    if len(held) > 1:
                        yield flush()
                    group, held = (mask, key), []
                held.append(fp)
        if len(held) > 1:
            yield flush()

    masks, out = covering_masks(radius), None
    rows = distinct.select("fp", F.explode(F.array(*[F.lit(signed(m)) for m in masks])).alias("mask"))
    while True:
        rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = written(rows.groupBy("mask", "key").count().where("count > 1"), "buckets")
        # distinct fingerprints in a bucket differ in the positions left, so few positions cannot hold a large one
        few = rows.join(sizes.where(F.col("count") <= bucket).select("mask", "key"), ["mask", "key"], "left_semi")
        found = few.repartition("mask", "key").sortWithinPartitions("mask", "key").mapInArrow(run, "a long, b long")
        out = found if out is None else out.union(found)
        crowded = sizes.where(F.col("count") > bucket).select("mask", "key")
        if crowded.isEmpty():
            return out
        masks = [r.mask for r in crowded.select("mask").distinct().collect()]
        table = spark.createDataFrame([(m, signed(x)) for m in masks for x in divided(m % (1 << 64), radius + 1)], "mask long, next long")
        rows = written(rows.join(crowded, ["mask", "key"], "left_semi").join(F.broadcast(table), "mask").select("fp", F.col("next").alias("mask")).distinct(), "divided")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """One row for each document: id, fingerprint (hex), component_id (least id reachable over links of ``radius`` or fewer bits).

    Null, empty and blank texts: fingerprint zero, linked like any other. Texts are read whole. Null ids come last among a component's ids. Equal rows get
    equal rows; an empty table gives an empty result; other columns are not looked at."""
    marked = written(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp"), radius, bucket))
    # the least document of each component: components name a fingerprint, documents of a fingerprint are already one row
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.join(least, "root").select("fp", "component_id")
    out = marked.join(by_fp, "fp", "left")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
