"""Operator 5, substring dedup: removes every word covered by a window of 35 words that also starts elsewhere.

Prefilter: a count-min sketch of bounded size. Each task counts the windows' keys of its partition, saturating at two, for each row of the
sketch; its counts go on in blocks of cells, and the partitions' blocks are added up by block. A window is counted under its least k-gram, so a
cell is never below the number of windows with that text: estimates are too high or right, and no repeated window is lost. Which cells count
two or more is a bit array of bounded size that all tasks get; anchors it rules out are never shuffled. The second pass groups exactly the windows whose estimate
is two or more. With many more k-grams than cells the sketch rules out less, and the second pass does the rest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toolspark.llm import repeats
from toolspark.llm.common import mix, powers, read, written

WINDOW = 35
GRAM = 8
#: Rows of the sketch and cells in a row at most; the bits that all tasks get are 16 MB a row.
DEPTH = 2
WIDTH = 1 << 27
#: Cells in a block.
BLOCK = 1 << 16


def cells(gram: np.ndarray, row: int, width: int) -> np.ndarray:
    """Cells of k-gram hashes in a row of the sketch."""
    return (mix(gram.view(np.uint64) + np.uint64(row + 1) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(width - 1)).astype(np.int64)


def sketch(anchors: DataFrame, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """(row, block, often): for each block of cells one bit a cell, set where the partitions' counts add up to two or more."""
    block = min(BLOCK, width)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> Iterator[pa.RecordBatch]:
            gram = np.concatenate(held)
            for r in range(depth):
                at, n = np.unique(cells(gram, r, width), return_counts=True)
                new = np.flatnonzero(np.append(True, at[1:] // block != at[:-1] // block))
                parts = [(at[a:z] % block, n[a:z] > 1) for a, z in zip(new, np.append(new[1:], len(at)), strict=True)]
                few, many = ([p[t if v else ~t].astype(np.uint16).tobytes() for p, t in parts] for v in (False, True))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(new), r, np.int32)), pa.array((at[new] // block).astype(np.int32)), pa.array(few, pa.binary()), pa.array(many, pa.binary())], ["row", "block", "once", "twice"])

        for b in batches:
            held.append(b.column("gram").to_numpy())
            size += b.num_rows
            if size > 1 << 22:
                yield from counted()
                held, size = [], 0
        if size:
            yield from counted()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, np.zeros(block, np.uint8)

        def merged() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([np.packbits(total >= 2).tobytes()], pa.binary())], ["row", "block", "often"])

        for b in batches:
            for r, i, once, twice in zip(*[b.column(c).to_pylist() for c in ("row", "block", "once", "twice")], strict=True):
                if (r, i) != key:
                    if key is not None and (total >= 2).any():
                        yield merged()
                    key, total = (r, i), np.zeros(block, np.uint8)
                at = np.frombuffer(once, np.uint16)
                total[at] = np.minimum(total[at] + 1, 2)
                total[np.frombuffer(twice, np.uint16)] = 2
        if key is not None and (total >= 2).any():
            yield merged()

    parts = anchors.select("gram").mapInArrow(count, "row int, block int, once binary, twice binary")
    return parts.repartition("row", "block").sortWithinPartitions("row", "block").mapInArrow(add, "row int, block int, often binary")


def estimated_repeated(anchors: DataFrame, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """anchors whose least cell over all sketch rows counts two or more. Small tables get fewer cells (16 for each anchor)."""
    width = min(width, 1 << max(6, (16 * anchors.count()).bit_length()))
    block = min(BLOCK, width)
    often = np.zeros((depth, width // 8), np.uint8)
    for r in sketch(anchors, depth, width).collect():
        often[r["row"], r["block"] * (block // 8) : (r["block"] + 1) * (block // 8)] = np.frombuffer(r["often"], np.uint8)
    told = anchors.sparkSession.sparkContext.broadcast(often)

    def repeated(gram: pd.Series) -> pd.Series:
        x, keep = gram.to_numpy(np.int64), np.ones(len(gram), bool)
        for r in range(depth):
            at = cells(x, r, width)
            keep &= (told.value[r][at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
        return pd.Series(keep)

    repeated.__annotations__ = {"gram": pd.Series, "return": pd.Series}
    return anchors.where(F.pandas_udf(repeated, "boolean")("gram"))


def repeated_runs(pieces: list[bytes], window: int = WINDOW) -> Iterator[tuple[int, int, int]]:
    """(piece, first, last) runs of starts of word windows that start twice or more in the pieces; equal hashes are compared word by word."""
    known: dict[bytes, int] = {}
    rows = [[known.setdefault(w, len(known)) for w in p.split()] for p in pieces]
    sizes = np.array([len(r) for r in rows], np.int64)
    if not len(sizes) or sizes.max() < window:
        return
    ids = np.fromiter((w for r in rows for w in r), np.int64, int(sizes.sum()))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    up, down = powers(len(ids) + 1)
    total = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(mix(ids.astype(np.uint64) + np.uint64(1)) * up[: len(ids)], out=total[1:])
    owner = np.searchsorted(bounds, np.arange(len(ids)), "right") - 1
    at = np.flatnonzero(np.arange(len(ids)) + window <= bounds[owner + 1])
    keys = mix((total[at + window] - total[at]) * down[at])
    at = at[np.argsort(keys, kind="stable")]
    keys.sort()
    same = np.flatnonzero(keys[1:] == keys[:-1]) + 1
    exact = np.ones(len(same), bool)
    for d in range(window):
        exact &= ids[at[same] + d] == ids[at[same - 1] + d]
    flags = np.zeros(len(ids), bool)
    if exact.all():
        flags[at[same]] = flags[at[same - 1]] = True
    else:  # two texts under one hash: group by the words themselves
        seen: dict[bytes, int] = {}
        for i in at.tolist():
            w = ids[i : i + window].tobytes()
            if w in seen:
                flags[i] = flags[seen[w]] = True
            seen[w] = i
    who, a, z = repeats.runs_of(flags, owner)
    yield from zip(who.tolist(), (a - bounds[who]).tolist(), (z - bounds[who]).tolist(), strict=True)


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, depth: int = DEPTH, width: int = WIDTH, hot: int = repeats.HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_removed, kept (remaining words joined by one space), kept_sha256.

    Null text: no words. Rows repeated with one id count as two places. An empty table gives an empty result. Ids are of any simple type; texts are read
    whole; other columns are not looked at. Contexts with equal 128-bit hashes within a k-gram are taken as equal."""
    texts = repeats.keyed(docs, id_col, text_col)
    small = repeats.shrunk(texts)
    found = estimated_repeated(written(repeats.anchors(texts, "word", window, gram), "windows"), depth, width)
    spans = repeats.repeated_spans(found, small, "word", window, gram, lambda p: repeated_runs(p, window), hot)

    def fn(text: bytes, spans: list[tuple[int, int]]) -> tuple:
        words, parts, at = text.split(), [], 0
        for a, z in spans:
            parts += words[at:a]
            at = z
        kept = b" ".join(parts + words[at:])
        return len(words), sum(z - a for a, z in spans), kept.decode("utf-8", "replace"), hashlib.sha256(kept).hexdigest()

    kind = docs.schema[id_col].dataType.simpleString()
    return repeats.applied(small, spans, fn, ["n_words", "n_removed", "kept", "kept_sha256"], f"id {kind}, n_words long, n_removed long, kept string, kept_sha256 string").withColumnRenamed("id", id_col)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
