"""Helpers of the text operators: bounded chunks of a text column as numpy bytes, words, hashes.

White space is the six bytes of ``[\\x20\\x09-\\x0D]`` everywhere; a word is a maximal run of other bytes.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


#: Rows handed to Python at once where the session has Spark's own default: long texts make larger batches costly in memory.
BATCH_ROWS = 1024


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see. Where none is set a local session gets a temporary one (tests); a cluster must name its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="toolspark-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def short_lived(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which is removed when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    of = spark._jvm.org.apache.hadoop.fs.Path(path)
    of.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(of)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, and safe from lost executors."""
    path = short_lived(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Two longs, never null, that name a row; rows equal in id and text share them, which every user allows for. Ids are of any simple type."""
    return [F.xxhash64(F.col(id_col).isNull(), F.col(id_col), F.col(text_col)).alias("rid"), F.coalesce(F.col(id_col).try_cast("long"), F.xxhash64(F.lit(1), F.col(id_col))).alias("did")]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        n = max(n, 1 << 16)
        steps = [np.full(n, b, np.uint64) for b in (_BASE, _INVERSE)]
        for s in steps:
            s[0] = 1
        _powers = tuple(np.multiply.accumulate(s) for s in steps)
    return _powers[0][:n], _powers[1][:n]


def free(df: DataFrame, name: str) -> str:
    """The name, with as many underscores as make it none of df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def refuse(df: DataFrame, *names: str) -> None:
    """ValueError if df has a column of a name that an operator adds."""
    if clash := {c.lower() for c in df.columns} & set(names):
        raise ValueError(f"the table already has columns named {sorted(clash)}")


def block_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for spans that do not overlap. Eight bytes at a time are scrambled by their place before they are
    added up, so no pattern of bytes cancels out as in sums of powers."""
    sizes = ends - starts
    blocks = (sizes + 7) // 8
    if not blocks.sum():
        return mix(np.full(len(starts), _BASE, np.uint64))
    owner = np.repeat(np.arange(len(starts)), blocks)
    turn = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    at = starts[owner] + 8 * turn
    left = ends[owner] - at
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    value = np.zeros(len(at), np.uint64)
    for i in range(8):
        value |= np.where(left > i, padded[at + i], 0).astype(np.uint64) << np.uint64(8 * i)
    each = mix(mix(value + (turn.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE)) + turn.astype(np.uint64))
    total = np.zeros(len(at) + 1, np.uint64)
    np.cumsum(each, out=total[1:])
    last = np.cumsum(blocks)
    return mix(total[last] - total[last - blocks] + sizes.astype(np.uint64) * np.uint64(_BASE))


def span_hash(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of codes[start:end] for every span, by one running sum."""
    up, down = powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[: len(codes)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Chunk:
    """Rows first:last of a batch; their texts end to end in data, text i at data[offsets[i]:offsets[i+1]]."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    def texts(self) -> list[bytes]:
        whole, o = self.data.tobytes(), self.offsets
        return [whole[a:b] for a, b in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)]


def chunks(column: pa.Array, most: int = 1 << 20) -> Iterator[Chunk]:
    """Cuts a string column (null: empty) into runs of rows of about ``most`` bytes; a longer text is a run of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    at = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        j = min(j, n)
        yield Chunk(i, j, data[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j


def words(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in the chunk, and for each text the index of its first word (one more at the end)."""
    data, n = chunk.data, len(chunk.data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(chunk.offsets), np.int64)
    solid = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[chunk.offsets] = True
    before = np.zeros(n, bool)
    before[1:] = solid[:-1]
    before &= ~edge[:-1]
    after = np.zeros(n, bool)
    after[:-1] = solid[1:]
    after &= ~edge[1:]
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, chunk.offsets)


def word_codes(chunk: Chunk, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return block_hash(chunk.data, starts, ends)
