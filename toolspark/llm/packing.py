"""Operator 3, packing: first-fit decreasing with a tournament tree of bin capacities, run in randomised groups of documents.

A document's tokens are cut into pieces of the sequence length, which fill sequences of their own, and a rest. The rests of a
group are placed by decreasing length, each into the first sequence with room, found by descending a tree whose nodes hold the largest
capacity below. What room is left is then filled by cutting rests of the emptiest sequences, so at most one sequence of a group stays
unfilled; it is divided at powers of two, which need no padding. Groups are dealt by a hash of the document and have about `GROUP` bytes.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from toolspark.llm.common import read

LENGTH = 2048
END = 1
GROUP = 8 << 20
SEED = 3
#: Characters whose Unicode classes do not differ between versions; other texts go to the slower library.
_plain = re.compile(r"[\t\n\r\x20-\x7e¡-ɏ‐-‧]*")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(4)
def encoder(path: str):
    """A function from texts to lists of ids, as tokenizers gives them without special tokens added.

    Where the file is a byte-level BPE whose ids follow its merges, tiktoken gives the same ids several times as fast; it gets
    the texts of plain characters that hold no special token."""
    import tiktoken
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    slow = Tokenizer.from_file(path)
    spec = json.load(open(path, encoding="utf-8"))
    special = [t["content"] for t in spec.get("added_tokens", [])]
    fast = None
    if spec["model"]["type"] == "BPE" and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not spec.get("normalizer") and not spec["pre_tokenizer"].get("add_prefix_space"):
        alphabet = sorted(ByteLevel.alphabet())
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(shown))}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        vocab = spec["model"]["vocab"]
        if set(alphabet) == set(byte_of) and all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges)):
            import public_tokenizers

            ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in special}
            fast = tiktoken.Encoding("fast", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(texts: list[str]) -> list[np.ndarray]:
        out = []
        for t in texts:
            if fast is not None and _plain.fullmatch(t) and not any(s in t for s in special):
                out.append(np.array(fast.encode_ordinary(t), np.int32))
            else:
                out.append(np.array(slow.encode(t, add_special_tokens=False).ids, np.int32))
        return out

    return encode


class Tournament:
    """Capacities of bins in a complete binary tree; the first bin with room for a size is found from the root down."""

    def __init__(self, n: int, capacity: int) -> None:
        self.leaves = 1
        while self.leaves < max(n, 1):
            self.leaves *= 2
        self.most = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        at, most = 1, self.most
        while at < self.leaves:
            at = 2 * at if most[2 * at] >= size else 2 * at + 1
        out = at - self.leaves
        most[at] -= size
        at //= 2
        while at:
            best = max(most[2 * at], most[2 * at + 1])
            if most[at] == best:
                break
            most[at] = best
            at //= 2
        return out


def pack(sizes: list[int], length: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of pieces (document, start, size). Every token is in one piece; sizes of zero get none."""
    full: list[list[tuple[int, int, int]]] = []
    rest: list[tuple[int, int, int]] = []
    for d, n in enumerate(sizes):
        full += [[(d, s, length)] for s in range(0, n - length + 1, length)]
        if n % length:
            rest.append((d, n - n % length, n % length))
    rest.sort(key=lambda p: -p[2])
    tree = Tournament(len(rest), length)
    bins: list[list[tuple[int, int, int]]] = [[] for _ in rest]
    for p in rest:
        bins[tree.place(p[2])].append(p)
    bins = [b for b in bins if b]
    room = {i: length - sum(p[2] for p in b) for i, b in enumerate(bins)}
    by_room = sorted((i for i in room if room[i]), key=lambda i: (room[i], i))
    a, z = 0, len(by_room) - 1
    while a < z:  # the fullest takes from the emptiest
        to, of = by_room[a], by_room[z]
        d, s, n = bins[of].pop()
        take = min(n, room[to])
        bins[to].append((d, s + n - take, take))
        if n > take:
            bins[of].append((d, s, n - take))
        room[to] -= take
        room[of] += take
        a += not room[to]
        z -= not bins[of]
    out = full + [b for i, b in enumerate(bins) if b and not room[i]]
    for i in (i for i in by_room[a : z + 1] if bins[i] and room[i]):
        left = sum(p[2] for p in bins[i])
        pieces = bins[i][::-1]
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            made = []
            while size:
                d, s, n = pieces.pop()
                take = min(n, size)
                made.append((d, s, take))
                size -= take
                if n > take:
                    pieces.append((d, s + take, n - take))
            out.append(made)
    return out


def packed(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end: int = END, group: int = GROUP, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: id, start, length, ids, doc_tokens, sequence_id, offset.

    Null text: empty, so only the end token. Repeated rows are packed each for itself. A text is tokenised as a whole, whatever its length. Null ids and ties
    have a fixed order in their group, so reruns agree. An empty table gives an empty result; other columns are not looked at."""
    tokenizer = tokenizer or default_tokenizer()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    groups = max(1, -(-total // group))
    rows = rows.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "id", "text"), F.lit(groups)))

    def run(t: pa.Table) -> pa.Table:
        ids_, texts = t.column("id").to_pylist(), t.column("text").to_pylist()
        # null ids last, ties by text, so reruns agree
        t = t.take(pa.array(sorted(range(t.num_rows), key=lambda i: (ids_[i] is None, 0 if ids_[i] is None else ids_[i], xxhash.xxh3_64_intdigest(texts[i])))))
        number = t.column("group")[0].as_py()
        ids = [np.append(x, np.int32(end)) for x in encoder(tokenizer)(t.column("text").to_pylist())]
        rows = [(d, s, n, q, i) for q, seq in enumerate(pack([len(x) for x in ids], length)) for i, (d, s, n) in enumerate(seq)]
        at = np.array([(d, s, n, q) for d, s, n, q, _ in rows], np.int64).reshape(-1, 4)
        run_ = np.cumsum(at[:, 2]) - at[:, 2]
        new = np.append(True, at[1:, 3] != at[:-1, 3]) if len(at) else np.zeros(0, bool)
        offset = run_ - np.maximum.accumulate(np.where(new, run_, 0))
        pieces = [ids[d][s : s + n] for d, s, n, _, _ in rows]
        flat = np.concatenate(pieces) if pieces else np.zeros(0, np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(at[:, 2])]).astype(np.int32)), pa.array(flat))
        whole = np.array([len(x) for x in ids], np.int64)
        return pa.table([t.column("id").take(pa.array(at[:, 0])), pa.array(at[:, 1]), pa.array(at[:, 2]), lists, pa.array(whole[at[:, 0]]), pa.array((number << 32) + at[:, 3]), pa.array(offset)], names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.groupBy("group").applyInArrow(run, f"id {kind}, start long, length long, ids array<int>, doc_tokens long, sequence_id long, offset long").withColumnRenamed("id", id_col)


@F.pandas_udf(LongType())
def ids_crc32(ids: pd.Series) -> pd.Series:
    """CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return ids.map(lambda x: zlib.crc32(np.ascontiguousarray(x, "<u4").tobytes()))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents")).select("doc_id", "start", "length", ids_crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
