"""Operator 1, suffix-array dedup: removes every byte covered by a byte string of a given length that also starts elsewhere.

`repeats` brings together the parts of texts that can share a long string; here a batch of such parts gets a suffix array by
two-stage sorting: only suffixes smaller than their successor are sorted directly, the others are induced by one scan over
first-byte buckets, and common prefixes of neighbours in the array show the repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from toolspark.llm import repeats
from toolspark.llm.common import read

LENGTH = 200
GRAM = 32


def _eight(data: np.ndarray) -> np.ndarray:
    """Big-endian integer of the eight bytes from each position on (zeros past the end)."""
    padded = np.zeros(len(data) + 8, np.uint64)
    padded[: len(data)] = data
    out = padded[:-8].copy()
    for i in range(1, 8):
        out <<= np.uint64(8)
        out |= padded[i : len(data) + i]
    return out


def sort_direct(starts: np.ndarray, eight: np.ndarray, depth: int) -> np.ndarray:
    """starts in the order of their first ``depth`` bytes, eight at a time; a group is sorted again only if it still differs."""
    n = len(eight)
    order = starts[np.argsort(eight[starts], kind="stable")]
    key = eight[order]
    same = np.zeros(len(order), bool)
    same[1:] = key[1:] == key[:-1]
    for d in range(8, depth, 8):
        tied = same.copy()
        tied[:-1] |= same[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group = np.cumsum(~same[at])
        key = eight[np.minimum(order[at] + d, n - 1)]
        head = np.searchsorted(group, group)
        unlike = key != key[head]
        if not unlike.any():
            continue
        mixed = np.zeros(group[-1] + 1, bool)
        mixed[group[unlike]] = True
        pick = mixed[group]
        sub, g, k = at[pick], group[pick], key[pick]
        by = np.lexsort((k, g))
        order[sub] = order[sub][by]
        g, k = g[by], k[by]
        same[sub[1:]] = (g[1:] == g[:-1]) & (k[1:] == k[:-1])
        same[sub[0]] = False
    return order


def suffix_array(pieces: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two-stage suffix array of all suffixes of at least ``depth`` bytes of the pieces, in order of their first ``depth`` bytes.

    Returns the array, the joined text (bytes plus one, zero after each piece; UTF-8 has no byte 255) and each piece's start."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    raw = np.frombuffer(b"\x00".join(pieces) + b"\x00", np.uint8)
    text = np.minimum(raw, 254) + np.uint8(1)
    text[starts + sizes] = 0
    n = len(text)
    # a suffix is small if the next different byte is larger; ends of pieces count as small
    change = np.sign(np.diff(text.astype(np.int16), append=0))
    at = np.where(change != 0, np.arange(n), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]
    small = change[at] > 0
    small[starts + sizes] = True
    # suffixes wanted, and those after them up to the next small one, from which the last large ones are induced
    need = np.zeros(n + 1, np.int64)
    wanted = np.maximum(sizes - depth + 1, 0)
    next_small = np.minimum.accumulate(np.where(small, np.arange(n), n - 1)[::-1])[::-1]
    end = next_small[np.minimum(starts + wanted, starts + sizes)]
    np.add.at(need, starts, 1)
    np.add.at(need, end + 1, -1)
    need = np.cumsum(need[:-1]) > 0
    first = np.zeros(n, bool)
    first[starts] = True
    direct = np.flatnonzero(need & small)
    ordered = sort_direct(direct, _eight(text), depth)
    heads = text[ordered]
    cuts = np.searchsorted(heads, np.arange(257))
    large = need & ~small
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []

    def induce(entries: np.ndarray, c: int) -> np.ndarray:
        """Hands the larger predecessors of finished entries to their buckets; returns those of the same bucket."""
        out.append(entries)
        before = entries[~first[entries]] - 1
        before = before[large[before]]
        if not len(before):
            return before
        heads = text[before]
        here = before[heads == c]
        other, heads = before[heads != c], heads[heads != c]
        if len(other):
            by = np.argsort(heads, kind="stable")
            other, heads = other[by], heads[by]
            edge = np.flatnonzero(np.diff(heads)) + 1
            for part, h in zip(np.split(other, edge), heads[np.concatenate([[0], edge])].tolist(), strict=True):
                waiting[h].append(part)
        return here

    for c in range(256):
        now = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        while len(now):
            now = induce(now, c)
        if cuts[c + 1] > cuts[c]:
            induce(ordered[cuts[c] : cuts[c + 1]], c)
    array = np.concatenate(out) if out else np.zeros(0, np.int64)
    piece = np.searchsorted(starts, array, "right") - 1
    return array[array - starts[piece] < wanted[piece]], text, starts


def common_prefixes(array: np.ndarray, text: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of each entry and the one before it (first: 0), counted up to ``depth``."""
    out = np.zeros(len(array), np.int64)
    eight = _eight(text)
    live = np.arange(1, len(array))
    for d in range(0, depth, 8):
        a, b = eight[np.minimum(array[live] + d, len(text) - 1)], eight[np.minimum(array[live - 1] + d, len(text) - 1)]
        equal = a == b
        apart = a[~equal] ^ b[~equal]
        bytes_equal = np.zeros(len(apart), np.int64)
        for i in range(1, 8):
            bytes_equal += (apart >> np.uint64(64 - 8 * i)) == 0
        out[live[~equal]] = np.minimum(d + bytes_equal, depth)
        live = live[equal]
    out[live] = depth
    return out


def repeated_runs(pieces: list[bytes], depth: int = LENGTH) -> Iterator[tuple[int, int, int]]:
    """(piece, first, last) runs of starts of strings of ``depth`` bytes that start twice or more in the pieces."""
    if not pieces:
        return
    array, text, starts = suffix_array(pieces, depth)
    long = common_prefixes(array, text, depth) >= depth
    long[:-1] |= long[1:]
    flags = np.zeros(len(text), bool)
    flags[array[long]] = True
    owner = np.searchsorted(starts, np.arange(len(text)), "right") - 1
    who, a, z = repeats.runs_of(flags, owner)
    yield from zip(who.tolist(), (a - starts[who]).tolist(), (z - starts[who]).tolist(), strict=True)


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = repeats.HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept (the remaining bytes; invalid UTF-8 left by a cut inside a character is replaced), kept_sha256.

    Null text: empty, nothing removed. Rows repeated with one id count as two places. An empty table gives an empty result. Ids are of any simple type;
    texts are read whole; other columns are not looked at. Contexts with equal 128-bit hashes within a k-gram are taken as equal."""
    texts = repeats.keyed(docs, id_col, text_col)
    small = repeats.shrunk(texts)
    spans = repeats.repeated_spans(repeats.anchors(texts, "byte", length, gram), small, "byte", length, gram, lambda p: repeated_runs(p, length), hot)

    def fn(text: bytes, spans: list[tuple[int, int]]) -> tuple:
        parts, at = [], 0
        for a, z in spans:
            parts.append(text[at:a])
            at = z
        kept = b"".join([*parts, text[at:]])
        return len(text), sum(z - a for a, z in spans), len(spans), kept.decode("utf-8", "replace"), hashlib.sha256(kept).hexdigest()

    kind = docs.schema[id_col].dataType.simpleString()
    return repeats.applied(small, spans, fn, ["n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"], f"id {kind}, n_bytes long, n_removed long, n_spans long, kept string, kept_sha256 string").withColumnRenamed("id", id_col)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
