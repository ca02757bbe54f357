"""Operator 10, document fingerprints: an improbable-feature digest.

Every window of 32 bytes gets a rank by how rare its entropy is in running text. In each run of windows the rarest is picked,
and a window picked often enough by runs that hold it is a feature. Features go into Bloom filters of 256 bytes, a new one chained on
when the last is full. Two digests are compared filter by filter by the bits they share beyond chance.
A text is framed by zero bytes, so short texts have windows too. Where no window is picked often enough, all distinct windows of a short
text are its features; of a longer one, those of least hash in each run. So only empty texts have none.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toolspark.llm.common import BYTE_CODE, mix, powers, read, row_key

WINDOW = 32
RUN = 32
PICKED = 10
BITS = 2048
FULL = 160
HASHES = 5
#: Bits of entropy of a window of running text, and below which a window says nothing.
USUAL, LEAST = 3.75, 2.4
#: Bytes of text in a range of ids that one task works through in order, and the most such ranges; beyond, ranges grow.
RANGE, MAX_RANGES = 16 << 20, 20_000

_g = np.concatenate([[0.0], np.arange(1, WINDOW + 1) * np.log2(np.arange(1, WINDOW + 1))])
_GAIN = np.round(np.diff(_g) * (1 << 20)).astype(np.int64)


def entropies(data: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Entropy in bits of every window of data: a running sum of what each byte adds on entering and takes on leaving."""
    n = len(data)
    ahead = np.zeros(n, np.uint8)
    behind = np.zeros(n, np.uint8)
    for d in range(1, window):
        same = data[d:] == data[:-d]
        behind[d:] += same
        ahead[:-d] += same
    enter, leave = np.cumsum(_GAIN[behind]), np.cumsum(_GAIN[ahead])
    total = enter[window - 1 :].copy()
    total[1:] -= leave[: n - window]
    return np.log2(window) - total / (window * float(1 << 20))


def features(texts: list[bytes], window: int = WINDOW, run: int = RUN, picked: int = PICKED) -> list[np.ndarray]:
    """64-bit hashes of the features of each text, in order."""
    frame = bytes(window - 1)
    data = np.frombuffer(frame + frame.join(texts) + frame, np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes + window - 1)[:-1]])  # first window with a byte of the text
    count = np.where(sizes > 0, sizes + window - 1, 0)
    e = entropies(data, window)
    n = len(e)
    rare = np.round(np.abs(e - USUAL) * 4096).astype(np.int64)
    rank = np.where(e < LEAST, 1 << 15, (1 << 15) - 1 - np.minimum(rare, (1 << 15) - 1))
    key = (rank.astype(np.uint64) << np.uint64(40)) | np.arange(n, dtype=np.uint64)
    least, have = key, 1
    while have < run and len(least) > 1:
        go = min(have, run - have)
        least = np.minimum(least[:-go], least[go:])
        have += go
    at = (least & np.uint64((1 << 40) - 1)).astype(np.int64)
    owner = np.searchsorted(first, np.arange(len(at)), "right") - 1
    # texts of no bytes share their start with the next text
    inside = np.arange(len(at)) + run <= first[owner] + count[owner]
    pos = np.flatnonzero(inside)
    if not len(pos):
        return [np.zeros(0, np.uint64) for _ in texts]
    a, o = at[pos], owner[pos]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (o[1:] != o[:-1])
    start = np.flatnonzero(new)
    length = np.diff(np.append(start, len(a)))
    only = np.bincount(o[start], minlength=len(texts)) == 1
    keep = (length >= picked) | only[o[start]]
    a, o = a[start[keep]], o[start[keep]]
    codes = BYTE_CODE[data]
    up, down = powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[: len(codes)], out=total[1:])
    hashes = mix((total[a + window] - total[a]) * down[a])
    cuts = np.searchsorted(o, np.arange(len(texts) + 1))
    out = [hashes[cuts[i] : cuts[i + 1]] for i in range(len(texts))]
    for i in np.flatnonzero((np.diff(cuts) == 0) & (count > 0)).tolist():
        b = np.arange(first[i], first[i] + count[i])
        out[i] = plain_features(mix((total[b + window] - total[b]) * down[b]), run)
    return out


def plain_features(hashes: np.ndarray, run: int = RUN) -> np.ndarray:
    """Distinct hashes of a text's windows in order; where they do not fit a filter, the least of each run."""
    if len(hashes) > FULL:
        at = np.unique(np.lib.stride_tricks.sliding_window_view(hashes, run).argmin(1) + np.arange(len(hashes) - run + 1))
        hashes = hashes[at]
    _, at = np.unique(hashes, return_index=True)
    return hashes[np.sort(at)]


def filters(hashes: np.ndarray, full: int = FULL) -> np.ndarray:
    """Chained Bloom filters, a row of bytes for each."""
    n = max(1, -(-len(hashes) // full))
    bits = np.zeros((n, BITS), np.uint8)
    row = np.arange(len(hashes)) // full
    for i in range(HASHES):
        bits[row, ((hashes >> np.uint64(11 * i)) & np.uint64(BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1)


def digest(chain: np.ndarray, size: int) -> str:
    """Number of features, then the filters in base 64; no features: '0'."""
    return f"{size}:{base64.b64encode(chain.tobytes()).decode()}" if size else "0"


def from_digest(text: str) -> tuple[np.ndarray, int]:
    size, _, rest = text.partition(":")
    return (np.frombuffer(base64.b64decode(rest), np.uint8).reshape(-1, BITS // 8) if rest else np.zeros((1, BITS // 8), np.uint8)), int(size)


def likeness(a: tuple[np.ndarray, int], b: tuple[np.ndarray, int]) -> float:
    """0 to 1. Each filter of the digest with fewer features meets its best match in the other; shared bits count beyond what
    chance would share, up to all bits of the sparser filter. Digests without features are like each other (1) and nothing else (0)."""
    if not a[1] or not b[1]:
        return float(a[1] == b[1])
    if (a[1], a[0].tobytes()) > (b[1], b[0].tobytes()):
        a, b = b, a
    x, y = a[0], b[0]
    px, py = np.bitwise_count(x).sum(1).astype(float), np.bitwise_count(y).sum(1).astype(float)
    total = weight = 0.0
    for i in range(len(x)):
        shared = np.bitwise_count(x[i] & y).sum(1)
        chance = px[i] * py / BITS
        most = np.minimum(px[i], py)
        score = np.clip((shared - chance) / np.maximum(most - chance, 1e-9), 0, 1)
        total += px[i] * score.max()
        weight += px[i]
    return float(total / weight)


def chains(texts: list[bytes]) -> list[tuple[np.ndarray, int]]:
    return [(filters(h), len(h)) for h in features(texts)]


class Ranges:
    """Numbers ranges of rows in the order of id (nulls first), then of the row's hash: between cuts of ids, and, where an id or null is so frequent
    that it makes several cuts, by equal shares of the hashes."""

    def __init__(self, cuts: list[int], nulls: int) -> None:
        self.cuts, times = np.unique(np.array(cuts, np.int64), return_counts=True)
        self.times, self.nulls = np.where(times > 1, times, 0), max(1, nulls)
        # ranges before a cut's own: nulls, and for each earlier cut its own and the one behind it
        self.base = self.nulls + 1 + np.concatenate([[0], np.cumsum(self.times + 1)])

    def of(self, ids: np.ndarray, null: np.ndarray, rid: np.ndarray) -> np.ndarray:
        share = (rid.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(np.float64) / 2.0**64
        out = np.zeros(len(ids), np.int64)
        out[:] = np.minimum(share * self.nulls, self.nulls - 1)
        behind = np.searchsorted(self.cuts, ids, "right")
        at = np.maximum(behind - 1, 0)
        own = (behind > 0) & (self.cuts[at] == ids) & (self.times[at] > 0) if len(self.cuts) else np.zeros(len(ids), bool)
        times = self.times[at] if len(self.cuts) else np.zeros(len(ids), np.int64)
        place = np.where(own, self.base[at] + np.minimum(share * times, times - 1).astype(np.int64), self.base[behind] - 1)
        return np.where(null, out, place)


def with_next(docs: DataFrame, fn, schema: str, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE) -> DataFrame:
    """Calls fn(list of (id, text, next text)) -> RecordBatch over all rows by ascending id; the last row's next is the first row.

    Rows are dealt into ranges of ids and each range works in order; the first row of a range is also sent to the range before it.
    Ties in id go by a hash of the row. Null ids come first. A range's bounds and first row are all the driver holds of it."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col)[0].alias("rid"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = F.octet_length("text") + 64
    total, null_bytes = (x or 0 for x in rows.agg(F.sum(size), F.sum(F.when(F.col("id").isNull(), size))).first())
    n = int(min(MAX_RANGES, max(1, -(-total // range_bytes))))
    cuts = rows.agg(F.percentile_approx("id", [i / n for i in range(1, n)], max(10_000, 20 * n))).first()[0] or [] if n > 1 else []
    ranges = Ranges(cuts, round(n * null_bytes / total) if total else 1)

    def numbered(ids: np.ndarray, null: np.ndarray, rid: np.ndarray) -> np.ndarray:
        return ranges.of(ids, null, rid)

    @F.pandas_udf("long")
    def place(x, null, rid):
        import pandas as pd

        return pd.Series(numbered(x.to_numpy(np.int64), null.to_numpy(bool), rid.to_numpy(np.int64)))

    where_ = place(F.coalesce("id", F.lit(0)).cast("long"), F.col("id").isNull(), "rid")
    heads = sorted(rows.select("id", "rid").groupBy(where_.alias("range")).agg(F.min(F.struct(F.col("id").isNotNull().alias("some"), "id", "rid")).alias("head")).collect())
    names = [r["range"] for r in heads]
    sent = {}
    for i, r in enumerate(heads):
        sent.setdefault((r.head.id, r.head.rid), []).append(names[i - 1])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("id")
            x = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            where = numbered(x, ids.is_null().to_numpy(zero_copy_only=False), b.column("rid").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(np.zeros(len(x), np.int32)), ids, b.column("rid"), b.column("text")], ["range", "tail", "id", "rid", "text"])
            pairs = zip(ids.to_pylist(), b.column("rid").to_pylist(), strict=True)
            more = [(i, to) for i, k in enumerate(pairs) for to in sent.get(k, ())]
            if more:
                at = pa.array([i for i, _ in more])
                yield pa.RecordBatch.from_arrays([pa.array([to for _, to in more], pa.int64()), pa.array(np.ones(len(more), np.int32)), ids.take(at), b.column("rid").take(at), b.column("text").take(at)], ["range", "tail", "id", "rid", "text"])

    dealt = rows.mapInArrow(deal, f"range long, tail int, id {kind}, rid long, text string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, todo, size = None, [], 0
        for b in batches:
            for row in zip(*[b.column(c).to_pylist() for c in ("range", "tail", "id", "text")], strict=True):
                if last is not None and last[0] == row[0]:
                    todo.append((last[2], last[3], row[3]))
                    size += len(last[3])
                    if size > 1 << 20:
                        yield fn(todo)
                        todo, size = [], 0
                    last = None if row[1] else row
                elif not row[1]:
                    last = row
        if todo:
            yield fn(todo)

    return dealt.repartition("range").sortWithinPartitions("range", "tail", F.col("id").asc_nulls_first(), "rid").mapInArrow(run, schema)


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the next document."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE) -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; ids are integers. Null text: empty.

    Ties in id are ordered by a hash of the row, null ids come first; a frequent id is spread over ranges, rows alike in id and text stay together.
    A table of one row has itself as next row; an empty table gives an empty result. Texts are read whole; other columns are not looked at."""
    kind = docs.schema[id_col].dataType.simpleString()

    def fn(rows: list[tuple]) -> pa.RecordBatch:
        own = [t.encode() for _, t, _ in rows]
        # the next of a row is mostly the row that follows
        extra = [i for i in range(len(rows)) if i + 1 == len(rows) or rows[i][2] is not rows[i + 1][1]]
        all_ = chains(own + [rows[i][2].encode() for i in extra])
        following = {i: all_[len(rows) + k] for k, i in enumerate(extra)}
        changed = [edited(t, f).encode() for _, t, f in rows]
        other = chains(changed)
        cols = [
            pa.array([r[0] for r in rows], {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.int64())),
            pa.array([len(r[1]) for r in rows], pa.int64()),
            pa.array([hashlib.sha256(c).hexdigest() for c in changed]),
            pa.array([digest(*all_[i]) for i in range(len(rows))]),
            pa.array([digest(*c) for c in other]),
            pa.array([likeness(all_[i], other[i]) for i in range(len(rows))]),
            pa.array([likeness(all_[i], following[i] if i in following else all_[i + 1]) for i in range(len(rows))]),
        ]
        return pa.RecordBatch.from_arrays(cols, ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return with_next(docs, fn, f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double", id_col, text_col, range_bytes).withColumnRenamed("id", id_col)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))
