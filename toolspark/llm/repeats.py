"""Which windows of a fixed number of symbols start more than once in a corpus, without a row for each window.

A window (200 bytes, 35 words, ...) is assigned to the symbol at which the least hash of its k-grams sits (the last such, on
ties). Equal windows have equal least k-grams at equal offsets, so a window can only repeat if its k-gram is chosen twice. The plan:

1. `anchors`: one row for each chosen k-gram and the run of window starts that chose it, about 2 in (window - k) symbols, with a 128-bit
   hash of the context, the symbols which that run of windows spans.
2. `survivors`: anchors whose k-gram is chosen twice or more. Where all its contexts are alike, all its windows repeat: such anchors
   need no text. The others are mixed. (A caller may have left out anchors by an estimate that is never too low.)
3. mixed contexts are counted by k-gram and hash; for one row of each the text is cut out of the documents.
4. these texts meet by k-gram; an exact grouping of the windows in them (suffix array, window table) finds repeats.
   A context with two rows repeats as a whole. A k-gram with more than HOT different contexts is not gathered: its texts are searched
   as a corpus of their own with a longer k-gram, and so on up to the whole window, of which there is one context only.
5. runs of repeated windows go back to the anchors by k-gram and hash and to the documents by row key.

No step gathers a key's rows in one task: counts combine before the shuffle, and joins to anchors have few rows for each key on the
other side, which adaptive execution can split. What is read twice is written to the shared folder, so a lost executor costs a step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolspark.llm.common import BYTE_CODE, Chunk, chunks, mix, powers, row_key, span_hash, word_codes, words, written

#: Different contexts of a k-gram that are grouped in one task: about as many as give a suffix array of some tens of MB.
HOT = 1024
#: How far a crowded k-gram is lengthened each time: by this share of what is left up to the window.
LONGER = 0.5
_POS = 24
_LOW = np.uint64((1 << _POS) - 1)


def choose(codes: np.ndarray, bounds: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all windows inside the texts given by bounds: the k-gram hash of each run of windows that chose the same
    position, and the run's first and last window start."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = 1 << 22
    for a in range(0, max(0, len(codes) - window + 1), step):
        part = codes[a : a + step + window - 1]
        n = len(part) - k + 1
        up, down = powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=total[1:])
        grams = mix((total[k:] - total[:n]) * down[:n])
        least = (grams & ~_LOW) | (_LOW - np.arange(n, dtype=np.uint64))
        width, have = window - k + 1, 1
        while have < width:
            go = min(have, width - have)
            least = np.minimum(least[:-go], least[go:])
            have += go
        at = (_LOW - (least & _LOW)).astype(np.int64)
        starts = np.arange(len(at))
        text = np.searchsorted(bounds, starts + a, "right")
        inside = starts + a + window <= bounds[np.minimum(text, len(bounds) - 1)]
        starts, at = starts[inside], at[inside]
        if not len(starts):
            continue
        new = np.ones(len(starts), bool)
        new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(starts)) - 1
        out.append((grams[at[first]], starts[first] + a, starts[last] + a))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def symbols(chunk: Chunk, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the chunk's bytes or words and the bounds of its texts in them."""
    if unit == "byte":
        return BYTE_CODE[chunk.data], chunk.offsets
    starts, ends, first = words(chunk)
    return word_codes(chunk, starts, ends), first


def anchors(texts: DataFrame, unit: str, window: int, k: int) -> DataFrame:
    """texts(rid, did, text) -> one row (rid, did, gram, context, more, lo, n) for each run of n windows; context and more are its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rid, did = (b.column(c).to_numpy(zero_copy_only=False) for c in ("rid", "did"))
            for c in chunks(b.column("text")):
                codes, bounds = symbols(c, unit)
                gram, lo, hi = choose(codes, bounds, window, k)
                context, more = span_hash(codes, lo, hi + window), span_hash(mix(codes + np.uint64(1)), lo, hi + window)
                row = np.searchsorted(bounds, lo, "right") - 1
                cols = (rid[c.first + row], did[c.first + row], gram.view(np.int64), context.view(np.int64), more.view(np.int64), (lo - bounds[row]), (hi - lo + 1).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["rid", "did", "gram", "context", "more", "lo", "n"])

    return texts.select("rid", "did", "text").mapInArrow(run, "rid long, did long, gram long, context long, more long, lo long, n int")


def turned(name: str) -> Column:
    """A key as distinct as the column. A join of counts on it deals them out once more, and then a task with a hot key can be split."""
    return F.col(name).bitwiseXOR(F.lit(1))


def survivors(found: DataFrame, hot: int = HOT) -> DataFrame:
    """Anchors whose k-gram occurs twice or more, with mixed (its contexts differ) and many (it occurs more than ``hot`` times)."""
    often = found.groupBy("gram").agg(F.count("*").alias("c"), *[f(x).alias(f"{f.__name__}_{x}") for x in ("context", "more") for f in (F.min, F.max)]).where("c > 1")
    often = often.select(turned("gram").alias("key"), ((F.col("min_context") != F.col("max_context")) | (F.col("min_more") != F.col("max_more"))).alias("mixed"), (F.col("c") > hot).alias("many"))
    return written(found.withColumn("key", turned("gram")).join(often, "key").drop("key"), "anchors")


def shrunk(texts: DataFrame) -> DataFrame:
    """texts(rid, did, id, text) -> (rid, did, id, z): rows with their texts compressed, for shuffles. The keys are never null; saying so keeps both joins to this on one exchange."""
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3, write_content_size=True).compress
        for b in batches:
            for c in chunks(b.column("text"), 4 << 20):
                part = b.slice(c.first, c.last - c.first)
                yield pa.RecordBatch.from_arrays([part.column("rid"), part.column("did"), part.column("id"), pa.array([pack(t) for t in c.texts()], pa.binary())], ["rid", "did", "id", "z"])

    return texts.select("rid", "did", "id", "text").mapInArrow(run, f"rid long, did long, id {kind}, z binary").where("rid is not null and did is not null")


def pieces(chosen: DataFrame, small: DataFrame, unit: str, window: int) -> DataFrame:
    """chosen(rid, did, gram, context, more, lo, n, whole, crowded) -> (gram, context, more, whole, crowded, piece). Alike rows of small give a piece again."""
    names = ["gram", "context", "more", "whole", "crowded"]
    both = small.join(chosen.groupBy("rid", "did").agg(F.collect_list(F.struct(*names, "lo", "n")).alias("runs")), ["rid", "did"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            runs, z = b.column("runs"), b.column("z")
            at, flat = runs.offsets.to_numpy(), runs.values
            lo, n = flat.field(5).to_numpy(), flat.field(6).to_numpy()
            i = 0
            while i < b.num_rows:
                out: list[bytes] = []
                first, size = at[i], 0
                while i < b.num_rows and size < 4 << 20:
                    text = unpack(z[i].as_py())
                    if unit == "word":
                        text = text.split()
                    p = slice(at[i], at[i + 1])
                    new = [text[x : x + m + window - 1] if unit == "byte" else b" ".join(text[x : x + m + window - 1]) for x, m in zip(lo[p].tolist(), n[p].tolist(), strict=True)]
                    out += new
                    size += sum(map(len, new))
                    i += 1
                part = flat.slice(first, at[i] - first)
                yield pa.RecordBatch.from_arrays([*[part.field(k) for k in range(5)], pa.array(out, pa.binary())], [*names, "piece"])

    return both.mapInArrow(cut, "gram long, context long, more long, whole boolean, crowded boolean, piece binary")


def runs_of(flags: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true flags within one owner: owner, first index, last index."""
    on = np.flatnonzero(flags)
    if not len(on):
        return on, on, on
    new = np.ones(len(on), bool)
    new[1:] = (on[1:] != on[:-1] + 1) | (owner[on[1:]] != owner[on[:-1]])
    first = np.flatnonzero(new)
    return owner[on[first]], on[first], on[np.append(first[1:], len(on)) - 1]


def grouped(cut: DataFrame, exact: Callable[[list[bytes]], Iterator[tuple[int, int, int]]], most: int = 2 << 20) -> DataFrame:
    """Pieces meet by k-gram; exact(pieces) yields (piece, first, last) runs of repeated windows. Whole k-grams are handed over.

    -> (gram, context, more, first, last) for the pieces that do not repeat as a whole."""
    key = ["gram", "context", "more"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[tuple[int, int, int, bool]] = []
        texts: list[bytes] = []
        size, last = 0, None

        def flush() -> pa.RecordBatch:
            rows = [(*keys[c][:3], a, z) for c, a, z in exact(texts) if not keys[c][3]] if texts else []
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], [*key, "first", "last"])

        for t in batches:
            for *k, whole, piece in zip(*[t.column(x).to_pylist() for x in (*key, "whole", "piece")], strict=True):
                if k == last:
                    continue
                if last is not None and k[0] != last[0] and size >= most:
                    yield flush()
                    keys, texts, size = [], [], 0
                last = k
                keys.append((*k, whole))
                texts.append(piece)
                size += len(piece)
        yield flush()

    return cut.repartition("gram").sortWithinPartitions(*key).mapInArrow(run, "gram long, context long, more long, first long, last long")


def repeated_spans(found: DataFrame, small: DataFrame, unit: str, window: int, k: int, exact, hot: int = HOT) -> DataFrame:
    """found: anchors by k-grams; small: rows of `shrunk`. -> (rid, did, spans array<struct<a,z>>): symbol ranges covered by repeated windows; they may overlap."""
    key = ["gram", "context", "more"]
    left = survivors(found, hot)
    mixed = left.where("mixed and gram is not null and context is not null and more is not null")
    one = mixed.groupBy(*key).agg(F.min(F.struct("rid", "did", "lo", "n")).alias("r"), (F.count("*") > 1).alias("whole"))
    crowded = mixed.where("many").select(*key).distinct().groupBy("gram").count().where(F.col("count") > hot).select("gram")
    crowded = written(crowded, "crowded")
    chosen = one.select(*key, "whole", "r.rid", "r.did", "r.lo", "r.n")
    if crowded.isEmpty():
        runs = grouped(pieces(chosen.withColumn("crowded", F.lit(False)), small, unit, window), exact)
    else:
        marked = chosen.join(crowded.withColumn("crowded", F.lit(True)), "gram", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
        cut = written(pieces(marked, small, unit, window), "pieces")
        runs = grouped(cut.where("not crowded"), exact)
        longer = min(window, k + max(1, round((window - k) * LONGER)))
        corpus = cut.where("crowded").select(F.xxhash64(*key).alias("rid"), F.xxhash64(F.lit(2), *key).alias("did"), F.col("piece").alias("text"), F.col("whole").alias("id"), *key).dropDuplicates(["rid", "did"])
        corpus = written(corpus, "corpus")
        again = repeated_spans(anchors(corpus, unit, window, longer), shrunk(corpus), unit, window, longer, exact, hot)
        back = corpus.where("not id").select("rid", "did", *key).join(again, ["rid", "did"]).select(*key, F.explode("spans").alias("s"))
        runs = runs.unionByName(back.select(*key, F.col("s.a").alias("first"), (F.col("s.z") - window).alias("last")))
    runs = runs.unionByName(one.where("whole").select(*key, F.lit(0).cast("long").alias("first"), (F.col("r.n") - 1).cast("long").alias("last")))
    spans = mixed.select("rid", "did", *key, "lo").join(runs, key).select("rid", "did", (F.col("lo") + F.col("first")).alias("a"), (F.col("lo") + F.col("last") + window).alias("z"))
    spans = spans.unionByName(left.where("not mixed").select("rid", "did", F.col("lo").alias("a"), (F.col("lo") + F.col("n") - 1 + window).alias("z")))
    # alike rows have their spans in common
    return spans.groupBy("rid", "did").agg(F.collect_set(F.struct("a", "z")).alias("spans"))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(*row_key(id_col, text_col), F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def merged(spans: np.ndarray) -> list[tuple[int, int]]:
    """Sorted maximal runs of a list of possibly overlapping or touching (a, z) ranges."""
    if not len(spans):
        return []
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.ones(len(spans), bool)
    new[1:] = spans[1:, 0] > reach[:-1]
    first = np.flatnonzero(new)
    return list(zip(spans[first, 0].tolist(), reach[np.append(first[1:], len(spans)) - 1].tolist(), strict=True))


def applied(small: DataFrame, spans: DataFrame, fn: Callable[[bytes, list[tuple[int, int]]], tuple], names: list[str], schema: str) -> DataFrame:
    """Calls fn(text, merged spans) on every row; schema describes id and fn's fields."""
    both = small.join(spans, ["rid", "did"], "left")
    types = [pa.string() if t.split()[-1] == "string" else pa.int64() for t in schema.split(",")][1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            col, z = b.column("spans"), b.column("z")
            at, flat = col.offsets.to_numpy(), col.values
            az = np.stack([flat.field(0).to_numpy(), flat.field(1).to_numpy()], 1) if len(flat) else np.zeros((0, 2), np.int64)
            i = 0
            while i < b.num_rows:
                first, rows, size = i, [], 0
                while i < b.num_rows and size < 8 << 20:
                    text = unpack(z[i].as_py())
                    rows.append(fn(text, merged(az[at[i] : at[i + 1]])))
                    size += len(text)
                    i += 1
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([b.column("id").slice(first, i - first), *[pa.array(list(c), t) for c, t in zip(cols, types, strict=True)]], ["id", *names])

    return both.mapInArrow(run, schema)
