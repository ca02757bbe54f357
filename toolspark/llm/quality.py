"""Operator 4, quality rules: gradient-boosted trees over document statistics after a few fixed rules.

The trees are fitted on a bounded sample of labelled documents (`SAMPLE` rows, least hashes of the id first), flattened to node
arrays and applied to whole batches of rows. More noise never raises the score: constraints hold on the features in `FALLING`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toolspark.llm import gbt
from toolspark.llm.common import SPACE, Chunk, block_hash, chunks, mix, read, refuse, word_codes, words

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SAMPLE = 20_000
THRESHOLD = 0.5
WINDOW = 5
#: fixed values: the characters that count as symbols
SYMBOLS = b"#*$%&|<>"
FEATURES = ["mean_word", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "digit_share", "punct_share", "distinct_share", "stop_share", "short_line_share", "log_words", "mark_share", "top_word_share"]
#: Features of noise, in which the score may only fall.
FALLING = ["symbols_per_word", "dup_line_share", "repeat_share", "mark_share"]
#: fixed values: frequent words of the four languages
STOP = "the of and to in is that it for was on are with as be by at this from der die das und ist von den zu mit sich des auf nicht ein eine le la les de des et un une que qui pour dans sur est pas el los las y en es por con una del se no su para".split()

_symbol = np.zeros(256, bool)
_symbol[list(SYMBOLS)] = True
_kinds = {"upper": np.zeros(256, bool), "digit": np.zeros(256, bool), "punct": np.zeros(256, bool), "mark": np.zeros(256, bool)}
_kinds["upper"][65:91] = True
_kinds["digit"][48:58] = True
_kinds["punct"][list(b".,;:")] = True
_kinds["mark"][list(b"!?#*$%&|<>@=_~^")] = True
_lead = np.ones(256, np.int64)
_lead[0x80:0xC0] = 0


def _stop_codes() -> np.ndarray:
    stop = [w.encode() for w in sorted(set(STOP) | {w.title() for w in STOP})]
    joined = b"".join(stop)
    ends = np.cumsum([len(w) for w in stop])
    return np.sort(block_hash(np.frombuffer(joined, np.uint8), ends - [len(w) for w in stop], ends))


_STOP = _stop_codes()


def _sums(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x) + 1, np.int64)
    np.cumsum(x, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(codes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For keys and their texts: whether the key is found twice or more in its text."""
    key = mix(codes + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = np.zeros(len(k), bool)
    same[1:] = k[1:] == k[:-1]
    any_ = same.copy()
    any_[:-1] |= same[1:]
    out = np.zeros((2, len(k)), bool)
    out[0, order] = any_
    out[1, order] = same  # not the first: the sort is stable
    return out


def statistics(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """BASE as integers and FEATURES as floats, a row for each text of the chunk."""
    n = len(c.offsets) - 1
    base, extra = np.zeros((n, len(BASE)), np.int64), np.zeros((n, len(FEATURES)))
    data, off = c.data, c.offsets
    starts, ends, first = words(c)
    n_words = np.diff(first)
    word_chars = _sums(_lead[data] * ~SPACE[data], off)
    n_symbols = _sums(_symbol[data], off)
    codes = word_codes(c, starts, ends)
    owner = np.repeat(np.arange(n), n_words)
    covered = np.zeros(len(codes) + 1, np.int64)
    if len(codes) >= WINDOW:
        at = np.flatnonzero(owner[: len(codes) - WINDOW + 1] == owner[WINDOW - 1 :])
        key = np.zeros(len(at), np.uint64)
        for d in range(WINDOW):
            key = mix(key * np.uint64(3) + codes[at + d])
        on = at[_repeats(key, owner[at])[0]]
        np.add.at(covered, on, 1)
        np.add.at(covered, on + WINDOW, -1)
    n_repeat = _sums(np.cumsum(covered)[:-1] > 0, first)
    # lines: cut at line feeds and ends of texts
    feeds = np.flatnonzero(data == 10)
    line_text = np.searchsorted(off[1:], feeds, "right")
    order = np.lexsort((np.concatenate([off[:-1], feeds + 1]), np.concatenate([np.arange(n), line_text])))
    line_start = np.concatenate([off[:-1], feeds + 1])[order]
    line_owner = np.concatenate([np.arange(n), line_text])[order]
    line_end = np.empty_like(line_start)
    line_end[:-1] = np.where(line_owner[1:] == line_owner[:-1], line_start[1:] - 1, off[line_owner[:-1] + 1])
    line_end[-1:] = off[-1:]
    words_in = np.searchsorted(starts, line_end) - np.searchsorted(starts, line_start)
    real = words_in > 0
    ls, le, lo, lw = line_start[real], line_end[real], line_owner[real], words_in[real]
    again = _repeats(block_hash(data, ls, le), lo)[1] if len(ls) else np.zeros(0, bool)
    n_dup = np.bincount(lo[again], minlength=n)
    n_lines = np.bincount(lo, minlength=n)
    base[:] = np.stack([n_words, word_chars, n_symbols, n_dup, n_repeat], 1)
    w = np.maximum(n_words, 1)
    size = np.maximum(word_chars, 1)
    _, seen = _repeats(codes, owner) if len(codes) else (None, np.zeros(0, bool))
    distinct = n_words - np.bincount(owner[seen], minlength=n)
    stop = np.bincount(owner[_STOP[np.minimum(np.searchsorted(_STOP, codes), len(_STOP) - 1)] == codes], minlength=n) if len(codes) else np.zeros(n)
    short = np.bincount(lo[lw <= 3], minlength=n)
    kinds = {k: _sums(v[data], off) / size for k, v in _kinds.items()}
    top = np.zeros(n)
    if len(codes):
        key = mix(codes + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, idx, cnt = np.unique(key, return_index=True, return_counts=True)
        np.maximum.at(top, owner[idx], cnt)
    extra[:] = np.stack([word_chars / w, n_symbols / w, n_dup / np.maximum(n_lines, 1), n_repeat / w, kinds["upper"], kinds["digit"], kinds["punct"], distinct / w, stop / w, short / np.maximum(n_lines, 1), np.log1p(n_words), kinds["mark"], top / w], 1)
    return base, extra


def base_failed(base: np.ndarray) -> np.ndarray:
    """The fixed rules: under ten words, or over a fifth of the words in repeated windows of five."""
    return (base[:, 0] < 10) | (100 * base[:, 4] > 20 * base[:, 0])


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of up to ``sample`` labelled documents; which ones depends on ids alone, so refits agree."""
    pick = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)
    # the labelled ids are bounded by sample, and so is what each id contributes: its text of least hash, combined before the shuffle
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(pick), "id")
    rows = rows.groupBy("id").agg(F.max("y").alias("y"), F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("id", "y", "t.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [np.concatenate([base, extra], 1) for c in chunks(b.column("text")) for base, extra in [statistics(c)]]
            x = np.concatenate(parts) if parts else np.zeros((0, len(BASE) + len(FEATURES)))
            yield pa.RecordBatch.from_arrays([b.column("id").cast(pa.string()), b.column("y").cast(pa.float64()), pa.array(list(x), pa.list_(pa.float64()))], ["id", "y", "x"])

    got = rows.mapInArrow(run, "id string, y double, x array<double>").toPandas().sort_values("id", kind="stable")
    if not len(got):
        return np.zeros((0, len(FEATURES))), np.zeros(0)
    x = np.array(got["x"].tolist())
    keep = ~base_failed(x[:, : len(BASE)])
    return x[keep, len(BASE) :], got["y"].to_numpy()[keep]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> gbt.Trees:
    """Trees for label 1 (good). Rows that the fixed rules reject are not learned from; no labels: every row is good. An id labelled more than once has
    its largest label, one found on several documents gives the text of least hash; null ids, labels and texts are not learned from."""
    x, y = labelled(docs, labels, id_col, text_col, label_col, sample)
    return gbt.fit(x, y, {FEATURES.index(f): -1 for f in FALLING}) if len(y) else gbt.fit(np.zeros((0, len(FEATURES))), np.zeros(0))


def assess(docs: DataFrame, model: gbt.Trees | None, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """docs with a struct column ``quality_``: BASE, base_failed, score (probability of good), kept.

    Null and empty texts: no words, so the fixed rules reject them. Rows are judged one by one, so repeated rows and ties get equal results and an empty
    table gives an empty one; texts are read whole. All other columns pass through unchanged; a column named ``quality_`` is refused."""
    refuse(docs, "quality_")
    fields = ", ".join(f"{c}: long" for c in BASE) + ", base_failed: boolean, score: double, kept: boolean"
    @F.pandas_udf(f"struct<{fields}>".replace(": ", ":"))
    def quality(text: pd.Series) -> pd.DataFrame:
        parts = [statistics(c) for c in chunks(pa.array(text, pa.string(), from_pandas=True))]
        base = np.concatenate([p[0] for p in parts]) if parts else np.zeros((0, len(BASE)), np.int64)
        extra = np.concatenate([p[1] for p in parts]) if parts else np.zeros((0, len(FEATURES)))
        failed = base_failed(base)
        score = model.probability(extra) if model is not None and len(model.roots) else np.ones(len(base))
        out = pd.DataFrame(base, columns=BASE)
        return out.assign(base_failed=failed, score=score, kept=~failed & (score >= threshold))

    return docs.withColumn("quality_", quality(F.col(text_col)))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs, read(spark, sf_dir, "labels"))
    return assess(docs.select("doc_id", "text"), model).select("doc_id", *[f"quality_.{c}" for c in [*BASE, "base_failed", "kept", "score"]])
