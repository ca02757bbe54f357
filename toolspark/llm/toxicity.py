"""Operator 6, toxicity: a classifier chain of linear models.

Categories are predicted one after the other; each model sees the words of a document and the probabilities of the categories before
it. While training, those are out-of-fold: made by models that did not see the document. Words are features chosen by their chi-square in
the training sample (`SAMPLE` labelled rows at most, least hashes of the id first); a document has a word or has it not, wherever it stands.

Labels tell toxic or not, no kind of toxicity. The earlier categories are the kinds that the toxic rows of the sample fall into: clusters by the
words they have in common, largest first. The last category is the label itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toolspark.llm.common import BYTE_CODE, Chunk, chunks, read, span_hash, written

SAMPLE = 12_000
WORDS = 768
FOLDS = 5
RIDGE = 0.1
#: Bytes of the beginnings of words that are features beside whole words.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Least chi-square of a feature (one degree of freedom, p = 0.0001).
CHI = 15.1
THRESHOLD = 0.3
#: Kinds of toxic documents, the chain's earlier categories.
KINDS = 3

_letter = np.zeros(256, bool)
_letter[65:91] = _letter[97:123] = _letter[0x80:] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def letters(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all runs of letters (A-Z as a-z) and of their beginnings, by text, and the text of each code."""
    data, n = _lower[c.data], len(c.data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    solid = _letter[data]
    edge = np.zeros(n + 1, bool)
    edge[c.offsets] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:-1]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | edge[1:-1]
    a, z = np.flatnonzero(start), np.flatnonzero(end) + 1
    owner = np.searchsorted(c.offsets[1:], a, "right")
    codes = BYTE_CODE[data]
    parts = [(span_hash(codes, a, z), owner)]
    for size in BEGINNINGS:
        longer = z - a > size
        parts.append((~span_hash(codes, a[longer], a[longer] + size), owner[longer]))
    found, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(owner, kind="stable")
    return found[order], owner[order]


def present(codes: np.ndarray, owner: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs for the codes found in ``known`` (sorted)."""
    if not len(known) or not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    hit = known[at] == codes
    pair = np.unique(owner[hit] * len(known) + at[hit])
    return pair // len(known), pair % len(known)


@dataclass
class Chain:
    names: list[str]
    known: np.ndarray  # word codes, sorted
    words: np.ndarray  # a row of weights for each category
    earlier: np.ndarray  # weights of earlier categories' probabilities
    bias: np.ndarray

    def probabilities(self, row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, len(self.names)))
        for k in range(len(self.names)):
            z = self.bias[k] + np.bincount(row, self.words[k][feature], n) + out[:, :k] @ self.earlier[k, :k]
            out[:, k] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return out


def logistic(row: np.ndarray, feature: np.ndarray, n: int, m: int, extra: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 150) -> np.ndarray:
    """Ridge logistic regression on sparse 0/1 features and dense extra columns: weights, extra weights, bias. Accelerated gradient steps."""
    size = m + extra.shape[1] + 1
    w, look = np.zeros(size), np.zeros(size)
    w[-1] = look[-1] = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    # columns are scaled by their share of rows so that steps fit frequent and rare features alike; the step is safe for the largest eigenvalue
    count = np.concatenate([np.bincount(feature, minlength=m), (extra**2).sum(0), [n]])
    scale = 1 / np.sqrt(count + 1.0)
    times = lambda v: np.bincount(row, v[feature], n) + extra @ v[m:-1] + v[-1]
    back = lambda r: np.concatenate([np.bincount(feature, r[row], m), extra.T @ r, [r.sum()]])
    v = np.ones(size)
    for _ in range(20):
        u = scale * back(times(scale * v))
        top = np.linalg.norm(u) / np.linalg.norm(v)
        v = u / np.linalg.norm(u)
    step = scale**2 / (0.25 * 1.1 * top + ridge * scale.max() ** 2)
    penalty = np.append(np.full(size - 1, ridge), 0.0)
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(times(look), -40, 40)))
        new = look - step * (back(p - y) + penalty * look)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        look = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return w


def fit_rows(row: np.ndarray, feature: np.ndarray, known: np.ndarray, labels: np.ndarray, names: list[str], folds: int = FOLDS) -> Chain:
    """row, feature: which document has which known feature; labels: a column for each category in order."""
    n = len(labels)
    m, k_all = len(known), labels.shape[1]
    fold = np.arange(n) % folds
    oof = np.zeros((n, k_all))
    out = Chain(names, known, np.zeros((k_all, m)), np.zeros((k_all, k_all)), np.zeros(k_all))
    for k in range(k_all):
        y, extra = labels[:, k].astype(float), oof[:, :k]
        for f in range(folds if k + 1 < k_all else 0):
            train = np.flatnonzero(fold != f)
            place = np.full(n, -1)
            place[train] = np.arange(len(train))
            use = place[row] >= 0
            w = logistic(place[row[use]], feature[use], len(train), m, extra[train], y[train])
            z = np.bincount(row, w[:m][feature], n) + extra @ w[m:-1] + w[-1]
            test = fold == f
            oof[test, k] = 1 / (1 + np.exp(-np.clip(z[test], -40, 40)))
        w = logistic(row, feature, n, m, extra, y)
        out.words[k], out.earlier[k, :k], out.bias[k] = w[:m], w[m:-1], w[-1]
    return out


def kinds(row: np.ndarray, feature: np.ndarray, n: int, m: int, toxic: np.ndarray, k: int = KINDS, steps: int = 20) -> np.ndarray:
    """A column for each of k kinds of the toxic rows, largest first: spherical k-means over their words, rarer words counting more. The first
    centre is the row nearest to the mean, each further one the row least like those before, so refits agree. Rows of no known word are of no kind."""
    out = np.zeros((n, k), bool)
    rows = np.flatnonzero(toxic)
    if not len(rows) or not m:
        return out
    place = np.full(n, -1)
    place[rows] = np.arange(len(rows))
    own = place[row] >= 0
    r, f = place[row[own]], feature[own]
    rare = np.log(1 + len(rows) / np.maximum(np.bincount(f, minlength=m), 1))
    norm = np.sqrt(np.bincount(r, rare[f] ** 2, len(rows)))
    value = rare[f] / np.maximum(norm[r], 1e-12)
    times = lambda centre: np.bincount(r, value * centre[f], len(rows))
    some = np.flatnonzero(norm > 0)
    if not len(some):
        return out
    seed = some[int(np.argmax(times(np.bincount(f, value, m))[some]))]
    centres, near = [], np.full(len(rows), -np.inf)
    for _ in range(k):
        centre = np.bincount(f[r == seed], value[r == seed], m)
        centres.append(centre)
        near = np.maximum(near, times(centre))
        seed = some[int(np.argmin(near[some]))]
    for _ in range(steps):
        best = np.argmax([times(c) for c in centres], 0)
        sums = [np.bincount(f[best[r] == i], value[best[r] == i], m) for i in range(k)]
        centres = [s / np.linalg.norm(s) if s.any() else c for s, c in zip(sums, centres, strict=True)]
    best = np.where(norm > 0, np.argmax([times(c) for c in centres], 0), -1)
    order = sorted(range(k), key=lambda i: (-int((best == i).sum()), i))
    for at, i in enumerate(order):
        out[rows[best == i], at] = True
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, words: int = WORDS, k: int = KINDS) -> Chain:
    """The chain for k kinds, then ``label_col``. Without toxic labelled rows nothing is toxic. An id labelled more than once has its largest label, one
    found on several documents gives the text of least hash; null ids and labels are not learned from."""
    pick = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)
    # the labelled ids are bounded by sample, and so is what each id contributes, combined before the shuffle
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(pick), "id")
    rows = rows.groupBy("id").agg(F.max("y").alias("y"), F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("id", "y", "t.text")
    names = [*[f"kind_{i + 1}" for i in range(k)], label_col]

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b.column("y").cast(pa.float64()).to_numpy(zero_copy_only=False) > 0
            for c in chunks(b.column("text")):
                codes, owner = letters(c)
                cuts = np.searchsorted(owner, np.arange(len(c.offsets)))
                found = [np.unique(codes[cuts[i] : cuts[i + 1]]) for i in range(len(c.offsets) - 1)]
                ends = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column("id").slice(c.first, c.last - c.first).cast(pa.string()), lists, pa.array(y[c.first : c.last].astype(float))], ["id", "codes", "y"])

    found = written(rows.mapInArrow(bags, "id string, codes array<long>, y double"), "bags")
    total = found.agg(F.count("*").alias("n"), F.sum("y").alias("y")).first()
    if not total.n or not total.y:
        return Chain(names, np.zeros(0, np.uint64), np.zeros((len(names), 0)), np.zeros((len(names), len(names))), np.full(len(names), -20.0))
    # chi-square of each word, counted on the executors; only the best words come to the driver
    counts = found.select(F.explode("codes").alias("code"), "y").groupBy("code").agg(F.count("*").alias("df"), F.sum("y").alias("y")).where("df >= 3")
    expected = F.col("df") * (total.y / total.n)
    best = counts.withColumn("score", (F.col("y") - expected) ** 2 / expected).where(F.col("score") > CHI).orderBy(F.desc("score"), "code").limit(words).select("code").collect()
    known = np.sort(np.array([r.code for r in best], np.int64).view(np.uint64))

    def own_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("codes")
            row, feature = present(lists.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy()), known)
            cuts = np.searchsorted(row, np.arange(b.num_rows + 1))
            own = [feature[cuts[i] : cuts[i + 1]].tobytes() for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(own, pa.binary()), b.column("y")], ["id", "own", "y"])

    got = found.mapInArrow(own_words, "id string, own binary, y double").toPandas().sort_values("id", kind="stable")
    own = [np.frombuffer(x, np.int64) for x in got["own"]]
    row, feature, toxic = np.repeat(np.arange(len(own)), [len(x) for x in own]), np.concatenate(own), got["y"].to_numpy() > 0
    return fit_rows(row, feature, known, np.column_stack([kinds(row, feature, len(own), len(known), toxic, k), toxic]).astype(float), names)


def scored(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, p_<category> for every category, toxic (the last at the threshold or above). Null, empty and blank texts have no words. Texts are read whole;
    rows are scored one by one, so repeated rows and ties get equal results and an empty table gives an empty one; other columns are not looked at."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [f"p_{n}" for n in chain.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.zeros((b.num_rows, len(names)))
            for c in chunks(b.column("text")):
                row, feature = present(*letters(c), chain.known)
                p[c.first : c.last] = chain.probabilities(row, feature, c.last - c.first)
            yield pa.RecordBatch.from_arrays([b.column("id"), *[pa.array(p[:, k]) for k in range(len(names))], pa.array(p[:, -1] >= threshold)], ["id", *names, "is_toxic"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} double" for n in names) + ", is_toxic boolean")
    return out.withColumnsRenamed({"id": id_col, "is_toxic": "toxic"})


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return scored(docs, fit(docs, read(spark, sf_dir, "labels")))
