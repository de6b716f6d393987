"""Quality classifier: histogram gradient-boosted trees over statistics of documents.

Trees are grown on a bounded sample of labelled rows, level by level: features in at most BINS bins of equal weight,
sums of gradients by bin, the split of largest gain in each leaf. All trees then lie in flat arrays, as complete binary
trees, and whole batches walk down them together with numpy.

Defined results: null and empty texts have the statistics of an empty text and get a score like any other; a null doc_id
is neither held out nor learned from; several labels of one doc_id count as their smallest; rows that repeat a doc_id are
each learned from as far as the sample reaches; without any labelled row each score is 0.5. Of splits of equal gain the one
of the earlier statistic and then of the lower bin is taken; rows with equal statistics have equal scores. Texts may be of any length;
columns of docs named score, held_out and predicted are replaced, all others stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing as H

#: Labelled rows that the trees are grown on at most: those with the smallest hashes of their ids.
SAMPLE = 20_000
TREES, DEPTH, RATE, BINS, LEAST_HESSIAN, RIDGE = 80, 5, 0.15, 64, 3.0, 1.0
THRESHOLD = 0.3
FOLDS = 5


def _class(*spans: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256)
    for a, b in spans:
        out[a : b + 1] = 1
    return out


#: Shares of bytes.
CLASSES = {
    "upper": _class((65, 90)), "lower": _class((97, 122)), "digit": _class((48, 57)), "space": _class((32, 32)), "newline": _class((10, 10)), "other": _class((128, 255)), "full_stop": _class((46, 46)), "comma": _class((44, 44)),
    "mark": _class((33, 33), (63, 63)), "symbol": _class((35, 38), (42, 43), (60, 62), (64, 64), (92, 92), (94, 96), (123, 126)), "rest": _class((34, 34), (39, 41), (45, 45), (47, 47), (58, 59), (91, 91), (93, 93), (95, 95)),
}
NAMES = ["log_bytes", "log_words", "log_lines", *CLASSES, "word_length", "word_spread", "words_a_line", "distinct_words", "top_word", "distinct_pairs", "distinct_triples", "same_next", "stops_a_word", "distinct_lines", "shouted", "byte_entropy"]


def _distinct(keys: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct keys each document has, and how often its most frequent one occurs."""
    order = np.lexsort((keys, doc))
    k, d = keys[order], doc[order]
    if not len(k):
        return np.zeros(n), np.zeros(n)
    new = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])])
    most = np.zeros(n)
    np.maximum.at(most, d[new], np.diff(np.r_[new, len(k)]))
    return np.bincount(d[new], minlength=n).astype(float), most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of NAMES for each text."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    of_byte = np.repeat(np.arange(n), size)
    counts = np.bincount(of_byte * 256 + data, minlength=n * 256).reshape(n, 256)
    each = np.maximum(size, 1)
    shares = counts / each[:, None]
    entropy = -np.sum(shares * np.log2(np.where(shares > 0, shares, 1)), axis=1)
    starts, ends = H.spans_of_words(data, offsets[1:-1])
    doc = np.searchsorted(offsets, starts, side="right") - 1
    words = np.bincount(doc, minlength=n).astype(float)
    some = np.maximum(words, 1)
    length = (ends - starts).astype(float)
    mean = np.bincount(doc, length, minlength=n) / some
    spread = np.sqrt(np.maximum(0, np.bincount(doc, length**2, minlength=n) / some - mean**2))
    h = H.hashes_of_words(data, starts, ends)
    distinct, top = _distinct(h, doc, n)
    grams = []
    for k in (2, 3):
        m = max(0, len(h) - k + 1)
        g = sum((H.mix(h[i : i + m] + np.uint64(i)) for i in range(k)), np.zeros(m, np.uint64))
        ok = doc[:m] == doc[k - 1 :] if m else np.zeros(0, bool)
        grams.append(_distinct(g[ok], doc[:m][ok], n)[0] / np.maximum(1, np.bincount(doc[:m][ok], minlength=n)))
    same = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1]) if len(h) else np.zeros(0, bool)
    same = np.bincount(doc[1:][same], minlength=n) / some if len(h) else np.zeros(n)
    lines = counts[:, 10] + 1.0
    breaks = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate([offsets[:-1][size > 0], breaks + 1]))
    line_start = np.unique(line_start[line_start < len(data)])
    line_end = np.r_[line_start[1:], len(data)]
    line_doc = np.searchsorted(offsets, line_start, side="right") - 1
    own = _distinct(H.hashes_of_words(data, line_start, line_end), line_doc, n)[0] / np.maximum(1, np.bincount(line_doc, minlength=n)) if len(line_start) else np.zeros(n)
    shouted = np.bincount(doc, (data[starts] - 65 < 26) & (data[np.minimum(starts + 1, ends - 1)] - 65 < 26), minlength=n) / some if len(starts) else np.zeros(n)
    columns = [np.log1p(size), np.log1p(words), np.log(lines), *(shares @ c for c in CLASSES.values()), mean, spread, words / lines, distinct / some, top / some, *grams, same, counts[:, 46] / some, own, shouted, entropy]
    return np.stack(columns, axis=1).astype(np.float32)


def featured(column) -> np.ndarray:
    """statistics() of an Arrow column of texts, some of them at a time."""
    return np.concatenate([np.zeros((0, len(NAMES)), np.float32), *(statistics(*p) for p in H.pieces(column))])


@dataclass
class Trees:
    """Complete trees of one depth: feature and threshold of inner nodes, value of leaves; x <= threshold goes left."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(value)))):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            margin += value[node - (len(value) - 1)]
        return 1 / (1 + np.exp(-margin))


def grown(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
    inner, leaves = 2**depth - 1, 2**depth
    out = Trees(0.0, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, leaves)))
    if not len(y):
        return out
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    out.base = float(np.log(share / (1 - share)))
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1]).astype(np.float32)) for f in range(m)]
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    place = bins + np.arange(m) * BINS
    margin = np.full(n, out.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            wide, first = 2**level, 2**level - 1
            cell = ((node - first)[:, None] * (m * BINS) + place).ravel()
            sums = [np.bincount(cell, np.repeat(v, m), minlength=wide * m * BINS).reshape(wide, m, BINS) for v in (g, h)]
            left_g, left_h = (np.cumsum(s, axis=2)[:, :, :-1] for s in sums)
            all_g, all_h = (s.sum(axis=2)[:, :, None] for s in sums)
            gain = left_g**2 / (left_h + RIDGE) + (all_g - left_g) ** 2 / (all_h - left_h + RIDGE) - all_g**2 / (all_h + RIDGE)
            for f, e in enumerate(edges):
                gain[:, f, len(e) :] = -1
            gain[(left_h < LEAST_HESSIAN) | (all_h - left_h < LEAST_HESSIAN)] = -1
            best = gain.reshape(wide, -1).argmax(axis=1)
            f, b = best // (BINS - 1), best % (BINS - 1)
            good = gain.reshape(wide, -1)[np.arange(wide), best] > 1e-6
            out.feature[t, first : first + wide] = np.where(good, f, 0)
            out.threshold[t, first : first + wide] = [edges[i][j] if ok else np.inf for i, j, ok in zip(f, b, good, strict=True)]
            own = node - first
            right = good[own] & (bins[np.arange(n), f[own]] > b[own])
            node = 2 * node + 1 + right
        leaf = node - inner
        out.value[t] = -rate * np.bincount(leaf, g, minlength=leaves) / (np.bincount(leaf, h, minlength=leaves) + RIDGE)
        margin += out.value[t][leaf]
    return out


def fold(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS))


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "quality") -> Trees:
    """Trees from at most sample labelled rows outside of fold 0."""
    labels = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold() != 0)).groupBy("doc_id").agg(F.min(label).cast("double").alias("y"))
    # bounded by sample rows of two numbers
    labels = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(labels), "doc_id").select("doc_id", F.xxhash64("doc_id", "text").alias("place"), "text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = featured(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("place"), b.column("y"), pa.array(list(x), pa.list_(pa.float32()))], names=["doc_id", "place", "y", "x"])

    # ids that several rows have are no more than sample rows, either
    got = rows.mapInArrow(run, "doc_id long, place long, y double, x array<float>").orderBy("place", "doc_id").limit(sample).toArrow()
    x = np.array(got.column("x").to_pylist(), np.float32).reshape(got.num_rows, len(NAMES))
    order = np.lexsort((*x.T, got.column("doc_id").to_numpy()))  # the same trees however the rows came in
    return grown(x[order], got.column("y").to_numpy()[order])


def scored(docs: DataFrame, trees: Trees) -> DataFrame:
    """docs with a column score."""
    docs = docs.drop("score")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(names.index("text"))
            x = featured(text.fill_null("") if text.null_count else text)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(trees.score(x))], names=[*names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """docs with held_out (never learned from), score and predicted."""
    docs = docs.drop("held_out", "predicted")
    out = scored(docs, learned(docs, labels, sample))
    return out.withColumn("held_out", F.coalesce(fold() == 0, F.lit(False))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
