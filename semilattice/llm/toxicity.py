"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A document's features are the n-grams of bytes (A-Z lower-cased, runs of white space as one space) that occur in
it, hashed. Each is scaled by the logarithm of the ratio of its smoothed shares among toxic and other documents,
and logistic regression weighs the scaled features. Learning takes a bounded sample of labelled rows
(``per_class`` of each label, those with the smallest hashes of their ids); scoring covers all rows and texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, _SPACE, Scratch, arrow_map, column, list_array, need, steps, texts, union_all

BITS = 18
ORDERS = (3, 4, 5)
#: Labelled rows of each class that the classifier is fitted on, and features that it keeps.
PER_CLASS, FEATURES = 3000, 30_000
_MIX = np.uint32(2654435761)


def ngrams(values: list[bytes | None], keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, hashed n-gram) as two arrays, ordered by text; ``keep`` limits the n-grams."""
    joined = np.frombuffer(b" \xff ".join(v or b"" for v in values) + b" \xff ", np.uint8)
    low = _LOWER[joined]
    low = np.where(_SPACE[joined], np.uint8(32), low)
    single = np.ones(len(low), bool)
    single[1:] = (low[1:] != 32) | (low[:-1] != 32)
    doc = np.repeat(np.arange(len(values)), [len(v or b"") + 3 for v in values])[single]
    low = low[single].astype(np.uint32)
    broken = low == 255  # a byte that no text has
    out = []
    h = low.copy()
    edge = broken.copy()
    for n in range(2, max(ORDERS) + 1):
        h = h[:-1] * np.uint32(0x01000193) + low[n - 1 :]
        edge = edge[:-1] | broken[n - 1 :]
        if n in ORDERS:
            x = ((h ^ (h >> np.uint32(15))) * _MIX + np.uint32(n * 0x9E3779B1 % (1 << 32))) >> np.uint32(32 - BITS)
            ok = ~edge if keep is None else keep[x] & ~edge
            at = np.flatnonzero(ok)
            out.append((doc[at] << BITS) | x[at])
    pairs = np.unique(np.concatenate(out))
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of 2^BITS features, 0 where not kept
    scale: np.ndarray  # the log-count ratios alone, for the norm
    bias: float

    def scores(self, values: list[bytes | None]) -> np.ndarray:
        out = np.empty(len(values))
        keep = self.scale != 0
        for a, b in steps(values):
            doc, x = ngrams(values[a:b], keep)
            n = b - a
            total = np.bincount(doc, self.weights[x], n)
            norm = np.sqrt(np.bincount(doc, self.scale[x] ** 2, n))
            out[a:b] = total / np.maximum(norm, 1.0)
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -30, 30)))


def fit_logistic(doc: np.ndarray, x: np.ndarray, scaled: np.ndarray, y: np.ndarray, weight: np.ndarray, n: int, l2: float = 1e-4, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Weighted logistic regression of sparse rows by accelerated gradient descent with per-feature steps."""
    w, b = np.zeros(n), 0.0
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    share = weight / weight.sum()
    for t in range(1, rounds + 1):
        z = np.bincount(doc, scaled * w[x], len(y)) + b
        err = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.append(np.bincount(x, scaled * err[doc], n) + l2 * w, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        d = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - d[:-1], b - d[-1]
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, train: Column, per_class: int = PER_CLASS, features: int = FEATURES) -> Model:
    """Fits on at most ``per_class`` rows of each label among the labelled rows for which ``train`` (over doc_id) holds.

    Labels of null or of other values than 0 and 1 do not count; a document labelled both ways counts as toxic.
    """
    none = Model(np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0)
    known = need(labels, doc_id="long", toxic="int").where("doc_id is not null and toxic in (0, 1)").where(train).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # each label's rows with the smallest hashes: a sorted limit, so every task sends its own first ones alone
    chosen = union_all([known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)])
    scratch = Scratch(docs.sparkSession, "toxicity")
    # at most 2 * per_class rows of two numbers
    sample = scratch.write(need(docs, doc_id="long", text="string").join(F.broadcast(chosen), "doc_id"), "sample")
    sizes = {int(r.toxic): int(r["count"]) for r in sample.groupBy("toxic").count().collect()}
    if set(sizes) != {0, 1}:
        scratch.drop(sample)
        return none

    def count(batch: pa.RecordBatch):
        y, values = column(batch, "toxic").to_numpy(), texts(batch)
        for a, b in steps(values):
            doc, x = ngrams(values[a:b])
            both = np.bincount(x * 2 + y[a:b][doc], minlength=2 << BITS).reshape(-1, 2)
            some = np.flatnonzero(both.any(1))
            yield {"x": some.astype(np.int32), "c0": both[some, 0], "c1": both[some, 1]}

    counts = arrow_map(sample, count, "x int, c0 long, c1 long").groupBy("x").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).toPandas()
    c0, c1 = np.zeros(1 << BITS), np.zeros(1 << BITS)
    c0[counts.x], c1[counts.x] = counts.c0, counts.c1
    p0, p1 = (c0 + 1) / (sizes[0] + 2), (c1 + 1) / (sizes[1] + 2)
    ratio = np.log(p1 / p0)
    clear = np.abs(p1 - p0) / np.sqrt(p1 * (1 - p1) / sizes[1] + p0 * (1 - p0) / sizes[0] + 1e-12)
    clear[c0 + c1 < 3] = 0
    best = np.argsort(-clear, kind="stable")[:features]
    scale = np.zeros(1 << BITS)
    scale[best[clear[best] > 2]] = ratio[best[clear[best] > 2]]
    keep = scale != 0

    def rows(batch: pa.RecordBatch):
        y, ids, values = column(batch, "toxic"), column(batch, "doc_id"), texts(batch)
        for a, b in steps(values):
            doc, x = ngrams(values[a:b], keep)
            yield {"doc_id": ids[a:b], "toxic": y[a:b], "x": list_array(x.astype(np.int32), np.searchsorted(doc, np.arange(b - a + 1)))}

    # at most 2 * per_class rows of at most ``features`` numbers
    got = arrow_map(sample, rows, "doc_id long, toxic int, x array<int>").toArrow().sort_by("doc_id").combine_chunks()
    scratch.drop(sample)
    place = (np.cumsum(keep) - 1).astype(np.int32)
    lists = got.column("x").combine_chunks() if isinstance(got.column("x"), pa.ChunkedArray) else got.column("x")
    first = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    x = lists.flatten().to_numpy()
    y = got.column("toxic").to_numpy().astype(float)
    doc = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(first))
    norm = np.maximum(np.sqrt(np.bincount(doc, scale[x] ** 2, len(y))), 1.0)
    # each class weighs as it does among all labelled training rows
    share = {int(r.toxic): int(r["count"]) for r in known.groupBy("toxic").count().collect()}
    weight = np.where(y == 1, share[1] / sizes[1], share[0] / sizes[0])
    w, b = fit_logistic(doc, place[x], (scale[x] / norm[doc]).astype(np.float32), y, weight, int(keep.sum()))
    weights = np.zeros(1 << BITS)
    weights[keep] = w * scale[keep]
    return Model(weights, scale, b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score``: a row per input row; a null text counts as empty and gets the score of no evidence.

    Whole texts of any length are scored; repeated rows and rows without doc_id are scored each, equal texts alike,
    so that ties stay ties; an empty table gives an empty result; other columns are not read, whatever their names.
    """

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": column(batch, "doc_id"), "score": model.scores(texts(batch))}

    return arrow_map(need(docs, doc_id="long", text="string"), run, "doc_id long, score double")
