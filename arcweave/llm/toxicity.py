"""Toxicity by non-negative positive-unlabelled learning.

Features of a document: its words and the first 4 to 8 bytes of its longer words, hashed to 32 bits; present or not.
fit() takes a bounded sample of labelled rows: at most MAX_POSITIVE documents that are confirmed toxic and at most
MAX_UNLABELLED of all documents with a label row, whose labels it doesn't look at (the smallest by hash, so the sample
doesn't depend on partitions). It keeps features that are clearly more common among the positives, and minimises the
non-negative risk estimator for a linear model with the sigmoid loss: prior * R+(positive) + max(0, R-(unlabelled) -
prior * R-(positive)); where the second part is negative, its gradient is turned round instead of followed.

Of equal hashes the smaller doc_id comes into the sample first. A very long text is read whole, in one task, with some 12
bytes of memory a byte.

Defined results. A null or empty text has the score of a text without features. A null doc_id is scored, but not used for
fitting. Label rows with a null, and repeated ones, don't count twice. Without positives, or where no feature tells them
apart, no document is toxic and the score is -1. Repeated rows repeat. Other columns are not read by score(), and pass
through filter_toxic() untouched, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcweave.llm import textnum, util

MAX_POSITIVE = 2000
MAX_UNLABELLED = 6000
PRIOR = 0.1
PREFIXES = (4, 5, 6, 7, 8)


class Classifier(NamedTuple):
    features: np.ndarray
    weights: np.ndarray
    bias: float
    threshold: float = 0.0


def _hashes(w: textnum.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions of words, their 32-bit feature) for words, then for each prefix length."""
    every = np.arange(len(w.start))
    for k, n in enumerate((0, *PREFIXES)):
        at = np.flatnonzero(w.end - w.start > n) if n else every
        yield at, ((w.heads(at, n, 101 + k) if n else w.hash(101)) >> textnum.U(32)).astype(np.uint32)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(positive, text) -> (positive, the document's distinct features)."""
    schema = pa.schema([("positive", pa.bool_()), ("features", pa.binary())])
    for batch in batches:
        for part in textnum.pieces(batch, "text"):
            w = textnum.words(part.column(1))
            row = w.of_row()
            both = np.unique(np.concatenate([(row[at].astype(textnum.U) << textnum.U(32)) | h for at, h in _hashes(w)]))
            cut = np.searchsorted(both >> textnum.U(32), np.arange(part.num_rows + 1, dtype=textnum.U))
            low = both.astype(np.uint32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([low[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())], schema=schema)


def risk(s: np.ndarray, is_p: np.ndarray, prior: float) -> tuple[float, float]:
    """(positive part, negative part) of the risk of outputs s, the sigmoid loss being 1 - s or s: prior * R+(positive), and
    R-(unlabelled) - prior * R-(positive), which estimates the negatives' share of it and can't be below 0 but by chance."""
    return float(prior * (1 - s[is_p]).mean()), float(s[~is_p].mean() - prior * s[is_p].mean())


def slopes(z: np.ndarray, is_p: np.ndarray, prior: float) -> np.ndarray:
    """What each score contributes to the gradient: that of both parts while the negative one isn't below 0, else that of the
    negative part alone turned round."""
    s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    slope, np_, nu = s * (1 - s), int(is_p.sum()), int((~is_p).sum())
    g = np.where(is_p, -prior * slope / np_, slope / nu)  # of the negative part
    if risk(s, is_p, prior)[1] < 0:
        return -g
    g[is_p] -= prior * slope[is_p] / np_
    return g


def learn(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float = PRIOR, steps: int = 400, rate: float = 0.05, decay: float = 1e-3, lift: float = 2.5, least: int = 4) -> Classifier:
    """Non-negative PU learning from sets of feature hashes."""
    none = Classifier(np.zeros(0, np.uint32), np.zeros(0), -1.0)
    if not positive or not unlabelled:
        return none
    sets = positive + unlabelled
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    names, ids = np.unique(flat, return_inverse=True)
    np_, nu = len(positive), len(unlabelled)
    in_p = np.bincount(ids[row < np_], minlength=len(names))
    in_u = np.bincount(ids[row >= np_], minlength=len(names))
    chosen = (in_p >= least) & ((in_p - np.sqrt(in_p)) / np_ >= lift * (in_u + 1) / nu)
    if not chosen.any():
        return none
    new = np.cumsum(chosen) - 1
    on = chosen[ids]
    r, c = row[on], new[ids[on]]
    names = names[chosen]
    w, b = np.zeros(len(names)), -1.0
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    is_p = np.arange(len(sets)) < np_
    for t in range(1, steps + 1):
        z = b + np.bincount(r, w[c], len(sets))
        g = slopes(z, is_p, prior)
        grad = np.append(np.bincount(c, g[r], len(w)) + decay * w / len(w), g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = np.maximum(w - step[:-1], 0), b - step[-1]  # every chosen feature speaks for toxic
    return Classifier(names, w, float(b))


def fit(documents: DataFrame, labels: DataFrame, prior: float = PRIOR, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Classifier:
    lab = labels.select(F.col("doc_id").cast("long").alias("doc"), F.col("toxic").cast("int").alias("toxic")).where("doc is not null and toxic is not null")
    lab = lab.groupBy("doc").agg(F.max("toxic").alias("toxic")).withColumn("turn", F.xxhash64("doc"))
    pos = lab.where("toxic = 1").orderBy("turn", "doc").limit(max_positive).select("doc", F.lit(True).alias("positive"))
    unl = lab.orderBy("turn", "doc").limit(max_unlabelled).select("doc", F.lit(False).alias("positive"))
    docs = util.small_batches(documents).select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text")).where("doc is not null")
    sample = docs.join(F.broadcast(pos.unionByName(unl)), "doc").select("positive", "text")  # at most max_positive + max_unlabelled ids
    rows = sample.mapInArrow(_extract, "positive boolean, features binary").toArrow()
    sets = {True: [], False: []}
    for p, f in sorted(zip(rows["positive"].to_pylist(), rows["features"].to_pylist())):
        sets[p].append(np.frombuffer(f, np.uint32))
    return learn(sets[True], sets[False], prior)


def logits(model: Classifier, texts: pa.Array) -> np.ndarray:
    """Scores of whole texts."""
    out = np.full(len(texts), model.bias)
    size = len(model.features)
    if not size:
        return out
    near = np.zeros(1 << 20, bool)
    near[model.features >> 12] = True
    w = textnum.words(texts)
    row, found = w.of_row(), []
    for at, h in _hashes(w):
        hit = np.flatnonzero(near[h >> 12])
        which = np.minimum(np.searchsorted(model.features, h[hit]), size - 1)
        ok = model.features[which] == h[hit]
        found.append(row[at[hit[ok]]] * size + which[ok])
    both = np.unique(np.concatenate(found))
    return out + np.bincount(both // size, model.weights[both % size], len(texts))


def _scored(df: DataFrame, model: Classifier, text: str, name: str) -> DataFrame:
    at = util.small_batches(df).columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textnum.pieces(batch, text):
                score = pa.array(np.round(logits(model, part.column(at)), 6))
                yield pa.RecordBatch.from_arrays([*part.columns, score], names=[*part.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))


def score(documents: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, score, toxic) for every row."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _scored(docs, model, "text", "score").select("doc_id", "score", (F.col("score") > model.threshold).alias("toxic"))


def filter_toxic(documents: DataFrame, model: Classifier) -> DataFrame:
    """documents without the toxic ones; all columns as they were."""
    name = "__score"
    while name in documents.columns:
        name += "_"
    return _scored(documents, model, "text", name).where(F.col(name) <= model.threshold).drop(name)
