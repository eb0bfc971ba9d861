"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text is the set of its hashed n-grams (3 to 6 characters). A bounded sample of labelled training rows is cut in two.
Of the larger part, each bucket's log-count ratio r between the classes is taken, and logistic regression is fitted on
indicators times r, over all buckets that occur often enough and whose ratio favours either class. The smaller part
chooses the regularisation and calibrates: scores are sigmoid(bias + sum of weights) after a linear map fitted there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .textvec import byte_values, mix64, slices

ORDERS = (3, 4, 5, 6)
BITS = 21
#: A bucket is a feature if so many texts have it and its log-count ratio is this far from 0, on either side.
MIN_SUPPORT = 4
MIN_RATIO = 0.5
#: At most so many labelled documents, those of a small hash of doc_id, are taken to fit.
MAX_TRAIN_ROWS = 20_000
#: One part in CALIBRATION of them, by a hash of the text, is not fitted on.
CALIBRATION = 5
PENALTIES = (0.1, 0.01)
STEPS = 60


def characters(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit value for each character of the texts, and where each text ends, in characters."""
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    padded = np.concatenate((data, np.zeros(3, np.uint8)))
    low = byte_values()
    low[[9, 10, 11, 12, 13, 32]] = low[0]  # white space is one character
    value = low[data[at]]
    going = np.ones(len(at), bool)
    for j in (1, 2, 3):
        byte = padded[at + j]
        going &= (byte & 0xC0) == 0x80
        value = np.where(going, value * np.uint64(0xC2B2AE3D27D4EB4F) + byte, value)
    return value, np.searchsorted(at, ends)


def buckets(data: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
    """For each text, its distinct n-gram buckets."""
    value, stop = characters(data, ends)
    grams, rolled = [], value.copy()
    for n in range(2, max(ORDERS) + 1):
        rolled = rolled[:-1] * np.uint64(0x9FB21C651E98DF25) + value[n - 1 :] if len(rolled) else rolled
        if n in ORDERS:
            grams.append((n, (mix64(rolled, n) >> np.uint64(64 - BITS)).astype(np.int32)))
    last, first = np.zeros(1 << BITS, np.int32), 0
    for end in stop:
        g = np.concatenate([x[first : max(first, end - n + 1)] for n, x in grams])
        at = np.arange(len(g), dtype=np.int32)
        last[g] = at
        first = end
        yield g[last[g] == at]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    both = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        for rows, data, ends in slices(batch, "text"):
            for label, found in zip(rows.column(1).to_numpy(zero_copy_only=False), buckets(data, ends)):
                both[int(label), found] += 1
    used = np.flatnonzero(both.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(both[0, used]), pa.array(both[1, used])], names=["bucket", "clean", "toxic"])


def _chosen(batches: Iterator[pa.RecordBatch], place: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, ends in slices(batch, "text"):
            found = [np.sort((p := place[b])[p >= 0]) for b in buckets(data, ends)]
            yield pa.RecordBatch.from_arrays([rows.column(1), rows.column(2), pa.array(found, pa.list_(pa.int32()))], names=["toxic", "fitted", "features"])


def sums(index: np.ndarray, size: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Of rows that hold `size` features each, one after the other in index: the sum of their values."""
    out = np.zeros(len(size))
    some = size > 0
    if some.any():
        out[some] = np.add.reduceat(values[index], (np.cumsum(size) - size)[some])
    return out


def fit_logistic(labels: np.ndarray, index: np.ndarray, size: np.ndarray, scale: np.ndarray, l2: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights (already times scale) and bias, by full-batch Adam on the mean log loss and l2 / 2 of the squared weights."""
    w, bias = np.zeros(len(scale)), float(np.log((labels.mean() + 1e-3) / (1 - labels.mean() + 1e-3)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, steps + 1):
        z = bias + sums(index, size, w * scale)
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels) / len(labels)
        g = np.bincount(index, weights=np.repeat(error, size), minlength=len(scale)) * scale + l2 * w
        gb = error.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.02 / (1 - 0.9**step)
        w -= rate * m / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        bias -= rate * mb / (np.sqrt(vb / (1 - 0.999**step)) + 1e-8)
    return w * scale, bias


def calibrate(z: np.ndarray, labels: np.ndarray, steps: int = 100) -> tuple[float, float, float]:
    """a >= 0 and b that make sigmoid(a * z + b) fit the labels, by damped Newton steps, and the mean log loss."""
    chance = lambda a, b: 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
    loss = lambda p: float(-np.mean(np.where(labels > 0, np.log(p), np.log1p(-p))))
    a, b, least = 1.0, 0.0, loss(chance(1.0, 0.0))
    for _ in range(steps):
        p = chance(a, b)
        g, h = p - labels, p * (1 - p) + 1e-9
        hessian = np.array([[(h * z * z).sum() + 1e-2, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-2]])
        da, db = np.linalg.solve(hessian, [(g * z).sum(), g.sum()])
        while (a - da < 0 or loss(chance(a - da, b - db)) > least) and abs(da) + abs(db) > 1e-9:
            da, db = da / 2, db / 2
        if abs(da) + abs(db) <= 1e-9:
            break
        a, b = a - da, b - db
        least = loss(chance(a, b))
    return a, b, least


def _fitted(batches: Iterator[pa.RecordBatch], ratio: np.ndarray) -> Iterator[pa.RecordBatch]:
    """All sampled rows in one task, at most MAX_TRAIN_ROWS documents: a line for each feature, and one (-1) for the bias."""
    labels, fitted, sizes, held = [], [], [], []
    for batch in batches:
        lists = batch.column(2)
        labels.append(batch.column(0).to_numpy(zero_copy_only=False).astype(float))
        fitted.append(batch.column(1).to_numpy(zero_copy_only=False).astype(bool))
        sizes.append(np.diff(lists.offsets.to_numpy()))
        held.append(lists.flatten().to_numpy())
    y, own, size, index = (np.concatenate(x) for x in (labels, fitted, sizes, held))
    mine = np.repeat(own, size)
    best = None
    for l2 in PENALTIES:
        w, bias = fit_logistic(y[own], index[mine], size[own], ratio, l2)
        a, b, loss = 1.0, 0.0, 0.0
        if 0 < y[~own].sum() < (~own).sum():
            a, b, loss = calibrate(bias + sums(index[~mine], size[~own], w), y[~own])
        if best is None or loss < best[0]:
            best = loss, w * a, bias * a + b
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(ratio))), pa.array(np.concatenate(([best[2]], best[1])))], names=["feature", "weight"])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """A weight for each bucket, and the bias. docs: doc_id, text; labels: doc_id, toxic (rows to learn from)."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, 0.95 * max_rows / max(1, known.count()))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) < F.lit(int(share * (1 << 31)))
    sample = staged(known.where(place).limit(max_rows), "toxicity-sample", max_rows)
    text = F.coalesce("text", F.lit(""))
    rows = docs.join(F.broadcast(sample), "doc_id").select(text.alias("text"), "toxic", (F.pmod(F.xxhash64(text, F.lit(5)), F.lit(CALIBRATION)) != 0).alias("fitted"))
    rows = staged(rows, "toxicity-rows")
    fitted = rows.where("fitted")
    n, toxic = fitted.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    weights = np.zeros(1 << BITS, np.float32)
    flat = weights, float(np.log((toxic + 0.5) / (n - toxic + 0.5)))
    if not 0 < toxic < n:
        return flat
    counts = fitted.mapInArrow(_counted, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    ratio = F.log((F.col("toxic") + 1) / (toxic + 2)) - F.log((F.col("clean") + 1) / (n - toxic + 2))
    features = counts.where(F.col("clean") + F.col("toxic") >= MIN_SUPPORT).select("bucket", ratio.alias("ratio")).where(F.abs("ratio") >= MIN_RATIO)
    features = features.toArrow().sort_by("bucket")  # fewer than 2^BITS
    if not len(features):
        return flat
    bucket, ratios = features.column("bucket").to_numpy(), features.column("ratio").to_numpy()
    place = np.full(1 << BITS, -1, np.int32)
    place[bucket] = np.arange(len(bucket))
    chosen = staged(rows.mapInArrow(lambda it: _chosen(it, place), "toxic int, fitted boolean, features array<int>"), "toxicity-features")
    found = chosen.coalesce(1).mapInArrow(lambda it: _fitted(it, ratios), "feature long, weight double").toArrow().sort_by("feature")
    value = found.column("weight").to_numpy()
    weights[bucket] = value[1:]
    return weights, float(value[0])


def scored(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """docs (doc_id, text) -> doc_id and score; null and empty texts get the bias's score."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, ends in slices(batch, "text"):
                z = np.array([bias + float(weights[b].sum(dtype=np.float64)) for b in buckets(data, ends)])
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """For each row of docs: doc_id, held_out, score and predicted.

    Labels of documents with crc32(doc_id as text) mod folds = 0 are held out. Null ids are not held out but
    have no labels; of a document's repeated labels the largest counts; equal rows get equal scores; texts of any length
    are scored whole, and other columns, whatever their names, take no part. Without labels of both classes every score
    is the smoothed share of label 1; an empty table gives no rows.
    """
    out = lambda c: F.coalesce(F.crc32(F.col(c).cast("string")) % folds == 0, F.lit(False))
    weights, bias = fit(docs.select("doc_id", "text"), labels.where(~out("doc_id")), max_rows)
    rows = scored(docs, weights, bias)
    return rows.select("doc_id", out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
