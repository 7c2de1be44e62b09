"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017), in numpy.

Confirmed toxic documents are the positives, all other text is unlabelled: labels of "not toxic" are not used
to train. A text's features are hashed: its case-folded words and their beginnings of 4 and 5 bytes (toxic stems take endings).
Features that positives have clearly more often than unlabelled texts (a share of ``MIN_SHARE`` at least, ``MIN_LIFT``
times the unlabelled one and ``MIN_SCORE`` standard errors above it) are kept, and a logistic classifier over which of them are there is trained with
the class-prior-corrected risk  pi * R+(f) + max(0, Ru-(f) - pi * R+-(f)); in a step in which the bracket is negative the
gradient turns to undo it, so the classifier can't win by driving the corrected risk below zero.

The sample has at most ``sample_positive`` confirmed toxic and ``sample_unlabelled`` documents of any kind (parameters of
``fit`` and all that calls it), those with the smallest hash of doc_id, read whole. The prior is ``prior`` where it is given,
else the share of toxic among the labels; where these confirm toxic documents only, as positive-unlabelled data may,
the share says nothing, and the prior is ``DEFAULT_PRIOR``. It is kept within ``PRIORS``, as the risk has none of one of the
classes at 0 or 1. Every document is scored whole.

Defined results: a null text, or one without words, gets no score and is not toxic; equal rows get equal
scores; null labels confirm nothing; a document with several labels is confirmed if one says toxic; without
confirmed examples nothing is toxic; very long texts are scored as any other; an empty table gives an empty result; other
columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_columns, fold_case, prefix_hash, row_chunks, span_hash, text_bytes, word_spans

BITS = 22
SAMPLE_POSITIVE, SAMPLE_UNLABELLED = 3000, 9000
MIN_POSITIVE, MIN_SHARE, MIN_LIFT, MIN_SCORE = 3, 0.005, 3.0, 5.0
STEPS, RATE, DECAY = 600, 0.05, 1e-5
THRESHOLD = 0.5
DEFAULT_PRIOR, PRIORS = 0.1, (1e-4, 0.9)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, row) of all words and word beginnings, repeats included."""
    low = fold_case(data)
    starts, ends, row = word_spans(low, offsets)
    sums, made, rows = prefix_hash(low), [], []
    for salt, size in ((1, None), (2, 4), (3, 5)):
        if size is None:
            at, stop = starts, ends
        else:
            long = ends - starts > size
            at, stop = starts[long], starts[long] + size
        made.append((span_hash(sums, at, stop) * np.uint64(2 * salt + 1) >> np.uint64(64 - BITS)).astype(np.int32))
        rows.append(row if size is None else row[long])
    return np.concatenate(made), np.concatenate(rows)


def distinct(feature: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique((row.astype(np.int64) << BITS) | feature)
    return (key & ((1 << BITS) - 1)).astype(np.int32), (key >> BITS).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray  # of all 2**BITS features, mostly 0
    bias: float
    prior: float


def _sums(x: tuple[np.ndarray, np.ndarray, int], w: np.ndarray) -> np.ndarray:
    return np.bincount(x[1], w[x[0]], minlength=x[2])


def nnpu_step(xp, xu, w: np.ndarray, b: float, prior: float) -> tuple[np.ndarray, float, float]:
    """(gradient of weights, of bias, bracket) of the non-negative risk with the logistic loss on one batch; x is (feature, row, rows)."""
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    zp, zu = _sums(xp, w) + b, _sums(xu, w) + b
    bracket = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    to_positive = -prior * (1 - sigmoid(zp)) / len(zp)
    gp, gu = -prior * sigmoid(zp) / len(zp), sigmoid(zu) / len(zu)
    if bracket < 0:
        dp, du = -gp, -gu
    else:
        dp, du = to_positive + gp, gu
    grad = np.bincount(xp[0], dp[xp[1]], minlength=len(w)) + np.bincount(xu[0], du[xu[1]], minlength=len(w))
    return grad, float(dp.sum() + du.sum()), float(bracket)


def _batch(feature: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    size = bounds[rows + 1] - bounds[rows]
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return feature[np.repeat(bounds[rows], size) + inner], np.repeat(np.arange(len(rows)), size), len(rows)


def train(positive: tuple[np.ndarray, np.ndarray, int], unlabelled: tuple[np.ndarray, np.ndarray, int], prior: float) -> Model:
    """A classifier from distinct (feature, row) pairs of positive and unlabelled texts."""
    size = 1 << BITS
    np_, nu = positive[2], unlabelled[2]
    if not np_ or not nu:
        return Model(np.zeros(size, np.float32), -30.0, prior)
    inp, inu = np.bincount(positive[0], minlength=size), np.bincount(unlabelled[0], minlength=size)
    share, usual = inp / np_, (inu + 1) / nu
    certain = (share - usual) / np.sqrt(usual * (1 - np.minimum(usual, 1)) / np_ + 1e-12)
    kept = np.flatnonzero((inp >= max(MIN_POSITIVE, MIN_SHARE * np_)) & (share >= MIN_LIFT * usual) & (certain >= MIN_SCORE))
    name = np.full(size, -1, np.int32)
    name[kept] = np.arange(len(kept))

    def reduced(x):
        here = name[x[0]]
        feature, row = here[here >= 0], x[1][here >= 0]
        order = np.argsort(row, kind="stable")
        return feature[order], np.searchsorted(row[order], np.arange(x[2] + 1))

    (fp, bp), (fu, bu) = reduced(positive), reduced(unlabelled)
    w, b = np.zeros(len(kept)), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    xp, xu = _batch(fp, bp, np.arange(np_)), _batch(fu, bu, np.arange(nu))
    for step in range(1, STEPS + 1):  # whole sample at a time: few features are left, and small batches make the bracket noise
        gw, gb, _ = nnpu_step(xp, xu, w, b, prior)
        g = np.append(gw + DECAY * w, gb)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    weights = np.zeros(size, np.float32)
    weights[kept] = w
    return Model(weights, float(b), prior)


def score(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability of toxicity of each text; NaN for one without words."""
    out = np.full(len(offsets) - 1, np.nan)
    for i, j in row_chunks(offsets):
        feature, row = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        there = np.bincount(row, minlength=j - i) > 0
        hit = model.weights[feature] != 0
        feature, row = distinct(feature[hit], row[hit])
        z = np.bincount(row, model.weights[feature].astype(float), minlength=j - i) + model.bias
        out[i:j] = np.where(there, 1 / (1 + np.exp(-np.clip(z, -30, 30))), np.nan)
    return out


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = text_bytes(batch.column(0))
        for i, j in row_chunks(offs):
            feature, row = distinct(*features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]))
            parts = np.split(feature, np.searchsorted(row, np.arange(1, j - i)))
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i), pa.array([p.tobytes() for p in parts], pa.binary())], ["toxic", "features"])


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None, sample_positive: int = SAMPLE_POSITIVE, sample_unlabelled: int = SAMPLE_UNLABELLED) -> Model:
    """The classifier of a corpus: its bounded sample, whole texts."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    # bounded by the sample sizes from here on
    confirmed = marks.filter("toxic = 1").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_positive)
    share = marks.agg(F.avg((F.col("toxic") == 1).cast("int"))).first()[0]
    if not share:
        return Model(np.zeros(1 << BITS, np.float32), -30.0, 0.0)
    prior = float(np.clip(prior if prior is not None else share if share < 1 else DEFAULT_PRIOR, *PRIORS))
    # unlabelled: any document, confirmed or not, so that it is a mixture with the prior's share of toxic ones
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    mixed = known.orderBy(F.xxhash64(F.lit(1), "doc_id"), "doc_id").limit(sample_unlabelled)
    ids = confirmed.withColumn("toxic", F.lit(True)).unionByName(mixed.withColumn("toxic", F.lit(False)))
    rows = doc_columns(docs).filter("text is not null").join(F.broadcast(ids), "doc_id").select("text", "toxic")
    found = rows.mapInArrow(_sample_features, "toxic boolean, features binary").toArrow()
    toxic = found["toxic"].to_numpy(zero_copy_only=False).astype(bool)
    blobs = [np.frombuffer(x, np.int32) for x in found["features"].to_pylist()]

    def pack(some: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
        some = sorted(some, key=bytes)
        return np.concatenate(some or [np.zeros(0, np.int32)]), np.repeat(np.arange(len(some)), [len(x) for x in some]), len(some)

    return train(pack([x for x, t in zip(blobs, toxic, strict=True) if t]), pack([x for x, t in zip(blobs, toxic, strict=True) if not t]), prior)


def scores(docs: DataFrame, labels: DataFrame, **fitting: float | None) -> DataFrame:
    """(doc_id, score) of every row; null where there is no word. ``fitting`` goes to ``fit``."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **fitting))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = score(model.value, *text_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, mask=np.isnan(found))], ["doc_id", "score"])

    return doc_columns(docs).mapInArrow(run, "doc_id long, score double")


def toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **fitting: float | None) -> DataFrame:
    """(doc_id, score) of the rows that are toxic."""
    return scores(docs, labels, **fitting).filter(F.col("score") >= threshold)
