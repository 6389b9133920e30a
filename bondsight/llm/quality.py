"""Operator 3, quality classifier: hashed word and character n-gram vectors, averaged, and a softmax over two labels.

Features of a text are its white-space words and its character n-grams, each hashed to one of 2 ** BITS learned
vectors; a document is their mean. Vectors and softmax weights are learned together by numpy stochastic gradient
descent on at most `sample` labelled rows, those with the smallest hash of doc_id (a bound on the fit alone; every
document is scored). As mean and softmax are linear below the exponent, the fitted model is one number a bucket.

Empty and null texts have no feature and get the bias alone, a score of the labels' rates. Rows without a label, with
a null label or another value than 0 and 1 aren't learned from; without any label all scores are 0.5. Only doc_id and
text are read of the documents, doc_id only to find labels; several labels of a doc_id all count, and so do several
documents of a label; equal rows have equal scores, and where hashes tie at the sample's end the smaller id and label
are taken. Very long texts are scored and learned from whole, a task holding one at a time. Empty tables give no rows, and other columns, whatever their names, play no part. Texts reach
Python alone, PIECE bytes of them at a time; the labelled sample's features are written to the shared folder by as
many tasks as the scan has, and one task reads at most `sample` of those rows, in the order of a hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from bondsight.llm import shared
from bondsight.llm.arrays import BASE, OTHER, U, binary, flat, mixed, numbers, pieces, prefixes, spans_hash, word_hashes, words

BITS, GRAMS = 18, (3, 4)
SAMPLE, DIM, EPOCHS, RATE, BATCH = 6000, 8, 6, 2.0, 16
PIECE = 512 << 10
FEATURES = "label int, nth long, buckets binary, shares binary"


def features(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, row) of all features of a batch of texts, one kind at a time."""
    start, end, first = words(data, off)
    yield (word_hashes(data, start, end) >> U(64 - BITS)).astype(np.int32), np.repeat(np.arange(len(off) - 1), np.diff(first))
    at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    sums = prefixes(data.astype(U) + U(1), OTHER)
    of = np.searchsorted(at, off)
    row = np.repeat(np.arange(len(off) - 1), np.diff(of))
    last = np.repeat(of[1:], np.diff(of))
    for n in GRAMS:
        i = np.flatnonzero(np.arange(len(row)) + n <= last)
        h = spans_hash(sums, at[i], at[i + n], OTHER)
        yield (mixed(h + U(n * BASE % (1 << 64))) >> U(64 - BITS)).astype(np.int32), row[i]


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, limit=PIECE):
        found = list(features(*flat(batch.column("text"))))
        codes, n = np.unique(np.concatenate([(row.astype(np.int64) << BITS) | b for b, row in found]), return_counts=True)
        off = np.searchsorted(codes >> BITS, np.arange(len(batch) + 1))
        total = np.add.reduceat(np.append(n, 0), off[:-1]) if len(codes) else np.ones(len(batch))
        share = (n / np.repeat(np.where(np.diff(off) > 0, total, 1), np.diff(off))).astype(np.float32)
        yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("nth"), binary((codes & ((1 << BITS) - 1)).astype(np.int32), off), binary(share, off)], names=["label", "nth", "buckets", "shares"])


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 1) -> np.ndarray:
    """What each bucket adds to the log odds of label 1, and the bias last. rows: (label, buckets, shares)."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    y = np.array([r[0] for r in rows])
    rate = (y.sum() + 0.5) / (len(y) + 1)
    weights, bias = np.zeros((DIM, 2), np.float32), np.log(np.array([1 - rate, rate], np.float32))
    steps = max(1, EPOCHS * -(-len(rows) // BATCH))
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            rate_now = RATE * (1 - step / steps)
            step += 1
            some = [rows[i] for i in order[at : at + BATCH]]
            n = np.array([len(r[1]) for r in some])
            bucket, share = np.concatenate([r[1] for r in some]), np.concatenate([r[2] for r in some])
            row = np.repeat(np.arange(len(some)), n)
            each = vectors[bucket] * share[:, None]
            mean = np.stack([np.bincount(row, each[:, d], len(some)) for d in range(DIM)], 1).astype(np.float32)
            z = mean @ weights + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), [r[0] for r in some]] -= 1
            back = (p @ weights.T).astype(np.float32)
            weights -= rate_now * mean.T @ p / len(some)
            bias -= 0.05 * rate_now * p.sum(0) / len(some)
            np.subtract.at(vectors, bucket, rate_now * 20 * back[row] * share[:, None])
    return np.append(vectors @ (weights[:, 1] - weights[:, 0]), bias[1] - bias[0]).astype(np.float32)


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        b, off = numbers(batch.column("buckets"), np.int32)
        s, _ = numbers(batch.column("shares"), np.float32)
        rows += [(y, b[i:j], s[i:j]) for y, i, j in zip(batch.column("label").to_pylist(), off[:-1], off[1:], strict=True)]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([fit(rows).tobytes()], pa.binary())], names=["model"])


def scorer(model: bytes | None) -> Callable[[Column], Column]:
    """A column function: the score of a text by the fitted numbers."""

    def scores(text: pa.Array) -> pa.Array:
        all_ = np.frombuffer(model, np.float32).astype(np.float64) if model else np.zeros((1 << BITS) + 1)
        of, bias = all_[:-1], all_[-1]
        out = []
        for batch in pieces([pa.RecordBatch.from_arrays([text], names=["text"])], limit=PIECE):
            n = total = np.zeros(len(batch))
            for bucket, row in features(*flat(batch.column("text"))):
                total = total + np.bincount(row, of[bucket], len(batch))
                n = n + np.bincount(row, minlength=len(batch))
            out.append(1 / (1 + np.exp(-(total / np.maximum(n, 1) + bias))))
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return F.arrow_udf(scores, DoubleType())


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> bytes | None:
    """A model from labels(doc_id, label): the bytes of fit()'s numbers, about a megabyte; None without labels."""
    shared.session(docs)
    labels = shared.columns(labels, doc_id="long", label="int").where("label in (0, 1) and doc_id is not null")
    some = labels.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    texts = shared.documents(docs).join(F.broadcast(some) if sample <= SAMPLE else some, "doc_id").select("label", F.xxhash64("doc_id", "text").alias("nth"), "text")
    found = shared.settle(texts.mapInArrow(_featured, FEATURES)).orderBy("nth", "label").limit(sample).mapInArrow(_fitted, "model binary").collect()
    return found[0][0] if found else None


def score(docs: DataFrame, model: bytes | None, *keep: Column) -> DataFrame:
    """docs' columns `keep` and the score of every whole text."""
    shared.session(docs)
    return docs.select(*keep, scorer(model)(F.col("text").cast("string")).alias("score"))
