"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

A text's features are its words and punctuation runs, its bigrams, and how often a word comes again at once or after one other, hashed
into buckets; a feature's value is the root of its share. Training is FTRL-proximal on the driver over a bounded sample of labelled
documents; most weights stay exactly 0. Scoring is a sparse dot product.

Defined results for odd input:
* null or empty text, or text of blanks only: score 0, not kept;
* very long texts: every word counts;
* no usable labels: every other text has score 0.5 and is kept (a tie at the threshold is kept);
* repeated rows are scored alike; an empty table gives an empty one; null doc_ids are scored, too; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common, labelled

BUCKETS = 1 << 20
#: Labelled documents to train on, at most.
MAX_TRAINING = 4000
EPOCHS = 4
THRESHOLD = 0.5
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01
#: Distinct words remembered by a worker; beyond it, it starts over.
REMEMBERED = 1 << 20

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_AGAIN = (BUCKETS - 1, BUCKETS - 2)
_hashes: dict[str, int] = {}


def features(texts: list[str | None]) -> list[labelled.Features]:
    """For each text its buckets and their values."""
    out = []
    if len(_hashes) > REMEMBERED:
        _hashes.clear()
    for text in texts:
        tokens = _TOKEN.findall(text.lower()) if text else []
        for t in set(tokens).difference(_hashes):
            _hashes[t] = crc32(t.encode())
        h = np.array(list(map(_hashes.__getitem__, tokens)), np.uint64)
        n = len(h)
        pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) >> np.uint64(20)
        # the last two buckets are the repetition counters'
        index, count = np.unique(np.concatenate([h, pairs]) % np.uint64(BUCKETS - 2), return_counts=True)
        again = np.array([(h[k:] == h[:-k]).sum() for k in (1, 2)])
        hit = again > 0
        index = np.concatenate([index.astype(np.int64), np.array(_AGAIN)[hit]])
        out.append((index, np.sqrt(np.concatenate([count, again[hit]]) / max(n, 1))))
    return out


def train(rows: list[labelled.Features], y: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float]:
    """(weight of each bucket, bias)."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    rng = np.random.default_rng(seed)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    rows = [(np.append(i, BUCKETS), np.append(v, 1.0).astype(np.float64)) for i, v in rows]  # the last is the bias
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            i, v = rows[k]
            zi, ni = z[i], n[i]
            w = weights(zi, ni)
            g = (1 / (1 + np.exp(-np.clip(w @ v, -30, 30))) - y[k]) * v
            after = ni + g * g
            z[i] = zi + g - (np.sqrt(after) - np.sqrt(ni)) / ALPHA * w
            n[i] = after
    w = weights(z, n)
    return w[:BUCKETS].astype(np.float32), float(w[BUCKETS])


def scores(texts: list[str | None], weights: np.ndarray, bias: float) -> np.ndarray:
    """The probability of good quality for each text."""
    return np.array([1 / (1 + np.exp(-np.clip(weights[i] @ v + bias, -30, 30))) if len(i) else 0.0 for i, v in features(texts)], np.float64)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = MAX_TRAINING) -> DataFrame:
    """(doc_id, quality, keep) for each row of docs; trained on at most `most` rows of labels (doc_id, quality)."""
    shared = docs.sparkSession.sparkContext.broadcast(train(*labelled.sample(docs, labels, "quality", features, most)[:2]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                p = scores(part["text"].to_pylist(), weights, bias)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(p), pa.array((p >= threshold) & (p > 0))], ["doc_id", "quality", "keep"])

    return docs.select(common.col("doc_id").cast("long").alias("doc_id"), common.col("text").alias("text")).mapInArrow(run, "doc_id long, quality double, keep boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
