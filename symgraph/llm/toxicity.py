"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly.

A word is the mean of the vectors of itself and its character n-grams, hashed into buckets; a text is the mean of its words (and of PAD empty ones); a linear
softmax over {clean, toxic} reads it. Vectors and softmax are trained together, in numpy on the driver, on a bounded sample of labelled
documents. Since everything before the softmax is a mean, a trained model is one number for each bucket: a word's score is the mean over
its buckets, a text's logit the mean over its words. An unseen misspelling shares most of its n-grams with the word it stands for.

Defined results for odd input:
* null or empty text, or text without a word: score 0 and not toxic;
* very long texts: every word counts;
* no usable labels, or labels of one class only: the score is that class's share (0 without labels);
* ties at the threshold are toxic; repeated rows are scored alike; an empty table gives an empty one; null doc_ids are scored, too;
* extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common, labelled

BUCKETS = 1 << 18
DIMENSION = 16
N_GRAMS = (3, 4, 5)
#: Labelled documents to train on, at most.
MAX_TRAINING = 10_000
EPOCHS = 8
#: What Adagrad's sums begin with: about that of a hundred updates, so that a word which only one text has isn't learned as the reason for its label.
FIRST_SUM = 1e-5
RATE = 1.0
#: Part of a vector that goes at each update.
DECAY = 1e-3
THRESHOLD = 0.5
#: Empty words in each mean: a few odd words in a very short text don't decide.
PAD = 8
#: Distinct words remembered by a worker; beyond it, it starts over.
REMEMBERED = 1 << 20

_WORD = re.compile(r"\w+")
_PRIME = np.uint64(0x100000001B3)


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(32))) % np.uint64(BUCKETS)).astype(np.int64)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, number of the word) for each word itself and each of its character n-grams, with < and > at its ends."""
    chars = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], np.int64)
    first = np.cumsum(size) - size
    word = np.repeat(np.arange(len(words)), size)
    left = np.repeat(first + size, size) - np.arange(len(chars))  # characters up to the word's end
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(size.max(initial=1)) - 1, _PRIME)]))
        whole = np.add.reduceat(chars * powers[np.repeat(size, size) - left], first) if len(words) else np.zeros(0, np.uint64)
        found = [(_bucket(whole * _PRIME + np.uint64(1)), np.arange(len(words)))]
        h = chars
        for n in range(2, max(N_GRAMS) + 1):
            if len(chars) < n:
                break
            h = h[: len(chars) - n + 1] * _PRIME + chars[n - 1 :]
            if n in N_GRAMS:
                at = np.flatnonzero(left[: len(h)] >= n)
                found.append((_bucket(h[at] + np.uint64(n)), word[at]))
    return np.concatenate([b for b, _ in found]), np.concatenate([w for _, w in found])


def features(texts: list[str]) -> list[labelled.Features]:
    """For each text its distinct words and the weight of each in the mean."""
    out = []
    for text in texts:
        count = Counter(_WORD.findall(text.lower()))
        out.append((np.array(list(count), object), np.array(list(count.values()), np.float32) / (sum(count.values()) + PAD)))
    return out


def train(rows: list[labelled.Features], y: np.ndarray, words: list[str], epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> tuple[np.ndarray, float]:
    """(score of each bucket, bias): the logit of toxic over clean is their weighted sum. Adagrad on the softmax loss with a falling rate and decaying vectors, both classes weighing the same."""
    known = np.array([len(i) > 0 for i, _ in rows], bool)
    rows, y = [r for r, k in zip(rows, known) if k], y[known].astype(int) if len(y) else y.astype(int)
    if len(set(y.tolist())) < 2:
        return np.zeros(BUCKETS, np.float32), (np.inf if len(y) and y[0] else -np.inf)
    parts = [subwords(words[i : i + 50_000]) for i in range(0, len(words), 50_000)]
    bucket = np.concatenate([b[np.argsort(w, kind="stable")].astype(np.int32) for b, w in parts])
    size = np.concatenate([np.bincount(w) for _, w in parts])
    del parts
    first = np.cumsum(size) - size
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (BUCKETS, DIMENSION)).astype(np.float32)
    seen = np.full(BUCKETS, FIRST_SUM, np.float32)
    soft = rng.normal(0, 0.1, (DIMENSION, 2)).astype(np.float32)
    soft_seen = np.full((DIMENSION, 2), 1e-8, np.float32)
    bias, bias_seen = np.zeros(2, np.float32), np.full(2, 1e-8, np.float32)
    weight = len(y) / (2 * np.bincount(y, minlength=2))
    start = rate
    for epoch in range(epochs):
        rate = start * (1 - epoch / epochs)
        for k in rng.permutation(len(rows)):
            own_words = rows[k][0]
            n = size[own_words]
            flat = bucket[np.repeat(first[own_words] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            index, inverse = np.unique(flat, return_inverse=True)
            share = np.bincount(inverse, np.repeat(rows[k][1] / n, n)).astype(np.float32)
            own = vectors[index]
            hidden = share @ own
            z = hidden @ soft + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[k]] -= 1
            p *= weight[y[k]]
            back = soft @ p
            g = np.outer(hidden, p)
            soft_seen += g * g
            soft -= rate * g / np.sqrt(soft_seen)
            bias_seen += p * p
            bias -= rate * p / np.sqrt(bias_seen)
            seen[index] += share * share * (back @ back)
            vectors[index] = (1 - DECAY) * own - (rate * share / np.sqrt(seen[index]))[:, None] * back
    return vectors @ (soft[:, 1] - soft[:, 0]), float(bias[1] - bias[0])


class Scorer:
    def __init__(self, buckets: np.ndarray, bias: float):
        self.buckets, self.bias = buckets, bias
        self.words: dict[str, float] = {}

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The probability of toxic for each text."""
        found = [_WORD.findall(t.lower()) if t else [] for t in texts]
        words = self.words
        if len(words) > REMEMBERED:
            words.clear()
        new = list({w for own in found for w in own if w not in words})
        if new:
            bucket, word = subwords(new)
            words.update(zip(new, (np.bincount(word, self.buckets[bucket]) / np.bincount(word)).tolist()))
        look = words.__getitem__
        logit = np.array([sum(map(look, own)) / (len(own) + PAD) + self.bias if own else -np.inf for own in found])
        return 1 / (1 + np.exp(-np.clip(logit, -700, 700))) * (logit > -np.inf)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = MAX_TRAINING) -> DataFrame:
    """(doc_id, toxicity, is_toxic) for each row of docs; trained on at most `most` rows of labels (doc_id, toxic)."""
    model = train(*labelled.sample(docs, labels, "toxic", features, most, named=True))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                p = scorer.scores(part["text"].to_pylist())
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(p, pa.float64()), pa.array(p >= threshold)], ["doc_id", "toxicity", "is_toxic"])

    return docs.select(common.col("doc_id").cast("long").alias("doc_id"), common.col("text").alias("text")).mapInArrow(run, "doc_id long, toxicity double, is_toxic boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
