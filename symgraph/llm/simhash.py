"""SimHash near-duplicates, compared bit-sliced.

A document's signature is 128 bits: for each bit, whether most of its distinct words have it set in their hash. Documents of equal
signature are one group at once. The others are found by bit sampling: a few tables, each keyed by some sampled bits; how many bits and
tables follows from the number of signatures, so that a bucket stays small and, at any number, a pair at the very radius is met with probability
RECALL or more; expected_recall() gives it by distance (at half the radius it is 0.9999). Every document is a query: within a bucket, each is compared with
every later one. A bucket of more than HOT signatures is spread over blocks, each pair of blocks a bucket of its own.

The comparison is vertical. 64 signatures of a bucket make a block, stored as 128 bit planes of 64 lanes; a query flips a plane where its
own bit is set, and the planes run through carry-save adders into bitwise counters, which holds 64 distances at once. After every 16
planes, lanes beyond the radius die, and a block whose lanes are all dead is abandoned. A bucket gives a spanning forest of its matches,
at most one edge for each member, so a bucket of thousands of copies stays linear in output; components are then united over all tables.

Defined results for odd input:
* null text, or text without a word: no signature, never a duplicate; a null doc_id can't be named, so it is never a duplicate either;
* very long texts are read whole;
* ties: of each group, the least doc_id is kept; a bit set in exactly half of the words is 0;
* rows that repeat a doc_id are one document: keep_documents() keeps one of them (the one of least text), near_duplicates() says nothing of them;
* an empty table gives an empty result;
* extra columns pass through keep_documents(), whatever they are called.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BITS = 128
#: Largest distance of a near copy.
RADIUS = 18
#: Least chance that a pair at the radius shares a bucket.
RECALL = 0.99
#: Signatures in a bucket, on average, if they were random.
BUCKET = 64
PAIRS_AT_ONCE = 1 << 14
ROWS_AT_ONCE = 1 << 14
WORDS_AT_ONCE = 1 << 14
#: Signatures of a bucket that a task compares at once.
HOT = 1 << 16

_WORD = re.compile(r"\w+")


def signature(text: str | None) -> bytes | None:
    """16 bytes, or None where there is no word."""
    words = list(set(_WORD.findall(text.lower()))) if text else []
    if not words:
        return None
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(words), WORDS_AT_ONCE):
        raw = b"".join(map(xxhash.xxh3_128_digest, words[i : i + WORDS_AT_ONCE]))
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 16), axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > len(words)).tobytes()


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(i, s) for i, t in zip(batch["doc_id"].to_pylist(), batch["text"]) if (s := signature(t.as_py())) is not None]
        halves = np.frombuffer(b"".join(s for _, s in found), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1])], ["doc_id", "h0", "h1"])


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, h0, h1) of the documents that have a signature and an id."""
    d = docs.select(common.col("doc_id").cast("long").alias("doc_id"), common.col("text").alias("text")).where("doc_id IS NOT NULL")
    return d.mapInArrow(_signatures, "doc_id long, h0 long, h1 long")


def _agree(k: int, distance: int) -> float:
    """The chance that k different bits are none of those in which two signatures differ."""
    return math.comb(BITS - distance, k) / math.comb(BITS, k)


def plan(n: int, radius: int = RADIUS, recall: float = RECALL) -> list[np.ndarray]:
    """The bits that each table samples, for n signatures."""
    k = max(8, math.ceil(math.log2(max(n, 1) / BUCKET))) if n > BUCKET else 8
    tables = math.ceil(math.log(1 - recall) / math.log(1 - _agree(k, radius)))
    rng = np.random.default_rng(20)
    return [np.sort(rng.choice(BITS, k, replace=False)) for _ in range(tables)]


def expected_recall(n: int, distance: int, radius: int = RADIUS, recall: float = RECALL) -> float:
    """The chance that two of n signatures, this far apart, share a bucket."""
    tables = plan(n, radius, recall)
    return 1 - (1 - _agree(len(tables[0]), distance)) ** len(tables)


def _unpack(h0: np.ndarray, h1: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.stack([h0, h1], axis=1).view(np.uint8), axis=1)


def _csa(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def _add16(state: list[np.ndarray], d: list[np.ndarray]) -> list[np.ndarray]:
    """Adds 16 planes to the vertical counters state (least bit first), by a tree of carry-save adders."""
    carry = d
    out = []
    for s in state[:4]:
        up = []
        for i in range(0, len(carry), 2):
            s, c = _csa(s, carry[i], carry[i + 1])
            up.append(c)
        out.append(s)
        carry = up
    c = carry[0]
    for s in state[4:]:
        out.append(s ^ c)
        c = s & c
    return out


def _beyond(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count is over radius."""
    over = np.zeros_like(counter[0])
    equal = ~over
    for i in reversed(range(len(counter))):
        if radius >> i & 1:
            equal &= counter[i]
        else:
            over |= equal & counter[i]
            equal &= ~counter[i]
    return over


def matches(bits: np.ndarray, starts: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs (i < j) within radius, both in the same bucket. bits: a row of 0 and 1 for each signature; starts: first row of each bucket, and the end."""
    sizes = np.diff(starts)
    n_blocks = -(-sizes // 64)
    first_block = np.concatenate([[0], np.cumsum(n_blocks)])
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(bits)) - starts[bucket]
    block, lane = first_block[bucket] + place // 64, place % 64
    padded = np.zeros((first_block[-1] * 64, BITS), np.uint8)
    padded[block * 64 + lane] = bits
    planes = np.ascontiguousarray(np.packbits(padded.reshape(-1, 64, BITS), axis=1, bitorder="little").transpose(2, 0, 1)).view(np.uint64)[:, :, 0]
    filled = np.zeros(first_block[-1] * 64, np.uint8)
    filled[block * 64 + lane] = 1
    valid = np.packbits(filled.reshape(-1, 64), axis=1, bitorder="little").view(np.uint64)[:, 0]
    row_of = np.zeros(first_block[-1] * 64, np.int64)
    row_of[block * 64 + lane] = np.arange(len(bits))
    flips = np.ascontiguousarray((0 - bits.T.astype(np.int64)).view(np.uint64))
    each = first_block[bucket + 1] - block  # a query meets its own block and the later ones
    ends = np.cumsum(each)
    left, right = [], []
    row = 0
    while row < len(bits):
        stop = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + PAIRS_AT_ONCE, "right")))
        count = each[row:stop]
        q = np.repeat(np.arange(row, stop), count)
        b = block[q] + np.arange(len(q)) - np.repeat(np.cumsum(count) - count, count)
        own = b == block[q]
        later = np.where(own, ~np.uint64(0) << np.minimum(lane[q] + 1, 63).astype(np.uint64), ~np.uint64(0))
        later[own & (lane[q] == 63)] = 0
        alive = valid[b] & later
        state = [np.zeros(len(q), np.uint64) for _ in range(8)]
        for p in range(0, BITS, 16):
            go = np.flatnonzero(alive)
            if len(go) < len(alive):
                q, b, alive, state = q[go], b[go], alive[go], [s[go] for s in state]
            if not len(q):
                break
            state = _add16(state, [planes[i][b] ^ flips[i][q] for i in range(p, p + 16)])
            if p + 16 > radius:
                alive = alive & ~_beyond(state, radius)
        if go := np.flatnonzero(alive).tolist():
            hit, at = np.nonzero(np.unpackbits(alive[go].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            left.append(q[go][hit])
            right.append(row_of[b[go][hit] * 64 + at])
        row = stop
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def forest(n: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, least row it is connected to) for rows where these differ."""
    root = np.arange(n)
    while True:
        a, b = root[left], root[right]
        differ = a != b
        if not differ.any():
            break
        np.minimum.at(root, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
        while (root != (up := root[root])).any():
            root = up
    rows = np.flatnonzero(root != np.arange(n))
    return rows, root[rows]


def _keyed(tables: list[np.ndarray]):
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, h0, h1 = (batch[c].to_numpy() for c in ("id", "h0", "h1"))
            bits = _unpack(h0, h1)
            for t, sample in enumerate(tables):
                key = bits[:, sample].astype(np.int64) @ (1 << np.arange(len(sample), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(key * len(tables) + t), pa.array(ids), pa.array(h0), pa.array(h1)], ["key", "id", "h0", "h1"])

    return keyed


def _compared(radius: int):
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in common.whole_groups(batches, "key", ROWS_AT_ONCE):
            key, ids, h0, h1 = (rows[c].to_numpy() for c in ("key", "id", "h0", "h1"))
            starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
            a, b = forest(len(ids), *matches(_unpack(h0, h1), starts, radius))
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

    return compared


def near_duplicates(docs: DataFrame, radius: int = RADIUS, recall: float = RECALL, hot: int = HOT) -> DataFrame:
    """(doc_id, duplicate_of) for every document but the first of each group; duplicate_of is the least doc_id of its group."""
    sig = common.materialize(signatures(docs), "simhash-signatures")
    reps = common.materialize(sig.groupBy("h0", "h1").agg(F.min("doc_id").alias("id")), "simhash-distinct")
    tables = plan(reps.count(), radius, recall)
    keyed = common.blocked(reps.mapInArrow(_keyed(tables), "key long, id long, h0 long, h1 long"), "key", "id", hot)
    edges = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_compared(radius), "a long, b long")
    roots = common.connected_components(edges, "simhash-components")
    first = reps.join(roots, "id", "left").select("h0", "h1", F.coalesce("root", "id").alias("duplicate_of"))
    out = common.materialize(sig.join(first, ["h0", "h1"]).where("doc_id <> duplicate_of").select("doc_id", "duplicate_of").distinct(), "simhash-copies")
    for t in (sig, reps):
        common.drop_table(t)
    return out


def keep_documents(docs: DataFrame, radius: int = RADIUS, recall: float = RECALL) -> DataFrame:
    """docs with one document of each group of near copies."""
    drop = near_duplicates(docs, radius, recall).select(F.col("doc_id").alias("drop_id"))
    again = common.materialize(docs.groupBy(common.col("doc_id").alias("again_id")).count().where("count > 1 AND again_id IS NOT NULL").select("again_id"), "simhash-again")
    row = docs.select(F.struct(*(common.col(c) for c in docs.columns)).alias("row"))
    kept = row.join(common.bounded_broadcast(drop, drop.count()), F.col("row.doc_id") == F.col("drop_id"), "left_anti")
    n = again.count()
    if n:
        some = common.bounded_broadcast(again, n)
        one = Window.partitionBy("row.doc_id").orderBy(F.col("row.text"))
        repeated = kept.join(some, F.col("row.doc_id") == F.col("again_id"), "left_semi").withColumn("nth", F.row_number().over(one)).where("nth = 1").select("row")
        kept = kept.join(some, F.col("row.doc_id") == F.col("again_id"), "left_anti").union(repeated)
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read(spark, sf_dir, "documents"))
