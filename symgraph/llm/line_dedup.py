"""Line dedup by an exact set-similarity join: a line goes if an earlier one has nearly the same set of words.

A line's words are its lower-cased strings between blanks; two lines match when the Jaccard index of their word sets is SIMILARITY or
more. Lines are ordered by (doc_id, position); a line is removed when any earlier line matches it, whether that one stays or not.

1. Words are counted over all lines, in a table of hashed counters of fixed size; a word's rarity is a step of its counter, then its hash.
   Sharing counters only makes the order less sharp: it is the same order for every line, so the join stays exact.
2. Each line's words are put in that order. Lines of equal word set become one (their first occurrence; the others are removed).
3. Prefix filter: two sets can only match if they share one of their first n - ceil(s n) + 1 words. The prefixes are sorted by word; within a
   word, lines stand by length, so that the length filter is a window. Pairs in the window pass the positional filter (the words left after
   the shared one must suffice) and a parity filter (bits, each the parity of the words that hash to it: every bit in which two sets differ
   is a word they don't share; longer lines have more of them). All of that runs over Arrow batches in numpy. A word with more than HOT lines is
   spread over blocks, each pair of blocks a group of its own, so no task holds all of its lines.
4. Of a line's earlier candidates the CANDIDATES likeliest of each word (fewest parities apart) are verified on their full sets, so a passage that stands
   everywhere gives each of its lines a few candidates, not all pairs. Where these fail and there were more, all others are verified in a second
   round over the postings of those lines' words. The result is that of all pairs, as one match is enough.

Words are separated by ASCII blanks and compared by 64-bit hashes, lines of equal sets by 128-bit ones.

Defined results for odd input:
* null text stays null, with no line; empty text and blank lines are never removed (an empty set matches nothing);
* very long texts and lines are read whole; lines end at \\n;
* a null doc_id comes after all others; rows that repeat a doc_id and its text are the same document: their lines don't match each other as
  earlier and later, and are removed or kept alike; rows that repeat a doc_id with another text are ordered by the hash of the text;
* an empty table gives an empty one; extra columns pass through clean_documents() untouched, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SIMILARITY = Fraction(17, 20)
COUNTERS = 1 << 18
#: Steps of rarity for each doubling of a counter.
STEPS = 6
#: A table of candidate lines has 64 bits for each, up to this many bits; for more candidates the documents are joined instead.
MOST_BITS = 1 << 29
#: Likeliest earlier lines that are verified at first, for each line and word.
CANDIDATES = 4
#: Lines of a word that a task compares at once.
HOT = 1 << 16
ROWS_AT_ONCE = 1 << 16
PAIRS_AT_ONCE = 1 << 17
DOCS_AT_ONCE = 128
BYTES_AT_ONCE = 1 << 17
LINES_AT_ONCE = 1 << 12

#: A line's number has at most ID_BITS bits (those of monotonically_increasing_id() over 2 ** 23 partitions), the low POS_BITS for its position where that fits.
ID_BITS = 56
POS_BITS = 21

_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\r\f")] = True
_RANDOM = np.random.default_rng(5).integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_RANDOM[65:91] = _RANDOM[97:123]  # capital letters count as small ones
_BASE = 0x9E3779B97F4A7C15
_FIELDS = ["doc_id", "doc", "pos", "k1", "k2", "copy", "n", "bits", "prefix", "hot"]
_LINES = "doc_id long, doc long, pos int, k1 long, k2 long, copy boolean, n int, bits binary, prefix array<long>, hot array<long>"
#: 64 parities say little of a set of more words than this (most of them are odd by chance): larger sets have LONGER times the parities, much larger ones again.
FEW_WORDS = 96
LONGER = 4


def overlap_for(n: np.ndarray | int, s: Fraction):
    """Words that a set of n must share with any match."""
    return -(-n * s.numerator // s.denominator)


def _mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    h = (h ^ np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class _Powers:
    """Powers of an odd base modulo 2**64, and of its inverse, as far as they were needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            back = pow(_BASE, -1, 1 << 64)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]), dtype=np.uint64) for base in (_BASE, back))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts, lower-cased, and the line each stands in, lines being counted through. All at once: a word's hash is the difference of two prefix sums of a polynomial, shifted back."""
    raw = np.frombuffer("\n".join([t if t.isascii() else t.lower() for t in texts]).encode(), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    blank = _BLANK[raw]
    edge = np.flatnonzero(np.concatenate([[~blank[0]], blank[1:] != blank[:-1], [~blank[-1]]]))
    start, end = edge[::2], edge[1::2]
    up, down = _powers.upto(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    step = _RANDOM[raw]
    step *= up
    np.cumsum(step, out=total[1:])
    h = total[end] - total[start]
    h *= down[start]
    return _mix(h, 0xA5), np.searchsorted(np.flatnonzero(raw == 10), start)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[list, list, list[str]]]:
    """Runs of rows (doc_ids, docs, texts) of about BYTES_AT_ONCE; a longer text is a run of its own."""
    ids, docs, texts, size, lines = [], [], [], 0, 0
    for doc_id, doc, text in (row for i in range(0, batch.num_rows, DOCS_AT_ONCE) for row in zip(*(batch[c].slice(i, DOCS_AT_ONCE).to_pylist() for c in ("doc_id", "doc", "text")))):
        more = text.count("\n") + 1
        if texts and (size + len(text) > BYTES_AT_ONCE or lines + more > LINES_AT_ONCE):
            yield ids, docs, texts
            ids, docs, texts, size, lines = [], [], [], 0, 0
        ids.append(doc_id)
        docs.append(doc)
        texts.append(text)
        size += len(text)
        lines += more
    if texts:
        yield ids, docs, texts


def _identified(docs: DataFrame) -> DataFrame:
    d = docs.select(common.col("doc_id").cast("long").alias("doc_id"), common.col("text").alias("text")).where("text IS NOT NULL")
    return d.withColumn("doc", F.xxhash64("doc_id", "text"))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        at = [(hashed_words(texts)[0] % np.uint64(COUNTERS)).astype(np.int32) for _, _, texts in _chunks(batch)]
        if at:
            total += np.bincount(np.concatenate(at), minlength=COUNTERS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["c", "n"])


def rarity_steps(docs: DataFrame) -> np.ndarray:
    """The step of rarity of each counter: STEPS for each doubling of the number of words, over all lines, that fall to it."""
    rows = docs.mapInArrow(_count, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.int64)
    out[rows["c"].to_numpy()] = rows["n"].to_numpy()
    return np.minimum(255, STEPS * np.log2(out + 1)).astype(np.uint64)


def ordered_sets(h: np.ndarray, line: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, lines) of each line's distinct words, by line and then from the rarest on: by step, then by hash."""
    step = steps[(h % np.uint64(COUNTERS)).astype(np.int64)]
    key = (line.astype(np.uint64) << np.uint64(44)) | (step << np.uint64(36)) | (h >> np.uint64(28))
    order = np.argsort(key) if int(line[-1] if len(line) else 0) < 1 << 20 else np.lexsort((h, step, line))
    key, hs, ls = key[order], h[order], line[order]
    if ((key[1:] == key[:-1]) & (hs[1:] != hs[:-1])).any():  # the key doesn't have all bits of the hash
        order = np.lexsort((h, step, line))
        hs, ls = h[order], line[order]
    new = np.ones(len(hs), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (ls[1:] != ls[:-1])
    return hs[new], ls[new]


def _parities(hashes: np.ndarray, n: np.ndarray, at: np.ndarray) -> pa.Array:
    """The parities of each set, in 1, LONGER or LONGER ** 2 64-bit words, as bytes. hashes: of all words; n, at: number of each set's words, and the first."""
    size = np.where(n > FEW_WORDS * LONGER, LONGER**2, np.where(n > FEW_WORDS, LONGER, 1))
    ends = np.concatenate([[0], np.cumsum(size)])
    where = np.repeat(ends[:-1], n) + ((hashes >> np.uint64(6)) & np.repeat(size - 1, n).astype(np.uint64)).astype(np.int64)
    bit = np.uint64(1) << (hashes & np.uint64(63))
    out = np.zeros(ends[-1], np.uint64)
    if size.max(initial=1) == 1:
        out[:] = np.bitwise_xor.reduceat(bit, at)
    else:
        order = np.argsort(where, kind="stable")
        where, bit = where[order], bit[order]
        first = np.flatnonzero(np.diff(where, prepend=-1))
        out[where[first]] = np.bitwise_xor.reduceat(bit, first)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((8 * ends).astype(np.int32)), pa.py_buffer(out)])


def _lists(values: np.ndarray, length: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(values))


def _prefixes(shared, s: Fraction, hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = shared.value
        heavy = np.uint64(STEPS * np.log2(hot + 1))
        for batch in batches:
            for ids, docs, texts in _chunks(batch):
                h, line = ordered_sets(*hashed_words(texts), steps)
                if not len(h):
                    continue
                at = np.flatnonzero(np.diff(line, prepend=-1))
                n = np.diff(at, append=len(h))
                k1, k2 = (np.add.reduceat(_mix(h, salt), at).view(np.int64) for salt in (0x11, 0x22))
                n_lines = np.array([t.count("\n") + 1 for t in texts])
                before = np.cumsum(n_lines) - n_lines
                row = np.searchsorted(before, line[at], "right") - 1
                pos = line[at] - before[row]
                known = np.array([i is not None for i in ids])[row]
                own = np.array([i or 0 for i in ids], np.int64)[row]
                doc = np.array(docs, np.int64)[row]
                # of lines with the same set in this run, all but the first are copies
                order = np.lexsort((pos, doc, own, ~known, k2, k1))
                same = (k1[order][1:] == k1[order][:-1]) & (k2[order][1:] == k2[order][:-1])
                lead = order[np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(order)), 0))]
                copy = np.zeros(len(at), bool)
                copy[order] = (doc[order] != doc[lead]) | (pos[order] != pos[lead])  # a repeated row's line is the same line
                length = np.where(copy, 0, n - overlap_for(n, s) + 1)
                before = np.cumsum(length) - length
                words = h[np.repeat(at - before, length) + np.arange(length.sum())]
                much = steps[(words % np.uint64(COUNTERS)).astype(np.int64)] >= heavy
                n_much = np.bincount(np.repeat(np.arange(len(at)), length)[much], minlength=len(at))
                arrays = [pa.array(own, mask=~known), pa.array(doc), pa.array(pos.astype(np.int32)), pa.array(k1), pa.array(k2), pa.array(copy), pa.array(n.astype(np.int32)), _parities(_mix(h, 0x33), n, at), _lists(words.view(np.int64), length), _lists(words[much].view(np.int64), n_much)]
                yield pa.RecordBatch.from_arrays(arrays, _FIELDS)

    return run


def _apart(flat: np.ndarray, size: np.ndarray):
    """A function of two arrays of rows: in how many parities each two differ, of as many as both have. Fewer parities are the sums of more."""
    at = np.cumsum(size) - size
    levels, fold = [], None
    for words in (LONGER**2, LONGER):
        rows = np.flatnonzero(size >= words)
        number = np.zeros(len(size), np.int64)
        number[rows] = np.arange(len(rows))
        own = np.zeros((len(rows), words), np.uint64)
        if fold is not None:
            own[number[fold[0]]] = np.bitwise_xor.reduce(fold[1].reshape(-1, LONGER, words), axis=1)
        exact = np.flatnonzero(size == words)
        own[number[exact]] = flat[at[exact][:, None] + np.arange(words)]
        fold = rows, own
        levels.append((words, number, own))
    one = np.bitwise_xor.reduceat(flat, at) if len(at) else flat

    def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.bitwise_count(one[x] ^ one[y]).astype(np.int64)
        both = np.minimum(size[x], size[y])
        for words, number, own in levels:
            some = np.flatnonzero(both == words)
            if len(some):
                out[some] = np.bitwise_count(own[number[x[some]]] ^ own[number[y[some]]]).sum(axis=1)
        return out

    return apart


def pairs_of(key: np.ndarray, ids: np.ndarray, n: np.ndarray, p: np.ndarray, flat: np.ndarray, size: np.ndarray, s: Fraction) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(earlier id, later id, parities apart) of postings of one key that pass all filters, a run of pairs at a time. key: sorted; flat, size: words of parities, and how many each posting has."""
    up, down = s.numerator, s.denominator
    group = np.cumsum(np.diff(key, prepend=key[:1] - 1) != 0) - 1
    order = np.argsort((group << 32) | n, kind="stable")
    ids, n, p, group = ids[order], n[order], p[order], group[order]
    apart = _apart(flat[np.repeat((np.cumsum(size) - size)[order] - np.cumsum(size[order]) + size[order], size[order]) + np.arange(len(flat))], size[order])
    # of a group, the lines from here to that of the greatest fitting length
    past = np.searchsorted((group << 32) | n, (group << 32) | (n * down // up), "right")
    count = past - np.arange(len(n)) - 1
    ends = np.cumsum(count)
    row = 0
    while row < len(n):
        stop = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + PAIRS_AT_ONCE, "right")))
        x = np.repeat(np.arange(row, stop), count[row:stop])
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(count[row:stop]) - count[row:stop], count[row:stop])
        row = stop
        both = n[x] + n[y]
        go = np.flatnonzero((np.minimum(n[x] - p[x], n[y] - p[y]) * (up + down) >= up * both) & (ids[x] != ids[y]))
        x, y, both = x[go], y[go], both[go]
        d = apart(x, y)
        go = np.flatnonzero(d * (up + down) <= (down - up) * both)
        x, y = x[go], y[go]
        yield np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y]), d[go]


def _distinct(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs without repetition, by b, then from the likeliest a on."""
    order = np.lexsort((a, d, b))
    a, b, d = a[order], b[order], d[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new], d[new]


def _candidates(s: Fraction, most: int | None):
    """Of postings by key: (a, b, more): pairs that may match, a the earlier line. At most `most` of each b in a run of groups: more says whether there were others.
    Without a bound: the pairs whose b is asked for."""

    def best(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, ...]:
        a, b, d = _distinct(a, b, d)
        first = np.flatnonzero(np.diff(b, prepend=-1))
        nth = np.arange(len(b)) - np.repeat(first, np.diff(first, append=len(b)))
        more = np.repeat(np.diff(first, append=len(b)) > most, np.diff(first, append=len(b)))
        keep = nth < most
        return a[keep], b[keep], d[keep], more[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in common.whole_groups(batches, "key", ROWS_AT_ONCE):
            key = rows["key"].to_numpy()
            with_others = np.zeros(len(key), bool)
            with_others[1:] = key[1:] == key[:-1]
            with_others[:-1] |= with_others[1:]
            rows = rows.filter(pa.array(with_others))
            if not rows.num_rows:
                continue
            bits = rows["bits"].combine_chunks()
            ends = np.frombuffer(bits.buffers()[1], np.int32)[bits.offset : bits.offset + len(bits) + 1].astype(np.int64) // 8
            flat = np.frombuffer(bits.buffers()[2], np.uint64)[ends[0] : ends[-1]]
            np_ = rows["np"].to_numpy()
            asked = np.unique(rows["id"].filter(rows["asked"]).to_numpy()) if most is None else None
            a = b = d = np.zeros(0, np.int64)
            more: np.ndarray = np.zeros(0, bool)
            for x, y, apart in pairs_of(rows["key"].to_numpy(), rows["id"].to_numpy(), np_ >> 32, np_ & 0xFFFFFFFF, flat, np.diff(ends), s):
                if most is None:
                    x, y, apart = _distinct(*(v[np.isin(y, asked)] for v in (x, y, apart)))
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(np.zeros(len(x), bool))], ["a", "b", "more"])
                    continue
                had = np.unique(b[more])
                a, b, d, more = best(np.concatenate([a, x]), np.concatenate([b, y]), np.concatenate([d, apart]))
                more |= np.isin(b, had)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(more)], ["a", "b", "more"])

    return run


def _place(doc: np.ndarray, pos: np.ndarray, bits: int) -> np.ndarray:
    return _mix(doc.view(np.uint64) + pos.astype(np.uint64) * np.uint64(_BASE), 0x44) % np.uint64(bits)


def _bit_map(lines: DataFrame, n: int) -> np.ndarray:
    """A bit for each of the n lines (doc, pos), of a size bounded by MOST_BITS."""
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(16, (64 * n).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _place(batch["doc"].to_numpy(), batch["pos"].to_numpy(), bits)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int32)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["word", "b"])

    rows = lines.mapInArrow(run, "word int, b long").groupBy("word").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[rows["word"].to_numpy()] = rows["b"].to_numpy()
    return out.view(np.uint64)


def _sets(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bit_map = shared.value
        no_steps = np.zeros(COUNTERS, np.uint64)
        for batch in batches:
            for ids, docs, texts in _chunks(batch):
                n_lines = np.array([t.count("\n") + 1 for t in texts])
                before = np.cumsum(n_lines) - n_lines
                row = np.repeat(np.arange(len(texts)), n_lines)
                doc, pos = np.array(docs, np.int64)[row], np.arange(len(row)) - before[row]
                at = _place(doc, pos, 64 * len(bit_map))
                found = np.flatnonzero(bit_map[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1))
                if not len(found):
                    continue
                lines = "\n".join(texts).split("\n")
                h, line = ordered_sets(*hashed_words([lines[i] for i in found.tolist()]), no_steps)
                ends = np.searchsorted(line, np.arange(len(found) + 1)).astype(np.int32)
                known = np.array([i is not None for i in ids])[row[found]]
                own = np.array([i or 0 for i in ids], np.int64)[row[found]]
                arrays = [pa.array(own, mask=~known), pa.array(doc[found]), pa.array(pos[found].astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "doc", "pos", "words"])

    return run


def _numbered(d: DataFrame, sets: DataFrame) -> DataFrame:
    """sets with id, a number below 2 ** ID_BITS in the order of lines (doc_id, a null one last; then doc, pos). Where ids and positions are small
    and no doc_id is repeated they are packed into it; else the lines are sorted over ranges, and stored."""
    low, high, nulls = d.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.when(F.col("doc_id").isNull(), 1))).first()
    pos = sets.agg(F.max("pos")).first()[0]
    if pos is None or not nulls and low >= 0 and high < 1 << (ID_BITS - POS_BITS) and pos < 1 << POS_BITS and d.groupBy("doc_id").count().where("count > 1").isEmpty():
        return sets.withColumn("id", F.shiftleft(F.col("doc_id"), POS_BITS).bitwiseOR(F.col("pos").cast("long")))
    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("doc"), F.col("pos")]
    return common.materialize(sets.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()), "line-numbered")


def _words_of(d: DataFrame, sets: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, words) of the lines with these ids: read from the documents again, by a bit map of what is asked for; where that would be too full, by a join."""
    some = common.materialize(sets.select("id", "doc", "pos").join(ids, "id"), "line-candidates")
    n = some.count()
    if 64 * n <= MOST_BITS:
        asked = d
        bit_map = d.sparkSession.sparkContext.broadcast(_bit_map(some.select("doc", "pos"), n))
    else:
        asked = d.join(some.select("doc").distinct(), "doc", "left_semi")
        bit_map = d.sparkSession.sparkContext.broadcast(np.full(1, ~np.uint64(0)))  # every line of these
    full = asked.select("doc_id", "doc", "text").mapInArrow(_sets(bit_map), "doc_id long, doc long, pos int, words array<long>").drop("doc_id")
    out = common.materialize(full.join(some, ["doc", "pos"]).select("id", "words").dropDuplicates(["id"]), "line-words")
    common.drop_table(some)
    return out


def _postings(first: DataFrame, *more: str) -> DataFrame:
    return first.select("id", "bits", "n", F.posexplode("prefix").alias("p", "w"), *more).select("w", "id", "bits", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("p").cast("long")).alias("np"), *more)


def _blocks(postings: DataFrame, first: DataFrame, hot: int) -> DataFrame:
    """postings with key: the word, or for a word of many lines a pair of blocks of them. Only words that may be so frequent are counted."""
    words = first.where("size(hot) > 0").select(F.explode("hot").alias("key"))
    return common.blocked(postings.withColumnRenamed("w", "key"), "key", "id", hot, words)


def _met(postings: DataFrame, s: Fraction, most: int | None) -> DataFrame:
    found = postings.repartition("key").sortWithinPartitions("key").mapInArrow(_candidates(s, most), "a_id long, b_id long, more boolean")
    return common.materialize(found, "line-pairs")


def _verified(pairs: DataFrame, words: DataFrame, s: Fraction) -> DataFrame:
    """The (a_id, b_id) pairs whose sets match."""
    x, y = words.select(F.col("id").alias("a_id"), F.col("words").alias("a_words")), words.select(F.col("id").alias("b_id"), F.col("words").alias("b_words"))
    both = pairs.join(x, "a_id").join(y, "b_id")
    return both.where(f"size(array_intersect(a_words, b_words)) * {s.numerator + s.denominator} >= {s.numerator} * (size(a_words) + size(b_words))").select("a_id", "b_id")


def removed_lines(docs: DataFrame, similarity: Fraction = SIMILARITY, candidates: int = CANDIDATES, hot: int = HOT) -> DataFrame:
    """(doc, positions): the lines to remove of each document that has any; doc is xxhash64(doc_id, text)."""
    s, spark = Fraction(similarity), docs.sparkSession
    d = _identified(docs)
    steps = spark.sparkContext.broadcast(rarity_steps(d))
    lines = d.mapInArrow(_prefixes(steps, s, hot), _LINES)
    # copies known within a run are spread by document, so a line that is everywhere is no hot key
    lines = lines.withColumn("key", F.when(F.col("copy"), F.col("doc")).otherwise(F.col("k1")))
    nth = Window.partitionBy("key", "k1", "k2", "copy").orderBy(F.col("doc_id").isNull(), "doc_id", "doc", "pos")
    lines = lines.repartition("key").withColumn("nth", F.row_number().over(nth)).withColumn("rank", F.rank().over(nth))
    # of rows that are the same document, one speaks for all
    lines = lines.where("copy OR rank > 1 OR nth = 1").withColumn("first", F.expr("NOT copy AND nth = 1"))
    sets = lines.select("doc_id", "doc", "pos", "first", *(F.when(F.col("first"), F.col(c)).alias(c) for c in ("n", "bits", "prefix", "hot")))
    sets = common.materialize(sets, "line-sets")
    first = _numbered(d, sets.where("first").drop("first"))
    copies = sets.where("NOT first").select("doc", "pos")

    found = _met(_blocks(_postings(first), first, hot), s, candidates)
    pairs = common.materialize(found.select("a_id", "b_id").distinct(), "line-pairs")
    words = _words_of(d, first, pairs.selectExpr("a_id AS id").union(pairs.selectExpr("b_id AS id")).distinct())
    done = common.materialize(_verified(pairs, words, s).select("b_id").distinct(), "line-near")
    late = done
    rest = common.materialize(found.where("more").select("b_id").distinct().join(done, "b_id", "left_anti").withColumnRenamed("b_id", "id"), "line-rest")
    n_rest = rest.count()
    temporary = [sets, found, pairs, words, done, rest]
    if n_rest:
        # these are compared with every candidate: only postings of their own words are made again
        asked = first.join(common.bounded_broadcast(rest.withColumn("asked", F.lit(True)), n_rest), "id", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
        own = common.materialize(asked.where("asked").select(F.explode("prefix").alias("w")).distinct(), "line-asked")
        some = _postings(asked, "asked").join(common.bounded_broadcast(own, own.count()), "w", "left_semi")
        more = _met(_blocks(some, first, hot), s, None)
        others = common.materialize(more.select("a_id", "b_id").distinct().join(pairs, ["a_id", "b_id"], "left_anti"), "line-pairs")
        words = _words_of(d, first, others.selectExpr("a_id AS id").union(others.selectExpr("b_id AS id")).distinct())
        late = late.union(_verified(others, words, s).select("b_id")).distinct()
        temporary += [own, more, others, words]
    late = first.select("id", "doc", "pos").join(late.withColumnRenamed("b_id", "id"), "id").select("doc", "pos")
    out = common.materialize(copies.union(late).groupBy("doc").agg(F.collect_set("pos").alias("positions")), "line-removed")
    for t in temporary:
        common.drop_table(t)
    return out


@F.arrow_udf(T.StringType())
def _without(text: pa.Array, positions: pa.Array) -> pa.Array:
    def one(t: str | None, p: list[int] | None) -> str | None:
        if t is None or p is None:
            return t
        gone = set(p)
        return "\n".join([line for i, line in enumerate(t.split("\n")) if i not in gone])

    return pa.array((one(t.as_py(), p.as_py()) for t, p in zip(text, positions)), pa.string())


#: Said not to be deterministic, so that a filter on its result isn't pushed below it: it would run twice in each task, with a Python worker more.
_without = _without.asNondeterministic()


def _cleaned(docs: DataFrame, similarity: Fraction) -> DataFrame:
    """(row, text, n_removed): row is the document as it was."""
    removed = removed_lines(docs, similarity)
    d = docs.select(F.struct(*(common.col(c) for c in docs.columns)).alias("row"))
    d = d.withColumn("doc", F.xxhash64(F.col("row.doc_id").cast("long"), F.col("row.text")))
    d = d.join(removed, "doc", "left")  # what is removed grows with the documents: it isn't broadcast
    text = F.col("row.text")
    cleaned = _without(F.when(F.col("positions").isNotNull(), text), F.col("positions"))
    return d.select("row", F.when(F.col("positions").isNull(), text).otherwise(cleaned).alias("text"), F.coalesce(F.size("positions"), F.lit(0)).cast("long").alias("n_removed"))


def line_dedup(docs: DataFrame, similarity: Fraction = SIMILARITY) -> DataFrame:
    """(doc_id, text, n_removed) for each row of docs: its text without the removed lines."""
    return _cleaned(docs, similarity).select(F.col("row.doc_id").cast("long").alias("doc_id"), "text", "n_removed")


def clean_documents(docs: DataFrame, similarity: Fraction = SIMILARITY) -> DataFrame:
    """docs with cleaned text (and n_chars, where there is one). A document of which nothing but blanks is left, all else being said before, goes."""
    d = _cleaned(docs, similarity).where(r"n_removed = 0 OR text RLIKE '[^ \\t\\r\\n]'")
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return d.select(*((F.when(F.col("n_removed") > 0, new[c]).otherwise(F.col("row").getField(c)) if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(common.read(spark, sf_dir, "documents"))


#: Every pair of distinct word sets of fitting sizes that shares a word is compared: no prefix, no positions.
SQL = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
w AS (SELECT doc_id, pos, line, list_sort(list_distinct(list_filter(string_split_regex(lower(line), '[ \t\r\f]+'), lambda x: x <> ''))) AS words FROM l),
s AS (SELECT words, len(words) AS n, min((doc_id, pos)) AS f FROM w WHERE len(words) > 0 GROUP BY words),
later AS (SELECT DISTINCT b.words FROM s a JOIN s b ON a.f < b.f AND a.n * {SIMILARITY.denominator} >= b.n * {SIMILARITY.numerator} AND b.n * {SIMILARITY.denominator} >= a.n * {SIMILARITY.numerator}
          WHERE len(list_intersect(a.words, b.words)) * {SIMILARITY.numerator + SIMILARITY.denominator} >= {SIMILARITY.numerator} * (a.n + b.n)),
gone AS (SELECT w.doc_id, w.pos FROM w JOIN s ON w.words = s.words WHERE (w.doc_id, w.pos) <> s.f OR w.words IN (SELECT words FROM later)),
kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.pos) AS text FROM l ANTI JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text, coalesce(n.n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN n ON d.doc_id = n.doc_id"""
