"""Byte-level BPE encoding and decoding with the tokenizers library, over Arrow batches.

A text is cut before each run of blanks that follows something else. Such a cut is always a boundary of the tokenizer's own splitting, so
the ids of the parts, one after another, are the ids of the text; each distinct part is encoded once and its ids are looked up again.
A text that holds white space other than space, tab and line ends is encoded as it stands. Offsets come from the bytes: every token's
length in bytes is known, and the count of lead bytes up to a byte is its character.

Decoding reverses the byte table: a token's string is a character for each byte; the bytes are joined, so characters that were split over
tokens come together again, and decoded as UTF-8 (bytes that are no UTF-8 become U+FFFD). round_trip(), the registered query, encodes
each text, decodes the ids of its row, and says whether the text came back.

Defined results for odd input:
* null text: null ids and offsets; empty text: empty arrays; null ids decode to null, and so do ids outside the vocabulary;
* very long texts are encoded whole: only a single part is ever handed to the library at once, together with others up to a size;
* strings of special tokens in a text are ordinary text;
* repeated rows and ids are encoded alike, row by row; an empty table gives an empty one;
* extra columns are not read by encode() and round_trip(); their results have only the columns they name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

VOCABULARY = f"{common.TOKENIZER_DIR}/byte_bpe_50k.json"
#: Distinct parts remembered by a worker; beyond it, it starts over.
REMEMBERED = 1 << 18
ROWS_AT_ONCE = 256
PARTS_AT_ONCE = 1 << 14

_PART = re.compile(r"[ \t\r\n]*[^ \t\r\n]+|[ \t\r\n]+")
_BLANK = " \t\r\n"
_OTHER_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")
SCHEMA = "doc_id long, n_tokens int, token_ids array<int>, char_starts array<int>, char_ends array<int>"
ROUND_TRIP_SCHEMA = SCHEMA + ", decoded_text string, round_trip boolean"


def byte_table() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary, and back: printable Latin-1 stands for itself."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    table = {chr(b): b for b in shown}
    hidden = (b for b in range(256) if b not in set(shown))
    return table | {chr(256 + i): b for i, b in enumerate(hidden)}


class Codec:
    """Encodes and decodes with one vocabulary (the text of a tokenizers JSON file)."""

    def __init__(self, vocabulary: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.encode_special_tokens = True
        table = byte_table()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of: list[bytes | None] = [None] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
        self.n_bytes = np.array([len(b or b"") for b in self.bytes_of], np.int32)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.at = np.zeros(1 << 12, np.int64)
        self.size = np.zeros(1 << 12, np.int64)
        self.used = 0

    def _learn(self, parts: list[str]) -> None:
        # parts that begin with blanks and end otherwise can be encoded as one text: the joints are cuts, too
        joint = [p for p in parts if p[0] in _BLANK and p[-1] not in _BLANK and not _OTHER_SPACE.search(p)]
        alone = list(set(parts).difference(joint))
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(joint)], add_special_tokens=False)[0].ids, np.int32)
        ends = np.searchsorted(np.cumsum(self.n_bytes[ids]), np.cumsum([len(p.encode()) for p in joint]), "right")
        got = [e.ids for e in self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)]
        parts = joint + alone
        ids = np.concatenate([ids, np.array([i for g in got for i in g], np.int32)])
        sizes = np.concatenate([np.diff(ends, prepend=0), np.array([len(g) for g in got], np.int64)]).astype(np.int64)
        n = len(self.index)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(parts) > len(self.at):
            self.at, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size))
        self.ids[self.used : self.used + len(ids)] = ids
        self.size[n : n + len(parts)] = sizes
        self.at[n : n + len(parts)] = self.used + np.cumsum(sizes) - sizes
        self.index.update(zip(parts, range(n, n + len(parts))))
        self.used += len(ids)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids of all texts one after another, the number of each text, and each token's first character and the one after its last."""
        if len(self.index) > REMEMBERED:
            self.clear()
        parts = [[t] if _OTHER_SPACE.search(t) else _PART.findall(t) for t in texts]
        index = self.index
        new = sorted(set(chain.from_iterable(parts)).difference(index))
        for i in range(0, len(new), PARTS_AT_ONCE):
            self._learn(new[i : i + PARTS_AT_ONCE])
        counts = np.array([len(own) for own in parts], np.int64)
        look = index.__getitem__
        flat = np.array(list(map(look, chain.from_iterable(parts))), np.int64)
        size = self.size[flat]
        before = np.cumsum(size) - size
        where = np.repeat(self.at[flat] - before, size) + np.arange(int(size.sum()))
        ids = self.ids[where]
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
        per_text = np.diff(ends)
        # offsets: character of each byte, counted from the text's start
        raw = np.frombuffer("".join(texts).encode(), np.uint8)
        lead = (raw & 0xC0) != 0x80
        char = np.concatenate([np.cumsum(lead), [int(lead.sum())]])  # at a byte: characters begun up to and with it
        last = np.cumsum(self.n_bytes[ids].astype(np.int64))
        first = last - self.n_bytes[ids]
        base = np.repeat(np.concatenate([[0], np.cumsum([len(t) for t in texts])])[: len(texts)], per_text)
        starts = char[first] - 1 - base
        stops = char[last - 1] - base
        return ids, per_text, starts.astype(np.int32), stops.astype(np.int32)

    def decode(self, ids: list[int] | None) -> str | None:
        if ids is None:
            return None
        try:
            if ids and min(ids) < 0:
                return None
            raw = b"".join(map(self.bytes_of.__getitem__, ids))
        except (IndexError, TypeError):  # an id beyond the table; a null, or an id without a token
            return None
        return raw.decode("utf-8", "replace")


_codecs: dict[int, Codec] = {}


def _codec(vocabulary: str) -> Codec:
    """The worker's codec for this vocabulary, made once."""
    key = hash(vocabulary)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(vocabulary)
    return _codecs[key]


def _lists(values: np.ndarray, ends: np.ndarray, null: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.append(null, False)), pa.array(values))


def _coded(docs: DataFrame, vocabulary: str, back: bool, position: bool = False) -> DataFrame:
    """SCHEMA for each row of docs; back: ROUND_TRIP_SCHEMA; position: that column of docs before them."""
    shared = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(i, ROWS_AT_ONCE)
                null = part["text"].is_null().to_numpy(zero_copy_only=False)
                texts = part["text"].to_pylist()
                ids, counts, starts, stops = codec.encode([t or "" for t in texts])
                ends = np.concatenate([[0], np.cumsum(counts)])
                arrays = [part["doc_id"], pa.array(counts.astype(np.int32), mask=null), *(_lists(x, ends, null) for x in (ids, starts, stops))]
                names = ["doc_id", "n_tokens", "token_ids", "char_starts", "char_ends"]
                if back:
                    decoded = [None if no else codec.decode(ids[a:b].tolist()) for no, a, b in zip(null, ends[:-1], ends[1:])]
                    arrays += [pa.array(decoded, pa.string()), pa.array([None if t is None else t == d for t, d in zip(texts, decoded)], pa.bool_())]
                    names += ["decoded_text", "round_trip"]
                if position:
                    arrays, names = [part["position"], *arrays], ["position", *names]
                yield pa.RecordBatch.from_arrays(arrays, names)

    columns = [*(["position"] if position else []), common.col("doc_id").cast("long").alias("doc_id"), common.col("text").alias("text")]
    return docs.select(*columns).mapInArrow(run, "position long, " * position + (ROUND_TRIP_SCHEMA if back else SCHEMA))


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, token_ids, char_starts, char_ends) for each row of docs. vocabulary: path of a tokenizers JSON file, read by the driver."""
    return _coded(docs, vocabulary, False)


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """encode()'s columns, decoded_text (the row's token_ids decoded) and round_trip (whether that is the row's text; null for a null text)."""
    return _coded(docs, vocabulary, True)


def round_trip_in_order(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """round_trip() with position first: the row's place in docs, from 0 on."""
    return _coded(common.numbered(docs, ["doc_id", "text"], "ordered"), vocabulary, True, True)


def decode(tokens: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) for each row of (doc_id, token_ids)."""
    shared = tokens.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            texts = [codec.decode(x.as_py()) for x in batch["token_ids"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select(common.col("doc_id").cast("long").alias("doc_id"), common.col("token_ids").alias("token_ids")).mapInArrow(run, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(common.read(spark, sf_dir, "documents"))
