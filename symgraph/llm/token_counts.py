"""Count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton over the vocabulary enumerates every piece that ends at each character; dynamic programming carries the best
score and the number of pieces on its path, nothing else. The vocabulary is that of a sentencepiece model file. No such file here was
trained as a unigram model, so the scores of the file's pieces are taken as the piece scores, whatever they were made for: the count is
that of sentencepiece's own unigram engine loaded with these pieces and scores, not that of a merge-based segmentation with them. Scores
that only mark a piece as out of reach (SENTINEL or less) are set to 1 less than the least other score: no 32-bit sum could hold both.

Rules, those of that engine: candidates for an end come from the longest piece to the shortest and a later one must score strictly more;
a character without a piece of its own costs the least score less 10 and counts as its UTF-8 bytes where the vocabulary has byte pieces,
else a run of them as one; the text is changed before as the model says (a blank before it, blanks to U+2581). No piece crosses the
start of a word, so the best path of a text is that of its words, and each distinct word is solved once.

Defined results for odd input:
* null text: null count; empty text: 0; a text of blanks only is segmented like any other;
* very long texts are counted whole;
* ties go to the longest last piece; repeated rows are counted alike; an empty table gives an empty one;
* extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

MODEL = f"{common.TOKENIZER_DIR}/piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
SENTINEL = -1e8
#: Distinct words remembered by a worker; beyond it, it starts over.
REMEMBERED = 1 << 20

#: Blanks stand at the start of a word; a piece never has one after another character.
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def vocabulary(model: bytes) -> dict:
    """What counting needs of a sentencepiece model file: pieces with scores, the score of an unknown character, byte pieces, changes of the text."""
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    m.ParseFromString(model)
    kinds = m.SentencePiece
    if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces or not m.normalizer_spec.escape_whitespaces:
        raise ValueError("only models that leave the text as it is, but for blanks, are supported")
    if any(p.type == kinds.USER_DEFINED for p in m.pieces):
        raise ValueError("user-defined pieces are not supported")
    normal = {p.piece: p.score for p in m.pieces if p.type == kinds.NORMAL}
    floor = min(x for x in normal.values() if x > SENTINEL) - 1
    normal = {p: x if x > SENTINEL else floor for p, x in normal.items()}
    if any(SPACE in p.lstrip(SPACE) for p in normal):
        raise ValueError("a piece crosses words")
    return {"pieces": normal, "unknown": float(np.float32(min(normal.values())) - np.float32(UNKNOWN_PENALTY)), "bytes": any(p.type == kinds.BYTE for p in m.pieces), "prefix": m.normalizer_spec.add_dummy_prefix}


class Counter:
    def __init__(self, v: dict):
        self.automaton = ahocorasick.Automaton()
        for piece, score in v["pieces"].items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p in v["pieces"] if len(p) == 1}
        self.unknown, self.bytes, self.prefix = v["unknown"], v["bytes"], v["prefix"]
        self.words: dict[str, int] = {}

    def _solve_known(self, word: str) -> int:
        """Number of pieces where every character is a piece: the automaton names the pieces of an end from the longest to the shortest."""
        best, count, at = [0.0], [0], 0
        for end, (length, score) in self.automaton.iter(word):
            start = end + 1 - length
            s = best[start] + score
            if end == at:
                best.append(s)
                count.append(count[start] + 1)
                at += 1
            elif s > best[at]:
                best[at] = s
                count[at] = count[start] + 1
        return count[at]

    def _solve(self, word: str) -> int:
        n = len(word)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, piece in self.automaton.iter(word):
            ends[end + 1].append(piece)
        best, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(1, n + 1):
            c, top = word[end - 1], -np.inf
            for length, score in ends[end]:
                s = best[end - length] + score
                if s > top:
                    top, count[end] = s, count[end - length] + 1
            if c not in self.single and (s := best[end - 1] + self.unknown) > top:
                top, unknown[end] = s, True
                count[end] = count[end - 1] + (len(c.encode()) if self.bytes else not unknown[end - 1])
            best[end] = top
        return count[n]

    def count(self, text: str | None) -> int | None:
        if text is None:
            return None
        if not text:
            return 0
        text = text.replace(" ", SPACE)
        if self.prefix:
            text = SPACE + text
        if not self.bytes:  # unknown characters of neighbouring words would be one run
            return self._solve(text)
        words, total = self.words, 0
        for w in _WORD.findall(text):
            n = words.get(w)
            if n is None:
                if len(words) >= REMEMBERED:
                    words.clear()
                n = words[w] = self._solve_known(w) if self.single.issuperset(w) else self._solve(w)
            total += n
        return total


_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens) for each row of docs. model: path of a sentencepiece model file, read by the driver."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(Path(model).read_bytes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _counters:
            _counters.clear()
            _counters[model] = Counter(shared.value)
        count = _counters[model].count
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([count(t.as_py()) for t in batch["text"]], pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(common.col("doc_id").cast("long").alias("doc_id"), common.col("text").alias("text")).mapInArrow(run, "doc_id long, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.read(spark, sf_dir, "documents"))
