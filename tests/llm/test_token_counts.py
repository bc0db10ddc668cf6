import os
import re
import tempfile
from pathlib import Path

import pytest

from symgraph.llm import common, token_counts
from tests.llm import data


@pytest.fixture(scope="module")
def engine():
    """Sentencepiece's own unigram engine, loaded with these pieces and scores."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    raw = Path(token_counts.MODEL).read_bytes()
    v = token_counts.vocabulary(raw)
    m = sentencepiece_model_pb2.ModelProto()
    m.ParseFromString(raw)
    m.trainer_spec.model_type = m.trainer_spec.UNIGRAM
    for p in m.pieces:
        if p.piece in v["pieces"]:
            p.score = v["pieces"][p.piece]
    with tempfile.NamedTemporaryFile(suffix=".model", delete=False) as f:
        f.write(m.SerializeToString())
    yield sentencepiece.SentencePieceProcessor(model_file=f.name)
    os.unlink(f.name)


def test_counts_are_those_of_the_engine(spark, sf_dir, engine):
    d = common.read(spark, sf_dir, "documents")
    texts = {r["doc_id"]: r["text"] for r in d.select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(d).collect()}
    assert got == {i: len(engine.encode(t)) for i, t in texts.items()}


def test_odd_texts(engine):
    c = token_counts.Counter(token_counts.vocabulary(Path(token_counts.MODEL).read_bytes()))
    for t in ["a", " ", "   b  c ", "\n\n\t", "漢字 😀 \x00 é", "▁▁ x", "aaaaaaaaaaaaaaaaaaaaaaaa", "word " * 2000, "x" * 20_000]:
        assert c.count(t) == len(engine.encode(t)), repr(t[:20])
    assert c.count(None) is None and c.count("") == 0


def test_every_path_by_brute_force():
    """All segmentations of short words, over a tiny vocabulary: best score, then the longest last piece."""
    pieces = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -4.5, "ba": -3.0, "aba": -6.0, "▁a": -4.0}
    c = token_counts.Counter({"pieces": pieces, "unknown": -20.0, "bytes": True, "prefix": True})

    def best(word):
        if not word:
            return 0.0, 0
        found = None
        for n in range(len(word), 0, -1):
            piece = word[-n:]
            if piece in pieces or (n == 1 and piece not in pieces):
                s, k = best(word[:-n])
                s, k = s + pieces.get(piece, -20.0), k + (1 if piece in pieces else len(piece.encode()))
                if found is None or s > found[0]:
                    found = s, k
        return found

    for word in ["a", "ab", "aba", "abab", "baab", "xa", "aéb", "ababa"]:
        assert c.count(word) == best("▁" + word)[1]


def test_odd_tables(spark):
    d = data.odd_docs(spark)
    got = token_counts.token_counts(d).collect()
    assert len(got) == d.count() and {r["n_tokens"] for r in got if r["doc_id"] == 2} == {None} and {r["n_tokens"] for r in got if r["doc_id"] == 3} == {0}
    assert token_counts.token_counts(data.empty_docs(spark)).count() == 0
    assert re.search("long", token_counts.token_counts(d).schema["n_tokens"].dataType.simpleString().replace("bigint", "long"))
