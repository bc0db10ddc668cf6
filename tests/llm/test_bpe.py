import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from symgraph.llm import bpe, common
from tests.llm import data


@pytest.fixture(scope="module")
def codec():
    from pathlib import Path

    return bpe.Codec(Path(bpe.VOCABULARY).read_text())


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(bpe.VOCABULARY)
    t.encode_special_tokens = True
    return t


def check(codec, library, texts):
    ids, counts, starts, stops = codec.encode(texts)
    at = 0
    for t, n in zip(texts, counts):
        own = ids[at : at + n].tolist()
        assert own == library.encode(t, add_special_tokens=False).ids, repr(t[:60])
        assert codec.decode(own) == t
        for a, b, i in zip(starts[at : at + n], stops[at : at + n], own):
            assert 0 <= a < b <= len(t) and (codec.bytes_of[i] in t[a:b].encode())
        at += n


def test_ids_offsets_and_round_trip(codec, library):
    rng = random.Random(4)
    alphabet = "abcDEF  \n\t\r.,!'0123éßñ漢字😀👩‍👩‍👧  ﻿_-<|>"
    texts = ["", " ", "\n", "a", "it's  we'll\n\n  x ", "<|endoftext|> is text", "😀" * 30, "é" * 50, "a " * 500, " x  y"]
    texts += ["".join(rng.choices(alphabet, k=rng.randint(1, 80))) for _ in range(400)]
    check(codec, library, texts)


def test_the_table_of_documents(spark, sf_dir, codec):
    d = common.read(spark, sf_dir, "documents")
    tokens = bpe.encode(d)
    back = bpe.decode(tokens)
    assert d.select("doc_id", "text").exceptAll(back).count() == 0 and back.count() == d.count()
    bad = tokens.where((F.size("token_ids") != F.col("n_tokens")) | (F.size("char_starts") != F.col("n_tokens")) | (F.size("char_ends") != F.col("n_tokens")))
    assert bad.count() == 0


def test_odd_input(spark, codec):
    d = data.odd_docs(spark)
    out = bpe.encode(d)
    assert out.columns == ["doc_id", "n_tokens", "token_ids", "char_starts", "char_ends"]
    rows = out.collect()
    assert len(rows) == d.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["token_ids"] is None and by[2]["n_tokens"] is None and by[3]["token_ids"] == []
    assert d.select("doc_id", "text").exceptAll(bpe.decode(out)).count() == 0
    assert bpe.encode(data.empty_docs(spark)).count() == 0
    assert codec.decode([10**7]) is None and codec.decode([None]) is None and codec.decode(None) is None and codec.decode([]) == ""


def test_a_split_character_alone(codec):
    ids = codec.encode(["😀"])[0].tolist()
    if len(ids) > 1:
        assert codec.decode(ids[:1]) == "�" and codec.decode(ids) == "😀"


def test_the_query_decodes_what_it_encodes(spark, sf_dir):
    out = bpe.query(spark, sf_dir)
    assert out.columns == ["doc_id", "n_tokens", "token_ids", "char_starts", "char_ends", "decoded_text", "round_trip"]
    out = common.materialize(out, "t")
    d = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    assert d.exceptAll(out.select("doc_id", "decoded_text")).count() == 0 and out.count() == out.where("round_trip").count() == d.count()
    assert out.select("doc_id", "decoded_text").exceptAll(bpe.decode(out)).count() == 0


def test_round_trip_of_odd_input(spark, codec):
    d = data.odd_docs(spark)
    rows = bpe.round_trip(d).collect()
    assert sorted(((r["doc_id"], r["decoded_text"]) for r in rows), key=repr) == sorted(((r["doc_id"], r["text"]) for r in d.collect()), key=repr)
    assert all(r["round_trip"] is (None if r["decoded_text"] is None else True) for r in rows)
    assert bpe.round_trip(data.empty_docs(spark)).count() == 0
    assert codec.decode([-1]) is None and codec.decode([0, len(codec.bytes_of)]) is None
