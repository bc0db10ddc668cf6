import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from symgraph.llm import simhash
from tests.llm import data


def brute(texts, radius=simhash.RADIUS):
    """{doc: least of its group} over all pairs."""
    bits = [None if (s := simhash.signature(t)) is None else np.unpackbits(np.frombuffer(s, np.uint8)) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if bits[i] is not None and bits[j] is not None and (bits[i] != bits[j]).sum() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in range(len(texts)) if find(i) != i}


def near_copies(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(3000)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.5:
            words = rng.choice(out).split()
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            out.append(" ".join(words))
        else:
            out.append(" ".join(rng.choices(vocabulary, k=rng.randint(20, 200))))
    return out


def test_recall_against_brute_force(spark):
    """Of the pairs within the radius, so many are in one group; and nothing else is a copy."""
    found = wanted = 0
    for seed in range(2):
        texts = near_copies(seed, 200)
        got = {r["doc_id"]: r["duplicate_of"] for r in simhash.near_duplicates(data.docs(spark, texts)).collect()}
        assert got.keys() <= brute(texts).keys(), "only true near copies"
        bits = np.array([np.unpackbits(np.frombuffer(simhash.signature(t), np.uint8)) for t in texts])
        near = [(i, j) for i in range(len(texts)) for j in range(i) if (bits[i] != bits[j]).sum() <= simhash.RADIUS]
        found, wanted = found + sum(got.get(i, i) == got.get(j, j) for i, j in near), wanted + len(near)
    assert wanted > 100 and found >= simhash.RECALL * wanted


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(0, 150), min_size=1, max_size=4), st.integers(0, 2**32 - 1), st.integers(0, 60))
def test_bit_sliced_distances_are_exact(sizes, seed, radius):
    rng = np.random.default_rng(seed)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    base = rng.integers(0, 2, simhash.BITS, np.uint8)
    bits = base ^ (rng.random((starts[-1], simhash.BITS)) < rng.random((starts[-1], 1)) * 0.4).astype(np.uint8)
    left, right = simhash.matches(bits, starts[np.concatenate([[True], np.diff(starts) > 0])] if len(sizes) else starts, radius)
    want = {(i, j) for a, b in zip(starts, starts[1:]) for i in range(a, b) for j in range(i + 1, b) if (bits[i] != bits[j]).sum() <= radius}
    assert set(zip(left.tolist(), right.tolist())) == want


def test_odd_input(spark):
    d = data.odd_docs(spark)
    got = {(r["doc_id"], r["duplicate_of"]) for r in simhash.near_duplicates(d).collect()}
    assert got == {(6, 1), (8, 1)}
    kept = simhash.keep_documents(d)
    assert kept.columns == d.columns
    ids = sorted((r["doc_id"] for r in kept.select("doc_id").collect()), key=str)
    assert ids == [1, 2, 3, 4, 5, 7, None]
    assert simhash.near_duplicates(data.empty_docs(spark)).count() == 0 and simhash.keep_documents(data.empty_docs(spark)).count() == 0


def test_a_group_of_many_copies(spark):
    texts = ["some words that are copied very often indeed"] * 400 + ["something else entirely, and not like it"]
    got = simhash.near_duplicates(data.docs(spark, texts)).collect()
    assert len(got) == 399 and {r["duplicate_of"] for r in got} == {0}


def test_a_hot_bucket_in_blocks(spark):
    """Buckets of more rows than a task takes give the same groups."""
    texts = near_copies(5, 80)
    d = data.docs(spark, texts)
    assert {tuple(r) for r in simhash.near_duplicates(d, hot=5).collect()} == {tuple(r) for r in simhash.near_duplicates(d).collect()}


def test_the_promised_recall_holds_at_any_size():
    """By the formula at the radius and nearer; and measured, on pairs at the radius, with the plans of two sizes."""
    rng = np.random.default_rng(0)
    for n in (1_000, 1_000_000, 10**10):
        assert simhash.expected_recall(n, simhash.RADIUS) >= simhash.RECALL and simhash.expected_recall(n, simhash.RADIUS // 2) > 0.9999
    for n in (1_000, 1_000_000):
        tables = simhash.plan(n)
        far = np.array([rng.choice(simhash.BITS, simhash.RADIUS, replace=False) for _ in range(2000)])
        apart = np.zeros((2000, simhash.BITS), bool)
        apart[np.arange(2000)[:, None], far] = True
        met = np.any([~apart[:, t].any(axis=1) for t in tables], axis=0)
        assert met.mean() >= simhash.RECALL - 0.01
