from fractions import Fraction
from itertools import islice
from math import ceil, floor

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from symgraph.llm import mixing
from tests.llm import data


def deadline_first(weights):
    """An independent scheduler, slot by slot over all blocks' windows in fractions: no heap, no integers."""
    names = sorted(weights, key=lambda s: (s is None, s or ""))
    total = sum(Fraction(w) for w in weights.values())
    share = {s: Fraction(weights[s]) / total for s in names}
    had = dict.fromkeys(names, 0)
    slot = 0
    while True:
        released = [s for s in names if floor(had[s] / share[s]) <= slot]
        s = min(released, key=lambda s: (ceil((had[s] + 1) / share[s]), names.index(s)))
        had[s] += 1
        yield s
        slot += 1


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefgh"), st.floats(1e-4, 100), min_size=1))
def test_never_a_block_off_the_given_weights(weights):
    total = sum(map(Fraction, weights.values()))
    had = dict.fromkeys(weights, 0)
    for t, (s, other) in enumerate(islice(zip(mixing.schedule(weights), deadline_first(weights)), 600), 1):
        assert s == other
        had[s] += 1
        assert all(abs(had[k] - Fraction(w) * t / total) < 1 for k, w in weights.items())


def test_a_long_mix_does_not_drift():
    """Weights that are no multiples of anything, 200 000 slots."""
    weights = {"a": 1 / 3, "b": 1 / 7, "c": 0.0002, "d": 1 - 1 / 3 - 1 / 7 - 0.0002}
    had, total = dict.fromkeys(weights, 0), sum(weights.values())
    for t, s in enumerate(islice(mixing.schedule(weights), 200_000), 1):
        had[s] += 1
        assert abs(had[s] - weights[s] * t / total) < 1
        if not t % 997:
            assert all(abs(had[k] - w * t / total) < 1 for k, w in weights.items())


def test_blocks_of_a_table(spark):
    rows = [(i, "x" * (50 + i % 7), "en", "abc"[i % 3 if i < 900 else 0], 0) for i in range(1200)]
    d = spark.createDataFrame(rows, data.DOCS).repartition(5)
    weights = {"a": 5, "b": 3, "c": 2}
    got = mixing.mix(d, weights, block_chars=200).collect()
    slots = list(islice(deadline_first(weights), 1000))
    assert all(r["source"] == slots[r["slot"]] for r in got)
    # brute force: each source in its order, cut into blocks, dealt by slot
    order = {r["doc_id"]: r["h"] for r in d.select("doc_id", F.xxhash64(F.lit("mix"), "doc_id").alias("h")).collect()}
    blocks = {}
    for s in "abc":
        at = 0
        for i, t, *_ in sorted((r for r in rows if r[3] == s), key=lambda r: order[r[0]] % (1 << 64)):
            blocks.setdefault((s, at // 200), []).append(i)
            at += len(t)
        blocks[s] = -(-at // 200)
    want, dealt = [], dict.fromkeys("abc", 0)
    slot = 0
    while dealt[s := slots[slot]] < blocks[s]:
        want += [(slot, i) for i in blocks.get((s, dealt[s]), [])]
        dealt[s] += 1
        slot += 1
    assert sorted((r["slot"], r["in_block"], r["doc_id"]) for r in got) == sorted((slot, k, i) for slot in {a for a, _ in want} for k, i in enumerate((i for a, i in want if a == slot), 1))


def test_signed_hashes_stand_in_their_order(spark):
    """Parts of a source's order and the order within them agree: starts never fall."""
    d = spark.createDataFrame([(i, "x" * 10, "en", "a", 0) for i in range(500)], data.DOCS)
    starts = mixing._placed(d, [], 100).select("start").collect()
    assert sorted(r["start"] for r in starts) == list(range(0, 5000, 10))


def test_odd_input(spark):
    """A null source, null and empty texts, a text of many blocks, repeated rows and ties, by value."""
    d = data.odd_docs(spark)
    out = mixing.mix_documents(d, block_chars=100)
    assert out.columns == d.columns
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, d.collect()), key=repr)
    m = mixing.mix(d, block_chars=100).collect()
    slots = {}
    for r in m:
        slots.setdefault((r["source"], r["block"]), set()).add(r["slot"])
    assert all(len(x) == 1 for x in slots.values()) and len({min(x) for x in slots.values()}) == len(slots)
    assert {r["source"] for r in m} == {"a", "b", None} and sorted(str(r["doc_id"]) for r in m) == sorted("1 2 3 4 5 None 6 7 7 8".split())
    twice = [r for r in m if r["doc_id"] == 7]
    assert [r["source"] for r in twice] == [None, None] and twice[0]["in_block"] != twice[1]["in_block"] or twice[0]["slot"] != twice[1]["slot"]
    assert mixing.mix(data.empty_docs(spark)).count() == 0 and mixing.mix_documents(data.empty_docs(spark)).count() == 0
    assert mixing.mix(d, {"a": 1, "nowhere": 1}).count() == 0
    assert {r["source"] for r in mixing.mix(d, {"a": 1, "b": 0}, block_chars=100).collect()} == {"a"}
    assert list(islice(mixing.schedule({None: 1, "x": 1, "a": 1}), 6)) == ["a", "x", None] * 2, "ties go by name, null last"


def test_no_document_is_lost(spark):
    """A hot source, a source of a single document, sources without a character and empty texts at a source's end: each document has one slot."""
    rows = [(i, "x" * (50 + i % 7), "en", "hot", 0) for i in range(2000)] + [(5000 + i, "y" * 40, "en", "some", 0) for i in range(60)]
    rows += [(9000, "z", "en", "one", 0), (9001, None, "en", "nothing", 0), (9002, "", "en", None, 0)]
    full = [(10_000 + i, "w" * 100, "en", "full", 0) for i in range(40)] + [(20_000 + i, "", "en", "full", 0) for i in range(40)]
    d = spark.createDataFrame(rows + full, data.DOCS).repartition(5)
    want = sorted(r[0] for r in rows + full)
    got = mixing.mix(d, block_chars=200).collect()
    assert sorted(r["doc_id"] for r in got) == want
    assert sorted(r["doc_id"] for r in mixing.mix_documents(d, block_chars=200).collect()) == want
    assert len({(r["slot"], r["in_block"]) for r in got}) == len(want) and len({(r["source"], r["block"]) for r in got}) == len({(r["slot"], r["source"], r["block"]) for r in got}) == len({r["slot"] for r in got})
    weights = {"hot": 1, "some": 5, "one": 3, "nowhere": 2}
    assert sorted(r["doc_id"] for r in mixing.mix(d, weights, block_chars=200, whole=True).collect()) == sorted(r[0] for r in rows if r[3] in weights)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefg"), st.tuples(st.integers(1, 400), st.floats(0.01, 100)), min_size=1))
def test_each_block_is_dealt_once_and_each_phase_is_on_target(sources):
    blocks, weights = {s: n for s, (n, _) in sources.items()}, {s: w for s, (_, w) in sources.items()}
    left, current = dict(blocks), -1
    for phase, s, block in mixing.planned(blocks, weights):
        if phase != current:
            assert phase == current + 1 and (not phase or any(not left[k] for k in live))
            live = {k: Fraction(w) for k, w in weights.items() if left[k]}
            had, current = dict.fromkeys(live, 0), phase
        assert block == blocks[s] - left[s]
        left[s] -= 1
        had[s] += 1
        assert all(abs(had[k] - w * sum(had.values()) / sum(live.values())) < 1 for k, w in live.items())
    assert not any(left.values())
