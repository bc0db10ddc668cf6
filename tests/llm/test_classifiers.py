import math
import re

import numpy as np
import pytest

from symgraph.llm import common, labelled, quality_classifier, toxicity
from tests.llm import data

SMALL, LARGE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


@pytest.mark.parametrize(("module", "label", "named", "sf", "least"), [(toxicity, "toxic", True, LARGE, 0.92), (quality_classifier, "quality", False, SMALL, 0.85)])
def test_held_out_accuracy(spark, module, label, named, sf, least):
    rows, y, words = labelled.sample(common.read(spark, sf, "documents"), common.read(spark, sf, "labels"), label, module.features, 10_000, named=named)
    half = len(rows) // 2
    model = module.train(rows[:half], y[:half], words) if named else module.train(rows[:half], y[:half])
    texts = {r["doc_id"]: r["text"] for r in common.read(spark, sf, "documents").select("doc_id", "text").collect()}
    ids = sorted(r["doc_id"] for r in common.read(spark, sf, "labels").select("doc_id").distinct().collect() if r["doc_id"] in texts)[half:]
    held = [texts[i] for i in ids]
    p = module.Scorer(*model).scores(held) if named else module.scores(held, *model)
    assert np.mean((p >= module.THRESHOLD) == (y[half:] > 0)) >= least


def test_unseen_misspellings():
    rng = np.random.default_rng(1)
    plain = ["tree river stone cloud garden bread window table".split()[i] for i in range(8)]
    bad = ["horrible", "disgusting", "idiotic"]
    texts, y = [], []
    for k in range(120):
        words = list(rng.choice(plain, 12))
        if k % 2:
            words[rng.integers(12)] = bad[k % 3]
        texts.append(" ".join(words))
        y.append(k % 2)
    found = toxicity.features(texts)
    names = sorted({w for i, _ in found for w in i})
    number = {w: k for k, w in enumerate(names)}
    rows = [(np.array([number[w] for w in i]), v) for i, v in found]
    s = toxicity.Scorer(*toxicity.train(rows, np.array(y, float), names, epochs=20))
    clean, near = s.scores(["tree river stone cloud garden bread window table"] + ["tree river stone cloud garden bread disgustting window horribble"])
    assert near > clean


@pytest.mark.parametrize("module", [toxicity, quality_classifier])
def test_odd_input(spark, module):
    d = data.odd_docs(spark)
    run, label, flag = (module.toxicity, "toxic", "is_toxic") if module is toxicity else (module.quality, "quality", "keep")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (None, 1), (5, None), (7, 0), (99, 1)], f"doc_id long, {label} int")
    got = run(d, labels).collect()
    assert len(got) == d.count() and all(0 <= r[1] <= 1 for r in got)
    for r in got:
        if r["doc_id"] in (2, 3, 4):
            assert r[1] == 0 and not r[flag]
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    assert len({r[1] for r in run(d, none).collect() if r["doc_id"] in (1, 5, 7)}) == 1
    assert run(data.empty_docs(spark), labels).count() == 0


def plain_bucket(h):
    mask = (1 << 64) - 1
    h = ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) & mask
    return (h ^ (h >> 32)) % toxicity.BUCKETS


def plain_buckets(word):
    """Of a word: itself, then its n-grams, as polynomials of code points, one by one."""
    mask, prime = (1 << 64) - 1, 0x100000001B3

    def poly(chars):
        h = 0
        for c in chars:
            h = (h * prime + ord(c)) & mask
        return h

    w = f"<{word}>"
    whole = sum(ord(c) * prime**i for i, c in enumerate(w))
    return [plain_bucket((whole * prime + 1) & mask), *(plain_bucket((poly(w[i : i + n]) + n) & mask) for n in toxicity.N_GRAMS for i in range(len(w) - n + 1))]


def plain_score(text, buckets, bias):
    words = re.findall(r"\w+", text.lower())
    if not words:
        return 0.0
    logit = bias
    for w in words:
        own = plain_buckets(w)
        logit += sum(float(buckets[b]) for b in own) / len(own) / (len(words) + toxicity.PAD)
    return 1 / (1 + math.exp(-logit))


def test_toxicity_scores_against_plain_loops():
    rng = np.random.default_rng(4)
    buckets, bias = rng.normal(0, 3, toxicity.BUCKETS).astype(np.float32), 0.3
    texts = ["One two, two naïve 漢字 ok", "", "a", "!!! ---", "long " * 4000 + "tail", "Ünder_score x2"]
    got = toxicity.Scorer(buckets, bias).scores([*texts, None])
    assert np.allclose(got, [*(plain_score(t, buckets, bias) for t in texts), 0.0], atol=1e-6)


def test_toxicity_training_against_plain_loops():
    """One epoch over three texts, a number at a time."""
    texts, y = ["good plain words", "bad words bad", "other plain text"], [0, 1, 0]
    found = toxicity.features(texts)
    names = sorted({w for i, _ in found for w in i})
    rows = [(np.array([names.index(w) for w in i]), v) for i, v in found]
    got, got_bias = toxicity.train(rows, np.array(y, float), names, epochs=1)
    rng, d = np.random.default_rng(7), toxicity.DIMENSION
    vectors = rng.normal(0, 0.1, (toxicity.BUCKETS, d)).astype(np.float32).astype(float)
    soft = rng.normal(0, 0.1, (d, 2)).astype(np.float32).astype(float)
    seen, soft_seen, bias, bias_seen = {}, [[1e-8] * 2 for _ in range(d)], [0.0, 0.0], [1e-8, 1e-8]
    weight = [len(y) / (2 * y.count(c)) for c in (0, 1)]
    for k in rng.permutation(3):
        share = {}
        for w, part in zip(*found[k]):
            own = plain_buckets(w)
            for b in own:
                share[b] = share.get(b, 0) + float(part) / len(own)
        hidden = [sum(s * vectors[b][j] for b, s in share.items()) for j in range(d)]
        z = [sum(hidden[j] * soft[j][c] for j in range(d)) + bias[c] for c in (0, 1)]
        p = [math.exp(x - max(z)) for x in z]
        p = [(x / sum(p) - (c == y[k])) * weight[y[k]] for c, x in enumerate(p)]
        back = [sum(soft[j][c] * p[c] for c in (0, 1)) for j in range(d)]
        for j in range(d):
            for c in (0, 1):
                soft_seen[j][c] += (hidden[j] * p[c]) ** 2
                soft[j][c] -= hidden[j] * p[c] / math.sqrt(soft_seen[j][c])
        for c in (0, 1):
            bias_seen[c] += p[c] ** 2
            bias[c] -= p[c] / math.sqrt(bias_seen[c])
        for b, s in share.items():
            seen[b] = seen.get(b, toxicity.FIRST_SUM) + s * s * sum(x * x for x in back)
            for j in range(d):
                vectors[b][j] = (1 - toxicity.DECAY) * vectors[b][j] - s / math.sqrt(seen[b]) * back[j]
    want = vectors @ (soft[:, 1] - soft[:, 0])
    assert np.allclose(got, want, atol=1e-3) and abs(got_bias - (bias[1] - bias[0])) < 1e-3


def test_quality_training_and_scores_against_plain_loops():
    """Follow-the-regularised-leader a weight at a time, in dicts."""
    q = quality_classifier
    texts, y = ["a b c a b", "x y z z z", "a c d", "z z !! z", "b a d c"], [1, 0, 1, 0, 1]
    rows = q.features(texts)
    weights, bias = q.train(rows, np.array(y, float), epochs=3)
    z, n, rng = {}, {}, np.random.default_rng(7)

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= q.L1 else (math.copysign(q.L1, zi) - zi) / ((q.BETA + math.sqrt(n.get(i, 0.0))) / q.ALPHA + q.L2)

    for _ in range(3):
        for k in rng.permutation(len(rows)):
            own = [*zip(rows[k][0].tolist(), rows[k][1].tolist()), (q.BUCKETS, 1.0)]
            w = {i: weight(i) for i, _ in own}
            error = 1 / (1 + math.exp(-sum(w[i] * v for i, v in own))) - y[k]
            for i, v in own:
                g = error * v
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / q.ALPHA * w[i]
                n[i] = n.get(i, 0.0) + g * g
    assert np.allclose(bias, weight(q.BUCKETS), atol=1e-6)
    assert {i for i in np.flatnonzero(weights).tolist()} == {i for i in z if i < q.BUCKETS and weight(i)}
    assert all(abs(weights[i] - weight(i)) < 1e-6 for i in z if i < q.BUCKETS)
    for text, (index, value) in zip(texts, rows):
        want = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in zip(index.tolist(), value.tolist())) - weight(q.BUCKETS)))
        assert abs(q.scores([text], weights, bias)[0] - want) < 1e-5
