import tracemalloc

import numpy as np

from symgraph.llm import embedding_dedup as e

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in v], 0) for i, v in enumerate(x)], SCHEMA)


def brute(x, cosine=e.COSINE):
    x = np.asarray(x, np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(x @ x.T >= cosine, 1))
    rows, roots = e.forest(len(x), a, b)
    return dict(zip(rows.tolist(), roots.tolist()))


def clustered(n, seed=0, dim=64):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(2, n // 6), dim))
    return centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, dim)) * rng.choice([0.05, 0.2, 0.5], (n, 1))


def test_against_brute_force_over_several_shards(spark):
    x = clustered(900)
    want = brute(x)
    got = {r["vec_id"]: r["duplicate_of"] for r in e.near_duplicates(table(spark, x), shard=300, chunk=200).collect()}
    assert got.keys() <= want.keys() and sum(got.get(k) == v for k, v in want.items()) >= e.RECALL * len(want)


def test_a_graph_that_leads_nowhere_is_scanned():
    x = clustered(200, 2).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links, entry = e.build(x)
    left, right = e.query_shard(x, [np.full_like(layer, -1) for layer in links], entry, x)
    assert set(zip(left.tolist(), right.tolist())) >= set(zip(*(i.tolist() for i in np.nonzero(x @ x.T >= e.COSINE))))


def test_a_cosine_of_exactly_the_threshold_counts(spark):
    x = [[1.0, 0.0], [0.6, 0.8], [0.0, 1.0], [0.6 - 1e-3, 0.8]]
    assert {tuple(r) for r in e.near_duplicates(table(spark, x[:2]), cosine=0.6).collect()} == {(1, 0)}
    assert e.near_duplicates(table(spark, [x[0], x[3]]), cosine=0.6).count() == 0


def test_the_graph_itself_finds_neighbours():
    x = clustered(3000, 1).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links, entry = e.build(x)
    start = np.full((len(x), 1), entry, np.int32)
    for layer in range(len(links) - 1, 0, -1):
        start = e._search(x, links[layer], x, start, 1)[0][:, :1]
    ids, _ = e._search(x, links[0], x, start, e.BEAM)
    truth = np.argsort(-(x @ x.T), axis=1)[:, :5]
    assert np.mean([len(set(a[:5]) & set(b)) / 5 for a, b in zip(ids.tolist(), truth.tolist())]) > 0.85
    left, right = e.query_shard(x, links, entry, x)
    want = set(zip(*(i.tolist() for i in np.nonzero(x @ x.T >= e.COSINE))))
    assert len(want & set(zip(left.tolist(), right.tolist()))) >= 0.95 * len(want)


def test_odd_input(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [0.0, 0.0], 0), (4, None, 0), (5, [], 0), (None, [1.0, 0.0], 0), (6, [float("nan"), 1.0], 0), (7, [1.0, None], 0), (8, [1.0, 0.0, 0.0], 0), (9, [1.0, 0.0], 0), (9, [1.0, 0.0], 0), (10, [0.0, 1.0], 0)]
    d = spark.createDataFrame([(*r, 5, 6) for r in rows], SCHEMA + ", id int, dim int")
    assert {tuple(r) for r in e.near_duplicates(d).collect()} == {(2, 1), (9, 1)}
    assert e.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_memory_stays_bounded_in_a_large_group(spark, monkeypatch):
    """Wide beams take fewer queries at once, pairs are united as they come, and no graph is in a row of a table."""
    rng = np.random.default_rng(5)
    x = (np.ones((700, 16)) + rng.normal(size=(700, 16)) * 0.01).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links, entry = e.build(x)
    cells, search = [], e._search
    monkeypatch.setattr(e, "_search", lambda x, links, q, start, ef: (cells.append(len(q) * ef), search(x, links, q, start, ef))[1])
    left, right = e.query_shard(x, links, entry, x)
    assert max(cells) <= 1 << 15 and len(set(zip(left.tolist(), right.tolist()))) >= e.RECALL * 700 * 700
    monkeypatch.undo()

    tables, write = [], e.common.materialize
    monkeypatch.setattr(e.common, "materialize", lambda d, name: (tables.append(d.schema.simpleString()), write(d, name))[1])
    got = e.near_duplicates(table(spark, x), shard=250, chunk=100).collect()
    assert {tuple(r) for r in got} == {(i, 0) for i in range(1, 700)}
    assert tables and not any("binary" in t for t in tables)


def test_the_work_of_a_search_does_not_follow_the_size_of_its_shard(monkeypatch):
    """What a search remembers is bounded by its beam; vectors only pass through the layers above their own; full beams go on in whole batches."""
    peaks = []
    for n in (5000, 50000):
        x = np.random.default_rng(0).normal(size=(n, 8)).astype(np.float32)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        links = np.random.default_rng(1).integers(0, n, (n + 1, 2 * e.LINKS), dtype=np.int32)
        tracemalloc.start()
        e._search(x, links, x[:200], np.zeros((200, 1), np.int32), e.BEAM)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0]

    x = clustered(1500, 3, 16).astype(np.float32)
    x[::10] = x[0] + np.random.default_rng(2).normal(size=(150, 16)) * 0.01
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    searches, search = [], e._search
    monkeypatch.setattr(e, "_search", lambda x, links, q, start, ef: (searches.append((links.shape[1], ef, len(q))), search(x, links, q, start, ef))[1])
    links, entry = e.build(x)
    members = sum(int((layer[:-1, 0] >= 0).sum()) for layer in links[1:])
    assert sum(n for width, ef, n in searches if width == e.LINKS and ef > 1) <= members + len(links)
    searches.clear()
    left, right = e.query_shard(x, links, entry, x)
    want = set(zip(*(i.tolist() for i in np.nonzero(x @ x.T >= e.COSINE))))
    assert len(want & set(zip(left.tolist(), right.tolist()))) >= e.RECALL * len(want)
    assert sum(ef == 2 * e.BEAM for _, ef, _ in searches) <= 2  # one for the audit's sample, one for all


def test_more_equal_vectors_than_a_beam_holds():
    x = np.repeat(np.eye(4, dtype=np.float32), 100, axis=0)
    left, right = e.query_shard(x, *e.build(x), x)
    assert set(zip(left.tolist(), right.tolist())) == {(a, b) for a in range(400) for b in range(400) if a // 100 == b // 100}
