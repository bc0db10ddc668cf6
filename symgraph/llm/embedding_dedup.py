"""Embedding near-duplicates by a hierarchical navigable small-world graph per shard.

Vectors are spread over shards of about SHARD rows by hash; each shard builds its graph once and stores it as a file of the shared folder. Then every
vector queries every shard: a task has about CHUNK queries and reads one stored graph after another, so no graph passes through Spark's rows and a task
holds one at a time. As every vector queries every shard, the number of searches is rows * rows / SHARD, each costing about the logarithm of SHARD:
shards are as large as a task can hold (65536 vectors of 64 numbers and their links: 24 MB). A beam that ends full of near vectors is widened for that
query until it isn't or it spans the shard; the wider the beam, the fewer queries at once. Each task audits itself on each shard: a sample of its queries
is compared with a scan of the shard, and while recall is under RECALL the beams are made twice as wide, up to one that spans the shard, before all of the
chunk is searched; only if that fails its audit, too, is the shard scanned. Pairs are verified by their exact cosine, and components united over all tasks;
a task reduces its pairs to a spanning forest as it goes, so large groups stay linear in memory and output.

Insertion and search run over batches: all queries of a batch take a step of their beam searches together, in numpy. What a search remembers is bounded by
its beam, not by the shard; beams that have to be wider are gathered into batches of their own. A vector only passes through the layers above its own.

Defined results for odd input:
* a null id, or a null, empty, zero or non-finite embedding, or one with a null element: never a duplicate;
* vectors of different lengths are never near each other;
* ties: a group is named by its least id; a cosine of exactly the threshold counts;
* rows that repeat an id are vectors of one item, each a query; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .simhash import forest
from .warc import _store

COSINE = 0.95
RECALL = 0.95
SHARD = 1 << 16
CHUNK = 1 << 13
LINKS = 12
BEAM = 32
BUILD_BEAM = 48
BATCH = 256
#: Ids that a search remembers, per width of its beam.
SLOTS = 32
AUDITED = 64
#: Queries times beam width of a search, pairs verified, pairs held and queries of a scan at once.
CELLS = 1 << 15
VERIFIED = 1 << 14
PAIRS_AT_ONCE = 1 << 20
SCANNED = 32
#: Nearest vectors that an audited query must find even where they are no duplicates.
NEAREST = 5


def _search(x: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search on one layer: (ids, cosines) of ef each, best first, -1 and -inf where there are fewer. start: the entry point of each query."""
    n, step = len(q), max(2, ef // 8)
    # the last id compared in each slot, of as many slots as the beam needs and not as the shard has rows; what lost its slot is compared again, to no effect
    slots = 1 << (min(SLOTS * ef, len(x)) - 1).bit_length()
    seen = np.full((n, slots), -1, np.int32)
    ids, cos, done = np.full((n, ef), -1, np.int32), np.full((n, ef), -np.inf, np.float32), np.ones((n, ef), bool)
    ids[:, 0], cos[:, 0], done[:, 0] = start[:, 0], np.einsum("bd,bd->b", q, x[start[:, 0]]), False
    go = np.arange(n)
    while len(go):
        i, c, d, rows = ids[go], cos[go], done[go], np.arange(len(go))[:, None]
        pick = np.argsort(d, axis=1, kind="stable")[:, :step]  # the best that aren't expanded
        live = ~d[rows, pick]
        d[rows, pick] = True
        near = np.where(live[:, :, None], links[i[rows, pick]], -1).reshape(len(go), -1)
        # neighbours once each, without those in the beam, which sort before their equals
        keys = np.concatenate([2 * i, 2 * near + 1], 1)
        keys.sort(axis=1)
        fresh = (keys & 1 == 1) & (keys >= 0)
        fresh[:, 1:] &= keys[:, 1:] >> 1 != keys[:, :-1] >> 1
        r, k = np.nonzero(fresh)
        new = keys[r, k] >> 1
        slot = go[r] * slots + (new & (slots - 1))
        unseen = seen.ravel()[slot] != new
        r, new = r[unseen], new[unseen]
        seen.ravel()[slot[unseen]] = new
        new_cos = np.einsum("nd,nd->n", q.take(go[r], 0), x.take(new, 0))
        # only what is better than the beam's last goes in, so what left it never comes back
        better = new_cos > c[r, -1]
        r, new, new_cos = r[better], new[better], new_cos[better]
        count = np.bincount(r, minlength=len(go))
        at = ef + np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
        more = len(go), int(count.max())
        i, c, d = (np.concatenate([v, np.full(more, none, v.dtype)], 1) for v, none in ((i, -1), (c, -np.inf), (d, True)))
        i[r, at], c[r, at], d[r, at] = new, new_cos, False
        order = np.argsort(-c, axis=1)[:, :ef]
        ids[go], cos[go], done[go] = i[rows, order], c[rows, order], d[rows, order]
        go = go[~done[go].all(axis=1)]
    return ids, cos


def _diverse(x: np.ndarray, ids: np.ndarray, cos: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (best first), those nearer to the row's vector than to any taken before; then the best of the rest."""
    own = x[ids]
    among = own @ own.transpose(0, 2, 1)
    taken = np.zeros(ids.shape, bool)
    for k in range(ids.shape[1]):
        blocked = (taken & (among[:, k] > cos[:, k, None])).any(axis=1)
        taken[:, k] = (ids[:, k] >= 0) & ~blocked & (taken.sum(axis=1) < most)
    order = np.argsort(np.where(taken, 0, np.where(ids >= 0, 1, 2)), axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(ids, order, 1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


def build(x: np.ndarray, seed: int = 11) -> tuple[list[np.ndarray], int]:
    """(links of each layer from the bottom up, entry point) over unit vectors."""
    n = len(x)
    rng = np.random.default_rng(seed)
    level = np.minimum((-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(int), 6)
    level[0] = level.max(initial=0)
    top = int(level[0])
    links = [np.full((n + 1, 2 * LINKS if not layer else LINKS), -1, np.int32) for layer in range(top + 1)]
    at = 1
    while at < n:
        new = np.arange(at, min(n, at + min(at, BATCH)))
        start = np.zeros((len(new), 1), np.int32)
        for layer in range(top, -1, -1):
            # those that aren't of this layer only pass through it
            mine, rest = np.flatnonzero(level[new] >= layer), np.flatnonzero(level[new] < layer)
            start[rest] = _search(x, links[layer], x[new[rest]], start[rest], 1)[0]
            if not len(mine):
                continue
            ids, cos = _search(x, links[layer], x[new[mine]], start[mine], BUILD_BEAM)
            start[mine] = ids[:, :1]
            # candidates: what the search found, and earlier ones of the same batch
            own = x[new[mine]] @ x[new].T
            own[(new[None, :] >= new[mine][:, None]) | (level[new] < layer)[None, :]] = -np.inf
            ids = np.concatenate([ids, np.where(own > -np.inf, new[None, :], -1)], 1)
            cos = np.concatenate([cos, own], 1)
            order = np.argsort(-cos, axis=1, kind="stable")[:, :BUILD_BEAM]
            ids, cos = np.take_along_axis(ids, order, 1), np.take_along_axis(cos, order, 1)
            most = links[layer].shape[1]
            chosen = _diverse(x, ids, cos, LINKS)
            links[layer][new[mine], :LINKS] = chosen
            # links back, the targets' lists being chosen again where they are full
            a, b = np.repeat(new[mine], LINKS), chosen.ravel()
            a, b = a[b >= 0], b[b >= 0]
            order = np.argsort(b, kind="stable")
            a, b = a[order], b[order]
            target, first, count = np.unique(b, return_index=True, return_counts=True)
            wide = np.full((len(target), int(count.max(initial=0))), -1, np.int32)
            wide[np.repeat(np.arange(len(target)), count), np.arange(len(b)) - np.repeat(first, count)] = a
            by_count = np.argsort(count, kind="stable")  # so a target of many doesn't widen the others' lists
            for i in range(0, len(target), BATCH):
                some = by_count[i : i + BATCH]
                t = target[some]
                ids = np.concatenate([links[layer][t], wide[some, : count[some[-1]]]], 1)
                cos = np.where(ids >= 0, np.einsum("bd,bkd->bk", x[t], x[ids]), -np.inf)
                order = np.argsort(-cos, axis=1, kind="stable")[:, : 4 * most]
                ids, cos = np.take_along_axis(ids, order, 1), np.take_along_axis(cos, order, 1)
                full = (ids >= 0).sum(axis=1) > most
                links[layer][t[~full]] = np.pad(ids[~full], ((0, 0), (0, max(0, most - ids.shape[1]))), constant_values=-1)[:, :most]
                if full.any():
                    links[layer][t[full]] = _diverse(x, ids[full], cos[full], most)
        at = int(new[-1]) + 1
    return links, 0


def _pairs(x: np.ndarray, links: list[np.ndarray], entry: int, q: np.ndarray, cosine: float, recall: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """query_shard()'s pairs, a run at a time."""
    loose = cosine - 1e-5  # 32-bit; exact cosines decide later

    def beams(rows: np.ndarray, ef: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs, and the NEAREST ids of each query."""
        start, top = np.full((len(rows), 1), entry, np.int32), len(links) - 1
        while len(rows):
            at_once, wider = max(1, min(BATCH, CELLS // ef)), []
            for i in range(0, len(rows), at_once):
                part, at = rows[i : i + at_once], start[i : i + at_once]
                for layer in range(top, 0, -1):
                    at = _search(x, links[layer], q[part], at, 1)[0]
                ids, cos = _search(x, links[0], q[part], at, ef)
                filled = (cos[:, -1] >= loose) & (ef < len(x))  # there may be more: these go again, wider, from the best they have found
                a, k = np.nonzero((cos >= loose) & ~filled[:, None])
                yield part[a], ids[a, k].astype(np.int64), ids[: len(ids) * (top >= 0), :NEAREST]
                wider.append((part[filled], ids[filled, :1]))
            rows, start = map(np.concatenate, zip(*wider))
            top, ef = -1, 2 * ef

    sample = np.random.default_rng(3).permutation(len(q))[:AUDITED]
    number = np.full(len(q), -1)
    number[sample] = np.arange(len(sample))
    truth = q[sample] @ x.T
    fifth = np.partition(truth, len(x) - min(NEAREST, len(x)), axis=1)[:, len(x) - min(NEAREST, len(x))]
    dup, nearest = truth >= loose, np.minimum((truth >= fifth[:, None]).sum(axis=1), NEAREST).sum()
    del truth
    ef = BEAM
    while True:
        found, close = np.zeros(dup.shape, bool), []
        for left, right, near in beams(sample, ef):
            found[number[left], right] = True
            close.append(near)
        ok = not dup.any() or found[dup].mean() >= recall
        found = np.zeros((len(sample), len(x) + 1), bool)
        found[np.arange(len(sample))[:, None], np.concatenate(close)] = True
        ok &= found[:, :-1].sum() >= recall * nearest
        if ok or ef >= len(x):
            break
        ef *= 2
    del found, dup
    if ok:
        yield from ((left, right) for left, right, _ in beams(np.arange(len(q)), ef))
        return
    # a graph that doesn't lead everywhere: scan
    for i in range(0, len(q), SCANNED):
        a, b = np.nonzero(q[i : i + SCANNED] @ x.T >= loose)
        yield a + i, b


def query_shard(x: np.ndarray, links: list[np.ndarray], entry: int, q: np.ndarray, cosine: float = COSINE, recall: float = RECALL) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs of q and the shard's unit vectors x whose cosine may be `cosine` or more, with at least that recall on an audited sample."""
    if not len(q) or not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    left, right = zip(*_pairs(x, links, entry, q, cosine, recall))
    return np.concatenate(left), np.concatenate(right)


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy().astype(np.float64).reshape(-1, dim)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _built(folder: str):
    def run(table: pa.Table) -> pa.Table:
        dim, shard = table["dim"][0].as_py(), table["shard"][0].as_py()
        x = _unit(table["e"].combine_chunks(), dim)
        links, entry = build(x)
        fs, path = _store(folder)
        fs.create_dir(path, recursive=True)
        name = f"{path}/{dim}-{shard}.npz"
        attempt = f"{name}.{uuid.uuid4().hex}"
        with fs.open_output_stream(attempt) as out:
            np.savez(held := io.BytesIO(), x=x, ids=table["id"].to_numpy(), entry=entry, **{f"l{i}": v for i, v in enumerate(links)})
            out.write(held.getbuffer())
        fs.move(attempt, name)
        return pa.table({"dim": [dim], "shard": [shard]}, schema=pa.schema([("dim", pa.int32()), ("shard", pa.int32())]))

    return run


def _united(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of these edges."""
    known, number = np.unique(np.concatenate([a, b]), return_inverse=True)
    rows, roots = forest(len(known), number[: len(a)], number[len(a) :])
    return known[rows], known[roots]


def _edges(q: np.ndarray, own: np.ndarray, g: np.lib.npyio.NpzFile, cosine: float, recall: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of the queries q, own being their ids, and a stored shard's vectors."""
    x, ids, links = g["x"], g["ids"], [g[f"l{i}"] for i in range(sum(k.startswith("l") for k in g.files))]
    held, n = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
    for left, right in _pairs(x, links, int(g["entry"]), q, cosine, recall):
        for i in range(0, len(left), VERIFIED):
            a, b = left[i : i + VERIFIED], right[i : i + VERIFIED]
            keep = (q[a].astype(np.float64) * x[b].astype(np.float64)).sum(axis=1) >= cosine - 1e-7
            held.append((own[a[keep]], ids[b[keep]]))
            n += int(keep.sum())
            if n >= PAIRS_AT_ONCE:
                held, n = [_united(*map(np.concatenate, zip(*held)))], 0
    return _united(*map(np.concatenate, zip(*held)))


def _queried(folder: str, shards: dict[int, list[int]], chunk: int, cosine: float, recall: float):
    """shards: of each dimension."""

    def searched(queries: pa.Table) -> Iterator[pa.RecordBatch]:
        fs, path = _store(folder)
        for dim in pc.unique(queries["dim"]).to_pylist():
            some = queries.filter(pc.equal(queries["dim"], dim)).combine_chunks()
            q, own = _unit(some["e"].combine_chunks(), dim), some["id"].to_numpy()
            for shard in shards[dim]:
                with fs.open_input_file(f"{path}/{dim}-{shard}.npz") as f, np.load(f) as g:
                    a, b = _edges(q, own, g, cosine, recall)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, chunk):
                held.append(batch.slice(i, chunk))
                n += held[-1].num_rows
                if n >= chunk:
                    yield from searched(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            yield from searched(pa.Table.from_batches(held))

    return run


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, recall: float = RECALL, shard: int = SHARD, chunk: int = CHUNK) -> DataFrame:
    """(vec_id, duplicate_of) for every vector but the first of each group; duplicate_of is the least vec_id of its group."""
    e = common.col("embedding")
    v = embeddings.select(common.col("vec_id").cast("long").alias("id"), e.cast("array<float>").alias("e"))
    finite = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = v.where(F.col("id").isNotNull() & (F.size("e") > 0) & finite & F.exists("e", lambda c: c != 0)).withColumn("dim", F.size("e"))
    vectors = common.materialize(v, "embedding-vectors")
    n = vectors.count()
    shards, chunks = max(1, -(-n // shard)), max(1, -(-n // chunk))
    spark = embeddings.sparkSession
    folder = common.table_path(spark, "embedding-graphs")
    own = vectors.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    built: dict[int, list[int]] = {}
    for r in own.groupBy("dim", "shard").applyInArrow(_built(folder), "dim int, shard int").collect():  # a row for each shard
        built.setdefault(r["dim"], []).append(r["shard"])
    edges = vectors.repartition(chunks).mapInArrow(_queried(folder, built, chunk, cosine, recall), "a long, b long")
    roots = common.connected_components(edges, "embedding-components")
    common.drop_table(vectors)
    common.drop_path(spark, folder)
    return roots.where("id <> root").selectExpr("id AS vec_id", "root AS duplicate_of")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read(spark, sf_dir, "embeddings"))
