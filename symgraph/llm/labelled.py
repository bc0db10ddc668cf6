"""A bounded sample of labelled documents, as features, on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

Features = tuple[np.ndarray, np.ndarray]


def sample(docs: DataFrame, labels: DataFrame, label: str, features: Callable[[list[str]], list[Features]], most: int, named: bool = False) -> tuple[list[Features], np.ndarray, list[str]]:
    """Features and 0/1 labels of at most `most` labelled documents: those whose doc_id hashes lowest, so the same rows each time.

    named: features() names its features by strings; they come back numbered, with their names.

    Rows without an id, label or text are left out; of labels that repeat a doc_id, the largest counts, and of texts the least.
    """
    y = labels.select(common.col("doc_id").cast("long").alias("id"), common.col(label).cast("int").alias("y")).dropna().groupBy("id").agg(F.max("y").alias("y"))
    some = common.materialize(y.orderBy(F.xxhash64("id"), "id").limit(most), "labelled")
    d = docs.select(common.col("doc_id").cast("long").alias("id"), common.col("text").alias("text")).where("text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = features(batch["text"].to_pylist())
            ends = np.concatenate([[0], np.cumsum([len(i) for i, _ in got])]).astype(np.int32)
            flat = pa.array([x for i, _ in got for x in i], pa.string()) if named else pa.array(np.concatenate([np.zeros(0, np.int32), *(i for i, _ in got)]).astype(np.int32))
            value = np.concatenate([np.zeros(0, np.float32), *(v for _, v in got)]).astype(np.float32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), x) for x in (flat, pa.array(value))]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["y"], *lists], ["id", "y", "i", "v"])

    # at most `most` ids: small enough to broadcast whatever the corpus
    chosen = d.join(F.broadcast(some), "id").groupBy("id").agg(F.first("y").alias("y"), F.min("text").alias("text"))
    rows = chosen.select("id", "y", "text").mapInArrow(run, f"id long, y int, i array<{'string' if named else 'int'}>, v array<float>").toArrow().sort_by("id")
    y = rows["y"].to_numpy().astype(np.float64)
    index, value = rows["i"].combine_chunks(), rows["v"].combine_chunks()
    del rows
    common.drop_table(some)
    names: list[str] = []
    ends, flat, weights = index.offsets.to_numpy(), index.values, value.values.to_numpy()
    if named:
        coded = flat.dictionary_encode()
        flat, names = coded.indices, coded.dictionary.to_pylist()
    flat = flat.to_numpy()
    return [(flat[a:b], weights[a:b]) for a, b in zip(ends, ends[1:])], y, names
