"""Mixing sources to target weights by Pfair scheduling.

Each source's documents stand in a fixed shuffled order (by hash of the id) and are cut into blocks of BLOCK_CHARS characters. A source of
weight w has to have received w * t blocks after t slots; its block j (from 0) is released at slot floor(j / w) and due by slot
ceil((j + 1) / w). In every slot the released block with the earliest deadline goes next. On one processor that meets every deadline, so at
no time is a source a whole block ahead of its target or behind it. The weights are taken as they are given, as exact fractions; nothing is rounded, so
this holds however long the mix is.

One task plans the slots, one after another, and writes them as a table, so the driver holds a number for each source and no more; that is one step
for each BLOCK_CHARS characters (some 3 microseconds; 100 TB are 10 ** 8 slots, five minutes). The documents then meet the slots by source and
block. Within a slot, documents keep their source's order.

By default the target of a source is proportional to its size to the power TEMPERATURE, and every document has its slot: when a source has
no block left, a new phase begins at that slot, with the others' weights renormalised and scheduled anew, until all is dealt. Each phase is
Pfair among its sources. With weights given, these are targets to be held: the mix ends with the first phase, unless whole is true.

Defined results for odd input:
* a null source is a source of its own; null and empty texts are documents of length 0 and share the block they stand in (at a source's very end:
  its last block); a source without a character has one block;
* a document belongs to the block in which its first character falls; a very long one takes up several blocks, so later blocks of its source may
  be empty: such slots pass with no document;
* ties: of equal deadlines, the source that comes first by name (null last); of equal hashes, the smaller doc_id, then text;
* rows that repeat a doc_id are documents of their own; an empty table gives an empty one; a weight of 0 or of no weight at all leaves its source out,
  and a weight for a source without a character ends the mix at once if targets are to be held; else it counts for nothing where the source has no row;
* extra columns pass through mix_documents() untouched, whatever they are called.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from math import lcm

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BLOCK_CHARS = 1 << 20
TEMPERATURE = 0.7
#: Parts that a source's order is cut into, so that no task has a whole source.
PARTS = 1 << 14
SLOTS_AT_ONCE = 1 << 16

Source = str | None


def _order(s: Source) -> tuple:
    return (s is None, s or "")


def schedule(weights: dict[Source, float]) -> Iterator[Source]:
    """The source of each slot, without end: earliest deadline first among the released blocks. Weights are relative, and taken exactly."""
    live = sorted((s for s, w in weights.items() if w and w > 0), key=_order)
    if not live:
        return
    exact = [Fraction(weights[s]) for s in live]
    scale = lcm(*(x.denominator for x in exact))
    parts = [int(x * scale) for x in exact]
    whole = sum(parts)
    dealt = [0] * len(live)
    ready: list[tuple[int, int]] = [(-(-whole // p), k) for k, p in enumerate(parts)]  # deadline, number of the source
    heapq.heapify(ready)
    waiting: list[tuple[int, int]] = []  # release, number
    slot = 0
    while True:
        while waiting and waiting[0][0] <= slot:
            k = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(dealt[k] + 1) * whole // parts[k]), k))
        k = heapq.heappop(ready)[1]
        dealt[k] += 1
        heapq.heappush(waiting, (dealt[k] * whole // parts[k], k))
        yield live[k]
        slot += 1


def planned(blocks: dict[Source, int], weights: dict[Source, float], whole: bool = True) -> Iterator[tuple[int, Source, int]]:
    """The phase, the source and the number of its block of each slot. When a source has no block left for its slot, the others go on, scheduled anew; not whole: the end."""
    dealt, phase = dict.fromkeys(blocks, 0), 0
    while live := {s: weights[s] for s, n in blocks.items() if dealt[s] < n and (weights.get(s) or 0) > 0}:
        for s in schedule(live):
            if dealt[s] == blocks[s]:
                break
            yield phase, s, dealt[s]
            dealt[s] += 1
        if not whole:
            return
        phase += 1


def _placed(docs: DataFrame, extra: list[Column], block_chars: int) -> DataFrame:
    """source, doc_id, h (place in the source's order), start (characters before it in its source), block, and the extra columns."""
    d = docs.select(common.col("source").cast("string").alias("source"), common.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.length(common.col("text")), F.lit(0)).cast("long").alias("size"), F.xxhash64(common.col("text")).alias("th"), *extra)
    h = F.xxhash64(F.lit("mix"), "doc_id")
    # a null source has a name of its own, so that the join with the sizes is by plain equality and takes over the window's partitioning
    d = d.withColumn("h", h).withColumn("part", F.shiftrightunsigned("h", 64 - (PARTS.bit_length() - 1)).cast("int")).withColumn("name", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    sizes = d.groupBy("name", "part").agg(F.sum("size").alias("part_size"))
    before = Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("name", "part", F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("part_start"))
    own = Window.partitionBy("name", "part").orderBy("h", F.col("doc_id").asc_nulls_last(), "th").rowsBetween(Window.unboundedPreceding, -1)
    placed = d.withColumn("start", F.coalesce(F.sum("size").over(own), F.lit(0))).join(sizes.hint("merge"), ["name", "part"])
    return placed.withColumn("start", F.col("start") + F.col("part_start")).withColumn("block", F.floor(F.col("start") / block_chars).cast("long")).drop("name", "part_start", "part", "th")


def _sizes(docs: DataFrame) -> dict[Source, int]:
    """Characters of each source. One row for each source comes to the driver."""
    rows = docs.groupBy(common.col("source").cast("string").alias("source")).agg(F.sum(F.length(common.col("text"))).alias("n")).collect()
    return {r["source"]: r["n"] or 0 for r in rows}


def _slots(spark: SparkSession, blocks: dict[Source, int], weights: dict[Source, float], whole: bool) -> DataFrame:
    """(t_source, t_block, slot) of the whole mix, planned by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            slots, first = planned(blocks, weights, whole), 0
            while some := [x for _, x in zip(range(SLOTS_AT_ONCE), slots)]:
                yield pa.RecordBatch.from_arrays([pa.array([s for _, s, _ in some], pa.string()), pa.array([b for *_, b in some], pa.int64()), pa.array(range(first, first + len(some)), pa.int64())], ["t_source", "t_block", "slot"])
                first += len(some)

    return common.materialize(spark.range(0, 1, 1, 1).mapInArrow(run, "t_source string, t_block long, slot long"), "mix-slots")


def _mixed(docs: DataFrame, extra: list[Column], weights: dict[Source, float] | None, block_chars: int, whole: bool | None) -> DataFrame:
    """_placed() rows that are in the mix, with slot."""
    sizes = _sizes(docs)
    blocks = {s: max(1, -(-n // block_chars)) for s, n in sizes.items()}
    if weights is None:
        weights = {s: max(1, n) ** TEMPERATURE for s, n in sizes.items()}
        whole = whole is None or whole
    if not whole and not all(sizes.get(s) for s, w in weights.items() if w and w > 0):
        blocks = {}
    spark = docs.sparkSession
    slots = _slots(spark, blocks, weights, bool(whole))
    # from Arrow: a list of rows would start Python workers of another kind, which stay
    per_source = spark.createDataFrame(pa.table({"b_source": pa.array(list(blocks), pa.string()), "last_block": pa.array([n - 1 for n in blocks.values()], pa.int64())}))
    placed = _placed(docs, extra, block_chars).join(common.bounded_broadcast(per_source, len(blocks)), F.col("source").eqNullSafe(F.col("b_source"))).withColumn("block", F.least("block", "last_block"))
    at = placed.join(common.bounded_broadcast(slots, sum(blocks.values())), F.col("source").eqNullSafe(F.col("t_source")) & (F.col("block") == F.col("t_block")))
    return at.drop("b_source", "last_block", "t_source", "t_block")


def mix(docs: DataFrame, weights: dict[Source, float] | None = None, block_chars: int = BLOCK_CHARS, whole: bool | None = None) -> DataFrame:
    """(slot, doc_id, source, block, in_block): the mix is these rows ordered by slot and in_block. Sources to relative weights; None: sizes to the
    power TEMPERATURE. whole: go on when a source runs out; None: where no weights are given."""
    in_block = Window.partitionBy("slot").orderBy("start", "h", F.col("doc_id").asc_nulls_last())
    m = _mixed(docs, [], weights, block_chars, whole).withColumn("in_block", F.row_number().over(in_block).cast("long"))
    return m.select("slot", "doc_id", "source", "block", "in_block")


def mix_documents(docs: DataFrame, weights: dict[Source, float] | None = None, block_chars: int = BLOCK_CHARS, whole: bool | None = None) -> DataFrame:
    """The documents of the mix, all columns as they are, in its order: a file read after another by its part's number gives the interleaving (common.numbered())."""
    row = F.struct(*(common.col(c) for c in docs.columns)).alias("row")
    m = _mixed(docs, [row], weights, block_chars, whole).orderBy("slot", "start", "h", F.col("doc_id").asc_nulls_last())
    return m.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.read(spark, sf_dir, "documents"))
