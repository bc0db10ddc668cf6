"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER_DIR = "/opt/tokenizers"

#: Rows of a side that is broadcast on purpose; beyond it the shuffled way is taken.
BROADCAST_ROWS = 50_000


def col(name: str) -> Column:
    """A column by its whole name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a folder of our own if all runs on this machine (tests); else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="symgraph-")
        atexit.register(shutil.rmtree, path, True)
        path = Path(path).as_uri()
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/symgraph/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: it cuts lineage and survives the loss of executors."""
    path = table_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.symgraph_path = path
    return out


def numbered(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """These columns of df and position, its rows' place from 0 on. Of Parquet files, that is by the number of the part, name and row, however a scan packs the
    files into tasks; what is no scan of files is written to some first."""
    try:
        # a plan of more than the scan may have the files' places of one of its inputs
        if not df._jdf.queryExecution().analyzed().children().isEmpty():
            return numbered(materialize(df.select(*map(col, columns)), name), columns, name)
        meta = df.metadataColumn("_metadata")
        d = df.select(*map(col, columns), meta.getField("file_name").alias("in_file"), meta.getField("row_index").alias("in_row"))
    except AnalysisException:
        return numbered(materialize(df.select(*map(col, columns)), name), columns, name)
    n_rows = df.select(meta.getField("file_name").alias("file")).groupBy("file").count().collect()  # a row for each file
    part = re.compile(r"part-(\d+)")
    at, places = 0, []
    for r in sorted(n_rows, key=lambda r: (int(m[1]) if (m := part.match(r["file"])) else -1, r["file"])):
        places.append((r["file"], at))
        at += r["count"]
    # from Arrow: a list of rows would start Python workers of another kind, which stay
    places = df.sparkSession.createDataFrame(pa.table({"at_file": pa.array([f for f, _ in places], pa.string()), "at": pa.array([n for _, n in places], pa.int64())}))
    d = d.join(F.broadcast(places), F.col("in_file") == F.col("at_file"))
    return d.select(*map(col, columns), (F.col("at") + F.col("in_row")).alias("position"))


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int) -> Iterator[pa.Table]:
    """Batches sorted by key as tables of about this many rows, each with all the rows of its keys."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if n >= rows and batch[key][-1] != held[-1][key][-1]:
            # all but the last key of the new batch are complete
            keys = batch[key].to_numpy()
            cut = int(np.argmax(keys == keys[-1]))
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held, n = [], 0
            batch = batch.slice(cut)
        held.append(batch)
        n += batch.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def blocked(df: DataFrame, key: str, row_id: str, hot: int, counted: DataFrame | None = None) -> DataFrame:
    """df with keys of at most about 2 * hot rows: the rows of a key with more are spread over blocks, and each pair of blocks has a key of its own, so any two rows
    of a key still meet in one. counted: (key, of rows) to count in, where it is known which rows can have such a key."""
    heavy = (df.select(key) if counted is None else counted).groupBy(F.col(key).alias("hot_key")).count().where(F.col("count") > hot)
    heavy = materialize(heavy.select("hot_key", F.ceil(F.col("count") / hot).cast("int").alias("blocks")), "hot-keys")
    n = heavy.count()
    if not n:
        drop_table(heavy)
        return df
    p = df.join(bounded_broadcast(heavy, n), F.col(key) == F.col("hot_key"), "left").withColumn("own", F.pmod(F.xxhash64(row_id), F.col("blocks")))
    p = p.withColumn("other", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1))))
    pair = F.xxhash64(key, F.least("own", "other"), F.greatest("own", "other"))
    return p.withColumn(key, F.when(F.col("blocks").isNull(), F.col(key)).otherwise(pair)).drop("hot_key", "blocks", "own", "other")


def drop_table(df: DataFrame) -> None:
    """Deletes the folder of a DataFrame that materialize() returned."""
    drop_path(df.sparkSession, df.symgraph_path)


def drop_path(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most limit rows; else as it is, and Spark shuffles it."""
    return F.broadcast(df) if rows <= limit else df


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum("v")).first())


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(a, b) edges over longs -> (id, root), root being the least id that id is connected to. Ids without an edge don't occur.

    Alternating large-star and small-star steps over tables in the shared folder, until a round changes nothing: about log(n) rounds,
    each a shuffle of the edges. The minimum of a vertex is aggregated before it is shuffled; the join that hands it out again is a sort-merge join
    whose streamed side is the edges, so a vertex with many edges costs a task time, not memory, and AQE splits it (skew join).
    """
    e = materialize(edges.where("a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct(), name)
    seen = _fingerprint(e)
    while True:
        # large star: every larger neighbour of u is linked to the least of u and its neighbours
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").selectExpr("v AS u", "m AS v").where("u <> v").distinct()
        # small star: u and its smaller neighbours are linked to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").selectExpr("v AS u", "m AS v").union(low.selectExpr("u", "m AS v")).distinct()
        new = materialize(small, name)
        drop_table(e)
        e, before, seen = new, seen, _fingerprint(new)
        if seen == before:
            return e.selectExpr("u AS id", "v AS root").union(e.selectExpr("v AS id", "v AS root").distinct())
