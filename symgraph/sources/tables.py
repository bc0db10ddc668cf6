"""Reading and writing tables. What is written on the way goes to the folder that all executors share, so it survives the loss of any."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that is broadcast on purpose, and rows that one task is meant for.
BROADCAST_ROWS = 50_000
ROWS_OF_TASK = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and all runs on this machine (tests), a folder of our own, which goes when the driver ends; else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="symgraph-")
        atexit.register(shutil.rmtree, folder, True)
        path = Path(folder).as_uri()
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: its lineage ends here."""
    path = f"{shared_dir(df.sparkSession)}/symgraph/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_broadcast(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast where it has few rows; it is counted, so it should be a table."""
    return F.broadcast(df) if df.count() <= most else df


def partitions(spark: SparkSession, sf_dir: str, *tables: str) -> int:
    """How many partitions the rows of these tables need, so that a task's share doesn't grow with them. The footers have the counts."""
    rows = sum(read(spark, sf_dir, t).count() for t in tables)
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_OF_TASK))
