"""Keeping tables: last writer wins, cascades, and the parts of a snapshot that changed. Nothing is updated in place: each operator gives the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REVISION = "1"


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    """old and new with one row for each key: of new before old, the first by order, which must be total."""
    both = old.withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)), allowMissingColumns=True)
    return first_of(both, key, ["_age", *order]).drop("_age")


def first_of(df: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    """A row for each key, the first by order. An aggregate, not a window: rows are combined before they are shuffled."""
    rest = [c for c in df.columns if c not in key]
    by = [F.struct(*(o if isinstance(o, Column) else F.col(o) for o in order)), F.struct(*rest)]
    return df.groupBy(*key).agg(F.min_by(by[1], by[0]).alias("_r")).select(*key, "_r.*").select(*df.columns)


def cascade_delete(nodes: DataFrame, edges: DataFrame, refs: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the symbols of the files that are gone (file), without edges at either end of them, and without their references."""
    files = gone.select("file").distinct()
    ids = nodes.join(files, "file", "left_semi").select("id")
    kept = nodes.join(files, "file", "left_anti")
    e = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    return kept, e, refs.join(ids.withColumnRenamed("id", "from_node"), "from_node", "left_anti")


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) of two snapshots (path, size, content_hash): added, removed, changed; files that are the same don't occur. A different size settles it before the hash is looked at."""
    o, n = old.select("path", F.col("size").alias("o_size"), F.col("content_hash").alias("o_hash")), new.select("path", F.col("size").alias("n_size"), F.col("content_hash").alias("n_hash"))
    change = F.when(F.col("o_hash").isNull(), "added").when(F.col("n_hash").isNull(), "removed").when((F.col("o_size") != F.col("n_size")) | (F.col("o_hash") != F.col("n_hash")), "changed")
    return o.join(n, "path", "full").select("path", change.alias("change")).where("change IS NOT NULL")


def touched(old: DataFrame, new: DataFrame) -> DataFrame:
    """new (path, size, mtime, content_hash, indexed_at): where the hash is the same only mtime and size are new, indexed_at stays."""
    o = old.select("path", F.col("content_hash").alias("o_hash"), F.col("indexed_at").alias("o_at"))
    j = new.join(o, "path", "left")
    return j.withColumn("indexed_at", F.when(F.col("o_hash") == F.col("content_hash"), F.col("o_at")).otherwise(F.col("indexed_at"))).select(*new.columns)


def stats(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """(n_nodes, n_edges, n_files, revision)."""
    one = [df.agg(F.count("*").alias(k)) for k, df in (("n_nodes", nodes), ("n_edges", edges), ("n_files", files))]
    return one[0].crossJoin(one[1]).crossJoin(one[2]).withColumn("revision", F.lit(REVISION))


def counts(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"))


def incoming_by_file(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, n): edges into the symbols of each file. Counted by node before the join."""
    per_node = edges.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("m"))
    return per_node.join(nodes.select("id", "file"), "id").groupBy("file").agg(F.sum("m").alias("n"))


def evolve(df: DataFrame, schema: str, spark: SparkSession) -> DataFrame:
    """df with the columns of schema that it lacks, as nulls, in that order; its other columns follow."""
    want = spark.createDataFrame([], schema)
    out = want.unionByName(df, allowMissingColumns=True)
    return out


def save_snapshot(spark: SparkSession, folder: str, tables: dict[str, DataFrame]) -> None:
    """Writes the tables and then the revision: a folder without that is no snapshot."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    spark.createDataFrame([(REVISION,)], "revision string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/_meta")


def load_snapshot(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame] | None:
    """The tables of a snapshot, or None where there is none of this revision: it has to be built again."""
    from pyspark.errors import AnalysisException

    try:
        found = spark.read.parquet(f"{folder}/_meta").first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if not found or found["revision"] != REVISION:
        return None
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def last_by_change(events: DataFrame, key: list[str], at: str, tie: str) -> DataFrame:
    """The last event of each key."""
    w = Window.partitionBy(*key).orderBy(F.desc(at), F.desc(tie))
    return events.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
