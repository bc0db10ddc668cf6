"""What to show of a graph for a question: words of the question, scores of files, and packing into a budget."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, paths
from .graph import top

MOST_TOKENS = 16
MOST_PER_TOKEN = 6
CALLABLE = ("component", "constructor", "function", "method")
_SOURCE_END = re.compile(r"\.(" + "|".join(sorted(paths.EXTENSION_LANGUAGE, key=len, reverse=True)) + ")$", re.I)


def question_tokens(question: str) -> list[str]:
    """Identifiers of a question, at most MOST_TOKENS: extensions of source files go, and so do short ones and repetitions."""
    out: dict[str, str] = {}
    for raw in re.split(r"[\s,()\[\]]+", question):
        t = _SOURCE_END.sub("", raw)
        if len(t.encode()) >= 3 and re.fullmatch(r"[A-Za-z_$][\w$]*((\.|::)[A-Za-z_$][\w$]*)*", t, re.A):
            out.setdefault(t.lower(), t)
    return list(out.values())[:MOST_TOKENS]


def token_hits(nodes: DataFrame, tokens: DataFrame, most: int = MOST_PER_TOKEN) -> DataFrame:
    """(token, id): callable symbols of that name, or of the token's tail where none bears all of it; the first `most` by place."""
    # a name's first ones before any token meets them
    n = top(nodes.where(F.col("kind").isin(*CALLABLE)).select("id", "name", "file", "line"), ["name"], ["file", "line", "id"], most)
    each = tokens.select("token", F.posexplode(F.array_distinct(F.array(F.col("token"), names.name_tail(F.col("token"))))).alias("way", "k"))
    hit = each.join(n, F.col("k") == F.col("name"))
    first = Window.partitionBy("token")
    hit = hit.withColumn("least", F.min("way").over(first)).where("way = least")
    w = Window.partitionBy("token").orderBy("file", "line", "id")
    return hit.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select("token", "id")


def file_scores(nodes: DataFrame, on_path: DataFrame, named: DataFrame) -> DataFrame:
    """(file, score): 100 for each symbol on the path, 50 for each that was named, 1 for each callable."""
    flag = lambda df, c: df.select("id").distinct().withColumn(c, F.lit(True))
    n = nodes.join(flag(on_path, "p"), "id", "left").join(flag(named, "m"), "id", "left")
    value = F.when(F.col("p"), 100).otherwise(0) + F.when(F.col("m"), 50).otherwise(0) + F.when(F.col("kind").isin(*CALLABLE), 1).otherwise(0)
    return n.groupBy("file").agg(F.sum(value).alias("score"))


def generated_last(files: DataFrame, path: str = "path") -> DataFrame:
    """files with rank: written by hand before generated, each by path. Ranks are made of counts by range, not of one sorted partition."""
    f = files.withColumn("is_generated", paths.is_generated(F.col(path)))
    return ranked(f, [F.col("is_generated"), F.col(path)])


def ranked(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with rank (from 1) by a total order: range partitions, then the number of rows in those before."""
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    from ..sources.tables import materialize

    spread = materialize(spread, "ranked")
    size = spread.groupBy("_p").agg(F.count("*").alias("_c"), F.min("_i").alias("_first"))
    before = size.select("_p", "_first", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return spread.join(before, "_p").withColumn("rank", F.col("_before") + F.col("_i") - F.col("_first") + 1).drop("_p", "_i", "_before", "_first")


def pack_overloads(defs: DataFrame, most_bytes: int = 12_000, most: int = 16) -> DataFrame:
    """Of each name's definitions (name, file, line, size, ...) the first by place that fit: at most `most`, and most_bytes together; the first always fits."""
    w = Window.partitionBy("name").orderBy("file", "line", "id")
    d = defs.withColumn("nth", F.row_number().over(w).cast("long")).withColumn("total", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.where((F.col("nth") == 1) | ((F.col("nth") <= most) & (F.col("total") <= most_bytes)))


@dataclass(frozen=True)
class Budget:
    most_chars: int
    most_files: int
    per_file: int


def budget(n_files: int) -> Budget:
    """By the size of the project."""
    for below, chars, files, per_file in ((150, 13_000, 4, 3800), (500, 18_000, 5, 3800), (5000, 24_000, 8, 6500), (15_000, 24_000, 8, 7000)):
        if n_files < below:
            return Budget(chars, files, per_file)
    return Budget(24_000, 8, 7000)


def pack(parts: list[tuple[str, str, bool]], b: Budget) -> list[tuple[str, str]]:
    """(file, text) in order of rank, cut to the budget: necessary files may take 2.5 times a file's share; at 90 % only necessary ones are taken. A list of at most a few dozen: it is packed on the driver."""
    ceiling = max(b.most_chars, min(b.most_chars * 3 // 2, 25_000))
    out, used = [], 0
    for file, text, needed in parts:
        if not needed and (used >= 0.9 * b.most_chars or len(out) >= b.most_files):
            continue
        room = min(int(b.per_file * (2.5 if needed else 1)), (ceiling if needed else b.most_chars) - used)
        if room <= 0:
            break
        body = text if len(text) <= room else text[:room].rsplit("\n", 1)[0]
        out.append((file, body))
        used += len(body)
    return out
