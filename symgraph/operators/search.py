"""Full text over any table of texts: postings, phrase and prefix matches, BM25; and search by regular expression.

A query's words are AND-ed; a word in a text is a run of letters, digits and _ of its lower-case form. Postings are an aggregate by (word, id): the
words of the query are filtered before anything is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .graph import top

K1, B = 1.2, 0.75
MOST = 50
MOST_LINES, LINES_OF_FILE = 70, 12


def query_words(query: str) -> tuple[list[str], bool]:
    """The words of a query, lower-cased, each once; whether the last is a prefix (a * at the end)."""
    prefix = query.rstrip().endswith("*")
    found = re.findall(r"\w+", query.lower())
    return list(dict.fromkeys(found)), prefix and bool(found)


def postings(docs: DataFrame, words: list[str] | None = None) -> DataFrame:
    """(id, word, tf) of docs (id, text); of these words only, if given."""
    w = docs.select("id", F.explode(text.words(F.col("text"))).alias("word"))
    if words is not None:
        w = w.where(F.col("word").isin(words))
    return w.groupBy("id", "word").agg(F.count("*").alias("tf"))


def matching(docs: DataFrame, query: str) -> DataFrame:
    """(id, tf_...) rows of docs (id, text) that hold all words of the query, with the number of hits of each: tf_0, tf_1, ..."""
    words, prefix = query_words(query)
    if not words:
        return docs.select("id").where("false")
    own = text.words(F.col("text"))

    def hits(k: int, w: str) -> Column:
        test = (lambda x: F.startswith(x, F.lit(w))) if prefix and k == len(words) - 1 else (lambda x: x == w)
        return F.size(F.filter(F.col("ws"), test)).cast("long")

    # the text must hold the query's words as strings before its own words are made
    maybe = docs
    for w in words:
        maybe = maybe.where(F.contains(F.lower(F.col("text")), F.lit(w)))
    d = maybe.select("id", own.alias("ws")).select("id", F.size("ws").cast("long").alias("n_words"), *(hits(k, w).alias(f"tf_{k}") for k, w in enumerate(words)))
    for k in range(len(words)):
        d = d.where(F.col(f"tf_{k}") > 0)
    return d


def bm25(docs: DataFrame, query: str, most: int = MOST) -> DataFrame:
    """(id, score): the best `most` of docs (id, text) that hold all words of the query, ties by id."""
    words, _ = query_words(query)
    m = matching(docs, query)
    if not words:
        return m.select("id", F.lit(0.0).alias("score"))
    size = docs.where("text IS NOT NULL").select(F.size(text.words(F.col("text"))).cast("long").alias("n"), *(F.contains(F.lower(F.col("text")), F.lit(w)).alias(f"c_{k}") for k, w in enumerate(words)), text.words(F.col("text")).alias("ws"))
    prefix = query_words(query)[1]

    def holds(k: int, w: str) -> Column:
        return F.exists("ws", (lambda x: F.startswith(x, F.lit(w))) if prefix and k == len(words) - 1 else (lambda x: x == w))

    stats = size.agg(F.count("*").alias("n_docs"), F.avg("n").alias("avg_len"), *(F.count(F.when(F.col(f"c_{k}") & holds(k, w), 1)).alias(f"df_{k}") for k, w in enumerate(words)))
    s = m.crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for k in range(len(words)):
        idf = F.log1p((F.col("n_docs") - F.col(f"df_{k}") + 0.5) / (F.col(f"df_{k}") + 0.5))
        tf = F.col(f"tf_{k}")
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n_words") / F.col("avg_len")))
    return s.select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(most)


def phrase(docs: DataFrame, words: list[str]) -> DataFrame:
    """(id) of docs that hold these words one right after another."""
    joined = F.concat(F.lit(" "), F.array_join(text.words(F.col("text")), " "), F.lit(" "))
    return docs.where(F.contains(joined, F.lit(f" {' '.join(w.lower() for w in words)} "))).select("id")


def scan(docs: DataFrame, pattern: str, ignore_case: bool = False, per_file: int = LINES_OF_FILE, most: int | None = MOST_LINES) -> DataFrame:
    """(file, line, content): lines of docs (file, text) that the regular expression matches, the first per_file of each file and `most` in all."""
    p = f"(?i){pattern}" if ignore_case else pattern
    lines = docs.where(F.regexp_like("text", F.lit(f"(?m){p}"))).select("file", F.posexplode(F.split("text", "\n")).alias("pos", "content"))
    hit = lines.where(F.regexp_like("content", F.lit(p))).select("file", (F.col("pos") + 1).cast("long").alias("line"), "content")
    hit = top(hit, ["file"], ["line"], per_file)
    return hit.orderBy("file", "line").limit(most) if most else hit


def scan_counts(docs: DataFrame, word: str) -> DataFrame:
    """(file, n): lines of each file that hold word as a whole word."""
    p = rf"(^|[^\p{{L}}\p{{N}}_]){re.escape(word)}($|[^\p{{L}}\p{{N}}_])"
    n = F.size(F.filter(F.split("text", "\n"), lambda x: F.regexp_like(x, F.lit(p)))).cast("long")
    return docs.where(F.contains("text", F.lit(word))).select("file", n.alias("n")).where("n > 0")
