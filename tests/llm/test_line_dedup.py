import random
import re
import subprocess
import sys
from fractions import Fraction
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from symgraph.llm import line_dedup
from tests.llm import data


def brute(rows, s=line_dedup.SIMILARITY):
    """{row number: removed positions} by comparing every pair of lines."""
    lines = []
    for k, (doc_id, text) in enumerate(rows):
        for pos, line in enumerate((text or "").split("\n") if text is not None else []):
            words = frozenset(re.findall(r"[^ \t\r\n\f]+", line.lower()))
            lines.append((((doc_id is None, doc_id or 0, text), pos), k, words))
    gone = {}
    for at, k, words in lines:
        for other, _, w in lines:
            if words and other < at and other != at and (words == w or Fraction(len(words & w), len(words | w)) >= s):
                gone.setdefault(k, set()).add(at[1])
                break
    return gone


def cleaned(rows, gone):
    return sorted(((i, None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone.get(k, ())), len(gone.get(k, ()))) for k, (i, t) in enumerate(rows)), key=repr)


def random_rows(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + [f"v{i}" for i in range(2000)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 7, 14, 30, 120, 500]))] for _ in range(12)]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(rng.randint(0, 6)):
            words = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, len(words) // 12])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            lines.append(" ".join(words))
        rows.append((i, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed):
    rows = random_rows(seed)
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(map(tuple, got.collect()), key=repr) == cleaned(rows, brute(rows))


@pytest.mark.parametrize("limits", [{"candidates": 1}, {"hot": 3}, {"candidates": 1, "hot": 2}])
def test_small_bounds_change_nothing(spark, limits):
    """Few candidates at first, and words spread over blocks: the same lines go."""
    rows = random_rows(3)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc"]: sorted(r["positions"]) for r in line_dedup.removed_lines(d, **limits).collect()}
    names = {r["doc_id"]: r["doc"] for r in d.select("doc_id", F.xxhash64("doc_id", "text").alias("doc")).collect()}
    assert got == {names[i]: sorted(p) for i, p in brute(rows).items()}


@pytest.mark.parametrize("offset", [0, -5, 1 << 40])
def test_ids_that_cannot_be_packed(spark, offset):
    """Negative, huge, null and repeated ids: lines are numbered by sorting. Texts of one id are ordered by hash, so only the number of lines that are left is compared."""
    rows = [(i + offset if i % 9 else None, t) for i, t in random_rows(7)] if offset else [*random_rows(7), *random_rows(7)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    want = cleaned(rows, brute(rows))
    if offset:
        assert sum(r["n_removed"] for r in got.collect()) == sum(w[2] for w in want)
    else:
        assert sorted(map(tuple, got.collect()), key=repr) == want


def test_the_sql_says_the_same(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(con.sql(line_dedup.SQL).select("doc_id, text, n_removed").fetchall(), key=repr)
    assert sorted(map(tuple, line_dedup.query(spark, sf_dir).collect()), key=repr) == want


def test_odd_input(spark):
    d = data.odd_docs(spark)
    out = line_dedup.clean_documents(d)
    assert out.columns == d.columns and out.schema.simpleString() == d.schema.simpleString()
    rows = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert (2, None) in rows and (3, "") in rows and (4, " \n\t\n") in rows
    assert len([1 for i, _ in rows if i == 7]) == 2, "rows that are the same document stay or go alike"
    assert {i for i, _ in rows} == {1, 2, 3, 4, 5, 7, None}, "6 and 8 say nothing new"
    assert next(t for i, t in rows if i == 5).count("\n") == 1
    assert line_dedup.line_dedup(data.empty_docs(spark)).count() == 0
    assert line_dedup.clean_documents(data.empty_docs(spark)).count() == 0


def test_many_variants_of_one_passage(spark):
    """Each line but the first has an earlier match, though few match the very first."""
    words = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(80):
        words[i % 40] = f"q{i}"
        rows.append((i, " ".join(words)))
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.where("n_removed = 0").select(F.min("doc_id"), F.count("*")).first() == (0, 1)


def test_a_filter_on_the_cleaned_text_does_not_run_python_twice(spark):
    """One Python operator in a task of clean_documents(), so one worker for each of an executor's cores; and workers don't load pandas for it."""
    d = line_dedup.clean_documents(data.docs(spark, ["one two three\nfour five six", "one two three\nseven eight nine", "one two three", ""]))
    assert d._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted((r["doc_id"], r["text"]) for r in d.collect()) == [(0, "one two three\nfour five six"), (1, "seven eight nine"), (3, "")]
    assert subprocess.run([sys.executable, "-c", "import sys, symgraph.llm.line_dedup; sys.exit('pandas' in sys.modules)"], cwd=Path(__file__).parents[2]).returncode == 0
