import re
import unicodedata

import numpy as np
from pyspark.sql import functions as F

from symgraph.llm import quality_rules
from tests import oracle
from tests.llm import data


def test_the_sql_says_the_same(spark, sf_dir):
    assert oracle.difference(quality_rules.query(spark, sf_dir), oracle.connect(sf_dir), quality_rules.SQL) == ""


def test_junk_goes_and_clean_text_stays(spark):
    clean = [f"This is text number {i} with several quite ordinary words in it, written by {chr(97 + i % 26)}{i}." for i in range(60)]
    junk = ["$$$ %%% ### @@@ !!! ^^^ &&& *** ((( )))" * 5, "BUY NOW " * 60, "same " * 300]
    kept = {r["doc_id"] for r in quality_rules.filter_documents(data.docs(spark, clean + junk)).collect()}
    assert kept == set(range(60))


def test_small_groups_take_the_fences_of_larger_ones(spark):
    """A source of one document has nearly its language's fences, one of many its own; between, they move without a step."""
    plain = [f"plain words here number {i}" for i in range(400)]
    loud = ["LOUD WORDS HERE"] * 400

    def fence(n):
        d = data.docs(spark, plain).union(data.docs(spark, loud[:n], "en", "rare"))
        m = d.select("lang", "source", quality_rules.measures("text").alias("m")).select("lang", "source", "m.*")
        return {r["source"]: r["max_upper_ratio"] for r in quality_rules.thresholds(m).collect()}["rare"]

    found = [fence(n) for n in (1, 29, 30, 31, 400)]
    assert found == sorted(found) and found[0] < 0.06 and found[4] > 0.1
    assert found[2] - found[1] < 0.01 and found[3] - found[2] < 0.01


def test_fences_do_not_depend_on_the_partitions(spark):
    """80 000 continuous measures: the same fences for any partitioning and in any run."""
    d = spark.range(80_000).selectExpr("'en' AS lang", "CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS source", "5L AS n_words", *(f"abs(hash(id, {k})) / 2147483649D AS {c}" for k, c in enumerate(quality_rules.RULES)))
    found = {tuple(sorted(map(tuple, quality_rules.thresholds(d.repartition(n)).collect()))) for n in (1, 8, 64) for _ in range(2)}
    assert len(found) == 1


def test_measures_against_plain_loops(spark):
    texts = ["", "One, TWO two!", "naïve Café — ÜNÏ 漢字 😀 $$$", "a\tb\nc\x0bd e\r\nF", "x" * 300_000 + " Y", " \n\t"]
    got = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string").select(quality_rules.measures("text").alias("m")).select("m.*").collect()
    for t, r in zip([*texts, ""], got):
        words = re.findall("[^ \t\r\n]+", t.lower())
        kinds = [unicodedata.category(c) for c in t if c not in " \t\n\x0b\x0c\r"]
        assert r["n_words"] == len(words) and r["symbol_ratio"] == sum(k[0] not in "LN" for k in kinds) / (len(t) + 100)
        assert r["upper_ratio"] == sum(k == "Lu" for k in kinds) / (len(t) + 100) and r["distinct_ratio"] == (len(set(words)) / len(words) if words else None)


def test_ties_on_a_fence_stay(spark):
    d = data.docs(spark, ["some plain words, all alike"] * 50)
    m = d.select("lang", "source", quality_rules.measures("text").alias("m")).select("lang", "source", "m.*")
    fence = quality_rules.thresholds(m).first()
    same = m.withColumn("upper_ratio", F.lit(fence["max_upper_ratio"])).limit(1)
    above = m.withColumn("upper_ratio", F.lit(np.nextafter(fence["max_upper_ratio"], 1))).limit(1)
    assert quality_rules._joined(same.union(above), quality_rules.thresholds(m)).count() == 1


def test_odd_input(spark):
    d = data.odd_docs(spark)
    kept = quality_rules.filter_documents(d)
    assert kept.columns == d.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert not {2, 3, 4} & set(ids), "without a word there is no quality"
    assert {1, 6, 8, None} <= set(ids)
    assert ids.count(7) in (0, 2)
    assert quality_rules.quality_rules(data.empty_docs(spark)).count() == 0 and quality_rules.filter_documents(data.empty_docs(spark)).count() == 0
