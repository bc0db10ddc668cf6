"""Quality rules whose thresholds come from the data: mergeable quantile sketches per language and source.

Every document gets three measures; every (lang, source) group gets a sketch of each: the count of each bucket, a bucket being an octave cut into
2 ** FINE steps, so a quantile is off by one part in 2 ** FINE at most, and by 2 ** -(FINE + OCTAVES) near zero. Two sketches merge by
adding their counts, so the sums, and with them the fences, are the same however the rows are spread and merged. The quantiles of a source are drawn
to those of its language, and these to those of all documents, as if PRIOR more documents of the larger group stood in the smaller: a small group takes the
larger one's fences, and its own say grows with its size, without a step. The documents are then joined with the fences of their group and filtered.

The text is measured in numpy over Arrow batches: character classes by one look into a table, words by one scan. Only the measures leave Python.

Defined results for odd input:
* null or empty text, or text without a word: rejected (it has no words), and not counted in any sketch;
* null lang or source: a group of its own, matched null-safely;
* very long texts are measured whole;
* ties on a fence: kept (the fences are inclusive); repeated rows are each measured, counted and judged alike;
* an empty table gives an empty table;
* extra columns pass through filter_documents() untouched, whatever they are called.
"""

from __future__ import annotations

import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: measure -> (side, how many spreads from the median the fence lies). The spread is the distance of the quartile on the lenient side, MIN_SPREAD at least.
RULES = {"symbol_ratio": ("max", 8.0), "upper_ratio": ("max", 8.0), "distinct_ratio": ("min", 2.5)}
#: Least spread of each measure: in a group of texts that are all alike, a small difference is no defect.
MIN_SPREAD = {"symbol_ratio": 0.005, "upper_ratio": 0.005, "distinct_ratio": 0.04}
#: Documents of the larger group that count with those of a group.
PRIOR = 30
FINE, OCTAVES = 9, 14
#: Added to the length, so that a few symbols in a very short text don't count for much.
SMOOTH = 100
CHARS_AT_ONCE = 1 << 17
ROWS_AT_ONCE = 128

_WORD = re.compile("[^ \t\r\n]+")
_SYMBOL, _UPPER = 1, 2
_MEASURED = T.StructType([T.StructField("n_words", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in RULES)])
_classes: list[np.ndarray] = []


def _class_table() -> np.ndarray:
    """_SYMBOL (no letter, number or white space) or _UPPER for each code point."""
    if not _classes:
        kinds = [unicodedata.category(chr(c)) for c in range(sys.maxunicode + 1)]
        table = np.array([_UPPER if k == "Lu" else 0 if k[0] in "LN" else _SYMBOL for k in kinds], np.uint8)
        table[[9, 10, 11, 12, 13, 32]] = 0
        _classes.append(table)
    return _classes[0]


def _measured(texts: list[str]) -> tuple[np.ndarray, ...]:
    """n_words, symbol_ratio, upper_ratio, distinct_ratio of each text."""
    kind = _class_table()[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)]
    length = np.array([len(t) for t in texts], np.int64)
    ends = np.concatenate([[0], np.cumsum(length)])
    symbols, uppers = (np.diff(np.searchsorted(np.flatnonzero(kind == k), ends)) for k in (_SYMBOL, _UPPER))
    words = np.zeros((2, len(texts)), np.int64)
    for i, t in enumerate(texts):
        own = _WORD.findall(t.lower())
        words[:, i] = len(own), len(set(own))
    return words[0], symbols / (length + SMOOTH), uppers / (length + SMOOTH), words[1] / np.maximum(words[0], 1)


@F.arrow_udf(_MEASURED)
def _measures(text: pa.Array) -> pa.Array:
    out, held, size = [_measured([])], [], 0
    for t in (t for i in range(0, len(text), ROWS_AT_ONCE) for t in text.slice(i, ROWS_AT_ONCE).to_pylist()):
        if held and size + len(t or "") > CHARS_AT_ONCE:
            out.append(_measured(held))
            held, size = [], 0
        held.append(t or "")
        size += len(t or "")
    out.append(_measured(held))
    n, symbols, uppers, distinct = (np.concatenate(x) for x in zip(*out))
    return pa.StructArray.from_arrays([pa.array(n), pa.array(symbols), pa.array(uppers), pa.array(distinct, mask=n == 0)], ["n_words", "symbol_ratio", "upper_ratio", "distinct_ratio"])


#: Never evaluated twice for one row: the optimizer doesn't copy what it takes for non-deterministic.
measures = _measures.asNondeterministic()


def _bucket(x: Column) -> Column:
    """The lower end of the bucket of x (0 to 1). Powers of two only, so nothing is rounded."""
    scale = F.lit(2.0 ** (FINE + OCTAVES + 1))
    for octave in reversed(range(OCTAVES)):
        scale = F.when(x >= 2.0 ** -(octave + 1), F.lit(2.0 ** (FINE + octave + 1))).otherwise(scale)
    return F.floor(x * scale) / scale


def _quantiles(sketch: DataFrame, keys: list[str], level: str) -> DataFrame:
    """keys, rule and the level's number of documents, median and quartile on the lenient side."""
    if keys:
        sketch = sketch.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))
    else:
        sketch = sketch.groupBy("rule", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "rule")
    s = sketch.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("total", F.sum("n").over(group))
    lenient = F.when(F.col("rule").isin([c for c, (side, _) in RULES.items() if side == "max"]), 0.75).otherwise(0.25)
    at = [F.min(F.when(F.col("upto") >= F.ceil(q * F.col("total")), F.col("bucket"))).alias(f"{name}_{level}") for name, q in (("mid", F.lit(0.5)), ("edge", lenient))]
    return s.groupBy(*keys, "rule").agg(F.max("total").alias(f"n_{level}"), *at)


def thresholds(m: DataFrame, prior: int = PRIOR) -> DataFrame:
    """One row for each (lang, source) in m: n_group and a fence for each rule."""
    rules = F.inline(F.array(*(F.struct(F.lit(c).alias("rule"), _bucket(F.col(c)).alias("bucket")) for c in RULES)))
    sketch = m.where("n_words > 0").select("lang", "source", rules).groupBy("lang", "source", "rule", "bucket").agg(F.count("*").alias("n"))
    sketch = common.materialize(sketch, "quality-sketches")
    lang = _quantiles(sketch, ["lang"], "lang").withColumnsRenamed({"lang": "l_lang", "rule": "l_rule"})
    everything = _quantiles(sketch, [], "all").withColumnRenamed("rule", "a_rule")
    g = _quantiles(sketch, ["lang", "source"], "source")
    g = g.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("rule") == F.col("l_rule"))).join(F.broadcast(everything), F.col("rule") == F.col("a_rule"))  # a row for each rule

    def drawn(x: str) -> Column:
        of_lang = (F.col("n_lang") * F.col(f"{x}_lang") + prior * F.col(f"{x}_all")) / (F.col("n_lang") + prior)
        return (F.col("n_source") * F.col(f"{x}_source") + prior * of_lang) / (F.col("n_source") + prior)

    g = g.select("lang", "source", "rule", "n_source", drawn("mid").alias("mid"), drawn("edge").alias("edge"))
    fences = []
    for c, (side, spread) in RULES.items():
        width = F.greatest(F.abs(F.col("edge") - F.col("mid")), F.lit(MIN_SPREAD[c]))
        fences.append(F.max(F.when(F.col("rule") == c, F.col("mid") + F.lit(spread if side == "max" else -spread) * width)).alias(f"{side}_{c}"))
    out = common.materialize(g.groupBy("lang", "source").agg(F.max("n_source").alias("n_group"), *fences), "quality-thresholds")
    common.drop_table(sketch)
    return out


def _passes() -> Column:
    ok = F.col("n_words") > 0
    for c, (side, _) in RULES.items():
        fence = F.col(f"{side}_{c}")
        ok = ok & ((F.col(c) <= fence) if side == "max" else (F.col(c) >= fence))
    return ok


def _joined(m: DataFrame, t: DataFrame) -> DataFrame:
    t = common.bounded_broadcast(t.withColumnsRenamed({"lang": "t_lang", "source": "t_source"}), t.count())
    return m.join(t, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source"))).where(_passes()).drop("t_lang", "t_source")


def quality_rules(docs: DataFrame, prior: int = PRIOR) -> DataFrame:
    """The documents that pass every rule: doc_id, lang, source, the measures, the size of their group and the fences they were held against."""
    m = docs.select(*(common.col(c) for c in ("doc_id", "lang", "source")), measures(common.col("text")).alias("m")).select("doc_id", "lang", "source", "m.*")
    m = common.materialize(m, "quality-measures")
    return _joined(m, thresholds(m, prior))


def filter_documents(docs: DataFrame, prior: int = PRIOR) -> DataFrame:
    """docs without those that break a rule; all columns stay as they are. The text is measured twice, which costs less than storing or shuffling it."""
    m = docs.select(common.col("lang").alias("lang"), common.col("source").alias("source"), measures(common.col("text")).alias("m")).select("lang", "source", "m.*")
    t = thresholds(m, prior)
    row = F.struct(*(common.col(c) for c in docs.columns)).alias("row")
    again = docs.select(row).select("row", F.col("row.lang").alias("lang"), F.col("row.source").alias("source"), measures(F.col("row.text")).alias("m")).select("row", "lang", "source", "m.*")
    return _joined(again, t).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(common.read(spark, sf_dir, "documents"))


_MEASURES_SQL = r"""
    len(list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t\r\n]+'), lambda w: w <> ''))::BIGINT AS n_words,
    length(regexp_replace(coalesce(text, ''), '[\p{L}\p{N}\s]+', '', 'g'))::DOUBLE / (length(coalesce(text, '')) + 100) AS symbol_ratio,
    length(regexp_replace(coalesce(text, ''), '[^\p{Lu}]+', '', 'g'))::DOUBLE / (length(coalesce(text, '')) + 100) AS upper_ratio,
    CASE WHEN n_words > 0 THEN len(list_distinct(list_filter(string_split_regex(lower(text), '[ \t\r\n]+'), lambda w: w <> '')))::DOUBLE / n_words END AS distinct_ratio"""


def _sql() -> str:
    scale = "CASE " + " ".join(f"WHEN x >= {2.0**-(o + 1)!r} THEN {2 ** (FINE + o + 1)}.0::DOUBLE" for o in range(OCTAVES)) + f" ELSE {2 ** (FINE + OCTAVES + 1)}.0::DOUBLE END"
    values = " UNION ALL ".join(f"SELECT lang, source, '{c}' AS rule, {0.75 if side == 'max' else 0.25} AS q, {c} AS x FROM m WHERE n_words > 0" for c, (side, _) in RULES.items())
    ctes = []
    for level, keys in {"source": "lang, source, ", "lang": "lang, ", "all": ""}.items():
        ctes.append(
            f"c_{level} AS (SELECT {keys}rule, q, bucket, sum(count(*)) OVER (PARTITION BY {keys}rule ORDER BY bucket) AS upto, sum(count(*)) OVER (PARTITION BY {keys}rule) AS total FROM b GROUP BY {keys}rule, q, bucket), "
            f"by_{level} AS (SELECT {keys}rule, max(total)::BIGINT AS n, min(bucket) FILTER (WHERE upto >= ceil(0.5::DOUBLE * total)) AS mid, min(bucket) FILTER (WHERE upto >= ceil(q::DOUBLE * total)) AS edge FROM c_{level} GROUP BY {keys}rule)"
        )

    def drawn(x: str) -> str:
        return f"(s.n * s.{x} + {PRIOR} * ((l.n * l.{x} + {PRIOR} * a.{x}) / (l.n + {PRIOR}))) / (s.n + {PRIOR})"

    fences = ", ".join(f"max(CASE WHEN rule = '{c}' THEN mid + {spread if side == 'max' else -spread}::DOUBLE * greatest(abs(edge - mid), {MIN_SPREAD[c]}::DOUBLE) END) AS {side}_{c}" for c, (side, spread) in RULES.items())
    rule = " AND ".join(f"{c} {'<=' if side == 'max' else '>='} {side}_{c}" for c, (side, _) in RULES.items())
    return f"""
WITH m AS (SELECT doc_id, lang, source, {_MEASURES_SQL} FROM documents),
v AS ({values}),
b AS (SELECT lang, source, rule, q, floor(x * {scale}) / {scale} AS bucket FROM v),
{", ".join(ctes)},
g AS (SELECT s.lang, s.source, s.rule, s.n, {drawn("mid")} AS mid, {drawn("edge")} AS edge
      FROM by_source s JOIN by_lang l ON s.lang IS NOT DISTINCT FROM l.lang AND s.rule = l.rule JOIN by_all a ON s.rule = a.rule),
t AS (SELECT lang AS t_lang, source AS t_source, max(n) AS n_group, {fences} FROM g GROUP BY lang, source)
SELECT doc_id, lang, source, n_words, symbol_ratio, upper_ratio, distinct_ratio, n_group, {", ".join(f"{side}_{c}" for c, (side, _) in RULES.items())}
FROM m JOIN t ON m.lang IS NOT DISTINCT FROM t_lang AND m.source IS NOT DISTINCT FROM t_source
WHERE n_words > 0 AND {rule}"""


SQL = _sql()
