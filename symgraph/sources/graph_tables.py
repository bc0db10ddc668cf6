"""The property graph (nodes, edges, refs, files) that is made from the star schema and the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import partitions, read

#: Extensions that stand in for those of source files, by doc_id % 12.
EXTENSIONS = [".go", "_test.go", ".pb.go", ".ts", ".test.ts", ".gen.ts", ".py", "_pb2.py", ".rs", ".vue", ".c", ".txt"]

#: id = code * SPAN + key
SPAN = 10**12
REGION, NATION, CUSTOMER, SUPPLIER, PART, ORDER = (code * SPAN for code in range(1, 7))

_END = "CASE WHEN {k} % 7 = 0 THEN NULL ELSE {k} + {k} % 50 END"
_KINDS = [
    ("region", "r_regionkey", REGION, "module", "r_name", "concat('geo/', r_regionkey)"),
    ("nation", "n_nationkey", NATION, "class", "n_name", "concat('geo/', n_regionkey, '/', n_nationkey)"),
    ("customer", "c_custkey", CUSTOMER, "function", "c_name", "concat('customer/', c_mktsegment, '/', c_nationkey)"),
    ("supplier", "s_suppkey", SUPPLIER, "interface", "s_name", "concat('supplier/', s_nationkey)"),
    ("part", "p_partkey", PART, "method", "p_name", "concat('part/', p_type, '/', p_brand)"),
    ("orders", "o_orderkey", ORDER, "route", "concat('order#', o_orderkey)", "concat('orders/', o_orderpriority, '/', o_custkey % 100)"),
]


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, kind, name, file, line, end_line): end_line is null for a symbol whose end isn't known."""
    out = None
    for table, key, base, kind, name, file in _KINDS:
        k = f"CAST({key} AS BIGINT)"
        one = read(spark, sf_dir, table).selectExpr(f"{base} + {k} AS id", f"'{kind}' AS kind", f"{name} AS name", f"{file} AS file", f"{k} AS line", f"{_END.format(k=k)} AS end_line")
        out = one if out is None else out.unionByName(one)
    return out


def edges(spark: SparkSession, sf_dir: str, once: bool = True) -> DataFrame:
    """(source_id, target_id, kind), each once; or with repetitions, for what is a set in the end: then the lines aren't shuffled for it."""
    each = lambda df: df.distinct() if once else df
    t = {name: read(spark, sf_dir, name) for name in ("nation", "customer", "supplier", "orders", "lineitem")}
    next_order = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    parts = [
        t["nation"].selectExpr(f"{NATION} + n_nationkey AS source_id", f"{REGION} + n_regionkey AS target_id", "'contains' AS kind"),
        t["customer"].selectExpr(f"{CUSTOMER} + c_custkey AS source_id", f"{NATION} + c_nationkey AS target_id", "'references' AS kind"),
        t["supplier"].selectExpr(f"{SUPPLIER} + s_suppkey AS source_id", f"{NATION} + s_nationkey AS target_id", "'references' AS kind"),
        t["orders"].selectExpr(f"{ORDER} + o_orderkey AS source_id", f"{CUSTOMER} + o_custkey AS target_id", "'calls' AS kind"),
        t["orders"].withColumn("n", next_order).where("n IS NOT NULL").selectExpr(f"{ORDER} + o_orderkey AS source_id", f"{ORDER} + n AS target_id", "'calls' AS kind"),
        each(t["lineitem"].selectExpr(f"{ORDER} + l_orderkey AS source_id", f"{PART} + l_partkey AS target_id", "'calls' AS kind")),
        each(t["lineitem"].selectExpr(f"{PART} + l_partkey AS source_id", f"{SUPPLIER} + l_suppkey AS target_id", "'bridge' AS kind")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(from_node, name, kind, file), each once: what an order names; one in fifty names what doesn't exist."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    name = "CASE WHEN l_partkey % 50 = 7 THEN concat('Missing.absent', l_partkey) ELSE concat(p_brand, '.', p_name) END AS name"
    r = line.selectExpr(f"{ORDER} + l_orderkey AS from_node", name, "'calls' AS kind", "concat('part/', p_type, '/', p_brand) AS file")
    # one shuffle for the duplicates and for what is joined to the symbol that refers
    return r.repartition(partitions(spark, sf_dir, "lineitem"), "from_node").distinct()


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, doc_id, size, content_hash) of the documents."""
    exts = ", ".join(f"'{x}'" for x in EXTENSIONS)
    return read(spark, sf_dir, "documents").selectExpr(f"concat(coalesce(source, ''), '/d', doc_id, element_at(array({exts}), CAST(doc_id % 12 AS INT) + 1)) AS path", "doc_id", "CAST(octet_length(text) AS BIGINT) AS size", "sha2(text, 256) AS content_hash")


def _nodes_sql() -> str:
    return " UNION ALL ".join(f"SELECT {base}::BIGINT + {key} AS id, '{kind}' AS kind, {name} AS name, {file} AS file, {key}::BIGINT AS line, ({_END.format(k=key)})::BIGINT AS end_line FROM {table}" for table, key, base, kind, name, file in _KINDS)


#: Common table expressions for the oracle.
GRAPH_SQL = f"""nodes AS ({_nodes_sql()}),
edges AS (SELECT {NATION} + n_nationkey AS source_id, {REGION} + n_regionkey AS target_id, 'contains' AS kind FROM nation
  UNION SELECT {CUSTOMER} + c_custkey, {NATION} + c_nationkey, 'references' FROM customer
  UNION SELECT {SUPPLIER} + s_suppkey, {NATION} + s_nationkey, 'references' FROM supplier
  UNION SELECT {ORDER} + o_orderkey, {CUSTOMER} + o_custkey, 'calls' FROM orders
  UNION SELECT {ORDER} + o_orderkey, {ORDER} + n, 'calls' FROM (SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n IS NOT NULL
  UNION SELECT {ORDER} + l_orderkey, {PART} + l_partkey, 'calls' FROM lineitem
  UNION SELECT {PART} + l_partkey, {SUPPLIER} + l_suppkey, 'bridge' FROM lineitem),
walked AS (SELECT * FROM edges WHERE kind IN ('calls', 'references', 'bridge'))"""
REFS_SQL = f"""refs AS (SELECT DISTINCT {ORDER} + l_orderkey AS from_node, CASE WHEN l_partkey % 50 = 7 THEN 'Missing.absent' || l_partkey ELSE p_brand || '.' || p_name END AS name, 'calls' AS kind, 'part/' || p_type || '/' || p_brand AS file
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
FILES_SQL = f"files AS (SELECT coalesce(source, '') || '/d' || doc_id || {EXTENSIONS!r}[doc_id % 12 + 1] AS path, doc_id, octet_length(encode(text))::BIGINT AS size, sha256(text) AS content_hash FROM documents)"
