"""Queries over an index that is built from source files: a Go tree written from the star schema, a package for each region, nation and customer,
each importing the one above it. SQL says from the same tables what must be found in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import index
from ..sources.tables import read
from ..tools import Project
from .graph_queries import query

_MODULE = "example.com/shop"


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content, size, mtime, content_hash) of the tree's files."""
    def source(own: str, above: str, name: str, call: str) -> str:
        return f"concat('package ', {own}, '\\n\\nimport (\\n\\t\"{_MODULE}/', {above}, '\"\\n)\\n\\nfunc ', {name}, '() {{\\n\\t', {call}, '()\\n}}\\n')"

    region = read(spark, sf_dir, "region").selectExpr("concat('geo/r', r_regionkey, '/lib.go') AS path", "concat('package r', r_regionkey, '\\n\\nfunc Hub', r_regionkey, '() {\\n}\\n') AS content")
    nation = read(spark, sf_dir, "nation").selectExpr("concat('geo/n', n_nationkey, '/lib.go') AS path", source("concat('n', n_nationkey)", "concat('geo/r', n_regionkey)", "concat('Land', n_nationkey)", "concat('r', n_regionkey, '.Hub', n_regionkey)") + " AS content")
    customer = read(spark, sf_dir, "customer")
    buyer = customer.selectExpr("concat('shop/c', c_custkey, '/buyer.go') AS path", source("concat('c', c_custkey)", "concat('geo/n', c_nationkey)", "concat('Buyer', c_custkey)", "concat('n', c_nationkey, '.Land', c_nationkey)") + " AS content")
    test = customer.where("c_custkey % 5 = 0").selectExpr("concat('shop/c', c_custkey, '/buyer_test.go') AS path", "concat('package c', c_custkey, '\\n\\nfunc TestBuyer', c_custkey, '() {\\n\\tBuyer', c_custkey, '()\\n}\\n') AS content")
    module = spark.createDataFrame([("go.mod", f"module {_MODULE}\n")], "path string, content string")
    files = region.union(nation).union(buyer).union(test).union(module)
    return files.select("path", "content", F.octet_length("content").cast("long").alias("size"), F.lit(None).cast("timestamp").alias("mtime"), F.sha2("content", 256).alias("content_hash"))


_built: dict[tuple[str, str], Project] = {}


def project(spark: SparkSession, sf_dir: str) -> Project:
    """The tree's index, built once in an application: its tables lie in the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        _built[key] = Project(index.build(tree(spark, sf_dir)))
    return _built[key]


@query(
    "index_symbols",
    """SELECT 'function' AS kind, 'Hub' || r_regionkey AS name, 'geo/r' || r_regionkey || '/lib.go' AS file, 3::BIGINT AS line, 4::BIGINT AS end_line FROM region
UNION ALL SELECT 'function', 'Land' || n_nationkey, 'geo/n' || n_nationkey || '/lib.go', 7, 9 FROM nation
UNION ALL SELECT 'function', 'Buyer' || c_custkey, 'shop/c' || c_custkey || '/buyer.go', 7, 9 FROM customer
UNION ALL SELECT 'function', 'TestBuyer' || c_custkey, 'shop/c' || c_custkey || '/buyer_test.go', 3, 5 FROM customer WHERE c_custkey % 5 = 0""",
)
def index_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(spark, sf_dir).nodes.where("kind NOT IN ('file', 'module')").select("kind", "name", "file", "line", "end_line")


_CALLS = """SELECT 'Land' || n_nationkey AS caller, 'Hub' || n_regionkey AS callee FROM nation
UNION ALL SELECT 'Buyer' || c_custkey, 'Land' || c_nationkey FROM customer
UNION ALL SELECT 'TestBuyer' || c_custkey, 'Buyer' || c_custkey FROM customer WHERE c_custkey % 5 = 0"""


@query("index_calls", _CALLS)
def index_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = project(spark, sf_dir)
    side = lambda x, name: p.nodes.select(F.col("id").alias(x), F.col("name").alias(name))
    return p.edges.where("kind = 'calls'").join(side("source_id", "caller"), "source_id").join(side("target_id", "callee"), "target_id").select("caller", "callee")


@query(
    "index_imports",
    f"""SELECT 'geo/n' || n_nationkey || '/lib.go' AS file, '{_MODULE}/geo/r' || n_regionkey AS name FROM nation
UNION ALL SELECT 'shop/c' || c_custkey || '/buyer.go', '{_MODULE}/geo/n' || c_nationkey FROM customer""",
)
def index_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(spark, sf_dir).imports()


_PATHS = """SELECT 'geo/r' || r_regionkey || '/lib.go' AS path FROM region UNION ALL SELECT 'geo/n' || n_nationkey || '/lib.go' FROM nation
UNION ALL SELECT 'shop/c' || c_custkey || '/buyer.go' FROM customer UNION ALL SELECT 'shop/c' || c_custkey || '/buyer_test.go' FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT 'go.mod'"""


@query("index_packages", f"SELECT path AS file, CASE WHEN path = 'go.mod' THEN '{_MODULE}' ELSE '{_MODULE}/' || regexp_replace(path, '/[^/]*$', '') END AS package FROM ({_PATHS})")
def index_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(spark, sf_dir).packages()


@query("index_affected", "SELECT 'shop/c' || c_custkey || '/buyer_test.go' AS file, 2::BIGINT AS depth FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 AND c_custkey % 5 = 0")
def index_affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(spark, sf_dir).affected(["geo/r1/lib.go"])


@query("tool_callers", "SELECT 'Buyer' || c_custkey AS name, 'function' AS kind, 'shop/c' || c_custkey || '/buyer.go' AS file, 7::BIGINT AS line FROM customer WHERE c_nationkey = 3 ORDER BY file LIMIT 40")
def tool_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tool's own cut: the first 40 by place."""
    return project(spark, sf_dir).callers("Land3")


@query("tool_callees", "SELECT 'Land' || c_nationkey AS name, 'function' AS kind, 'geo/n' || c_nationkey || '/lib.go' AS file, 7::BIGINT AS line FROM customer WHERE c_custkey = 7")
def tool_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(spark, sf_dir).callees("Buyer7")


@query(
    "tool_impact",
    """SELECT 'shop/c' || c_custkey || '/buyer.go' AS file, 1::BIGINT AS hits, 2::BIGINT AS min_depth FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2
UNION ALL SELECT 'geo/n' || n_nationkey || '/lib.go', 1, 1 FROM nation WHERE n_regionkey = 2""",
)
def tool_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(spark, sf_dir).impact("Hub2", most=1 << 30)


@query("tool_dependents", "SELECT 'shop/c' || c_custkey || '/buyer.go' AS dependent FROM customer WHERE c_nationkey = 4")
def tool_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(spark, sf_dir).dependents("geo/n4/lib.go")


@query("tool_files", "SELECT 'geo/n' || n_nationkey || '/lib.go' AS path, 'go' AS language FROM nation UNION ALL SELECT 'geo/r' || r_regionkey || '/lib.go', 'go' FROM region")
def tool_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(spark, sf_dir).files(path="geo", most=1 << 30).select("path", "language")


@query("tool_file_lines", "SELECT * FROM (VALUES (7::BIGINT, 'func Land5() {'), (8, chr(9) || 'r' || (SELECT n_regionkey FROM nation WHERE n_nationkey = 5) || '.Hub' || (SELECT n_regionkey FROM nation WHERE n_nationkey = 5) || '()'), (9, '}')) v(line, content)")
def tool_file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(spark, sf_dir).file("geo/n5/lib.go", 7, 3)


@query("tool_search_lines", "SELECT 'shop/c' || c_custkey || '/buyer.go' AS file, 8::BIGINT AS line, chr(9) || 'n' || c_nationkey || '.Land' || c_nationkey || '()' AS content FROM customer WHERE c_nationkey = 6")
def tool_search_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(spark, sf_dir).search(r"\bn6\.Land6\(", path="shop", most=1 << 30)


@query("tool_symbols", "SELECT 7::BIGINT AS line, 'function' AS kind, 'Land9' AS name, 9::BIGINT AS end_line")
def tool_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(spark, sf_dir).symbols("geo/n9/lib.go")


@query("tool_node", "SELECT 'Hub' || r_regionkey AS name, 'geo/r' || r_regionkey || '/lib.go' AS file, 'func Hub' || r_regionkey || '() {' || chr(10) || '}' AS body, least(6, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey))::BIGINT AS n_callers FROM region WHERE r_regionkey = 3")
def tool_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(spark, sf_dir).node("Hub3").select("name", "file", "body", F.size("callers").cast("long").alias("n_callers"))
