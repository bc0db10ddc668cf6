"""Queries over the property graph, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import explore, graph, linking, resolve, store
from ..sources import graph_tables as t
from ..sources.graph_tables import GRAPH_SQL, REFS_SQL
from ..sources.tables import materialize, partitions, read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _dir_sql(c: str) -> str:
    return f"CASE WHEN contains({c}, '/') THEN regexp_replace({c}, '/[^/]*$', '') ELSE '' END"


def _neighbours_sql(own: str, other: str) -> str:
    return f"""WITH {GRAPH_SQL},
f AS (SELECT DISTINCT d.name AS symbol, n.name, n.kind, n.file, n.line FROM walked e JOIN nodes d ON e.{own} = d.id JOIN nodes n ON e.{other} = n.id)
SELECT symbol, name, min(kind) AS kind, file, line FROM f GROUP BY symbol, name, file, line QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY file, line, name) <= {graph.MOST_SYMBOLS}"""


@query("callers", _neighbours_sql("target_id", "source_id"))
def callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = t.nodes(spark, sf_dir)
    return graph.callers(n, t.edges(spark, sf_dir, once=False), n, partitions=2 * partitions(spark, sf_dir, "lineitem"))


@query("callees", _neighbours_sql("source_id", "target_id"))
def callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = t.nodes(spark, sf_dir)
    return graph.callees(n, t.edges(spark, sf_dir, once=False), n, partitions=2 * partitions(spark, sf_dir, "lineitem"))


def _impact_sql(depth: int) -> str:
    return f"""WITH RECURSIVE {GRAPH_SQL},
r(id, depth) AS (SELECT id, 0 FROM nodes WHERE kind = 'interface' UNION SELECT e.source_id, r.depth + 1 FROM r JOIN walked e ON e.target_id = r.id WHERE r.depth < {depth - 1}),
m AS (SELECT id, min(depth) AS depth FROM r GROUP BY id)
SELECT n.file, count(*)::BIGINT AS hits, min(m.depth + 1)::BIGINT AS min_depth FROM m JOIN walked e ON e.target_id = m.id JOIN nodes n ON n.id = e.source_id GROUP BY n.file"""


def _impact(depth: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        n = t.nodes(spark, sf_dir)
        return graph.impact(n, materialize(t.edges(spark, sf_dir), "edges"), n.where("kind = 'interface'"), depth)

    return run


for _d in (2, 5):
    query(f"impact_depth{_d}", _impact_sql(_d))(_impact(_d))


@query("file_dependents", f"WITH {GRAPH_SQL} SELECT DISTINCT t.file, s.file AS dependent FROM walked e JOIN nodes s ON e.source_id = s.id JOIN nodes t ON e.target_id = t.id WHERE s.file <> t.file")
def file_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.file_dependents(t.nodes(spark, sf_dir), t.edges(spark, sf_dir, once=False))


@query(
    "flow_path_length",
    f"""WITH RECURSIVE {GRAPH_SQL}, named AS (SELECT {t.ORDER} + o_orderkey AS id FROM orders WHERE o_orderstatus <> 'O'),
e AS (SELECT source_id, target_id, target_id IN (SELECT id FROM named) AS is_named, source_id IN (SELECT id FROM named) AS from_named FROM edges WHERE kind = 'calls'),
r(seed, id, is_named, hops) AS (SELECT id, id, true, 0 FROM named UNION SELECT r.seed, e.target_id, e.is_named, r.hops + 1 FROM r JOIN e ON e.source_id = r.id WHERE r.hops < {graph.FLOW_NODES - 1} AND (e.is_named OR e.from_named)),
m AS (SELECT seed, id, min(hops) AS hops FROM r WHERE is_named AND hops > 0 AND id <> seed GROUP BY seed, id)
SELECT seed, arg_min(id, (-hops, id)) AS target, max(hops)::BIGINT AS hops FROM m GROUP BY seed""",
)
def flow_path_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = read(spark, sf_dir, "orders").where("o_orderstatus <> 'O'").selectExpr(f"{t.ORDER} + o_orderkey AS id")
    return graph.flow_paths(t.edges(spark, sf_dir, once=False).where("kind = 'calls'"), named)


@query(
    "affected_bfs",
    f"""WITH RECURSIVE {GRAPH_SQL},
pk AS (SELECT DISTINCT file, {_dir_sql("file")} AS package FROM nodes),
imp AS (SELECT DISTINCT s.file, {_dir_sql("t.file")} AS name FROM walked e JOIN nodes s ON e.source_id = s.id JOIN nodes t ON e.target_id = t.id WHERE s.file <> t.file),
who AS (SELECT DISTINCT p.package, i.file FROM (SELECT DISTINCT package FROM pk) p JOIN imp i ON i.name = p.package OR starts_with(i.name, p.package || '/')),
visited(file, depth) AS (SELECT DISTINCT file, 0 FROM nodes WHERE kind = 'interface'
  UNION SELECT who.file, v.depth + 1 FROM visited v JOIN pk ON pk.file = v.file JOIN who ON who.package = pk.package WHERE v.depth < 4),
near AS (SELECT pk.file, v.depth FROM visited v JOIN pk ON pk.package = {_dir_sql("v.file")} WHERE NOT regexp_matches(v.file, '(^|/)[^/]*[5-9]$'))
SELECT file, min(depth)::BIGINT AS depth FROM (SELECT * FROM visited UNION ALL SELECT * FROM near) WHERE regexp_matches(file, '(^|/)[^/]*[5-9]$') GROUP BY file""",
)
def affected_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders stand for packages, and a file whose name ends in 5 to 9 for a test."""
    n, e = t.nodes(spark, sf_dir), t.edges(spark, sf_dir, once=False)
    imports = materialize(graph.file_edges(n, e).select(F.col("source").alias("file"), paths.dirname(F.col("target")).alias("name")).distinct(), "imports")
    packages = materialize(n.select("file", paths.dirname(F.col("file")).alias("package")).distinct(), "packages")
    return graph.affected(imports, packages, n.where("kind = 'interface'").select("file").distinct(), 5, "*[5-9]")


@query("graph_stats", f"WITH {GRAPH_SQL} SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FROM documents) AS n_files, '{store.REVISION}' AS revision")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.stats(t.nodes(spark, sf_dir), t.edges(spark, sf_dir), t.files(spark, sf_dir))


@query("edge_kind_counts", f"WITH {GRAPH_SQL} SELECT kind, count(*) AS n FROM edges GROUP BY kind")
def edge_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.counts(t.edges(spark, sf_dir), "kind")


@query("node_kind_counts", f"WITH {GRAPH_SQL} SELECT kind, count(*) AS n FROM nodes GROUP BY kind")
def node_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.counts(t.nodes(spark, sf_dir), "kind")


@query("incoming_by_file", f"WITH {GRAPH_SQL} SELECT n.file, count(*)::BIGINT AS n FROM walked e JOIN nodes n ON e.target_id = n.id GROUP BY n.file")
def incoming_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.incoming_by_file(t.nodes(spark, sf_dir), graph.walked(t.edges(spark, sf_dir)))


_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


@query("upsert_edges_dedup", f"SELECT {_LINE} FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) = 1")
def upsert_edges_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    order = [(-F.unix_micros(F.col("l_shipdate").cast("timestamp"))).alias("at"), "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    return store.first_of(line, ["l_orderkey", "l_linenumber"], order).selectExpr(*_LINE.split(", "))


_GONE = "SELECT DISTINCT file FROM nodes WHERE kind = 'interface'"


@query(
    "cascade_delete_file",
    f"""WITH {GRAPH_SQL}, gone AS ({_GONE}), ids AS (SELECT id FROM nodes WHERE file IN (SELECT file FROM gone))
SELECT kind, count(*) AS n FROM edges WHERE source_id NOT IN (SELECT id FROM ids) AND target_id NOT IN (SELECT id FROM ids) GROUP BY kind""",
)
def cascade_delete_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = t.nodes(spark, sf_dir)
    return store.counts(store.cascade_delete(n, t.edges(spark, sf_dir), t.refs(spark, sf_dir), n.where("kind = 'interface'"))[1], "kind")


_CANDIDATES_SQL = rf"""{GRAPH_SQL}, {REFS_SQL},
k AS (SELECT *, unnest(list_distinct([name, regexp_extract(name, '([^.#@]+)$', 1)])) AS k FROM refs),
cand AS (SELECT k.from_node, k.name, k.kind, k.file, n.id, n.kind AS c_kind, n.name AS c_name, n.file AS c_file, n.line AS c_line, count(*) OVER (PARTITION BY k.from_node, k.name, k.kind, k.file) AS n FROM k JOIN nodes n ON n.name = k.k WHERE n.id <> k.from_node),
few AS (SELECT *, {_dir_sql("file")} AS d, {_dir_sql("c_file")} AS cd FROM cand),
sc AS (SELECT *, (CASE WHEN file = c_file THEN 100 WHEN d = cd THEN 50 WHEN cd = {_dir_sql("d")} OR {_dir_sql("cd")} = {_dir_sql("d")} THEN 20 ELSE 0 END)
   + (CASE WHEN c_kind IN ('function', 'method') THEN 5 WHEN c_kind = 'route' THEN 3 ELSE 0 END) + (CASE WHEN c_name = name THEN 2 ELSE 0 END) AS score,
   CASE WHEN file = c_file THEN 'exact' WHEN d = cd OR cd = {_dir_sql("d")} OR {_dir_sql("cd")} = {_dir_sql("d")} THEN 'proximity' ELSE 'heuristic' END AS p FROM few)"""
_RESOLVE_SQL = rf"""{_CANDIDATES_SQL},
best AS (SELECT from_node, name, kind, file, max(n) AS n, arg_min(struct_pack(id := id, p := p, score := score), (-(CASE WHEN n > 80 THEN 100 ELSE score END), c_file, c_line, c_kind, c_name, id)) FILTER (WHERE (n <= 80 AND score > 0 AND c_kind NOT IN ('file', 'module')) OR (n > 80 AND file = c_file)) AS b,
   count(*) FILTER (WHERE c_kind <> 'module') AS callables, min(id) FILTER (WHERE c_kind <> 'module') AS lone, bool_or(cd = d OR {_dir_sql("cd")} = d) FILTER (WHERE c_kind <> 'module') AS lone_near FROM sc GROUP BY from_node, name, kind, file),
res AS (SELECT r.*, CASE WHEN b.b IS NOT NULL AND b.b.p <> 'heuristic' AND NOT (b.n > 1 AND b.n <= 80 AND b.b.score < 5) THEN b.b.id WHEN b.callables = 1 AND b.lone_near THEN b.lone END AS target_id,
   CASE WHEN b.b IS NOT NULL AND b.b.p <> 'heuristic' AND NOT (b.n > 1 AND b.n <= 80 AND b.b.score < 5) THEN b.b.p WHEN b.callables = 1 AND b.lone_near THEN 'heuristic' END AS provenance
   FROM refs r LEFT JOIN best b ON r.from_node = b.from_node AND r.name = b.name AND r.kind = b.kind AND r.file = b.file)"""
#: However many candidates there are, all are scored.
_RESOLVE_ALL_SQL = rf"""{_CANDIDATES_SQL},
best AS (SELECT from_node, name, kind, file, max(n) AS n, arg_min(struct_pack(id := id, p := p, score := score), (-score, c_file, c_line, c_kind, c_name, id)) FILTER (WHERE score > 0 AND c_kind NOT IN ('file', 'module')) AS b,
   count(*) FILTER (WHERE c_kind <> 'module') AS callables, min(id) FILTER (WHERE c_kind <> 'module') AS lone, bool_or(cd = d OR {_dir_sql("cd")} = d) FILTER (WHERE c_kind <> 'module') AS lone_near FROM sc GROUP BY from_node, name, kind, file),
res AS (SELECT r.*, CASE WHEN b.b IS NOT NULL AND b.b.p <> 'heuristic' AND NOT (b.n > 1 AND b.b.score < 5) THEN b.b.id WHEN b.callables = 1 AND b.lone_near THEN b.lone END AS target_id,
   CASE WHEN b.b IS NOT NULL AND b.b.p <> 'heuristic' AND NOT (b.n > 1 AND b.b.score < 5) THEN b.b.p WHEN b.callables = 1 AND b.lone_near THEN 'heuristic' END AS provenance
   FROM refs r LEFT JOIN best b ON r.from_node = b.from_node AND r.name = b.name AND r.kind = b.kind AND r.file = b.file)"""


def _resolved(spark: SparkSession, sf_dir: str, ceiling: int | None = resolve.CEILING) -> tuple[DataFrame, DataFrame]:
    n = t.nodes(spark, sf_dir)
    return resolve.resolve(t.refs(spark, sf_dir), n, ceiling=ceiling), n


@query("resolve_refs", f"WITH {_RESOLVE_ALL_SQL} SELECT from_node, name, kind, file, target_id, provenance FROM res")
def resolve_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir, None)[0].select("from_node", "name", "kind", "file", "target_id", "provenance")


@query("resolved_edges", f"WITH {_RESOLVE_SQL} SELECT from_node AS source_id, target_id, kind, arg_min(provenance, list_position(['exact', 'import', 'proximity', 'heuristic'], provenance)) AS provenance FROM res WHERE target_id IS NOT NULL GROUP BY from_node, target_id, kind")
def resolved_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolved_edges(_resolved(spark, sf_dir)[0])


@query("retry_failed_refs", f"WITH {_RESOLVE_SQL} SELECT from_node, name, file FROM res WHERE target_id IS NULL AND (name IN (SELECT name FROM nodes) OR regexp_extract(name, '([^.#@]+)$', 1) IN (SELECT name FROM nodes))")
def retry_failed_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n = _resolved(spark, sf_dir)
    return resolve.retried(r, n).select("from_node", "name", "file")


_NOISE = ("log", "on", "emit")


@query("scrub_noise", "WITH r AS (SELECT event_id, unnest(CASE event_type WHEN 'click' THEN ['app.emit'] WHEN 'view' THEN ['on'] WHEN 'error' THEN ['console.log'] ELSE [event_type] END) AS name FROM events) SELECT event_id, name FROM r WHERE name NOT IN ('app.emit', 'on', 'console.log')")
def scrub_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = "CASE event_type WHEN 'click' THEN 'app.emit' WHEN 'view' THEN 'on' WHEN 'error' THEN 'console.log' ELSE event_type END"
    failed = read(spark, sf_dir, "events").selectExpr("event_id AS from_node", f"{name} AS name", "'calls' AS kind", "'e' AS file", "CAST(NULL AS BIGINT) AS target_id")
    return resolve.scrubbed(failed, t.nodes(spark, sf_dir)).selectExpr("from_node AS event_id", "name")


@query("refs_to_retry", f"WITH {GRAPH_SQL}, {REFS_SQL}, ch AS (SELECT DISTINCT file FROM nodes WHERE kind = 'method' AND contains(file, 'ECONOMY')), d AS (SELECT DISTINCT name FROM nodes WHERE file IN (SELECT file FROM ch)) SELECT DISTINCT from_node, name, file FROM refs WHERE file IN (SELECT file FROM ch) OR name IN (SELECT name FROM d) OR regexp_extract(name, '([^.#@]+)$', 1) IN (SELECT name FROM d)")
def refs_to_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = t.nodes(spark, sf_dir)
    return resolve.refs_to_retry(t.refs(spark, sf_dir), n, n.where("kind = 'method' AND contains(file, 'ECONOMY')")).select("from_node", "name", "file")


@query("unique_callable", f"WITH {GRAPH_SQL}, r AS (SELECT c_name AS name FROM customer UNION SELECT s_name FROM supplier UNION SELECT p_name FROM part) SELECT n.name, min(id) AS target_id FROM nodes n JOIN r ON n.name = r.name GROUP BY n.name HAVING count(*) = 1")
def unique_callable(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = t.nodes(spark, sf_dir)
    return resolve.unique_targets(n.where("kind IN ('function', 'interface', 'method')"), n)


@query("ambiguity_ceiling", f"WITH {GRAPH_SQL} SELECT string_split(name, ' ')[1] AS name, count(*) AS n FROM nodes WHERE kind = 'method' GROUP BY 1 HAVING count(*) > {resolve.CEILING}")
def ambiguity_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.crowded_names(t.nodes(spark, sf_dir).where("kind = 'method'"), F.split("name", " ")[0])


@query("same_file_link", f"WITH {GRAPH_SQL}, b AS (SELECT file, name, arg_min(id, (line, id)) AS local_id FROM nodes WHERE kind = 'method' GROUP BY file, name) SELECT 'part/' || p_type || '/' || p_brand AS file, p_name AS name, l_orderkey, b.local_id FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) l JOIN part ON l_partkey = p_partkey LEFT JOIN b ON b.file = 'part/' || p_type || '/' || p_brand AND b.name = p_name")
def same_file_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct().join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    r = line.selectExpr("concat('part/', p_type, '/', p_brand) AS file", "p_name AS name", "l_orderkey")
    return resolve.linked_or_parked(r, t.nodes(spark, sf_dir).where("kind = 'method'"))


@query(
    "enclosing_symbol",
    f"""WITH {GRAPH_SQL}, p AS (SELECT l_orderkey, 'part/' || p_type || '/' || p_brand AS file, l_partkey + 3 AS place FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN part ON l_partkey = p_partkey),
b AS (SELECT l_orderkey, p.file, place, arg_max(n.id, (n.line, n.id)) AS symbol FROM p JOIN nodes n ON n.file = p.file AND n.line <= place AND (n.end_line IS NULL OR n.end_line >= place) GROUP BY ALL)
SELECT p.l_orderkey, p.file, p.place, b.symbol FROM p LEFT JOIN b ON p.l_orderkey = b.l_orderkey AND p.file = b.file AND p.place = b.place""",
)
def enclosing_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct().join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    places = line.selectExpr("l_orderkey", "concat('part/', p_type, '/', p_brand) AS file", "l_partkey + 3 AS at")
    return graph.enclosing(t.nodes(spark, sf_dir), places, partitions(spark, sf_dir, "lineitem")).select("l_orderkey", "file", F.col("at").alias("place"), "symbol")


_CHANNEL = "json_extract_string(props, '$.k') || '/' || ((day(ts) - 1) // 7)"


@query("event_channel_join", f"WITH c AS (SELECT DISTINCT {_CHANNEL} AS channel, event_id AS id, event_type FROM events), e AS (SELECT * FROM c WHERE event_type = 'click' QUALIFY count(*) OVER (PARTITION BY channel) <= {linking.EVENT_FANOUT}), h AS (SELECT * FROM c WHERE event_type = 'view' QUALIFY count(*) OVER (PARTITION BY channel) <= {linking.EVENT_FANOUT}) SELECT e.id AS source_id, h.id AS target_id, channel FROM e JOIN h USING (channel) WHERE e.id <> h.id")
def event_channel_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").selectExpr("event_type", "event_id AS id", "concat(get_json_object(props, '$.k'), '/', (day(ts) - 1) div 7) AS channel")
    return linking.channel_edges(e.where("event_type = 'click'"), e.where("event_type = 'view'"))


@query("explore_file_rank", f"WITH {GRAPH_SQL}, p AS (SELECT id FROM nodes WHERE kind = 'interface'), m AS (SELECT DISTINCT source_id AS id FROM edges WHERE kind = 'bridge') SELECT file, sum((CASE WHEN id IN (SELECT id FROM p) THEN 100 ELSE 0 END) + (CASE WHEN id IN (SELECT id FROM m) THEN 50 ELSE 0 END) + (CASE WHEN kind IN ('function', 'method') THEN 1 ELSE 0 END))::BIGINT AS score FROM nodes GROUP BY file")
def explore_file_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = t.nodes(spark, sf_dir)
    return explore.file_scores(n, n.where("kind = 'interface'"), t.edges(spark, sf_dir).where("kind = 'bridge'").select(F.col("source_id").alias("id")))


@query("overload_pack", "WITH d AS (SELECT p_name AS name, 'part/' || p_type || '/' || p_brand AS file, p_partkey AS line, p_partkey AS id, p_size * 40 AS size FROM part), w AS (SELECT *, row_number() OVER o AS nth, sum(size) OVER (o ROWS UNBOUNDED PRECEDING)::BIGINT AS total FROM d WINDOW o AS (PARTITION BY name ORDER BY file, line, id)) SELECT name, file, line, id, size::BIGINT AS size, nth, total FROM w WHERE nth = 1 OR (nth <= 16 AND total <= 12000)")
def overload_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.pack_overloads(read(spark, sf_dir, "part").selectExpr("p_name AS name", "concat('part/', p_type, '/', p_brand) AS file", "p_partkey AS line", "p_partkey AS id", "CAST(p_size * 40 AS BIGINT) AS size"))


@query("token_lookup", f"WITH {GRAPH_SQL}, t AS (SELECT DISTINCT p_brand || '.' || p_name AS token, p_name FROM part) SELECT t.token, n.id FROM t JOIN nodes n ON n.name = t.p_name WHERE n.kind = 'method' QUALIFY row_number() OVER (PARTITION BY t.token ORDER BY n.file, n.line, n.id) <= {explore.MOST_PER_TOKEN}")
def token_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.token_hits(t.nodes(spark, sf_dir), read(spark, sf_dir, "part").selectExpr("concat(p_brand, '.', p_name) AS token").distinct())


@query("synth_first_pass_wins", f"WITH {GRAPH_SQL} SELECT source_id, target_id, 'calls' AS kind, CASE WHEN bool_or(kind = 'calls') THEN 'callback' ELSE 'bridge' END AS made_by FROM edges WHERE kind IN ('calls', 'bridge') GROUP BY source_id, target_id")
def synth_first_pass_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t.edges(spark, sf_dir)
    one = lambda kind, by: e.where(F.col("kind") == kind).select("source_id", "target_id", F.lit("calls").alias("kind"), F.lit(by).alias("made_by"))
    return linking.first_pass_wins([one("calls", "callback"), one("bridge", "bridge"), one("calls", "late")], 3 * partitions(spark, sf_dir, "lineitem"))


@query("refs_by_status", f"WITH {_RESOLVE_SQL} SELECT CASE WHEN target_id IS NULL THEN 'failed' ELSE 'resolved' END AS status, count(*) AS n FROM res GROUP BY 1")
def refs_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.counts(_resolved(spark, sf_dir)[0].select(F.when(F.col("target_id").isNull(), "failed").otherwise("resolved").alias("status")), "status")


@query("line_pin", f"WITH {GRAPH_SQL}, p AS (SELECT DISTINCT p_name AS name, p_size * 10 AS place FROM part) SELECT p.name, p.place, arg_min(n.id, (CASE WHEN n.line <= place AND place <= coalesce(n.end_line, n.line) THEN 0 ELSE 1 END, abs(n.line - place), n.file, n.line, n.id)) AS id FROM p JOIN nodes n ON n.name = p.name WHERE n.kind = 'method' GROUP BY p.name, p.place")
def line_pin(spark: SparkSession, sf_dir: str) -> DataFrame:
    pins = read(spark, sf_dir, "part").select(F.col("p_name").alias("name"), (F.col("p_size") * 10).alias("at"))
    return graph.pinned(t.nodes(spark, sf_dir).where("kind = 'method'"), pins).select("name", F.col("at").alias("place"), "id")


@query("nearest_package", f"WITH {GRAPH_SQL}, f AS (SELECT DISTINCT file FROM nodes) SELECT file, CASE WHEN starts_with(file, 'part/') THEN 'mod-' || string_split(file, '/')[2] WHEN starts_with(file, 'customer/') THEN 'app/' || string_split(file, '/')[2] ELSE regexp_extract({_dir_sql('file')}, '([^/]*)$', 1) END AS package FROM f")
def nearest_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = read(spark, sf_dir, "part").selectExpr("concat('part/', p_type) AS folder", "concat('mod-', p_type) AS package").distinct()
    more = spark.createDataFrame([("part", "parts"), ("customer", "app")], "folder string, package string")
    return graph.nearest_package(t.nodes(spark, sf_dir), kinds.union(more))


@query("callback_targets", f"WITH {GRAPH_SQL}, c AS (SELECT DISTINCT p_name AS name, 'part/' || p_type || '/Brand#1' AS caller_file, 'part/ECONOMY/' || p_brand AS registrar_file FROM part) SELECT c.*, arg_min(n.id, (CASE WHEN n.file = caller_file THEN 1 WHEN {_dir_sql('n.file')} = {_dir_sql('caller_file')} THEN 2 WHEN n.file = registrar_file THEN 3 WHEN {_dir_sql('n.file')} = {_dir_sql('registrar_file')} THEN 4 WHEN starts_with(n.file, {_dir_sql('caller_file')} || '/') THEN 10 ELSE 100 END, n.file, n.line, n.id)) AS target_id FROM c JOIN nodes n ON n.name = c.name WHERE n.kind IN ('function', 'method') GROUP BY ALL")
def callback_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = read(spark, sf_dir, "part").selectExpr("p_name AS name", "concat('part/', p_type, '/Brand#1') AS caller_file", "concat('part/ECONOMY/', p_brand) AS registrar_file").distinct()
    return linking.callback_targets(calls, t.nodes(spark, sf_dir))


@query("edges_between", f"WITH {GRAPH_SQL} SELECT DISTINCT a.source_id, a.target_id FROM edges a JOIN edges b ON a.source_id = b.source_id AND a.target_id = b.target_id WHERE a.kind = 'calls'")
def edges_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t.edges(spark, sf_dir)
    return e.where("kind = 'calls'").select("source_id", "target_id").join(e.select("source_id", "target_id").distinct(), ["source_id", "target_id"], "left_semi").distinct()


@query("touch_unchanged", "SELECT doc_id, CASE WHEN contains(text, chr(10)) THEN 2 ELSE 1 END::BIGINT AS indexed_at FROM documents")
def touch_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document of several lines was another one when it was first indexed (at 1); those are indexed again (at 2)."""
    d = read(spark, sf_dir, "documents")
    snapshot = lambda text, at: d.select(F.col("doc_id").alias("path"), F.length("text").alias("size"), F.lit(0).alias("mtime"), F.sha2(text, 256).alias("content_hash"), F.lit(at).cast("long").alias("indexed_at"))
    got = store.touched(snapshot(F.replace("text", F.lit("\n"), F.lit(" ")), 1), snapshot(F.col("text"), 2))
    return got.select(F.col("path").alias("doc_id"), "indexed_at")
