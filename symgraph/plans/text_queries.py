"""Queries over documents, pages, names and the stream of changes, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, paths, text
from ..operators import explore, graph, linking, search, store
from ..sources import extract
from ..sources import graph_tables as t
from ..sources.graph_tables import FILES_SQL, GRAPH_SQL
from ..sources.tables import read
from ..streaming import changes
from .graph_queries import _dir_sql, query

QUERY = "the and"
_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


@query("fts_match", f"WITH w AS (SELECT doc_id AS id, {_WORDS} AS ws FROM documents) SELECT id, len(list_filter(ws, lambda x: x = 'the')) AS tf_0, len(list_filter(ws, lambda x: x = 'and')) AS tf_1 FROM w WHERE list_contains(ws, 'the') AND list_contains(ws, 'and')")
def fts_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.matching(_docs(spark, sf_dir), QUERY).select("id", "tf_0", "tf_1")


@query("fts_prefix", f"WITH w AS (SELECT doc_id AS id, {_WORDS} AS ws FROM documents) SELECT id, len(list_filter(ws, lambda x: starts_with(x, 'tion'))) AS hits FROM w WHERE len(list_filter(ws, lambda x: starts_with(x, 'tion'))) > 0")
def fts_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.matching(_docs(spark, sf_dir), "tion*").selectExpr("id", "tf_0 AS hits")


@query(
    "fts_bm25_topk",
    f"""WITH w AS (SELECT doc_id AS id, {_WORDS} AS ws FROM documents WHERE text IS NOT NULL),
c AS (SELECT id, len(ws) AS n, len(list_filter(ws, lambda x: x = 'the')) AS a, len(list_filter(ws, lambda x: x = 'and')) AS b FROM w),
s AS (SELECT count(*) AS nd, avg(n) AS al, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM c)
SELECT id, round(ln(1 + (nd - da + 0.5) / (da + 0.5)) * a * {search.K1 + 1} / (a + {search.K1} * ({1 - search.B} + {search.B} * n / al)) + ln(1 + (nd - db + 0.5) / (db + 0.5)) * b * {search.K1 + 1} / (b + {search.K1} * ({1 - search.B} + {search.B} * n / al)), 6) AS score
FROM c, s WHERE a > 0 AND b > 0 ORDER BY score DESC, id LIMIT {search.MOST}""",
)
def fts_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(_docs(spark, sf_dir), QUERY)


@query("fts_phrase", r"SELECT doc_id AS id FROM documents WHERE contains(' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ' ') || ' ', ' the and ')")
def fts_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.phrase(_docs(spark, sf_dir), ["the", "and"])


@query("term_document_counts", f"WITH w AS (SELECT doc_id, unnest({_WORDS}) AS word FROM documents) SELECT word, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM w GROUP BY word")
def term_document_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.postings(_docs(spark, sf_dir)).groupBy("word").agg(F.sum("tf").alias("n"), F.count("*").alias("n_docs"))


@query("text_scan", rf"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents) SELECT 'd' || doc_id AS file, line, content FROM l WHERE regexp_matches(content, '^[A-Z][a-z]+\.$') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line) <= {search.LINES_OF_FILE}")
def text_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.scan(_docs(spark, sf_dir).select(F.concat(F.lit("d"), "id").alias("file"), "text"), r"^[A-Z][a-z]+\.$", most=None)


@query("text_scan_counts", r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content FROM documents) SELECT doc_id AS file, count(*) AS n FROM l WHERE regexp_matches(content, '(^|[^\p{L}\p{N}_])the($|[^\p{L}\p{N}_])') GROUP BY doc_id")
def text_scan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.scan_counts(_docs(spark, sf_dir).select(F.col("id").alias("file"), "text"), "the")


@query("line_window", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))[2:4]) AS content, generate_subscripts(string_split(text, chr(10))[2:4], 1) AS k FROM documents) SELECT doc_id, k + 1 AS line, content FROM l")
def line_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(text.line_window(F.col("text"), 2, 3)).alias("k", "content")).select("doc_id", (F.col("k") + 2).cast("long").alias("line"), "content")


@query("content_hash_groups", "SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1")
def content_hash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.files(spark, sf_dir).groupBy("content_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query(
    "incremental_changed_files",
    f"""WITH {FILES_SQL}, l AS (SELECT doc_id, min(quality) AS q, max(toxic) AS t FROM labels GROUP BY doc_id),
o AS (SELECT path, size, CASE WHEN q = 0 THEN sha256(path) ELSE content_hash END AS content_hash FROM files JOIN l USING (doc_id)),
n AS (SELECT path, size, content_hash FROM files LEFT JOIN l USING (doc_id) WHERE t IS NULL OR t = 0)
SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.path = n.path WHERE o.content_hash IS DISTINCT FROM n.content_hash""",
)
def incremental_changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the labelled documents, those of low quality in another version, to all documents but the toxic ones."""
    label = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    f = t.files(spark, sf_dir).join(label, "doc_id", "left")
    old = f.where("q IS NOT NULL").withColumn("content_hash", F.when(F.col("q") == 0, F.sha2("path", 256)).otherwise(F.col("content_hash")))
    return store.changes(old, f.where("t IS NULL OR t = 0"))


_GENERATED_SQL = f"regexp_matches(regexp_extract(path, '([^/]*)$', 1), '{paths.GENERATED}')"


@query("generated_rank_last", f"WITH {FILES_SQL} SELECT path, {_GENERATED_SQL} AS is_generated, row_number() OVER (ORDER BY {_GENERATED_SQL}, path) AS rank FROM files")
def generated_rank_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.generated_last(t.files(spark, sf_dir)).select("path", "is_generated", "rank")


@query("test_file_flags", f"WITH {FILES_SQL} SELECT path, regexp_matches(path, '{paths.TEST_DIR}') OR regexp_matches(path, '{paths.TEST_NAME}') AS is_test, regexp_matches(regexp_extract(lower(path), '([^/]*)$', 1), '{paths.LOW_VALUE_NAME}') OR regexp_matches(lower(path), '{paths.LOW_VALUE_DIR}') AS is_low_value FROM files")
def test_file_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.files(spark, sf_dir).select("path", paths.is_test(F.col("path")).alias("is_test"), paths.is_low_value(F.col("path")).alias("is_low_value"))


_LANG_SQL = " ".join(f"WHEN '{x}' THEN '{lang}'" for x, lang in paths.EXTENSION_LANGUAGE.items())


@query("language_counts", rf"WITH {FILES_SQL} SELECT CASE lower(regexp_extract(path, '\.([^./]+)$', 1)) {_LANG_SQL} END AS language, count(*) AS n FROM files GROUP BY 1")
def language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.counts(t.files(spark, sf_dir).select(paths.language(F.col("path")).alias("language")), "language")


@query("name_tail", r"SELECT page_id, CASE WHEN regexp_matches(trim(url), '[./#@]$') THEN trim(url) ELSE regexp_extract(trim(url), '([^./#@]+)$', 1) END AS tail, CASE WHEN regexp_matches(trim(url), '[.#@]$') THEN trim(url) ELSE regexp_extract(trim(url), '([^.#@]+)$', 1) END AS ref_tail FROM pages")
def name_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", names.name_tail(u).alias("tail"), names.ref_tail(u).alias("ref_tail"))


@query("relpath_dirname", f"SELECT page_id, CASE WHEN starts_with(url, 'http:/') THEN substring(url, 7) ELSE url END AS rel, {_dir_sql('url')} AS dir, regexp_extract(url, '([^/]*)$', 1) AS base FROM pages")
def relpath_dirname(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", paths.relative_to(u, "http:/").alias("rel"), paths.dirname(u).alias("dir"), paths.basename(u).alias("base"))


@query("kebab_to_pascal", "SELECT p_partkey, array_to_string(list_transform(string_split(replace(p_name, ' ', '-'), '-'), lambda x: upper(x[1]) || x[2:]), '') AS pascal FROM part")
def kebab_to_pascal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", names.kebab_to_pascal(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("pascal"))


_SEGMENTS = r"list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(regexp_replace({c}, '[_\-.$]', ' ', 'g'), '(\p{{Ll}})(\p{{Lu}})', '\1 \2', 'g'), '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g')), '\s+'), lambda x: x <> '')"
_CAMEL = "c_mktsegment || 'XMLKey' || c_custkey || '_' || c_name"


@query("segments", f"SELECT c_custkey, array_to_string({_SEGMENTS.format(c='(' + _CAMEL + ')')}, '|') AS segments FROM customer")
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return c.select("c_custkey", F.array_join(names.segments(F.concat("c_mktsegment", F.lit("XMLKey"), "c_custkey", F.lit("_"), "c_name")), "|").alias("segments"))


@query("fuzzy_score", "WITH s AS (SELECT p_partkey, string_split(p_name, ' ') AS n, 'red' AS a, 'ring' AS b FROM part) SELECT p_partkey, CASE WHEN n[1] = 'red' AND n[2] = 'ring' THEN 45 ELSE 0 END::BIGINT AS score FROM s")
def fuzzy_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", names.fuzzy_score(F.array(F.lit("red"), F.lit("ring")), names.segments(F.col("p_name"))).cast("long").alias("score"))


@query("edit_distance_candidates", "WITH n AS (SELECT DISTINCT p_name FROM part) SELECT a.p_name AS a, b.p_name AS b, levenshtein(a.p_name, b.p_name)::BIGINT AS distance FROM n a JOIN n b ON a.p_name < b.p_name WHERE levenshtein(a.p_name, b.p_name) <= 2")
def edit_distance_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names within two edits of each other. One of three parts of a name must be the same in both, at most two places off: names meet by equal parts."""
    n = read(spark, sf_dir, "part").select("p_name").where("p_name IS NOT NULL").distinct()
    return close_names(n, "p_name", 2)


def close_names(df: DataFrame, column: str, most: int) -> DataFrame:
    """(a, b, distance) of distinct values within `most` edits. most + 1 pieces of the shorter: one is untouched, and stands in the longer at most `most` places off. Lengths differ by `most` at most."""
    v = df.select(F.col(column).alias("v")).withColumn("n", F.length("v"))
    piece = lambda n, k: F.floor(n * k / (most + 1)).cast("int")
    own = F.explode(F.transform(F.sequence(F.lit(0), F.lit(most)), lambda k: F.struct(F.col("n").alias("n"), k.alias("k"), F.substring(F.col("v"), piece(F.col("n"), k) + 1, piece(F.col("n"), k + 1) - piece(F.col("n"), k)).alias("s"))))
    a = v.select(F.col("v").alias("x"), own.alias("p")).select("x", "p.*")
    # what each value would have to share with one of n characters (n up to its own), for every place that piece may stand at
    lengths = F.filter(F.sequence(F.greatest(F.col("n") - most, F.lit(0)), F.col("n")), lambda n: n >= 0)
    pieces = F.flatten(F.transform(lengths, lambda n: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(most)), lambda k: F.transform(F.sequence(F.lit(-most), F.lit(most)), lambda d: F.struct(n.alias("n"), k.alias("k"), F.when(piece(n, k) + d >= 0, F.substring(F.col("v"), piece(n, k) + d + 1, piece(n, k + 1) - piece(n, k))).alias("s")))))))
    b = v.select(F.col("v").alias("y"), F.explode(F.array_distinct(pieces)).alias("p")).select("y", "p.*")
    pair = a.join(b, ["n", "k", "s"]).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return pair.withColumn("distance", F.levenshtein("a", "b", most).cast("long")).where("distance >= 0")


_HTML_TAGS = r"regexp_extract_all(html, '<([A-Za-z][A-Za-z0-9-]*)', 1)"


@query("html_tag_refs", f"WITH g AS (SELECT page_id, unnest({_HTML_TAGS}) AS tag FROM pages) SELECT page_id, tag, list_contains({sorted(extract.NATIVE_TAGS)!r}, lower(tag)) AS is_native, count(*) AS n FROM g GROUP BY page_id, tag")
def html_tag_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.tag_refs(read(spark, sf_dir, "pages"), "page_id", "html")


@query("script_calls", r"WITH s AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<script[^>]*>(.*?)</script>', 1)) AS script FROM pages), c AS (SELECT page_id, unnest(regexp_extract_all(script, '([A-Za-z_$][A-Za-z0-9_$]*)\s*\(', 1)) AS callee FROM s) SELECT page_id, callee, count(*) AS n FROM c GROUP BY page_id, callee")
def script_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.script_calls(read(spark, sf_dir, "pages"), "page_id", "html")


@query("page_import_edges", """SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"#?]+)', 1)) AS spec FROM pages""")
def page_import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.link_specs(read(spark, sf_dir, "pages"), "page_id", "html")


_BARE = "regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '')"


@query("importers_prefix", f"WITH p AS (SELECT page_id, {_BARE} AS name FROM pages), k AS (SELECT DISTINCT array_to_string(string_split(name, '/')[1:2], '/') AS package FROM p) SELECT k.package, count(*) AS n FROM k JOIN p ON p.name = k.package OR starts_with(p.name, k.package || '/') GROUP BY k.package")
def importers_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages").selectExpr("CAST(page_id AS STRING) AS file", f"{_BARE} AS name")
    packages = p.select(F.array_join(F.slice(F.split("name", "/"), 1, 2), "/").alias("package"))
    return store.counts(graph.importers(p, packages), "package")


@query("longest_prefix_alias", f"WITH p AS (SELECT page_id, {_BARE} AS name FROM pages), a AS (SELECT DISTINCT string_split(name, '/')[1] AS prefix FROM p UNION SELECT DISTINCT array_to_string(string_split(name, '/')[1:2], '/') FROM p WHERE len(string_split(name, '/')) > 2) SELECT page_id, arg_max(prefix, length(prefix)) AS prefix FROM p LEFT JOIN a ON name = prefix OR starts_with(name, prefix || '/') GROUP BY page_id")
def longest_prefix_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages").selectExpr("page_id", f"{_BARE} AS name")
    s = F.split("name", "/")
    table = p.select(s[0].alias("prefix")).union(p.where(F.size(s) > 2).select(F.array_join(F.slice(s, 1, 2), "/"))).distinct().withColumn("target", F.concat(F.lit("src/"), "prefix"))
    return linking.longest_prefix(p, "name", table).select("page_id", "prefix")


@query("direct_children", f"WITH {GRAPH_SQL} SELECT DISTINCT {_dir_sql('file')} AS folder, file FROM nodes WHERE contains(file, '/')")
def direct_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = t.nodes(spark, sf_dir)
    return n.where("instr(file, '/') > 0").select(paths.dirname(F.col("file")).alias("folder"), "file").distinct()


_OPS = "CASE event_type WHEN 'error' THEN 'remove' WHEN 'signup' THEN 'create' ELSE 'write' END"


@query(
    "debounce_sessions",
    """WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id AS path, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS n_events FROM s GROUP BY user_id, k""",
)
def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = changes.change_events(read(spark, sf_dir, "events"))
    return changes.sessions(e, "30 minutes").select(F.col("path").cast("long").alias("path"), "first_us", "last_us", "n_events")


@query(
    "debounce_last_op",
    f"""WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id AS path, epoch_us(max(ts)) AS last_us, CASE WHEN arg_max({_OPS}, (ts, event_id)) = 'remove' THEN 'delete' ELSE 'upsert' END AS action FROM s GROUP BY user_id, k""",
)
def debounce_last_op(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = changes.change_events(read(spark, sf_dir, "events"))
    return changes.sessions(e, "30 minutes").select(F.col("path").cast("long").alias("path"), "last_us", "action")


@query("pending_files", "SELECT e.user_id AS path, count(*) AS n FROM events e LEFT JOIN (SELECT DISTINCT doc_id FROM documents) d ON e.event_id = d.doc_id WHERE d.doc_id IS NULL GROUP BY e.user_id")
def pending_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    done = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_id"))
    return store.counts(e.join(done, "event_id", "left_anti").select(F.col("user_id").alias("path")), "path")


@query("stored_body_cut", "SELECT doc_id, strlen(text) <= 8000 AS whole FROM documents WHERE text IS NOT NULL")
def stored_body_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", (text.stored_body(F.col("text")) == F.col("text")).alias("whole"))


@query("whole_word_flags", "WITH d AS (SELECT doc_id, ' ' || text || ' ' AS t, instr(text, 'the') AS k FROM documents) SELECT doc_id, k > 0 AND NOT regexp_matches(t[k], '^[A-Za-z0-9_]$') AND NOT regexp_matches(t[k + 4], '^[A-Za-z0-9_]$') AS whole FROM d")
def whole_word_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", names.has_whole_word(F.col("text"), "the").alias("whole"))


@query("identifier_flags", "SELECT DISTINCT p_name AS name, regexp_matches(p_name, '^[A-Za-z_$][A-Za-z0-9_$]*$') AS is_identifier FROM part UNION SELECT DISTINCT p_type, regexp_matches(p_type, '^[A-Za-z_$][A-Za-z0-9_$]*$') FROM part")
def identifier_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    n = p.select(F.col("p_name").alias("name")).union(p.select("p_type")).distinct()
    return n.select("name", names.is_identifier(F.col("name")).alias("is_identifier"))


@query("skipped_paths", f"WITH p AS (SELECT page_id, {_BARE} AS name FROM pages) SELECT page_id, list_has_any(string_split(name, '/')[:-2], {paths.SKIPPED_DIRS!r}) OR regexp_matches('/' || name, '/go/(pkg|bin|src)/') AS skipped FROM p")
def skipped_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").selectExpr("page_id", f"{_BARE} AS name").select("page_id", paths.is_skipped(F.col("name")).alias("skipped"))


@query("spec_matches", f"WITH p AS (SELECT page_id, {_BARE} AS name, string_split({_BARE}, '/')[2] AS spec FROM pages) SELECT page_id, coalesce(spec, '') <> '' AS hit FROM p")
def spec_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages").selectExpr("page_id", f"{_BARE} AS name")
    return p.select("page_id", paths.matches_spec(F.col("name"), F.coalesce(F.get(F.split("name", "/"), F.lit(1)), F.lit(""))).alias("hit"))


@query("line_of_match", "SELECT doc_id, 1 + length(t) - length(replace(t, chr(10), '')) AS line FROM (SELECT doc_id, substring(text, 1, instr(text, 'the') - 1) AS t, instr(text, 'the') AS k FROM documents) WHERE k > 0")
def line_of_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "text", F.instr("text", "the").alias("k")).where("k > 0")
    return d.select("doc_id", text.line_of(F.col("text"), F.col("k")).alias("line"))
