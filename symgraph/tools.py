"""The nine questions to ask of an index: explore, node, search, callers, callees, impact, files, status, affected. Answers are DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import names, paths
from .operators import explore, graph, index, search, store


class Project:
    """tables: files (path, content, ...), nodes, edges, refs, as index.build() gives them or load() reads them."""

    def __init__(self, tables: dict[str, DataFrame]):
        self.files_table, self.nodes, self.edges, self.refs = (tables[k] for k in index.TABLES)
        self.spark: SparkSession = self.nodes.sparkSession

    @classmethod
    def build(cls, spark: SparkSession, folder: str) -> Project:
        return cls(index.build(index.scan(spark, folder)))

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Project | None:
        """None where folder holds no index of this revision."""
        found = store.load_snapshot(spark, folder, index.TABLES)
        return cls(found) if found else None

    def save(self, folder: str) -> None:
        store.save_snapshot(self.spark, folder, dict(zip(index.TABLES, (self.files_table, self.nodes, self.edges, self.refs))))

    def _names(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([(name,)], "name string")

    def definitions(self, name: str, path: str | None = None, file: str | None = None, glob: str | None = None) -> DataFrame:
        """Symbols of that name; where there is none, those whose name ends in .name. Filters narrow; a file hint never empties the result."""
        real = self.nodes.where("kind NOT IN ('file', 'module')")
        d = real.where(F.col("name") == name)
        if d.isEmpty():
            d = real.where(F.endswith("name", F.lit("." + name)) | (F.lower("name") == name.lower()))
        if path:
            d = d.where(paths.below(F.col("file"), path))
        if glob:
            d = d.where(paths.matches_glob(F.col("file"), glob))
        if file:
            hit = d.where(paths.matches_hint(F.col("file"), file))
            d = d if hit.isEmpty() else hit
        return d

    def _beside(self, name: str, own: str, other: str, most: int, filters: dict) -> DataFrame:
        d = self.definitions(name, **filters).select(F.col("id").alias(own))
        found = graph.walked(self.edges).join(d, own, "left_semi").select(F.col(other).alias("id")).distinct().join(self.nodes, "id")
        return found.select("name", "kind", "file", "line").dropDuplicates(["name", "file", "line"]).orderBy("file", "line", "name").limit(most)

    def callers(self, name: str, most: int = graph.MOST_SYMBOLS, **filters: str) -> DataFrame:
        return self._beside(name, "target_id", "source_id", most, filters)

    def callees(self, name: str, most: int = graph.MOST_SYMBOLS, **filters: str) -> DataFrame:
        return self._beside(name, "source_id", "target_id", most, filters)

    def impact(self, name: str, depth: int = 2, most: int = graph.MOST_SYMBOLS, **filters: str) -> DataFrame:
        got = graph.impact(self.nodes, self.edges, self.definitions(name, **filters), min(max(depth, 1), 5))
        return got.orderBy(F.desc("hits"), "file").limit(most)

    def search(self, pattern: str, path: str | None = None, glob: str | None = None, ignore_case: bool = False, most: int = search.MOST_LINES) -> DataFrame:
        """(file, line, content): symbols by full text for a plain identifier, else lines that match."""
        plain = names.is_identifier(F.lit(pattern))
        if not (path or glob or ignore_case) and self.spark.range(1).where(plain).count():
            docs = self.nodes.where("kind NOT IN ('file', 'module')").select("id", F.concat_ws(" ", "name", "body", "language").alias("text"))
            hit = search.bm25(docs, pattern, most)
            return hit.join(self.nodes, "id").orderBy(F.desc("score"), "file", "line").select("file", "line", F.col("name").alias("content"))
        f = self.files_table
        if path:
            f = f.where(paths.below(F.col("path"), path))
        if glob:
            f = f.where(paths.matches_glob(F.col("path"), glob))
        return search.scan(f.select(F.col("path").alias("file"), F.col("content").alias("text")), pattern, ignore_case, most=most)

    def files(self, glob: str | None = None, path: str | None = None, most: int = 100) -> DataFrame:
        f = self.files_table
        if path:
            f = f.where(paths.below(F.col("path"), path))
        if glob:
            f = f.where(paths.matches_glob(F.col("path"), glob))
        return f.select("path", "size", paths.language(F.col("path")).alias("language")).orderBy("path").limit(most)

    def node(self, name: str, most: int = 16, **filters: str) -> DataFrame:
        """Definitions of a name with their bodies, and up to six callers and callees of each."""
        d = explore.pack_overloads(self.definitions(name, **filters).withColumn("size", F.coalesce(F.octet_length("body"), F.lit(0)).cast("long")), most=most)
        out = d.select("id", "name", "kind", "file", "line", "end_line", "body")
        for column, own, other in (("callers", "target_id", "source_id"), ("callees", "source_id", "target_id")):
            near = graph.walked(self.edges).select(F.col(own).alias("id"), F.col(other).alias("o")).join(d.select("id"), "id", "left_semi").distinct().join(self.nodes.select(F.col("id").alias("o"), F.col("name").alias("n"), F.col("file").alias("f"), F.col("line").alias("l")), "o")
            near = graph.top(near, ["id"], ["f", "l", "n"], 6).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("f", "l", "n"))).alias(column))
            out = out.join(near, "id", "left")
        return out.drop("id").orderBy("file", "line")

    def file(self, path: str, first: int = 1, most: int = 2000) -> DataFrame:
        """(line, content) of one file."""
        lines = self.files_table.where(F.col("path") == path).select(F.posexplode(F.slice(F.split("content", "\n"), first, most)).alias("k", "content"))
        return lines.select((F.col("k") + first).cast("long").alias("line"), "content").orderBy("line")

    def symbols(self, path: str) -> DataFrame:
        return self.nodes.where((F.col("file") == path) & (F.col("kind") != "file")).select("line", "kind", "name", "end_line").orderBy("line", "name")

    def dependents(self, path: str) -> DataFrame:
        return graph.file_dependents(self.nodes, self.edges).where(F.col("file") == path).select("dependent").orderBy("dependent")

    def status(self) -> DataFrame:
        return store.stats(self.nodes, self.edges, self.files_table).withColumn("n_failed", F.lit(self.refs.where("target_id IS NULL").count()))

    def affected(self, files: list[str], depth: int = 5, pattern: str | None = None) -> DataFrame:
        """(file, depth): tests that a change of these files may break, by who imports their packages."""
        changed = self.spark.createDataFrame([(f,) for f in files], "file string")
        return graph.affected(self.imports(), self.packages(), changed, depth, pattern).orderBy("file")

    def imports(self) -> DataFrame:
        """(file, name): what each file imports, as it names it."""
        n = self.nodes.select("id", "file", "name")
        e = self.edges.where("kind = 'imports'").select("source_id", "target_id")
        return e.join(n.select(F.col("id").alias("source_id"), "file"), "source_id").join(n.select(F.col("id").alias("target_id"), "name"), "target_id").select("file", "name").distinct()

    def packages(self) -> DataFrame:
        """(file, package) of every file: by the nearest go.mod above it, else the nearest package.json, else the name of its folder."""
        folder, name = paths.dirname(F.col("path")), paths.basename(F.col("path"))
        go = F.regexp_extract("content", r"(?m)^\s*module\s+(\S+)", 1)
        package = F.when(name == "go.mod", go).when(name == "package.json", F.get_json_object("content", "$.name"))
        manifests = self.files_table.where(name.isin("go.mod", "package.json")).select(folder.alias("folder"), package.alias("package"), (name == "go.mod").cast("int").alias("rank")).where("package <> ''")
        return graph.nearest_package(self.files_table.select(F.col("path").alias("file")), manifests)

    def explore(self, question: str) -> list[tuple[str, str]]:
        """(file, text) for a question, packed to the budget of a project of this size. Files are scored and cut in Spark; only those few are packed on the driver."""
        tokens = explore.question_tokens(question)
        if not tokens:
            return []
        b = explore.budget(self.files_table.count())
        hits = explore.token_hits(self.nodes, self.spark.createDataFrame([(t,) for t in tokens], "token string")).select("id").distinct()
        flow = graph.flow_paths(self.edges, hits) if len(tokens) > 1 else None
        on_path = flow.select(F.col("seed").alias("id")).union(flow.select("target")).distinct() if flow is not None else hits.limit(0)
        scores = explore.file_scores(self.nodes.where("kind <> 'module'"), on_path, hits).where("score >= 50")
        best = scores.where(~paths.is_low_value(F.col("file")) | (F.col("score") >= 100)).orderBy(F.desc("score"), "file").limit(b.most_files)
        rows = best.join(self.files_table.select(F.col("path").alias("file"), "content"), "file").orderBy(F.desc("score"), "file").collect()
        return explore.pack([(r["file"], r["content"], r["score"] >= 100) for r in rows], b)
