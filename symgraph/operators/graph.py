"""Walks over the property graph: callers, callees, impact, flow, dependents, affected files.

Every walk is over a set of names or ids at once. A search in breadth goes level by level: each level is one join with the edges, an anti-join
with what was reached before, and a table in the shared folder, so the plan of a level doesn't hold those of all earlier ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..sources.tables import bounded_broadcast, materialize

#: Only these kinds of edge are walked.
WALKED = ("calls", "references", "bridge")
MOST_SYMBOLS = 40
FLOW_NODES = 7
FLOW_UNNAMED = 1


def walked(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("kind").isin(*WALKED))


def top(df: DataFrame, keys: list[str], order: list[str | Column], most: int) -> DataFrame:
    """The first `most` rows of each key; order must be total, or which of equal rows stay is open."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def _neighbours(nodes: DataFrame, edges: DataFrame, names: DataFrame, most: int, own: str, other: str, partitions: int | None) -> DataFrame:
    defs = nodes.join(names.select("name").distinct(), "name", "left_semi").select(F.col("name").alias("symbol"), F.col("id").alias(own))
    found = walked(edges).join(defs, own).select("symbol", F.col(other).alias("id"))
    if partitions:
        found = found.repartition(partitions, "id")
    # a task keeps the first places of each symbol that it sees before anything is shuffled by symbol; a place that comes twice has one rank
    place = Window.partitionBy("symbol").orderBy("file", "line", "name")
    found = found.join(nodes, "id").select("symbol", "name", "kind", "file", "line").withColumn("_n", F.dense_rank().over(place)).where(F.col("_n") <= most)
    return found.groupBy("symbol", "name", "file", "line").agg(F.min("kind").alias("kind")).select("symbol", "name", "kind", "file", "line")


def callers(nodes: DataFrame, edges: DataFrame, names: DataFrame, most: int = MOST_SYMBOLS, partitions: int | None = None) -> DataFrame:
    """(symbol, name, kind, file, line): who calls each of names, the first `most` by place."""
    return _neighbours(nodes, edges, names, most, "target_id", "source_id", partitions)


def callees(nodes: DataFrame, edges: DataFrame, names: DataFrame, most: int = MOST_SYMBOLS, partitions: int | None = None) -> DataFrame:
    """(symbol, name, kind, file, line): whom each of names calls, the first `most` by place."""
    return _neighbours(nodes, edges, names, most, "source_id", "target_id", partitions)


def reach(edges: DataFrame, seeds: DataFrame, depth: int, key: str = "id") -> DataFrame:
    """(key, depth): what is reached from seeds over (source, target) rows in at most depth steps, with the least number of steps."""
    level = materialize(seeds.select(key, F.lit(0).alias("depth")).distinct(), "reach")
    seen = level
    for step in range(1, depth + 1):
        near = level.join(edges, level[key] == edges["source"]).select(F.col("target").alias(key)).distinct()
        level = materialize(near.join(seen, key, "left_anti").select(key, F.lit(step).alias("depth")), "reach")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def impact(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """(file, hits, min_depth): files that call into seeds (id) over at most depth steps. hits: edges into nodes that were expanded."""
    back = walked(edges).select(F.col("target_id").alias("source"), F.col("source_id").alias("target"))
    expanded = reach(back, seeds, depth - 1)
    hits = back.join(expanded, back["source"] == expanded["id"]).select(F.col("target").alias("id"), (F.col("depth") + 1).alias("depth"))
    # counted by node before the files are looked up: the join then moves one row for each node
    per_node = hits.groupBy("id").agg(F.count("*").alias("hits"), F.min("depth").alias("depth"))
    return per_node.join(nodes.select("id", "file"), "id").groupBy("file").agg(F.sum("hits").alias("hits"), F.min("depth").cast("long").alias("min_depth"))


def flow_paths(edges: DataFrame, named: DataFrame, most_nodes: int = FLOW_NODES) -> DataFrame:
    """(seed, target, hops): from each named id the farthest named one, by the fewest hops, over at most most_nodes - 1 edges with at most one unnamed node between two named ones.

    An unnamed node can only be reached from a named one, so whether a path may go on depends on its last node alone.
    """
    names = named.select("id").distinct()
    e = walked(edges).select("source_id", "target_id")
    side = lambda c: names.select(F.col("id").alias(c))
    into = e.join(side("target_id"), "target_id", "left_semi").join(side("source_id").withColumn("s", F.lit(True)), "source_id", "left")
    into = materialize(into.distinct(), "flow-into")
    # an unnamed node is only a way to a named one: edges to those that lead to none are left out
    between = into.where("s IS NULL").select(F.col("source_id").alias("target_id")).distinct()
    out = e.join(between, "target_id", "left_semi").join(side("source_id"), "source_id", "left_semi").select("source_id", "target_id", F.lit(False).alias("is_named")).distinct()
    e = materialize(into.select("source_id", "target_id", F.lit(True).alias("is_named")).unionByName(out), "flow-edges")
    level = names.select(F.col("id").alias("seed"), F.col("id"), F.lit(True).alias("is_named"), F.lit(0).alias("hops"))
    seen = materialize(level, "flow")
    level = seen
    for hop in range(1, most_nodes):
        near = level.select("seed", F.col("id").alias("source_id")).join(e, "source_id").select("seed", F.col("target_id").alias("id"), "is_named").distinct()
        level = materialize(near.join(seen, ["seed", "id"], "left_anti").withColumn("hops", F.lit(hop)), "flow")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    found = seen.where("is_named AND hops > 0")
    return found.groupBy("seed").agg(F.min(F.struct((-F.col("hops")).alias("h"), "id")).alias("m")).select("seed", F.col("m.id").alias("target"), (-F.col("m.h")).cast("long").alias("hops"))


def file_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, target): files of which one has a symbol that uses one of the other. Edges carry numbers for files, not their names."""
    files = materialize(nodes.select("file").where("file IS NOT NULL").distinct().withColumn("n", F.monotonically_increasing_id()), "files")
    known = nodes.select("id", "file").join(bounded_broadcast(files), "file")
    src, tgt = (known.select(F.col("id").alias(f"{side}_id"), F.col("n").alias(f"{side}_n")) for side in ("source", "target"))
    both = walked(edges).join(src, "source_id").join(tgt, "target_id").where("source_n <> target_n").select("source_n", "target_n").distinct()
    for side in ("source", "target"):
        both = both.join(files.select(F.col("n").alias(f"{side}_n"), F.col("file").alias(side)), f"{side}_n")
    return both.select("source", "target")


def file_dependents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, dependent): for every file, the others that use a symbol of it."""
    return file_edges(nodes, edges).select(F.col("target").alias("file"), F.col("source").alias("dependent"))


def affected(imports: DataFrame, packages: DataFrame, changed: DataFrame, depth: int = 5, pattern: str | None = None) -> DataFrame:
    """(file, depth): test files that a change of `changed` (file) may break. imports: (file, name); packages: (file, package) of every file.

    Level 0 are the changed files; the next level are the files that import the package of one of this level, or one below it. `depth` levels are visited in all.
    Tests are those among the visited, and those in the folder of a visited file that is no test itself.
    """
    meet = materialize(importers(imports, packages), "importers")
    level = materialize(changed.select("file", F.lit(0).alias("depth")).distinct(), "affected")
    seen = level
    for step in range(1, depth):
        named = level.join(packages, "file").select("package").distinct()
        near = meet.join(named, "package", "left_semi").select("file").distinct()
        level = materialize(near.join(seen, "file", "left_anti").select("file", F.lit(step).alias("depth")), "affected")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    folders = seen.where(~paths.is_test(F.col("file"), pattern)).groupBy(paths.dirname(F.col("file")).alias("folder")).agg(F.min("depth").alias("depth"))
    beside = packages.select("file", paths.dirname(F.col("file")).alias("folder")).distinct().join(folders, "folder").select("file", "depth")
    both = seen.unionByName(beside).where(paths.is_test(F.col("file"), pattern))
    return both.groupBy("file").agg(F.min("depth").cast("long").alias("depth"))


def importers(imports: DataFrame, packages: DataFrame) -> DataFrame:
    """(package, file): files that import the package or one below it. imports: (file, name). The prefixes of each name are joined by equality: no nested loop."""
    prefixes = imports.select("file", F.explode(F.array_distinct(paths.ancestors(F.col("name")))).alias("package"))
    return prefixes.join(packages.select("package").distinct(), "package").distinct().select("package", "file")


def enclosing(nodes: DataFrame, places: DataFrame, partitions: int | None = None) -> DataFrame:
    """places (file, at, ...) with the id of the innermost symbol whose lines hold it: the one that starts last; an unknown end is open.

    A symbol that starts later than another and ends before `at` doesn't hide it. Each line of a file is looked up once, whatever the number of places on it:
    both sides go to buckets of lines, a symbol to each that it spans, so no file is compared in full; symbols without an end are met by a running maximum
    within a bucket, after that of the buckets before. partitions: how many the places need.
    """
    width = 256
    n = nodes.select(F.col("file"), F.col("line").alias("first"), F.col("end_line").alias("last"), F.col("id").alias("symbol"))
    closed = n.where("last >= first").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(F.col("last") / width))))
    spread = places.repartition(partitions, "file", "at") if partitions else places
    p = spread.select("file", "at").where("file IS NOT NULL AND at IS NOT NULL").distinct().withColumn("bucket", F.floor(F.col("at") / width))
    inner = p.join(closed, ["file", "bucket"]).where("first <= at AND at <= last").select("file", "at", F.struct("first", "symbol").alias("s"))
    opened = n.where("last IS NULL AND first IS NOT NULL").select("file", F.col("first").alias("x"), F.lit(0).alias("is_place"), F.struct("first", "symbol").alias("s"))
    spine = p.select("file", F.col("at").cast(opened.schema["x"].dataType).alias("x"), F.lit(1).alias("is_place"), F.lit(None).cast(opened.schema["s"].dataType).alias("s"), "at")
    both = spine.unionByName(opened, allowMissingColumns=True).withColumn("bucket", F.floor(F.col("x") / width))
    before = both.groupBy("file", "bucket").agg(F.max("s").alias("s"))
    before = before.select("file", "bucket", F.max("s").over(Window.partitionBy("file").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    running = Window.partitionBy("file", "bucket").orderBy("x", "is_place").rowsBetween(Window.unboundedPreceding, 0)
    outer = both.withColumn("s", F.max("s").over(running)).where("is_place = 1").join(before, ["file", "bucket"]).select("file", "at", F.coalesce("s", "earlier").alias("s")).where("s IS NOT NULL")
    best = inner.unionByName(outer).groupBy("file", "at").agg(F.max("s").alias("s"))
    return spread.join(best, ["file", "at"], "left").select(*places.columns, F.col("s.symbol").alias("symbol"))


def _pieces(first: Column, last: Column) -> Column:
    """[first, last] as blocks of 2 ** level lines from index * 2 ** level on: two of a level at most, and as many levels as its length has bits."""
    def at(j: Column) -> Column:
        lo, hi = -F.call_function("shiftright", -first, j), F.call_function("shiftright", last + 1, j)
        one = lambda odd, index: F.when((lo < hi) & (odd % 2 != 0), F.struct(j.alias("level"), index.alias("index")))
        return F.array(one(lo, lo), one(hi, hi - 1))

    levels = F.sequence(F.lit(0), F.length(F.bin(last - first + 1)))
    return F.array_distinct(F.filter(F.flatten(F.transform(levels, at)), lambda x: x.isNotNull()))


def pinned(defs: DataFrame, pins: DataFrame) -> DataFrame:
    """(name, at, id): of each name's definitions the one whose lines hold `at`, else the one that starts nearest; ties by place. pins: (name, at).

    What holds a line is found by blocks of powers of two, of which a definition fills few and a line lies in one of each size; what starts nearest by the
    next starts on either side, within ranges of lines and from range to range. So no pin meets all definitions of its name.
    """
    width = 1024
    p = materialize(pins.select("name", "at").distinct(), "pins")
    d = defs.join(p.select("name").distinct(), "name", "left_semi").select("name", "id", "file", F.col("line").cast("long").alias("line"), F.coalesce("end_line", "line").cast("long").alias("last"))
    place = F.struct("file", "line", "id")
    spans = d.where("last >= line").groupBy("name", "line", "last").agg(F.min(place).alias("b"))
    filled = spans.select("name", "line", "b", F.explode(_pieces(F.col("line"), F.col("last"))).alias("x")).groupBy("name", "x.level", "x.index").agg(F.min(F.struct(-F.col("line"), "b")).alias("s"))
    asked = p.select("name", "at", F.explode(F.transform(F.sequence(F.lit(0), F.lit(62)), lambda j: F.struct(j.alias("level"), F.call_function("shiftright", F.col("at").cast("long"), j).alias("index")))).alias("x"))
    holding = asked.select("name", "at", "x.*").join(filled, ["name", "level", "index"]).groupBy("name", "at").agg(F.min("s").alias("s")).select("name", "at", F.col("s.b").alias("held"))

    starts = d.where("line IS NOT NULL").groupBy("name", F.col("line").alias("x")).agg(F.min(place).alias("b"))
    both = starts.select("name", "x", "b", F.lit(None).cast("long").alias("pin")).unionByName(p.where("at IS NOT NULL").select("name", F.col("at").cast("long").alias("x"), F.lit(None).cast(starts.schema["b"].dataType).alias("b"), F.col("at").cast("long").alias("pin")))
    both = both.withColumn("range", F.floor(F.col("x") / width))
    ranges = both.groupBy("name", "range").agg(F.max(F.when(F.col("b").isNotNull(), F.struct("x", "b"))).alias("hi"), F.min(F.when(F.col("b").isNotNull(), F.struct("x", "b"))).alias("lo"))
    by_range = Window.partitionBy("name").orderBy("range")
    ranges = ranges.select("name", "range", F.last("hi", True).over(by_range.rowsBetween(Window.unboundedPreceding, -1)).alias("hi"), F.first("lo", True).over(by_range.rowsBetween(1, Window.unboundedFollowing)).alias("lo"))
    inside = Window.partitionBy("name", "range").orderBy("x", F.col("pin").isNotNull())
    s = F.when(F.col("b").isNotNull(), F.struct("x", "b"))
    both = both.withColumn("before", F.last(s, True).over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("after", F.first(s, True).over(inside.rowsBetween(0, Window.unboundedFollowing))).where("pin IS NOT NULL")
    near = both.join(ranges, ["name", "range"]).select("name", F.col("pin").alias("at"), F.array(F.coalesce("before", "hi"), F.coalesce("after", "lo")).alias("c"))
    nearest = F.array_min(F.transform(F.filter("c", lambda c: c.isNotNull()), lambda c: F.struct(F.abs(c["x"] - F.col("at")).alias("far"), c["b"].alias("b"))))
    near = near.select("name", "at", nearest["b"].alias("near"))
    # where a pin has no line, or no definition has one
    first = d.groupBy("name").agg(F.min(place).alias("first"))
    got = p.join(first, "name").join(holding, ["name", "at"], "left").join(near, ["name", "at"], "left")
    return got.select("name", "at", F.coalesce("held", "near", "first")["id"].alias("id"))


def nearest_package(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """(file, package): of the manifests (folder, package, rank) the one of the highest rank, then in the nearest folder above the file, with the folders between; else the last part of the file's folder."""
    folder = paths.dirname(F.col("file"))
    f = files.select("file").distinct().withColumn("own", folder)
    up = f.select("file", "own", F.explode(F.array_distinct(F.concat(paths.ancestors(F.col("own")), F.array(F.lit(""))))).alias("folder"))
    if "rank" not in manifests.columns:
        manifests = manifests.withColumn("rank", F.lit(0))
    one = manifests.groupBy("folder", "rank").agg(F.min("package").alias("package"))
    best = up.join(one, "folder").groupBy("file").agg(F.max(F.struct("rank", F.length("folder").alias("n"), "folder", "package")).alias("b"))
    j = f.join(best, "file", "left")
    start = F.when(F.col("b.n") > 0, F.col("b.n") + 2).otherwise(1)
    below = F.substring(F.col("own"), start, F.length("own"))
    named = F.when(below == "", F.col("b.package")).otherwise(F.concat("b.package", F.lit("/"), below))
    return j.select("file", F.coalesce(named, paths.basename(F.col("own"))).alias("package"))
