"""Edges that no name says: events, callbacks, tags, routes; and the longest-prefix join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from .graph import top

EVENT_FANOUT = 6
CALLBACKS = 40
TAGS = 30


def channel_edges(emitters: DataFrame, handlers: DataFrame, most: int = EVENT_FANOUT) -> DataFrame:
    """(source_id, target_id, channel) for (channel, id) rows: every emitter with every handler of its channel, unless either side has more than `most`.

    The cap is applied to the sets, before the join: a crowded channel is never multiplied out."""
    sides = []
    for df, name in ((emitters, "source_id"), (handlers, "target_id")):
        d = df.select("channel", F.col("id").alias(name)).distinct()
        small = d.groupBy("channel").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("channel")
        sides.append(d.join(small, "channel"))
    return sides[0].join(sides[1], "channel").where("source_id <> target_id").select("source_id", "target_id", "channel")


def field_channels(registrars: DataFrame, dispatchers: DataFrame) -> DataFrame:
    """(file, field, registrar, dispatcher): both keep callbacks in the same field of the same file."""
    r, d = registrars.select("file", "field", F.col("id").alias("registrar")), dispatchers.select("file", "field", F.col("id").alias("dispatcher"))
    return r.join(d, ["file", "field"])


def callback_targets(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """calls (call, name, caller_file, registrar_file) with target_id: the function of that name that is nearest to the caller (its file, folder, the registrar's file, folder, below), ties by place.

    Each name's first function is taken for every file, folder, tree and anywhere before calls look there, so no call meets all functions of its name."""
    first = F.struct(F.col("file").alias("t_file"), F.col("line").alias("t_line"), F.col("id").alias("id"))
    n = nodes.where(F.col("kind").isin("function", "method")).join(calls.select("name").distinct(), "name", "left_semi")
    files = n.groupBy("name", F.col("file").alias("path")).agg(F.min(first).alias("c"))
    own = paths.dirname(F.col("path"))
    trees = F.when(F.instr("path", "/") > 0, F.array_distinct(paths.ancestors(own)))
    spots = F.concat(
        F.array(F.struct(F.lit("file").alias("scope"), F.col("path").alias("path")), F.struct(F.lit("folder").alias("scope"), own.alias("path")), F.struct(F.lit("any").alias("scope"), F.lit("").alias("path"))),
        F.transform(F.coalesce(trees, F.array().cast("array<string>")), lambda p: F.struct(F.lit("below").alias("scope"), p.alias("path"))),
    )
    near = files.select("name", "c", F.explode(spots).alias("s")).groupBy("name", "s.scope", "s.path").agg(F.min("c").alias("c"))
    here, there = paths.dirname(F.col("caller_file")), paths.dirname(F.col("registrar_file"))
    ways = ((1, "file", F.col("caller_file")), (2, "folder", here), (3, "file", F.col("registrar_file")), (4, "folder", there), (10, "below", here), (100, "any", F.lit("")))
    look = calls.distinct().withColumn("w", F.explode(F.array(*(F.struct(F.lit(score).alias("score"), F.lit(scope).alias("scope"), path.alias("path")) for score, scope, path in ways))))
    got = look.select(*calls.columns, "w.score", "w.scope", "w.path").join(near, ["name", "scope", "path"])
    g = got.groupBy(*calls.columns).agg(F.min(F.struct("score", "c")).alias("b"))
    return g.select(*calls.columns, F.col("b.c.id").alias("target_id"))


def tag_edges(tags: DataFrame, nodes: DataFrame, most: int = TAGS) -> DataFrame:
    """(source_id, target_id, tag): callables (id, tag) to the first component, function or class of the tag's name, at most `most` for each."""
    rank = F.when(F.col("kind") == "component", 0).when(F.col("kind") == "function", 1).otherwise(2)
    best = nodes.where(F.col("kind").isin("class", "component", "function")).groupBy(F.col("name").alias("tag")).agg(F.min(F.struct(rank, "file", "line", "id")).alias("b"))
    e = tags.select(F.col("id").alias("source_id"), "tag").distinct().join(best, "tag").select("source_id", F.col("b.id").alias("target_id"), "tag").where("source_id <> target_id")
    return top(e, ["source_id"], ["tag"], most)


def first_pass_wins(passes: list[DataFrame], partitions: int | None = None) -> DataFrame:
    """(source_id, target_id, kind, made_by) of all passes, each edge once, from the earliest. partitions: how many the passes need."""
    out = None
    for k, p in enumerate(passes):
        one = p.select("source_id", "target_id", "kind", F.struct(F.lit(k).alias("k"), "made_by").alias("m")).where("source_id <> target_id")
        out = one if out is None else out.unionByName(one)
    if partitions:
        out = out.repartition(partitions, "source_id", "target_id")
    return out.groupBy("source_id", "target_id", "kind").agg(F.min("m").alias("m")).select("source_id", "target_id", "kind", F.col("m.made_by").alias("made_by"))


def longest_prefix(df: DataFrame, column: str, table: DataFrame) -> DataFrame:
    """df with prefix and target of the longest prefix (whole parts of a path) in table (prefix, target) that df's column has; null where it has none.

    Every ancestor is looked up by equality and the longest that hits is kept with the row: no nested loop, whatever the table's size."""
    key = df.select(column).distinct()
    each = key.select(column, F.explode(F.array_distinct(paths.ancestors(F.col(column)))).alias("prefix"))
    best = each.join(table, "prefix").groupBy(column).agg(F.max(F.struct(F.length("prefix").alias("n"), "prefix", "target")).alias("b"))
    return df.join(best.select(column, "b.prefix", "b.target"), column, "left")


def keyed_handlers(routes: DataFrame, methods: DataFrame) -> DataFrame:
    """(route_id, target_id) for routes (route_id, key, bare, addon) and methods (id, key, bare, file): methods that take the route's type, by its
    qualified name, else by its bare one; of several the only one, else the only one in a folder of controllers, else the only one of the route's addon, else none."""
    m = methods.select(F.col("id").alias("target_id"), F.col("key").alias("m_key"), F.col("bare").alias("m_bare"), F.col("file").alias("m_file"))
    full = routes.join(m, routes["key"] == m["m_key"]).select("route_id", "addon", "target_id", "m_file")
    rest = routes.join(full.select("route_id").distinct(), "route_id", "left_anti")
    both = full.unionByName(rest.join(m, rest["bare"] == m["m_bare"]).select("route_id", "addon", "target_id", "m_file")).distinct()
    ways = {"all": F.lit(True), "controller": F.col("m_file").rlike("(^|/)controllers?/"), "addon": (F.col("addon") != "") & (paths.addon_root(F.col("m_file")) == F.col("addon"))}
    g = both.groupBy("route_id").agg(*(F.count(F.when(c, 1)).alias(f"n_{k}") for k, c in ways.items()), *(F.min(F.when(c, F.col("target_id"))).alias(f"t_{k}") for k, c in ways.items()))
    one = F.coalesce(*(F.when(F.col(f"n_{k}") == 1, F.col(f"t_{k}")) for k in ways))
    return g.select("route_id", one.alias("target_id")).where("target_id IS NOT NULL")
