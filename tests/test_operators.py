import pytest
from pyspark.sql import functions as F

from symgraph.operators import explore, graph, linking, resolve, search, store

NODES = "id long, kind string, name string, file string, line long, end_line long"


def chain(spark):
    nodes = spark.createDataFrame([(1, "function", "main", "main.go", 1, 3), (2, "function", "foo", "foo.go", 1, 3), (3, "function", "bar", "bar.go", 1, 3)], NODES)
    edges = spark.createDataFrame([(1, 2, "calls"), (2, 3, "calls"), (3, 1, "contains")], "source_id long, target_id long, kind string")
    return nodes, edges


def test_a_chain(spark):
    nodes, edges = chain(spark)
    ask = lambda n: nodes.where(F.col("name") == n)
    assert [r["name"] for r in graph.callers(nodes, edges, ask("foo")).collect()] == ["main"]
    assert [r["name"] for r in graph.callees(nodes, edges, ask("foo")).collect()] == ["bar"]
    assert {tuple(r) for r in graph.impact(nodes, edges, ask("bar"), 3).collect()} == {("foo.go", 1, 1), ("main.go", 1, 2)}
    assert {tuple(r) for r in graph.file_dependents(nodes, edges).collect()} == {("foo.go", "main.go"), ("bar.go", "foo.go")}
    assert {tuple(r) for r in graph.flow_paths(edges, nodes.select("id")).collect()} == {(1, 3, 2), (2, 3, 1)}


def test_cycles_end(spark):
    nodes, _ = chain(spark)
    edges = spark.createDataFrame([(1, 2, "calls"), (2, 1, "calls"), (1, 1, "calls")], "source_id long, target_id long, kind string")
    assert {tuple(r) for r in graph.impact(nodes, edges, nodes.where("id = 1"), 5).collect()} == {("foo.go", 2 - 1, 1), ("main.go", 2, 1)}


def test_one_unnamed_hop_but_not_two(spark):
    edges = spark.createDataFrame([(1, 2, "calls"), (2, 3, "calls"), (3, 4, "calls"), (4, 5, "calls"), (5, 6, "calls")], "source_id long, target_id long, kind string")
    named = spark.createDataFrame([(1,), (3,), (6,)], "id long")
    assert {tuple(r) for r in graph.flow_paths(edges, named).collect()} == {(1, 3, 2)}


def test_affected_tests(spark):
    """A chain p0 <- p1 <- ... <- p6 of packages: five levels are visited, the tests beside each visited file count, those beyond don't."""
    files = [f"p{i}/x{i}.go" for i in range(7)] + ["p0/x0_test.go", "p2/side_test.go", "p4/x4_test.go", "p5/x5_test.go", "q/q_test.go"]
    packages = spark.createDataFrame([(f, "m/" + f.split("/")[0]) for f in files], "file string, package string")
    imports = spark.createDataFrame([(f"p{i + 1}/x{i + 1}.go", f"m/p{i}") for i in range(6)] + [("q/q_test.go", "m/p1/sub")], "file string, name string")
    changed = spark.createDataFrame([("p0/x0.go",)], "file string")
    assert {tuple(r) for r in graph.affected(imports, packages, changed).collect()} == {("p0/x0_test.go", 0), ("p2/side_test.go", 2), ("p4/x4_test.go", 4), ("q/q_test.go", 2)}
    assert {r["file"] for r in graph.affected(imports, packages, changed, depth=1).collect()} == {"p0/x0_test.go"}


def test_importers_need_whole_parts(spark):
    i = spark.createDataFrame([("a", "x/pkg"), ("b", "x/pkg/sub"), ("c", "x/pkg_util"), ("d", "x/pkgXutil")], "file string, name string")
    p = spark.createDataFrame([("x/pkg",)], "package string")
    assert {r["file"] for r in graph.importers(i, p).collect()} == {"a", "b"}


def test_enclosing_takes_the_innermost(spark):
    nodes = spark.createDataFrame([(1, "class", "A", "f", 1, 1000), (2, "method", "m", "f", 10, 20), (3, "function", "open", "f", 500, None)], NODES)
    places = spark.createDataFrame([("f", 15), ("f", 21), ("f", 600), ("g", 1), ("f", 0), ("f", None)], "file string, at long")
    got = {(r["file"], r["at"]): r["symbol"] for r in graph.enclosing(nodes, places).collect()}
    assert got == {("f", 15): 2, ("f", 21): 1, ("f", 600): 3, ("g", 1): None, ("f", 0): None, ("f", None): None}


def refs(spark, *rows):
    return spark.createDataFrame(rows, "from_node long, name string, kind string, file string")


def test_resolution_by_place(spark):
    nodes = spark.createDataFrame([(1, "function", "run", "a/m.go", 1, 2), (2, "function", "help", "a/h.go", 1, 2), (3, "function", "help", "z/h.go", 1, 2), (4, "function", "far", "q/r/s.go", 1, 2)], NODES)
    got = {r["name"]: (r["target_id"], r["provenance"]) for r in resolve.resolve(refs(spark, (1, "help", "calls", "a/m.go"), (1, "pkg.help", "references", "a/m.go"), (1, "far", "calls", "a/m.go"), (1, "none", "calls", "a/m.go"), (1, "run", "calls", "a/m.go")), nodes).collect()}
    assert got == {"help": (2, "proximity"), "pkg.help": (2, "proximity"), "far": (None, None), "none": (None, None), "run": (None, None)}
    closure = spark.createDataFrame([("a/m.go", "q/r/s.go")], "file string, target_file string")
    assert resolve.resolve(refs(spark, (1, "far", "calls", "a/m.go")), nodes, closure).first()["provenance"] == "import"


def test_crowded_names_only_hit_their_own_file(spark):
    nodes = spark.createDataFrame([(i, "function", "get", f"d/f{i}.go", 1, 2) for i in range(100)] + [(500, "function", "main", "d/f7.go", 9, 9), (501, "function", "main", "d/none.go", 9, 9)], NODES)
    got = {r["from_node"]: r["target_id"] for r in resolve.resolve(refs(spark, (500, "get", "calls", "d/f7.go"), (501, "get", "calls", "d/none.go")), nodes).collect()}
    assert got == {500: 7, 501: None}


def test_retry_and_scrub(spark):
    nodes = spark.createDataFrame([(1, "function", "later", "x.go", 1, 2)], NODES)
    r = refs(spark, (9, "later", "calls", "y.go"), (9, "app.emit", "calls", "y.go"), (9, "gone", "calls", "y.go")).withColumn("target_id", F.lit(None).cast("long"))
    assert [x["name"] for x in resolve.retried(r, nodes).collect()] == ["later"]
    assert {x["name"] for x in resolve.scrubbed(r, nodes).collect()} == {"later", "gone"}


def test_channels_are_capped_before_they_meet(spark):
    rows = lambda n, base: spark.createDataFrame([("c", base + i) for i in range(n)] + [("d", base + 90)], "channel string, id long")
    got = linking.channel_edges(rows(7, 0), rows(2, 100)).collect()
    assert {tuple(r) for r in got} == {(90, 190, "d")}


def test_upsert_cascade_and_changes(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, n int")
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, None, 1)], "k int, v string, n int")
    assert {tuple(r) for r in store.upsert(old, new, ["k"], [-F.col("n")]).collect()} == {(1, "a", 1), (2, "d", 3), (3, None, 1)}
    nodes, edges = chain(spark)
    left = store.cascade_delete(nodes, edges, refs(spark, (2, "x", "calls", "f")), spark.createDataFrame([("foo.go",)], "file string"))
    assert [df.count() for df in left] == [2, 1, 0]
    snapshot = lambda *rows: spark.createDataFrame(rows, "path string, size long, content_hash string")
    got = store.changes(snapshot(("a", 1, "h"), ("b", 1, "h"), ("c", 1, "h")), snapshot(("a", 1, "h"), ("b", 1, "g"), ("d", 1, "h")))
    assert {tuple(r) for r in got.collect()} == {("b", "changed"), ("c", "removed"), ("d", "added")}


def test_snapshots(spark, tmp_path):
    nodes, edges = chain(spark)
    store.save_snapshot(spark, str(tmp_path / "s"), {"nodes": nodes, "edges": edges})
    assert store.load_snapshot(spark, str(tmp_path / "s"), ["nodes"])["nodes"].count() == 3
    assert store.load_snapshot(spark, str(tmp_path / "none"), ["nodes"]) is None
    assert store.evolve(nodes, NODES + ", extra string", spark).columns[-1] == "extra"


def test_search(spark):
    d = spark.createDataFrame([(1, "UserService handles user_id"), (2, "auth helper\nfoo_bar x"), (3, None), (4, ""), (5, "user user service")], "id long, text string")
    assert [r["id"] for r in search.bm25(d, "user service").collect()] == [5]
    assert {r["id"] for r in search.matching(d, "user*").collect()} == {1, 5}
    assert [r["id"] for r in search.matching(d, "foo_bar").collect()] == [2] and search.matching(d, "  ").count() == 0
    f = d.withColumnRenamed("id", "file")
    assert [(r["file"], r["line"]) for r in search.scan(f, "^foo").collect()] == [(2, 2)]
    assert [(r["file"], r["n"]) for r in search.scan_counts(f, "user").collect()] == [(5, 1)]


def test_all_candidates_of_a_crowded_name_are_scored(spark):
    nodes = spark.createDataFrame([(i, "function", "get", f"d/f{i}.go", 1, 2) for i in range(100)] + [(200, "function", "get", "e/g.go", 1, 2), (500, "function", "main", "d/none.go", 9, 9), (501, "function", "main", "e/x/y/none.go", 9, 9)], NODES)
    r = refs(spark, (500, "get", "calls", "d/none.go"), (501, "a.get", "calls", "e/x/y/none.go"), (0, "get", "calls", "d/f0.go"), (None, "get", "calls", "d/f3.go"))
    got = {x["from_node"]: (x["target_id"], x["provenance"]) for x in resolve.resolve(r, nodes, ceiling=None).collect()}
    assert got == {500: (0, "proximity"), 501: (None, None), 0: (1, "proximity"), None: (None, None)}


def _resolved_in_full(refs, nodes, closure, ceiling):
    """Every reference with every candidate, in plain Python."""
    folder = lambda p: p.rpartition("/")[0]
    out = {}
    for f, name, kind, file in refs:
        ks = {name, name.rsplit(".", 1)[-1]}
        cand = [n for n in nodes if n[2] in ks and n[0] != f]
        crowded, calling = ceiling is not None and len(cand) > ceiling, kind in resolve.CALLING
        if crowded:
            cand = [n for n in cand if n[3] == file and (not calling or n[1] in resolve.CALLABLE)]
        rows = []
        for i, k, nm, at, line, _ in cand:
            same, beside, near = at == file, folder(at) == folder(file), folder(at) == folder(folder(file)) or folder(folder(at)) == folder(folder(file))
            score = (100 if same else 50 if beside else 20 if near else 0) + (5 if k in ("function", "method") else 3 if k == "route" else 0) + 2 * (nm == name)
            score = 100 if crowded else score
            rows.append(((-score, at, line, k, nm, i), score > 0 and not (calling and k in ("file", "module")), "exact" if same else "proximity" if beside or near else "heuristic", (file, at) in closure))

        def best(rows, weigh):
            b = min((r for r in rows if r[1]), default=None)
            return b if b and not (weigh and calling and len(rows) > 1 and -b[0][0] < 5) else None

        lone = [n for n in cand if n[1] in resolve.CALLABLE]
        got = None
        if b := best([r for r in rows if r[3]], True):
            got = (b[0][5], "import")
        elif (b := best(rows, True)) and not (calling and b[2] == "heuristic"):
            got = (b[0][5], b[2])
        elif calling and len(lone) == 1 and not crowded:
            at = lone[0][3]
            got = (lone[0][0], "import") if (file, at) in closure else (lone[0][0], "heuristic") if folder(file) in (folder(at), folder(folder(at))) else None
        out[f, name, kind, file] = got or (None, None)
    return out


def test_resolution_as_of_all_pairs(spark):
    import random

    r = random.Random(5)
    files = [f"{d}f{i}.go" for d in ("", "a/", "a/b/", "a/c/", "a/b/d/", "z/y/") for i in range(3)]
    kinds = ["function", "method", "struct", "class", "variable", "file", "module", "route"]
    nodes = [(i, r.choice(kinds), r.choice(["run", "get", "x.get", "solo"] if i else ["once"]), r.choice(files), r.randrange(1, 6), 9) for i in range(60)] + [(90, "struct", "once", "a/b/d/f0.go", 1, 2), (91, "struct", "far", "z/y/f1.go", 1, 2)]
    asked = sorted({(r.choice([n[0] for n in nodes]), r.choice(["run", "get", "x.get", "q.run", "solo", "once", "far", "none"]), r.choice(["calls", "type", "bridge"]), r.choice(files)) for _ in range(300)})
    closure = {(r.choice(files), r.choice(files)) for _ in range(25)} | {("a/f0.go", "z/y/f1.go")}
    n, c = spark.createDataFrame(nodes, NODES), spark.createDataFrame(sorted(closure), "file string, target_file string")
    for reach, ceiling in ((closure, None), (closure, 8), (set(), None), (set(), 8)):
        got = resolve.resolve(refs(spark, *asked), n, c if reach else None, ceiling=ceiling).collect()
        assert {tuple(x)[:4]: tuple(x)[4:] for x in got} == _resolved_in_full(asked, nodes, reach, ceiling)


@pytest.fixture
def plain(spark):
    """Plans as they are made: their nodes can be asked for rows."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.enabled")


def most_joined(df):
    """The most rows that a join of df gives."""
    df.collect()
    found, todo = [0], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        if "Join" in p.nodeName():
            found.append(p.metrics().apply("numOutputRows").value())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return max(found)


def test_no_call_meets_all_functions_of_its_name(plain):
    nodes = plain.createDataFrame([(i, "function", "run", f"{'abc'[i % 3]}/{i % 7}/f{i}.go", i, i) for i in range(300)] + [(900, "function", "run", "top.go", 1, 1)], NODES)
    rows = [(i, "run", f"{'abcd'[i % 4]}/{i % 9}/f{i}.go", f"c/{i % 7}/x.go") for i in range(300)] + [(900, "run", "a/x.go", None), (901, "run", "y.go", "b/1/f1.go"), (902, "none", "a/x.go", "a/x.go")]
    calls = plain.createDataFrame(rows, "call long, name string, caller_file string, registrar_file string")
    folder = lambda p: p.rpartition("/")[0]
    got = linking.callback_targets(calls, nodes)
    assert most_joined(got) < 5000
    want = {}
    places = sorted((r["file"], r["line"], r["id"]) for r in nodes.collect())
    for call, name, caller, registrar in rows:
        here, there = folder(caller), folder(registrar or "")
        if name == "run":
            want[call] = min((1 if f == caller else 2 if folder(f) == here else 3 if f == registrar else 4 if folder(f) == there else 10 if f.startswith(here + "/") else 100, f, line, i) for f, line, i in places)[3]
    assert {r["call"]: r["target_id"] for r in got.collect()} == want


def test_no_pin_meets_all_definitions_of_its_name(plain):
    import random

    r = random.Random(3)
    defs = [(i, "function", r.choice("ab"), f"f{r.randrange(9)}", r.choice([None, *[r.randrange(-50, 4000)] * 20]), 0) for i in range(400)]
    defs = [(i, k, n, f, x, None if x is None or i % 5 == 0 else x + r.choice([-1, 0, 3, 40, 1500])) for i, k, n, f, x, _ in defs] + [(990, "function", "c", "f2", None, None), (991, "function", "c", "f1", None, 7)]
    pins = {(r.choice("abcd"), r.randrange(-100, 6000)) for _ in range(400)} | {("a", None), ("c", 5), ("a", 5000)}
    got = graph.pinned(plain.createDataFrame(defs, NODES), plain.createDataFrame(sorted(pins, key=repr), "name string, at long"))
    assert most_joined(got) < 8000
    want = {}
    for name, at in pins:
        own = [(0 if x is not None and at is not None and x <= at <= (x if e is None else e) else 1, abs(x - at) if x is not None and at is not None else 1 << 40, f, -1 if x is None else x, i) for i, _, n, f, x, e in defs if n == name]
        if own:
            want[name, at] = min(own)[4]
    assert {(x["name"], x["at"]): x["id"] for x in got.collect()} == want


def test_tokens_meet_the_first_of_a_name(plain):
    nodes = plain.createDataFrame([(i, "function", "get", f"f{i:03}.go", 1, 2) for i in range(300)], NODES)
    tokens = plain.createDataFrame([(f"x{i}.get",) for i in range(200)], "token string")
    got = explore.token_hits(nodes, tokens)
    assert most_joined(got) <= 200 * explore.MOST_PER_TOKEN
    assert {(r["token"], r["id"]) for r in got.collect()} == {(f"x{i}.get", k) for i in range(200) for k in range(explore.MOST_PER_TOKEN)}


def test_lines_are_looked_up_once(plain):
    import random

    r = random.Random(4)
    nodes = [(i, "function", "n", f"f{i % 3}", x := r.randrange(2000), r.choice([None, x - 1, x, x + 10, x + 700])) for i in range(150)]
    places = [(f"f{r.randrange(4)}", r.randrange(2100), k) for k in range(300)] * 5
    got = graph.enclosing(plain.createDataFrame(nodes, NODES), plain.createDataFrame(places, "file string, at long, k long"), 9)
    want = {(f, at, k): max(((n[4], n[0]) for n in nodes if n[3] == f and n[4] <= at and (n[5] is None or at <= n[5])), default=(None, None))[1] for f, at, k in places}
    rows = got.collect()
    assert len(rows) == 1500 and got.columns == ["file", "at", "k", "symbol"] and {tuple(x)[:3]: x["symbol"] for x in rows} == want


def test_passes_take_the_partitions_they_need(plain):
    p = plain.createDataFrame([(1, 2, "calls", "b"), (1, 2, "calls", "a"), (3, 3, "calls", "a")], "source_id long, target_id long, kind string, made_by string")
    got = linking.first_pass_wins([p, p.withColumn("made_by", F.lit("A"))], 37)
    assert got.rdd.getNumPartitions() == 37 and [tuple(r) for r in got.collect()] == [(1, 2, "calls", "a")]


def test_the_first_places_of_a_symbol_stay(plain):
    """Callers of two symbols of one name count once; of the kinds at one place the least is given."""
    nodes = plain.createDataFrame([(1, "function", "f", "a", 1, 1), (2, "function", "f", "b", 1, 1)] + [(i, "route" if i % 2 else "method", f"c{i // 2:02}", "z", i // 2, 9) for i in range(10, 130)], NODES)
    edges = plain.createDataFrame([(i, t, "calls") for i in range(129, 9, -1) for t in (1, 2)] * 2, "source_id long, target_id long, kind string")
    got = graph.callers(nodes, edges, nodes.where("name = 'f'"), partitions=3).collect()
    assert sorted((r["symbol"], r["name"], r["kind"], r["line"]) for r in got) == [("f", f"c{i:02}", "method", i) for i in range(5, 45)]


def test_ways_that_lead_to_no_named_node_are_left_out(spark, monkeypatch):
    kept = {}
    real = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name: kept.setdefault(name, real(df, name)) if name == "flow-edges" else real(df, name))
    edges = spark.createDataFrame([(1, 2, "calls"), (2, 3, "calls"), *((k, 100 + i, "calls") for i in range(50) for k in (1, 3)), (100, 200, "calls")] * 2, "source_id long, target_id long, kind string")
    assert {tuple(r) for r in graph.flow_paths(edges, spark.createDataFrame([(1,), (3,)], "id long")).collect()} == {(1, 3, 2)}
    assert {tuple(r) for r in kept["flow-edges"].collect()} == {(1, 2, False), (2, 3, True)}


def test_refs_are_taken_in_one_pass(plain):
    nodes = plain.createDataFrame([(1, "function", "get", "x.go", 1, 2), (2, "function", "other", "y.go", 1, 2)], NODES)
    r = refs(plain, (5, "a.get", "calls", "k.go"), (6, "get", "calls", "x.go"), (7, "other", "calls", "x.go"), (8, "other", "calls", "k.go"), (9, None, "calls", "k.go"), *[(5, "a.get", "calls", "k.go")] * 3)
    got = resolve.refs_to_retry(r, nodes, nodes.where("file = 'x.go'"))
    assert sorted(x["from_node"] for x in got.collect()) == [5, 6, 7]
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_files_are_joined_by_number(plain):
    nodes, edges = chain(plain)
    got = graph.file_edges(nodes, edges.union(edges))
    assert {tuple(r) for r in got.collect()} == {("main.go", "foo.go"), ("foo.go", "bar.go")} and got.count() == 2
    shuffled = [x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(source_id" in x or "Exchange hashpartitioning(target_id" in x]
    assert not any("file" in x for x in shuffled)
