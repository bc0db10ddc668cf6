import pytest

from symgraph.operators import index
from symgraph.tools import Project

TREE = {
    "go.mod": "module example.com/app\n",
    "cmd/main.go": 'package main\n\nimport (\n\t"example.com/app/pkga"\n)\n\nfunc Run() {\n\tpkga.Helper()\n\tLocal()\n}\n\nfunc Local() {\n}\n',
    "pkga/a.go": "package pkga\n\nfunc Helper() {\n}\n",
    "pkga/a_test.go": "package pkga\n\nfunc TestHelper() {\n\tHelper()\n}\n",
    "web/tsconfig.json": '{"compilerOptions": {"paths": {"@/*": ["src/*"]}}}',
    "web/src/main.ts": "import { formatName } from '@/lib/utils'\n\nexport function run() {\n  return formatName('x')\n}\n",
    "web/src/lib/utils.ts": "export function formatName(n: string) {\n  return n\n}\n",
    "web/bus.js": "class Bus {\n  publish() {\n    this.emitter.emit('saved')\n  }\n}\nfunction onsaved() {\n}\nfunction wire(b) {\n  b.on('saved', onsaved)\n}\n",
    "web/scene.js": "class Scene {\n  onUpdate(cb) {\n    this.listeners.push(cb)\n  }\n  triggerUpdate() {\n    this.listeners.forEach(f => f())\n  }\n}\nfunction redraw() {\n}\nfunction start(s) {\n  s.onUpdate(redraw)\n}\n",
    "web/App.vue": '<template>\n  <div><user-card/></div>\n</template>\n<script>\nfunction load() {\n}\n</script>\n',
    "web/UserCard.vue": "<template><p>x</p></template>\n",
    "web/canvas.jsx": "class Canvas {\n  dirty() {\n    this.setState({})\n  }\n  render() {\n    return <Shape x=1 />\n  }\n}\nfunction Shape() {\n}\n",
    "api/app.py": "from .util import greet\n\n@app.get('/hello')\ndef hello():\n    return greet()\n",
    "api/util.py": "def greet():\n    return 1\n",
    "native/ops.c": "struct ops {\n  int (*f)(int);\n};\nint add_one(int x) {\n  return x + 1;\n}\nint setup(struct ops *o) {\n  struct ops k = { .f = add_one };\n  return 0;\n}\nint dispatch(struct ops *o) {\n  return o->f(1);\n}\n",
    "web/late.js": "import { bus } from './bus'\n\nfunction onReady() {\n}\nfunction onLater() {\n}\nfunction far() {\n" + ("  work('" + "x" * 70 + "')\n") * 300 + "  bus.emit('later')\n  bus.emit('ready')\n}\nbus.on('ready', onReady)\nbus.once('later', () => onLater())\n",
    "node_modules/x/skip.js": "function skipped() {\n}\n",
    "notes.txt": "no language",
}


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, content in TREE.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(content)
    (root / "api/latin.py").write_bytes("def caf\xe9():\n    return 1\n".encode("latin-1"))
    return root


@pytest.fixture(scope="module")
def tables(spark, tree):
    return index.build(index.scan(spark, str(tree)))


@pytest.fixture(scope="module")
def edges(tables):
    n = {r["id"]: r["name"] for r in tables["nodes"].collect()}
    return {(n[r["source_id"]], n[r["target_id"]], r["kind"], r["made_by"] or r["provenance"]) for r in tables["edges"].collect()}


def test_what_is_scanned(tables):
    assert {r["path"] for r in tables["files"].collect()} == set(TREE) - {"node_modules/x/skip.js", "notes.txt"} | {"api/latin.py"}


def test_bytes_that_are_no_utf8_stop_nothing(tables):
    (row,) = tables["files"].where("path = 'api/latin.py'").collect()
    assert row["content"] == "def caf\ufffd():\n    return 1\n"


def test_symbols(tables):
    got = {(r["kind"], r["qualified_name"], r["file"]) for r in tables["nodes"].collect() if r["kind"] not in ("file", "module")}
    for x in [("function", "Run", "cmd/main.go"), ("function", "formatName", "web/src/lib/utils.ts"), ("method", "Scene.triggerUpdate", "web/scene.js"), ("component", "UserCard", "web/UserCard.vue"), ("function", "load", "web/App.vue"), ("route", "GET /hello", "api/app.py"), ("struct", "ops", "native/ops.c"), ("function", "dispatch", "native/ops.c")]:
        assert x in got


def test_resolved_calls(edges):
    for x in [("Run", "Helper", "calls", "import"), ("Run", "Local", "calls", "exact"), ("run", "formatName", "calls", "import"), ("hello", "greet", "calls", "import"), ("GET /hello", "hello", "references", "exact"), ("App", "UserCard", "references", "proximity"), ("Scene", "triggerUpdate", "contains", "exact")]:
        assert x in edges


def test_inferred_calls(edges):
    # registered at the top level of a file, sent from beyond byte 8000 of a body
    for x in [("far", "onReady", "calls", "event-emitter"), ("far", "onLater", "calls", "event-emitter"), ("publish", "onsaved", "calls", "event-emitter"), ("triggerUpdate", "redraw", "calls", "callback"), ("dirty", "render", "calls", "react-render"), ("dispatch", "add_one", "calls", "fn-pointer-dispatch"), ("render", "Shape", "calls", "jsx-render")]:
        assert x in edges


def test_an_index_that_follows_changes_equals_a_new_one(spark, tree, tables):
    path = tree / "pkga/a.go"
    before = path.read_text()
    path.write_text(before + "\nfunc Extra() {\n\tHelper()\n}\n")
    try:
        files = index.scan(spark, str(tree))
        new, followed = index.build(files), index.build(files, tables["extracted"])
        for t in ("nodes", "edges", "refs"):
            assert sorted(map(str, new[t].collect())) == sorted(map(str, followed[t].collect()))
        assert new["nodes"].where("name = 'Extra'").count() == 1
    finally:
        path.write_text(before)


def test_the_nine_tools(spark, tables, tmp_path):
    p = Project(tables)
    assert [r["name"] for r in p.callers("Helper").collect()] == ["Run", "TestHelper"]
    assert {r["name"] for r in p.callees("Run").collect()} == {"Helper", "Local"}
    assert {r["file"] for r in p.impact("Helper").collect()} >= {"cmd/main.go"}
    assert [r["content"] for r in p.search("formatName").collect()][0] in ("formatName", "run")
    assert {r["file"] for r in p.search("emit\\(", glob="*.js").collect()} == {"web/bus.js", "web/late.js"}
    assert [r["path"] for r in p.files(glob="*.go").collect()] == ["cmd/main.go", "pkga/a.go", "pkga/a_test.go"]
    node = p.node("Helper").first()
    assert node["file"] == "pkga/a.go" and [x["n"] for x in node["callers"]] == ["Run", "TestHelper"] and node["callees"] is None
    assert [r["content"] for r in p.file("api/util.py", 2, 1).collect()] == ["    return 1"]
    assert [r["name"] for r in p.symbols("pkga/a.go").collect()] == ["Helper"]
    assert [r["dependent"] for r in p.dependents("pkga/a.go").collect()] == ["cmd/main.go", "pkga/a_test.go"]
    assert [r["file"] for r in p.affected(["pkga/a.go"]).collect()] == ["pkga/a_test.go"]
    assert p.status().first()["n_files"] == len(TREE) - 1
    assert "cmd/main.go" in {f for f, _ in p.explore("Run Helper")}
    p.save(str(tmp_path / "index"))
    again = Project.load(spark, str(tmp_path / "index"))
    assert [r["name"] for r in again.callers("Helper").collect()] == ["Run", "TestHelper"]


def test_files_are_spread_by_number(spark, monkeypatch):
    """Small files of one part are parsed in as many tasks as their number needs, and so are their imports."""
    tasks = {}
    for module in (index, index.imports):
        monkeypatch.setattr(module, "materialize", lambda df, name, real=module.materialize: tasks.setdefault(name, df.rdd.getNumPartitions()) and real(df, name))
    monkeypatch.setattr(index, "FILES_OF_TASK", 2)
    monkeypatch.setattr(index.imports, "IMPORTS_OF_TASK", 2)
    rows = [(f"p{i}/x.go", f'package p{i}\n\nimport (\n\t"m/p{i + 1}"\n)\n\nfunc F{i}() {{\n\tp{i + 1}.F{i + 1}()\n}}\n') for i in range(19)] + [("go.mod", "module m\n")]
    files = spark.createDataFrame(rows, "path string, content string").coalesce(1).selectExpr("path", "content", "CAST(length(content) AS BIGINT) AS size", "CAST(NULL AS TIMESTAMP) AS mtime", "sha2(content, 256) AS content_hash")
    got = index.build(files)
    assert tasks["files"] == 10 and tasks["candidates"] == 10
    assert got["edges"].where("kind = 'calls' AND provenance = 'import'").count() == 18
