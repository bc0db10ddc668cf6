import pytest
from pyspark.sql import functions as F

from symgraph.functions import names, paths, text
from symgraph.operators import explore
from symgraph.sources import imports


def values(spark, rows, f):
    return [r[0] for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string").orderBy("i").select(f(F.col("x"))).collect()]


def test_tails(spark):
    x = ["util.greet", "a/b#c", "pkg@v1", "plain", "ends.", " x.y ", ""]
    assert values(spark, x, names.name_tail) == ["greet", "c", "v1", "plain", "ends.", "y", ""]
    assert values(spark, ["a/b", "a.b/c"], names.ref_tail) == ["a/b", "b/c"]


def test_segments_and_scores(spark):
    assert values(spark, ["getUserName", "XMLHttpRequest", "snake_case-kebab.dot", "", None], names.segments) == [["get", "user", "name"], ["xml", "http", "request"], ["snake", "case", "kebab", "dot"], [], None]

    def score(q, n):
        return spark.range(1).select(names.fuzzy_score(F.array(*map(F.lit, q)), F.array(*map(F.lit, n)))).first()[0]

    assert score(["get", "user"], ["get", "user"]) == 10 + 15 + 20
    assert score(["get", "user"], ["get", "the", "user"]) == 25
    assert score(["user"], ["get", "user"]) == 10
    assert score(["user", "get"], ["get", "user"]) == 0


def test_distance_is_bounded(spark):
    rows = [("kitten", "sitting", 3), ("ab", "ba", 2), ("", "abc", 3), ("same", "same", 0), ("abcdefgh", "x", 4)]
    got = spark.createDataFrame(rows, "a string, b string, d int").select(names.bounded_distance(F.col("a"), F.col("b"), 3).alias("g"), "d").collect()
    assert all(r["g"] == r["d"] for r in got)


def test_names_and_words(spark):
    assert values(spark, ["user-card-v2", "one", ""], names.kebab_to_pascal) == ["UserCardV2", "One", ""]
    assert values(spark, ["setState", "app.emit", "x#on", "save", " "], names.is_noisy) == [True, True, True, False, True]
    assert values(spark, ["foo bar", "xfoo", "food foo", "(foo)", "none"], lambda c: names.has_whole_word(c, "foo")) == [True, False, False, True, False]


def test_paths(spark):
    x = ["a/b.test.ts", "tests/x.rs", "a/FooTest.java", "latest/x.go", "a/b_test.go", "src/contest.py"]
    assert values(spark, x, paths.is_test) == [True, True, True, False, True, False]
    assert values(spark, ["a.pb.go", "x/mock_y.go", "api_pb2.py", "a.min.js", "main.go", "FooGrpc.java"], paths.is_generated) == [True] * 4 + [False, True]
    assert values(spark, ["a.GO", "x.tsx", "Makefile", "a.b/c"], paths.language) == ["go", "typescript", None, None]
    assert values(spark, ["a/node_modules/x.js", "src/build.go", "build/x.go", "my-go/pkg/a.go", "x/go/pkg/a.go"], paths.is_skipped) == [True, False, True, False, True]
    assert values(spark, ["src/a/b.ts", "src/b.ts", "b.ts"], lambda c: c.rlike(paths.glob_regex("src/**/*.ts"))) == [True, True, False]
    assert values(spark, ["a/b/c", "x"], paths.ancestors) == [["a", "a/b", "a/b/c"], ["x"]]
    assert values(spark, ["src/util/a.go", "src/xa.go", "lib/a.go"], lambda c: paths.matches_hint(c, "util/a.go")) == [True, False, True]


def test_bodies_are_cut_at_lines_and_characters(spark):
    assert text.cut_utf8("é".encode() * 10, 5) == "éé".encode()
    assert text.cut_utf8(b"x" * 80 + b"\n" + b"y" * 50, 100) == b"x" * 80
    got = values(spark, ["short", "é" * 5000, None], text.stored_body)
    assert got[0] == "short" and got[1] == "é" * 4000 + text.CUT_MARK and got[2] is None
    assert text.blank_literals('a("x // y") // z\nb') == 'a(        )     \nb'
    assert text.strip_json_comments('{"a": "//x", // c\n "b": [1,],}') == '{"a": "//x", \n "b": [1]}'


def test_question_tokens():
    assert explore.question_tokens("How does Foo.bar call main.go, (x) foo.BAR") == ["How", "does", "Foo.bar", "call", "main"]


def test_budget_and_packing():
    b = explore.budget(100)
    packed = explore.pack([("a", "line\n" * 5000, True), ("b", "z\n" * 3000, False), ("c", "q\n" * 3000, False), ("d", "q", False), ("e", "q", False)], b)
    assert [f for f, _ in packed] == ["a", "b"] and len(packed[0][1]) <= 2.5 * b.per_file and sum(len(t) for _, t in packed) <= b.most_chars


@pytest.mark.parametrize(
    ("file", "spec", "language", "hit"),
    [
        ("src/a.ts", "./util", "typescript", "src/util.ts"),
        ("src/a.ts", "@/lib/x", "typescript", "src/lib/x.ts"),
        ("src/a.ts", "@org/kit/deep", "typescript", "packages/kit/src/deep.ts"),
        ("a/b/c.py", "..x.y", "python", "a/x/y.py"),
        ("m.py", "pkg", "python", "pkg/__init__.py"),
        ("cmd/m.go", "example.com/app/pkga", "go", "pkga/*"),
        ("cmd/m.go", "example.com/lib/z", "go", "vendored/lib/z/*"),
        ("crates/app/src/main.rs", "core_kit::thing::Name", "rust", "crates/core-kit/src/thing.rs"),
        ("crates/app/src/main.rs", "crate::m", "rust", "crates/app/src/m.rs"),
    ],
)
def test_import_candidates(file, spec, language, hit):
    m = imports.parse_manifests(
        [
            ("tsconfig.json", '{"compilerOptions": {"paths": {"@/*": ["src/*"],}} /* all */}'),
            ("packages/kit/package.json", '{"name": "@org/kit"}'),
            ("go.mod", "module example.com/app\n\nreplace example.com/lib => ./vendored/lib\n"),
            ("crates/core-kit/Cargo.toml", '[package]\nname = "core-kit"\n'),
            ("crates/app/Cargo.toml", '[package]\nversion = "1"\nname = "app"\n'),
            ("broken/package.json", "{"),
        ]
    )
    assert hit in imports.candidates(file, spec, language, m)


def test_specs_that_leave_the_root():
    assert imports.candidates("a.ts", "../../x", "typescript", imports.Manifests()) == []
