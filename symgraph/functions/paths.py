"""Paths as columns: parts of a path, languages, and kinds of file told by path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LANGUAGES = {
    "astro": "astro", "c": "c h", "cpp": "cc cpp cxx hpp hxx", "csharp": "cs", "dart": "dart", "go": "go", "java": "java", "javascript": "cjs js jsx mjs",
    "kotlin": "kt kts", "liquid": "liquid", "lua": "lua", "luau": "luau", "objective-c": "m mm", "pascal": "dpk dpr lpr pas", "php": "php", "python": "py",
    "r": "r", "ruby": "rb", "rust": "rs", "scala": "scala", "svelte": "svelte", "swift": "swift", "typescript": "ts tsx", "vue": "vue",
}
EXTENSION_LANGUAGE = {x: lang for lang, xs in LANGUAGES.items() for x in xs.split()}

SKIPPED_DIRS = sorted(
    ".android .bundle .cache .cargo .dartServer .eggs .git .gradle .idea .mypy_cache .next .npm .nuxt .nvm .pub-cache .pytest_cache .ruff_cache .rustup .symgraph .terraform .tox "
    ".turbo .venv .yarn Carthage DerivedData Pods __pycache__ bower_components build coverage dist node_modules out site-packages target vendor venv".split()
)
SKIPPED_FRAGMENTS = sorted("/.cargo/git/ /.cargo/registry/ /.local/lib/ /.local/share/ /AppData/Local/Go/ /AppData/Local/npm-cache/ /Library/Caches/ /code_references/ /gopath/pkg/ /gopath/src/golang.org/".split())
PROJECT_MARKERS = sorted(
    "CMakeLists.txt Cargo.lock Cargo.toml Gemfile Makefile Package.swift Pipfile .git build.gradle build.gradle.kts build.sbt composer.json go.mod mix.exs package.json pnpm-workspace.yaml pom.xml pyproject.toml requirements.txt setup.py".split()
)

#: Endings of the names of generated files, by what makes them.
_GENERATED = {
    "go": r"(\.pb|\.pulsar|_mocks?)\.go$|^mock_[^/]+\.go$",
    "script": r"\.gen(erated)?\.[jt]sx?$|[._]pb\.[jt]s$|_grpc_pb\.[jt]s$|\.min\.m?js$",
    "python": r"_pb2(_grpc)?\.py$|_pb2\.pyi$",
    "others": r"\.pb\.(cc|h|rs|swift)$|\.grpc\.swift$|\.g\.(cs|dart)$|Grpc\.(cs|java)$|OuterClass\.java$|_pb\.rb$|_grpc\.kt$",
}
GENERATED = "|".join(_GENERATED.values())
TEST_DIR = r"(^|/)(__tests__|tests?)(/|$)"
TEST_NAME = r"(^|/)([^/]*_test\.(go|py)|test_[^/]*\.py|[^/]*\.(spec|test)\.[jt]sx?|[^/]*Tests?\.(cs|java))$"
LOW_VALUE_NAME = r"(_test\.|\.test\.|\.spec\.|_spec\.go$|test\.java$)"
LOW_VALUE_DIR = r"/(__tests__|testdata|fixtures|mocks)/"


def dirname(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def relative_to(path: Column, root: str) -> Column:
    """path from root on; as it is where it isn't below root."""
    r = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(r)), F.substring(path, len(r) + 1, 1 << 30)).otherwise(path)


def language(path: Column) -> Column:
    """By extension; null where it is none we know."""
    table = F.create_map(*(F.lit(x) for kv in EXTENSION_LANGUAGE.items() for x in kv))
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def is_generated(path: Column) -> Column:
    return basename(path).rlike(GENERATED)


def is_test(path: Column, pattern: str | None = None) -> Column:
    """In a folder of tests, or named like one. pattern: a glob that decides alone, on the path or its last part."""
    if pattern:
        r = glob_regex(pattern)
        return path.rlike(r) | basename(path).rlike(r)
    return path.rlike(TEST_DIR) | path.rlike(TEST_NAME)


def is_low_value(path: Column) -> Column:
    p = F.lower(path)
    return basename(p).rlike(LOW_VALUE_NAME) | p.rlike(LOW_VALUE_DIR)


def is_skipped(path: Column) -> Column:
    """Whether a file lies in a tree of caches, builds or toolchains."""
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    named = F.arrays_overlap(folders, F.array(*map(F.lit, SKIPPED_DIRS)))
    rooted = F.concat(F.lit("/"), path)
    parts = F.concat(*(F.lit("|".join(f.replace(".", r"\.") for f in SKIPPED_FRAGMENTS)),))
    return named | F.regexp_like(rooted, parts) | rooted.rlike("/go/(pkg|bin|src)/")


def below(path: Column, prefix: str) -> Column:
    p = prefix.rstrip("/")
    return (path == p) | F.startswith(path, F.lit(p + "/"))


def children_of(path: Column, folder: str) -> Column:
    return dirname(path) == folder.rstrip("/")


def glob_regex(glob: str) -> str:
    """* and ? stay within a part of the path, ** doesn't."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            inner = glob[i + 1 : end]
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]", end + 1
            continue
        out += {"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if not c.isalnum() and c not in "_/" else c)
        i += 1
    return f"^{out}$"


def matches_glob(path: Column, glob: str) -> Column:
    r = glob_regex(glob)
    return path.rlike(r) | basename(path).rlike(r)


def matches_hint(path: Column, hint: str) -> Column:
    """The file that a hint names: the whole path, its end from a part on, or its last part."""
    p, h = F.lower(path), hint.lower().lstrip("/")
    return (p == h) | F.endswith(p, F.lit("/" + h)) | (basename(p) == h.rsplit("/", 1)[-1])


def ancestors(path: Column) -> Column:
    """path and every prefix of it that ends before a /."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def matches_spec(path: Column, spec: Column) -> Column:
    """Whether spec is one or more whole parts of path (its extension aside)."""
    bare = F.regexp_replace(path, r"\.[^./]*$", "")
    inside = lambda p: F.contains(F.concat(F.lit("/"), p, F.lit("/")), F.concat(F.lit("/"), spec, F.lit("/")))
    return (spec != "") & (inside(path) | inside(bare))


def addon_root(path: Column) -> Column:
    """The folder below /addons/; empty where there is none."""
    return F.regexp_extract(path, "/addons/([^/]+)/", 1)
