"""Symbols, imports, calls, routes and bridges out of source files and pages.

What a regular expression can say stays in the JVM (pages). Source files go through Python in Arrow batches, one pass for each file; a
language is a table of expressions (register() adds one), blocks end by braces or by indentation, strings and comments are blanked first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.text import blank_literals

NATIVE_TAGS = frozenset(
    "a abbr address area article aside audio b base bdi bdo blockquote body br button canvas caption circle cite code col colgroup data datalist dd defs del details dfn dialog div dl dt ellipse em "
    "embed fieldset figcaption figure footer form g h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input ins kbd label legend li line link main map mark menu meta meter nav noscript "
    "object ol optgroup option output p param path picture polygon polyline pre progress q rect rp rt ruby s samp script search section select slot small source span strong style sub summary sup "
    "svg symbol table tbody td template text textarea tfoot th thead time title tr track tspan u ul use var video wbr".split()
)
BUILTIN_COMPONENTS = frozenset("Fragment KeepAlive RouterLink RouterView Slot Suspense Teleport Transition TransitionGroup".split())
KEYWORDS = frozenset(
    "and as assert async await break case catch class const continue def defer del delete do elif else enum except export extends finally fn for foreach from func function go if impl import in "
    "instanceof interface is let loop match new not or package panic pass pub raise range return select self sizeof static struct super switch throw throws trait try type typeof union unless until "
    "unsafe use using var void when where while with yield".split()
)
_CALL = re.compile(r"((?:[A-Za-z_$][\w$]*\s*(?:\.|::|->)\s*)*[A-Za-z_$][\w$]*)\s*\(", re.A)
MOST_LINES = 500
#: Made once: joining flags takes as long as a short search.
_BY_LINE = re.M | re.A


def tag_refs(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, tag, is_native, n): the tags that each page opens."""
    tags = pages.select(key, F.explode(F.regexp_extract_all(html, F.lit("<([A-Za-z][A-Za-z0-9-]*)"), 1)).alias("tag"))
    return tags.groupBy(key, "tag").agg(F.count("*").alias("n")).withColumn("is_native", F.lower("tag").isin(sorted(NATIVE_TAGS))).select(key, "tag", "is_native", "n")


def script_calls(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, callee, n): what the scripts of each page call."""
    scripts = pages.select(key, F.explode(F.regexp_extract_all(html, F.lit("(?s)<script[^>]*>(.*?)</script>"), 1)).alias("script"))
    calls = scripts.select(key, F.explode(F.regexp_extract_all("script", F.lit(r"([A-Za-z_$][A-Za-z0-9_$]*)\s*\("), 1)).alias("callee"))
    return calls.groupBy(key, "callee").agg(F.count("*").alias("n"))


def link_specs(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, spec): the targets of each page's links, each once."""
    return pages.select(key, F.explode(F.array_distinct(F.regexp_extract_all(html, F.lit('href="([^"#?]+)'), 1))).alias("spec"))


@dataclass(frozen=True)
class Language:
    """definitions: (kind, expression with the group `name`, and maybe `owner`); imports: expressions whose first group that matched is the spec."""

    definitions: list[tuple[str, str]]
    imports: list[str] = field(default_factory=list)
    by_indent: bool = False
    exported: str = r"[A-Za-z]"
    hash_comments: bool = False


_JS = Language(
    [
        ("class", r"^[ \t]*(?:export\s+(?:default\s+)?)?(?:abstract\s+)?class\s+(?P<name>[\w$]+)"),
        ("interface", r"^[ \t]*(?:export\s+)?interface\s+(?P<name>[\w$]+)"),
        ("type", r"^[ \t]*(?:export\s+)?type\s+(?P<name>[\w$]+)[^=\n]*="),
        ("function", r"^[ \t]*(?:export\s+(?:default\s+)?)?(?:async\s+)?function\s*\*?\s*(?P<name>[\w$]+)"),
        ("component", r"^[ \t]*(?:export\s+)?const\s+(?P<name>[A-Z][\w$]*)\s*(?::[^=\n]+)?=\s*(?:async\s*)?\([^)\n]*\)[^=\n]*=>"),
        ("function", r"^[ \t]*(?:export\s+)?(?:const|let|var)\s+(?P<name>[a-z_$][\w$]*)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^)\n]*\)|[\w$]+)[^=\n]*=>"),
        ("method", r"^[ \t]+(?:(?:public|private|protected|static|async|readonly|get|set)\s+)*(?P<name>[\w$]+)\s*\([^)\n]*\)\s*(?::[^{\n]+)?\{"),
    ],
    [r"""(?:^|;)[ \t]*(?:import|export)\b[^'"\n;]*['"]([^'"\n]+)['"]""", r"""\b(?:require|import)\(\s*['"]([^'"\n]+)['"]"""],
)
_C = Language(
    [("struct", r"^[ \t]*(?:typedef\s+)?struct\s+(?P<name>\w+)\s*\{"), ("class", r"^[ \t]*class\s+(?P<name>\w+)[^;{\n]*\{"), ("enum", r"^[ \t]*enum\s+(?:class\s+)?(?P<name>\w+)"), ("function", r"^(?:[A-Za-z_][\w:<>,*& \t]*[ \t*&])(?:(?P<owner>\w+)::)?(?P<name>~?\w+)[ \t]*\([^;{}]*\)[^;{}\n]*\{")],
    [r"^[ \t]*#[ \t]*include[ \t]*[<\"]([^>\"\n]+)[>\"]"],
)


def _classes(keyword_kinds: str, function: str, imports: list[str]) -> Language:
    kinds = [(k, rf"^[ \t]*(?:[\w@]+[ \t]+)*{k if k != 'type' else 'typealias'}\s+(?P<name>\w+)") for k in keyword_kinds.split()]
    return Language([*kinds, ("function", function)], imports)


_JVM_METHOD = r"^[ \t]*(?:(?:public|private|protected|internal|static|final|abstract|override|virtual|async|synchronized)\s+)+[\w<>\[\],.? \t]+?\s(?P<name>\w+)\s*\([^;{}]*\)[^;{}\n]*\{"
LANGUAGES: dict[str, Language] = {
    "go": Language(
        [("method", r"^func\s+\(\s*\w*\s*\*?(?P<owner>\w+)[^)]*\)\s*(?P<name>\w+)"), ("function", r"^func\s+(?P<name>\w+)"), ("struct", r"^type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+struct\b"), ("interface", r"^type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+interface\b"), ("type", r"^type\s+(?P<name>\w+)\s+(?!struct\b|interface\b)")],
        [r'^import\s+(?:[\w.]+\s+)?"([^"\n]+)"', r'^[ \t]+(?:[\w.]+\s+)?"([\w.\-/~]+)"[ \t]*$'],
        exported=r"[A-Z]",
    ),
    "python": Language([("class", r"^[ \t]*class\s+(?P<name>\w+)"), ("function", r"^[ \t]*(?:async\s+)?def\s+(?P<name>\w+)")], [r"^[ \t]*from\s+([.\w]+)\s+import\b", r"^[ \t]*import\s+([.\w]+)"], by_indent=True, exported=r"[^_]", hash_comments=True),
    "javascript": _JS,
    "typescript": _JS,
    "rust": Language(
        [("struct", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?struct\s+(?P<name>\w+)"), ("enum", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?enum\s+(?P<name>\w+)"), ("trait", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?trait\s+(?P<name>\w+)"), ("function", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*fn\s+(?P<name>\w+)")],
        [r"^[ \t]*(?:pub\s+)?use\s+([\w:]+)", r"^[ \t]*(?:pub\s+)?mod\s+(\w+)\s*;"],
    ),
    "c": _C,
    "cpp": _C,
    "java": _classes("class interface enum", _JVM_METHOD, [r"^[ \t]*import\s+(?:static\s+)?([\w.]+)"]),
    "csharp": _classes("class interface struct enum", _JVM_METHOD, [r"^[ \t]*using\s+(?:static\s+)?([\w.]+)\s*;"]),
    "kotlin": _classes("class interface", r"^[ \t]*(?:\w+\s+)*fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(?P<name>\w+)\s*\(", [r"^[ \t]*import\s+([\w.]+)"]),
    "scala": _classes("class trait", r"^[ \t]*(?:\w+\s+)*def\s+(?P<name>\w+)", [r"^[ \t]*import\s+([\w.]+)"]),
    "swift": _classes("class struct enum protocol", r"^[ \t]*(?:@?\w+\s+)*func\s+(?P<name>\w+)", [r"^[ \t]*import\s+([\w.]+)"]),
    "dart": _classes("class enum", r"^[ \t]*(?:[\w<>?]+\s+)+(?P<name>\w+)\s*\([^;{}]*\)\s*(?:async\s*)?\{", [r"""^[ \t]*import\s+['"]([^'"]+)['"]"""]),
    "php": _classes("class interface trait", r"^[ \t]*(?:(?:public|private|protected|static|abstract|final)\s+)*function\s+&?(?P<name>\w+)", [r"^[ \t]*use\s+([\w\\]+)", r"""\b(?:require|include)(?:_once)?\s*\(?\s*['"]([^'"]+)['"]"""]),
    "ruby": Language([("class", r"^[ \t]*class\s+(?P<name>\w+)"), ("module", r"^[ \t]*module\s+(?P<name>\w+)"), ("method", r"^[ \t]*def\s+(?:self\.)?(?P<name>\w+[?!]?)")], [r"""^[ \t]*require(?:_relative)?\s+['"]([^'"]+)['"]"""], by_indent=True, hash_comments=True),
    "lua": Language([("function", r"^[ \t]*(?:local\s+)?function\s+(?:(?P<owner>[\w.]+)[.:])?(?P<name>\w+)")], [r"""\brequire\s*\(?\s*['"]([^'"]+)['"]"""], by_indent=True),
    "r": Language([("function", r"^[ \t]*(?P<name>[\w.]+)\s*(?:<-|=)\s*function\b")], [r"""\b(?:library|require|source)\(\s*['"]?([^'")]+)"""], hash_comments=True),
    "objective-c": Language([("class", r"^@(?:interface|implementation)\s+(?P<name>\w+)"), ("protocol", r"^@protocol\s+(?P<name>\w+)"), ("method", r"^[-+]\s*\([^)]*\)\s*(?P<name>\w+)")], [r"^#(?:import|include)\s+[<\"]([^>\"]+)[>\"]"]),
    "pascal": Language([("unit", r"(?i)^[ \t]*unit\s+(?P<name>\w+)"), ("procedure", r"(?i)^[ \t]*(?:procedure|function)\s+(?:(?P<owner>\w+)\.)?(?P<name>\w+)")], [], by_indent=True),
    "liquid": Language([], [r"""\{%-?\s*(?:render|include|section)\s+['"]([^'"]+)['"]"""]),
}
LANGUAGES["luau"] = LANGUAGES["lua"]

_ROUTES: dict[str, list[str]] = {
    "go": [r'\.(?P<verb>GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS|Get|Post|Put|Patch|Delete|HandleFunc|Handle)\(\s*"(?P<path>/[^"\n]*)"\s*,\s*(?P<handler>[\w.]+)'],
    "javascript": [r"""\b(?:app|router|server)\.(?P<verb>get|post|put|patch|delete|all|use)\(\s*['"](?P<path>/[^'"\n]*)['"]\s*,\s*(?:[\w.]+\s*,\s*)*(?P<handler>[\w.]+)\s*\)""", r"""<Route\b[^>]*\bpath=['"](?P<path>[^'"\n]+)['"][^>]*(?:element=\{\s*<|component=\{\s*)(?P<handler>\w+)"""],
    "python": [r"""@[\w.]+\.(?P<verb>get|post|put|patch|delete|route)\(\s*['"](?P<path>/[^'"\n]*)['"][^\n]*\)\s*\n\s*(?:async\s+)?def\s+(?P<handler>\w+)""", r"""\bpath\(\s*['"](?P<path>[^'"\n]*)['"]\s*,\s*(?P<handler>[\w.]+)"""],
    "php": [r"""Route::(?P<verb>get|post|put|patch|delete|any)\(\s*['"](?P<path>[^'"\n]+)['"]\s*,\s*['"\[]*(?P<handler>[\w\\]+(?:@\w+)?)"""],
    "ruby": [r"""^[ \t]*(?P<verb>get|post|put|patch|delete)\s+['"](?P<path>[^'"\n]+)['"]\s*(?:,\s*to:|=>)\s*['"](?P<handler>[\w/#]+)"""],
    "java": [r"""@(?P<verb>Get|Post|Put|Patch|Delete|Request)Mapping\(\s*(?:value\s*=\s*)?"(?P<path>[^"\n]*)"[^)]*\)(?:\s*@[^\n]*\n)*\s*(?:[\w<>,\[\]]+\s+)+(?P<handler>\w+)\s*\("""],
    "csharp": [r"""\[Http(?P<verb>Get|Post|Put|Patch|Delete)\("(?P<path>[^"\n]*)"\)\](?:\s*\[[^\]]*\])*\s*(?:[\w<>,\[\]]+\s+)+(?P<handler>\w+)\s*\("""],
    "rust": [r"""#\[(?P<verb>get|post|put|patch|delete)\("(?P<path>[^"\n]*)"[^\]]*\)\]\s*(?:pub\s+)?(?:async\s+)?fn\s+(?P<handler>\w+)""", r"""\.route\(\s*"(?P<path>[^"\n]*)"\s*,\s*(?P<verb>get|post|put|patch|delete)\(\s*(?P<handler>[\w:]+)"""],
    "swift": [r"""\b(?:app|routes|router)\.(?P<verb>get|post|put|patch|delete)\(\s*"(?P<path>[^"\n]*)"\s*,\s*use:\s*(?P<handler>[\w.]+)"""],
    "scala": [r"""^(?P<verb>GET|POST|PUT|PATCH|DELETE)[ \t]+(?P<path>/\S*)[ \t]+(?P<handler>[\w.]+)"""],
    "kotlin": [],
}
_ROUTES["typescript"] = _ROUTES["javascript"] + [r"""@(?P<verb>Get|Post|Put|Patch|Delete)\(\s*['"]?(?P<path>[^'")\n]*)['"]?\s*\)\s*\n\s*(?:async\s+)?(?P<handler>\w+)\s*\("""]
_ROUTES["kotlin"] = _ROUTES["java"]
_BRIDGES: dict[str, list[str]] = {
    "go": [r"\bC\.(?P<name>(?!C?String\b|GoString\b|free\b|int\b|char\b|size_t\b)\w+)\s*\("],
    "python": [r"\b(?:lib|_lib|clib|ffi_lib)\.(?P<name>\w+)\s*\("],
    "javascript": [r"\bNativeModules\.\w+\.(?P<name>\w+)\s*\(", r"\brequireNativeModule\(\s*['\"](?P<name>\w+)"],
    "swift": [r"\[\s*\w+\s+(?P<name>\w+)\s*\]", r"#selector\(\s*(?:\w+\.)*(?P<name>\w+)"],
    "objective-c": [r"\[\s*\w+(?:Swift|Bridge)\s+(?P<name>\w+)"],
}
_BRIDGES["typescript"] = _BRIDGES["javascript"]
NODE = "kind string, name string, file string, line long, end_line long, body string, language string, qualified_name string, is_exported boolean"
REF = "source_name string, source_line long, name string, kind string, line long, file string, language string"
SCHEMA = f"path string, nodes array<struct<{NODE.replace(' ', ':').replace(',:', ',')}>>, refs array<struct<{REF.replace(' ', ':').replace(',:', ',')}>>"


def register(name: str, language: Language) -> None:
    """Adds a language, or replaces one; paths.EXTENSION_LANGUAGE says which files are of it."""
    LANGUAGES[name] = language


def _block_end(lines: list[str], first: int, by_indent: bool) -> int:
    """Last line (from 0) of the block that starts at first."""
    last = min(len(lines), first + MOST_LINES)
    if by_indent:
        own = len(lines[first]) - len(lines[first].lstrip())
        end = first
        for i in range(first + 1, last):
            if lines[i].strip():
                if len(lines[i]) - len(lines[i].lstrip()) <= own:
                    return i if lines[i].strip() == "end" else end
                end = i
        return end
    depth, opened = 0, False
    for i in range(first, last):
        for c in lines[i]:
            if c == "{":
                depth, opened = depth + 1, True
            elif c == "}":
                depth -= 1
        if opened and depth <= 0 or not opened and i > first + 3:
            return i if opened else first
    return last - 1 if opened else first


def _line(starts: list[int], at: int) -> int:
    from bisect import bisect_right

    return bisect_right(starts, at)


def extract_source(path: str, content: str, language: str, offset: int = 0) -> tuple[list[dict], list[dict]]:
    """(nodes, refs) of one file. Calls belong to the innermost function around them, else to the file."""
    rules = LANGUAGES.get(language)
    if rules is None:
        return [], []
    clean = blank_literals(re.sub(r"#[^\n]*", lambda m: " " * len(m[0]), content) if rules.hash_comments else content)
    lines, clean_lines = content.split("\n"), clean.split("\n")
    starts = [0]
    for x in lines[:-1]:
        starts.append(starts[-1] + len(x) + 1)
    nodes: list[dict] = []
    taken: set[tuple[int, str]] = set()
    for kind, expression in rules.definitions:
        for m in re.finditer(expression, clean, _BY_LINE):
            name, line = m["name"], _line(starts, m.start("name"))
            if name in KEYWORDS or (line, name) in taken:
                continue
            taken.add((line, name))
            end = _block_end(clean_lines, line - 1, rules.by_indent) + 1
            owner = m.groupdict().get("owner")
            nodes.append({"kind": "method" if owner and kind == "function" else kind, "name": name, "file": path, "line": line, "end_line": end, "body": "\n".join(lines[line - 1 : end]), "language": language, "qualified_name": f"{owner}.{name}" if owner else name, "is_exported": bool(re.match(rules.exported, name))})
    types = [n for n in nodes if n["kind"] in ("class", "interface", "struct", "trait", "module", "protocol")]
    for n in nodes:
        around = [t for t in types if t is not n and t["line"] < n["line"] and n["end_line"] <= t["end_line"]]
        if around and n["kind"] in ("function", "method"):
            n["kind"], n["qualified_name"] = "method", f"{max(around, key=lambda t: t['line'])['name']}.{n['name']}"
    functions = sorted((n for n in nodes if n["kind"] in ("component", "function", "method", "procedure")), key=lambda n: n["line"])
    defined = {(n["line"], n["name"]) for n in nodes}

    def source(line: int) -> dict | None:
        inner = [n for n in functions if n["line"] <= line <= n["end_line"]]
        return inner[-1] if inner else None

    refs: list[dict] = []

    def add(name: str, kind: str, line: int, by: dict | None) -> None:
        refs.append({"source_name": by["name"] if by else None, "source_line": by["line"] + offset if by else None, "name": name, "kind": kind, "line": line + offset, "file": path, "language": language})

    for m in _CALL.finditer(clean):
        name = re.sub(r"\s*(\.|::|->)\s*", lambda s: "." if s[1] == "->" else s[1], m[1])
        line = _line(starts, m.start(1))
        if name in KEYWORDS or re.split(r"\.|::", name)[-1] in KEYWORDS or (line, name) in defined:
            continue
        add(name, "calls", line, source(line))
    for expression in rules.imports:
        for m in re.finditer(expression, content, _BY_LINE):
            add(next(g for g in m.groups() if g), "imports", _line(starts, m.start(1)), None)
    for expression in _ROUTES.get(language, []):
        for m in re.finditer(expression, content, _BY_LINE):
            got = m.groupdict()
            verb = (got.get("verb") or "GET").upper()
            verb = {"ROUTE": "GET", "HANDLEFUNC": "ANY", "HANDLE": "ANY", "REQUEST": "ANY", "ALL": "ANY", "USE": "ANY"}.get(verb, verb)
            line = _line(starts, m.start())
            route = {"kind": "route", "name": f"{verb} {got['path']}", "file": path, "line": line, "end_line": line, "body": got["handler"], "language": language, "qualified_name": f"{verb} {got['path']}", "is_exported": True}
            nodes.append(route)
            handler = got["handler"].rsplit("@", 1)[-1]
            add(handler.rsplit(".", 1)[-1], "references", line, route)
    for expression in _BRIDGES.get(language, []):
        for m in re.finditer(expression, clean, _BY_LINE):
            line = _line(starts, m.start("name"))
            add(m["name"], "bridge", line, source(line))
    for n in nodes:
        n["line"], n["end_line"] = n["line"] + offset, n["end_line"] + offset
    return nodes, refs


def extract_component(path: str, content: str, language: str) -> tuple[list[dict], list[dict]]:
    """A single-file component: itself, what its scripts define, and the components that its template uses."""
    name = re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])
    n_lines = content.count("\n") + 1
    nodes = [{"kind": "component", "name": name, "file": path, "line": 1, "end_line": n_lines, "body": content, "language": language, "qualified_name": name, "is_exported": True}]
    refs: list[dict] = []
    blocks = list(re.finditer(r"<script\b([^>]*)>(.*?)</script>", content, re.S))
    if language == "astro" and (m := re.match(r"()---\n(.*?)\n---", content, re.S)):
        blocks.append(m)
    rest = content
    for m in blocks:
        n, r = extract_source(path, m[2], "typescript" if "ts" in m[1] else "javascript", content.count("\n", 0, m.start(2)))
        nodes += n
        refs += r
        rest = rest.replace(m[0], re.sub(r"[^\n]", " ", m[0]))
    seen: set[str] = set()
    for m in re.finditer(r"<([A-Za-z][\w.-]*)", rest):
        tag = m[1]
        pascal = "".join(x[:1].upper() + x[1:] for x in tag.split("-")) if "-" in tag else tag
        if tag in NATIVE_TAGS or pascal in BUILTIN_COMPONENTS or not pascal[0].isupper() or pascal in seen:
            continue
        seen.add(pascal)
        refs.append({"source_name": name, "source_line": 1, "name": pascal, "kind": "references", "line": content.count("\n", 0, m.start()) + 1, "file": path, "language": language})
    return nodes, refs


def extract_file(path: str, content: str, language: str) -> tuple[list[dict], list[dict]]:
    return (extract_component if language in ("vue", "svelte", "astro") else extract_source)(path, content, language)


def extract(files: DataFrame) -> DataFrame:
    """(path, nodes, refs) for each of files (path, content) whose language is known."""
    known = files.withColumn("language", paths.language(F.col("path"))).where("language IS NOT NULL AND content IS NOT NULL")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [extract_file(p, c, lang) for p, c, lang in zip(b["path"], b["content"], b["language"])]
            yield pd.DataFrame({"path": b["path"], "nodes": [n for n, _ in got], "refs": [r for _, r in got]})

    return known.select("path", "content", "language").mapInPandas(run, SCHEMA)
