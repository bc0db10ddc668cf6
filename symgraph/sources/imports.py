"""Import specs to files: each spec gives candidate paths by the rules of its language, and these meet the table of files by equality. No file system is asked.

What manifests say (modules, aliases, workspace packages) is parsed on the driver into a Manifests value: it grows with the number of manifests, not of files.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths
from ..functions.text import strip_json_comments
from .tables import materialize

SCRIPT_PROBES = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".d.ts", ".vue", ".svelte", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
SCRIPTS = ("astro", "javascript", "svelte", "typescript", "vue")
MANIFEST_NAMES = ("go.mod", "package.json", "tsconfig.json", "jsconfig.json", "Cargo.toml", "pnpm-workspace.yaml")
IMPORTS_OF_TASK = 1 << 15


@dataclass
class Manifests:
    """Each list: (folder of the manifest, what is matched, where it leads), folders relative to the root ("" is the root)."""

    go: list[tuple[str, str, str]] = field(default_factory=list)
    alias: list[tuple[str, str, str]] = field(default_factory=list)
    package: dict[str, str] = field(default_factory=dict)
    crate: dict[str, str] = field(default_factory=dict)


def normal(path: str) -> str | None:
    """path without . and ..; None where it leaves the root."""
    out: list[str] = []
    for part in path.split("/"):
        if part == "..":
            if not out:
                return None
            out.pop()
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)


def parse_manifests(rows: Iterable[tuple[str, str]]) -> Manifests:
    """rows: (path, content) of the manifests. One that can't be parsed says nothing."""
    m = Manifests()
    for path, content in sorted(rows):
        folder, _, name = path.rpartition("/")
        if name == "go.mod":
            if found := re.search(r"^\s*module\s+(\S+)", content, re.M):
                m.go.append((folder, found[1], folder))
            for old, new in re.findall(r"^\s*(?:replace\s+)?(\S+)(?:\s+v\S+)?\s+=>\s+(\.\.?/?\S*)", content, re.M):
                if (to := normal(f"{folder}/{new}")) is not None:
                    m.go.append((folder, old, to))
        elif name in ("tsconfig.json", "jsconfig.json"):
            try:
                options = json.loads(strip_json_comments(content)).get("compilerOptions") or {}
            except (ValueError, AttributeError):
                continue
            base = normal(f"{folder}/{options.get('baseUrl') or '.'}")
            for pattern, targets in (options.get("paths") or {}).items():
                for t in targets:
                    if base is not None and (to := normal(f"{base}/{t}")) is not None:
                        m.alias.append((folder, pattern, to + ("/" if t.endswith("/") else "")))
        elif name == "package.json":
            try:
                found = json.loads(content).get("name")
            except (ValueError, AttributeError):
                continue
            if isinstance(found, str) and found:
                m.package.setdefault(found, folder)
        elif name == "Cargo.toml" and (found := re.search(r"^\[package\][^\[]*?^\s*name\s*=\s*\"([^\"]+)\"", content, re.M | re.S)):
            m.crate.setdefault(found[1].replace("-", "_"), folder)
    m.go.sort(key=lambda x: -len(x[1]))
    m.alias.sort(key=lambda x: (-len(x[0]), -len(x[1].split("*")[0]), "*" in x[1]))
    return m


def _inside(file: str, folder: str) -> bool:
    return not folder or file.startswith(folder + "/")


def candidates(file: str, spec: str, language: str, m: Manifests) -> list[str]:
    """Paths that spec may mean in file, the likeliest first. One that ends in /* stands for the files of a folder."""
    folder = file.rpartition("/")[0]
    bases: list[str | None] = []
    if language in SCRIPTS:
        if spec.startswith("."):
            bases.append(normal(f"{folder}/{spec}"))
        else:
            for where, pattern, target in m.alias:
                head, star, tail = pattern.partition("*")
                if not _inside(file, where):
                    continue
                if star and spec.startswith(head) and spec.endswith(tail) and len(spec) >= len(head) + len(tail):
                    bases.append(normal(target.replace("*", spec[len(head) : len(spec) - len(tail)], 1)))
                elif not star and spec == pattern:
                    bases.append(normal(target))
            parts = spec.split("/")
            for n in range(len(parts), 0, -1):
                if (name := "/".join(parts[:n])) in m.package:
                    rest = "/".join(parts[n:])
                    bases += [normal(f"{m.package[name]}/{rest}"), normal(f"{m.package[name]}/src/{rest}")]
                    break
            for head in ("@/", "~/", "@src/", "src/", "@app/", "app/"):
                if spec.startswith(head):
                    bases.append(normal(("app/" if "app" in head else "src/") + spec[len(head) :]))
            bases.append(normal(spec))
        return [b + p for b in bases if b for p in SCRIPT_PROBES]
    if language == "go":
        if spec.startswith("."):
            bases.append(normal(f"{folder}/{spec}"))
        for where, module, to in m.go:
            if _inside(file, where) and (spec == module or spec.startswith(module + "/")):
                bases.append(normal(f"{to}/{spec[len(module):]}"))
        return [f"{b}/*" if b else "*" for b in bases if b is not None]
    if language == "python":
        dots = len(spec) - len(spec.lstrip("."))
        tail = spec[dots:].replace(".", "/")
        if dots:
            bases.append(normal(f"{folder}/{'../' * (dots - 1)}{tail}"))
        else:
            bases += [normal(f"{folder}/{tail}"), normal(tail)]
        return [c for b in bases if b is not None for c in (f"{b}.py", f"{b}/__init__.py" if b else "__init__.py")]
    if language == "rust":
        parts = spec.split("::")
        crate = max((f for f in m.crate.values() if _inside(file, f)), key=len, default="")
        home = file.removesuffix(".rs") if file.rpartition("/")[2] not in ("main.rs", "lib.rs", "mod.rs") else folder
        root = f"{crate}/src" if crate else "src"
        if parts[0] == "crate":
            base, rest = root, parts[1:]
        elif parts[0] == "self":
            base, rest = home, parts[1:]
        elif parts[0] == "super":
            base, rest = home.rpartition("/")[0], parts[1:]
        elif parts[0] in m.crate:
            base, rest = f"{m.crate[parts[0]]}/src".lstrip("/"), parts[1:]
        else:
            base, rest = home, parts
        out = []
        for n in range(len(rest), 0, -1):  # the last parts may be symbols
            b = normal(f"{base}/{'/'.join(rest[:n])}")
            out += [f"{b}.rs", f"{b}/mod.rs"]
        return out + ([f"{base}/lib.rs", f"{base}/main.rs"] if parts[0] in m.crate or parts[0] == "crate" else [])
    ending = {"java": ".java", "kotlin": ".kt", "scala": ".scala"}.get(language)
    if ending:
        return [spec.replace(".", "/") + ending, "src/main/java/" + spec.replace(".", "/") + ending]
    near = normal(f"{folder}/{spec}")
    return [c + p for c in (near, normal(spec)) if c for p in ("", ".rb", ".php", ".lua", ".dart", ".r")]


def targets(imports: DataFrame, files: DataFrame, m: Manifests) -> DataFrame:
    """(file, spec, target_file) for imports (file, spec, language) that lead to one of files (path): the first candidate that exists; for a folder all its files, tests only where there is nothing else."""
    shared = imports.sparkSession.sparkContext.broadcast(m)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def candidates_of(file: pd.Series, spec: pd.Series, language: pd.Series) -> pd.Series:
        return pd.Series([candidates(f, s, lang, shared.value) for f, s, lang in zip(file, spec, language)], dtype=object)

    # Python takes long for few bytes: imports are spread by number
    n = max(int(imports.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-imports.count() // IMPORTS_OF_TASK))
    i = imports.select("file", "spec", "language").repartition(n, "file", "spec", "language").distinct()
    c = materialize(i.select("file", "spec", F.posexplode(candidates_of("file", "spec", "language")).alias("k", "path")), "candidates")
    one = c.join(files.select("path"), "path").select("file", "spec", "k", F.col("path").alias("target_file"))
    inside = files.select(F.concat(F.when(F.instr("path", "/") > 0, F.concat(paths.dirname(F.col("path")), F.lit("/"))).otherwise(""), F.lit("*")).alias("path"), F.col("path").alias("target_file")).where(F.endswith("target_file", F.lit(".go")))
    several = c.join(inside, "path").withColumn("is_test", F.endswith("target_file", F.lit("_test.go")))
    w = Window.partitionBy("file", "spec", "path")
    several = several.withColumn("only_tests", F.min("is_test").over(w)).where("is_test = only_tests").select("file", "spec", "k", "target_file")
    both = one.unionByName(several)
    first = Window.partitionBy("file", "spec")
    return both.withColumn("least", F.min("k").over(first)).where("k = least AND file <> target_file").select("file", "spec", "target_file").distinct()
