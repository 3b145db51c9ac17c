"""Source files as tables: listing, symbols, calls, imports, exports.

Python is parsed with its own grammar; other languages by the shapes of their declarations, which gives
functions, classes, structs, enums, interfaces, traits, modules and types, a symbol ending where
its braces close.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import LANGUAGES, glob_regex, language_of

SYMBOLS = "repo string, path string, name string, kind string, start_line int, end_line int, signature string, qualified_name string, doc_comment string"
CALLS = "repo string, path string, caller string, callee string, line int, call_type string, scope_hint string"
IMPORTS = "repo string, path string, line int, module string, name string, alias string"

# fixed values: marker files of a repository
MARKERS = ".git Cargo.toml package.json pyproject.toml setup.py go.mod pom.xml build.gradle CMakeLists.txt Makefile Gemfile composer.json".split()
SKIPPED = r"(^|/)(\.[^/]+|node_modules|target|vendor|dist|build|__pycache__|venv)/"


def read_files(spark: SparkSession, root: str, repo: str, most_bytes: int = 1 << 20) -> DataFrame:
    """files(repo, path, language, content, size) below root, hidden and vendored folders and large files left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/")) + "/", "")
    known = r"\.(" + "|".join(LANGUAGES) + r")$"
    kept = raw.withColumn("p", path).where(~F.col("p").rlike(SKIPPED) & F.col("p").rlike(known) & (F.col("length") <= most_bytes))
    return kept.select(F.lit(repo).alias("repo"), F.col("p").alias("path"), language_of(F.col("p")).alias("language"), F.decode("content", "UTF-8").alias("content"), F.col("length").alias("size"))


def repositories(listing: DataFrame, most_depth: int = 3) -> DataFrame:
    """Folders of listing(path) that hold a marker, at most most_depth levels down."""
    parts = F.split("path", "/")
    at = F.filter(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(most_depth + 1))), lambda i: F.element_at(parts, i).isin(MARKERS))
    return listing.where(F.size(at) > 0).select(F.array_join(F.slice(parts, 1, F.element_at(at, 1) - 1), "/").alias("repo")).distinct()


_SHAPES = [
    ("function", r"^\s*(?:pub(?:\([^)]*\))?\s+|export\s+(?:default\s+)?|async\s+|static\s+|public\s+|private\s+|protected\s+|override\s+|unsafe\s+|const\s+|extern\s+)*(?:fn|func|function|fun|def|sub)\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)"),
    ("method", r"^\s+(?:public|private|protected|internal|static|final|abstract|virtual|override|async|\s)+[\w<>\[\],.?]+\s+([A-Za-z_]\w*)\s*\([^;]*\)\s*(?:throws\s+[\w, ]+)?\{"),
    ("class", r"^\s*(?:export\s+|default\s+|public\s+|abstract\s+|final\s+|sealed\s+|data\s+)*class\s+([A-Za-z_]\w*)"),
    ("struct", r"^\s*(?:pub\s+|typedef\s+|public\s+)*struct\s+([A-Za-z_]\w*)|^\s*type\s+([A-Za-z_]\w*)\s+struct"),
    ("enum", r"^\s*(?:pub\s+|export\s+|public\s+)*enum\s+(?:class\s+)?([A-Za-z_]\w*)"),
    ("interface", r"^\s*(?:export\s+|public\s+)*interface\s+([A-Za-z_]\w*)|^\s*type\s+([A-Za-z_]\w*)\s+interface"),
    ("trait", r"^\s*(?:pub\s+)?trait\s+([A-Za-z_]\w*)"),
    ("implementation", r"^\s*impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?([A-Za-z_]\w*)"),
    ("module", r"^\s*(?:pub\s+)?(?:mod|module|namespace|package)\s+([A-Za-z_][\w.]*)"),
    ("typealias", r"^\s*(?:pub\s+|export\s+)*type\s+([A-Za-z_]\w*)\s*(?:<[^>]*>)?\s*="),
    ("constant", r"^\s*(?:pub\s+|export\s+)*(?:const|static)\s+(?:mut\s+)?([A-Za-z_]\w*)\s*[:=]"),
]
_SHAPES = [(k, re.compile(p)) for k, p in _SHAPES]
_CALL = re.compile(r"(?:([A-Za-z_][\w]*)(::|\.))?([A-Za-z_]\w*)\s*\(")
_WORDS = frozenset("if for while switch match return catch fn func function def sizeof typeof await yield new in and or not elif except with assert lambda".split())


def python_symbols(source: str) -> list[tuple]:
    """(name, kind, start, end, signature, qualified, doc) of a module; empty if it does not parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    lines, out = source.split("\n"), []

    def walk(node: ast.AST, above: list[str], inside: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if inside else "function"
                out.append((child.name, kind, child.lineno, child.end_lineno, lines[child.lineno - 1].strip()[:200], ".".join([*above, child.name]), ast.get_docstring(child)))
                walk(child, [*above, child.name], isinstance(child, ast.ClassDef))
            else:
                walk(child, above, inside)

    walk(tree, [], False)
    return out


def brace_symbols(source: str) -> list[tuple]:
    lines, out = source.split("\n"), []
    for i, line in enumerate(lines):
        for kind, shape in _SHAPES:
            m = shape.match(line)
            if m:
                name = next(g for g in m.groups() if g)
                depth, end = 0, i
                for j in range(i, len(lines)):
                    bare = re.sub(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|//.*", "", lines[j])
                    depth += bare.count("{") - bare.count("}")
                    end = j
                    if depth <= 0 and ("{" in bare or ";" in bare or j > i):
                        break
                doc = lines[i - 1].strip().lstrip("/*# ") if i and re.match(r"\s*(///|//|\*|#)", lines[i - 1]) else None
                out.append((name, kind, i + 1, end + 1, line.strip()[:200], name, doc))
                break
    return out


def symbols_of(files: DataFrame) -> DataFrame:
    """Symbols of files(repo, path, language, content); a null or unparsable file has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for repo, path, language, content in b.itertuples(index=False):
                if content:
                    rows += [(repo, path, *s) for s in (python_symbols if language == "python" else brace_symbols)(content)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SYMBOLS.split(", ")])

    return files.select("repo", "path", "language", "content").mapInPandas(run, SYMBOLS)


def calls_of(files: DataFrame) -> DataFrame:
    """Calls inside functions: the caller is the innermost function around the line."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for repo, path, language, content in b.itertuples(index=False):
                made = [s for s in (python_symbols if language == "python" else brace_symbols)(content or "") if s[1] in ("function", "method")]
                for i, line in enumerate((content or "").split("\n"), 1):
                    around = [s for s in made if s[2] <= i <= s[3]]
                    if not around or re.match(r"\s*(//|#|\*)", line):
                        continue
                    caller = min(around, key=lambda s: s[3] - s[2])
                    for m in _CALL.finditer(line):
                        if m[3] in _WORDS or (i == caller[2] and m[3] == caller[0]):
                            continue
                        kind = "direct" if not m[2] else "static" if m[2] == "::" else "method"
                        rows.append((repo, path, f"{path}::{caller[0]}", m[3], i, kind, m[1]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CALLS.split(", ")])

    return files.select("repo", "path", "language", "content").mapInPandas(run, CALLS)


def imports_of(files: DataFrame) -> DataFrame:
    """One row for each imported name, by the import forms of Python, JavaScript, Rust, Go, Java and C."""
    lines = files.select("repo", "path", F.posexplode(F.split("content", "\n"))).select("repo", "path", (F.col("pos") + 1).cast("int").alias("line"), F.trim("col").alias("t"))
    get = lambda p, i: F.nullif(F.regexp_extract("t", p, i), F.lit(""))
    py_from, js_from = r"^from\s+(\S+)\s+import\s+\(?([^)#]*)", r"^(?:import|export)\s+(?:type\s+)?(.*?)\s*from\s+['\"]([^'\"]+)['\"]"
    plain, use, include = r"^import\s+(?:static\s+)?['\"]?([\w./@*-]+)['\"]?(?:\s+as\s+(\w+))?;?$", r"^(?:pub\s+)?use\s+([\w:]+?)(?:::\{([^}]*)\}|(?:\s+as\s+(\w+))?);", r"^#include\s+[<\"]([^>\"]+)"
    names = F.coalesce(get(py_from, 2), F.regexp_replace(get(js_from, 1), r"[{}]", ""), get(use, 2), F.lit(""))
    rows = lines.where(F.col("t").rlike(r"^(from\s|import\s|export\s.*from|(pub\s+)?use\s|#include)"))
    each = rows.select("repo", "path", "line", F.coalesce(get(py_from, 1), get(js_from, 2), get(plain, 1), get(use, 1), get(include, 1)).alias("module"), F.coalesce(get(plain, 2), get(use, 3)).alias("whole"), F.explode(F.transform(F.split(names, ","), lambda x: F.trim(x))).alias("n")).where("module is not null")
    name = F.nullif(F.regexp_extract("n", r"^([\w*]+)", 1), F.lit(""))
    return each.select("repo", "path", "line", "module", name.alias("name"), F.coalesce(F.nullif(F.regexp_extract("n", r"\s+as\s+(\w+)$", 1), F.lit("")), F.col("whole")).alias("alias"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Edges (src, dst, module): each import's candidate paths against the files there are, the first candidate winning.

    A path through '::' loses its root (crate, self, super); the whole of it is tried, then all but its last name.
    """
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    base = F.regexp_replace(F.regexp_replace("module", r"^\.+/?", ""), r"::|\.(?=\w+(\.|$))", "/")
    near = F.when(folder == "", base).otherwise(F.concat_ws("/", folder, base))
    rooted = F.concat(F.lit("src/"), F.regexp_replace(base, r"^((crate|self|super)/)+", ""))
    endings = F.array(*[F.lit(x) for x in (".py", ".ts", ".tsx", ".js", ".jsx", ".rs", "/__init__.py", "/index.ts", "/index.js", "/mod.rs", "")])
    candidates = F.flatten(F.transform(F.array(near, base, rooted, F.regexp_replace(rooted, "/[^/]*$", "")), lambda c: F.transform(endings, lambda e: F.concat(c, e))))
    asked = imports.select("repo", F.col("path").alias("src"), "module", folder.alias("folder"))
    # a module is looked up once for each folder that imports it; its candidates are many more than the sizes of the inputs tell, so they are never broadcast
    each = asked.select("repo", "folder", "module", F.col("src").alias("path")).groupBy("repo", "folder", "module").agg(F.min("path").alias("path"))
    tried = each.select("repo", "folder", "module", F.posexplode(candidates)).withColumnRenamed("col", "dst")
    met = tried.hint("merge").join(files.select("repo", F.col("path").alias("dst")).distinct().hint("merge"), ["repo", "dst"])
    found = met.groupBy("repo", "folder", "module").agg(F.array_sort(F.collect_list(F.struct("pos", "dst"))).alias("found"))
    first = F.filter("found", lambda x: x["dst"] != F.col("src"))
    return asked.join(found, ["repo", "folder", "module"]).select("repo", "src", F.get(first, F.lit(0))["dst"].alias("dst"), "module").where("dst is not null").distinct()


def exports_of(symbols: DataFrame) -> DataFrame:
    """Public symbols: no leading underscore, and 'pub' or 'export' where the language asks for it."""
    asks = F.col("path").rlike(r"\.(rs|ts|tsx|js|jsx)$")
    return symbols.where(~F.startswith("name", F.lit("_")) & (~asks | F.col("signature").rlike(r"^(pub|export)\b"))).select("repo", F.col("path").alias("file"), "name", "kind", F.col("start_line").alias("line"))


def find_symbols(symbols: DataFrame, name: str | None = None, kind: str | None = None, file_pattern: str | None = None) -> DataFrame:
    """Symbols whose name holds name in any case, of a kind, in files that a glob matches."""
    found = symbols
    if name:
        found = found.where(F.contains(F.lower("name"), F.lit(name.lower())))
    if kind:
        found = found.where(F.col("kind") == kind)
    return found.where(F.col("path").rlike(glob_regex(file_pattern))) if file_pattern else found


def definitions(symbols: DataFrame, name: str, file: str | None = None) -> DataFrame:
    """Where a name is defined, in one file or in all."""
    found = symbols.where(F.col("name") == name)
    return found.where(F.col("path") == file) if file else found


def symbol_at(symbols: DataFrame, positions: DataFrame) -> DataFrame:
    """(repo, path, line, name, kind) of positions(repo, path, line): the first symbol around each; positions outside any symbol have none."""
    met = positions.join(symbols, ["repo", "path"]).where("line between start_line and end_line")
    first = met.groupBy("repo", "path", "line").agg(F.min(F.struct("start_line", "end_line", "name", "kind")).alias("s"))
    return first.select("repo", "path", "line", "s.name", "s.kind")


def usages(symbols: DataFrame, lines: DataFrame) -> DataFrame:
    """(repo, name, path, line): every line that names a symbol of its repository, but for the lines that define it."""
    words = lines.select("repo", "path", "line", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z_]\w*)"), 1))).alias("name"))
    # parsed symbols and split lines are many times what their files' sizes tell, so neither is broadcast
    named = words.hint("merge").join(symbols.select("repo", "name").distinct().hint("merge"), ["repo", "name"])
    own = symbols.select("repo", "name", "path", F.col("start_line").alias("line"))
    return named.hint("merge").join(own.hint("merge"), ["repo", "name", "path", "line"], "left_anti")
