"""Control- and data-flow facts of Python functions, by the language's own grammar."""

from __future__ import annotations

import ast
from collections.abc import Collection, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import is_test_file
from lodestone.operators import flow
from lodestone.sources import unused

FACTS = "repo string, path string, fn string, fact string, a int, b int, var string, line int, kind string"


def names_in(node: ast.AST) -> list[ast.Name]:
    """The names below a node, in the order of ast.walk."""
    todo, found = [node], []
    for n in todo:
        if isinstance(n, ast.Name):
            found.append(n)
            continue
        for field in n._fields:
            value = getattr(n, field, None)
            if isinstance(value, ast.AST):
                todo.append(value)
            elif isinstance(value, list):
                todo.extend(v for v in value if isinstance(v, ast.AST))
    return found


class Builder:
    """Blocks, edges, definitions and uses of one function; a definition's idx is its order in the block."""

    def __init__(self, fn: ast.FunctionDef):
        self.rows: list[tuple] = []
        self.n, self.now, self.order = 1, 0, 0
        self.loops: list[tuple[int, int]] = []
        self.rows.append(("block", 0, 0, "entry", fn.lineno, "entry"))
        args = fn.args
        for a in [*args.posonlyargs, *args.args, *args.kwonlyargs, *filter(None, [args.vararg, args.kwarg])]:
            self.rows.append(("param", 0, 0, a.arg, fn.lineno, "param"))
        self.body(fn.body)
        if self.now is not None:
            self.rows.append(("exit", self.now, 0, None, fn.end_lineno, "end"))

    def block(self, label: str, line: int) -> int:
        self.rows.append(("block", self.n, 0, label, line, label))
        self.n += 1
        return self.n - 1

    def edge(self, a: int | None, b: int, kind: str) -> None:
        if a is not None:
            self.rows.append(("edge", a, b, None, 0, kind))

    def facts(self, node: ast.AST) -> None:
        """Uses on the reading side and definitions on the writing side, in order."""
        line = getattr(node, "lineno", 0)
        names = names_in(node)
        for n in names:
            if isinstance(n.ctx, ast.Load):
                self.order += 1
                self.rows.append(("use", self.now, self.order, n.id, n.lineno, "read"))
        if isinstance(node, ast.AugAssign) and isinstance(node.target, ast.Name):
            self.order += 1
            self.rows.append(("use", self.now, self.order, node.target.id, line, "read"))
        for n in names:
            if isinstance(n.ctx, ast.Store):
                self.order += 1
                self.rows.append(("def", self.now, self.order, n.id, n.lineno, "assign"))
        self.rows.append(("stmt", self.now, self.order, None, line, type(node).__name__))

    def body(self, nodes: list[ast.stmt]) -> None:
        for s in nodes:
            if self.now is None:
                self.now = self.block("unreachable", s.lineno)
            if isinstance(s, ast.If):
                self.facts(s.test)
                start = self.now
                self.now = self.block("then", s.body[0].lineno)
                self.edge(start, self.now, "true")
                self.body(s.body)
                ends = [self.now]
                if s.orelse:
                    self.now = self.block("else", s.orelse[0].lineno)
                    self.edge(start, self.now, "false")
                    self.body(s.orelse)
                    ends.append(self.now)
                if s.orelse and all(e is None for e in ends):
                    self.now = None
                    continue
                after = self.block("endif", s.end_lineno)
                for e in ends:
                    self.edge(e, after, "fall")
                if not s.orelse:
                    self.edge(start, after, "false")
                self.now = after
            elif isinstance(s, ast.While | ast.For | ast.AsyncFor):
                head = self.block("loop_header", s.lineno)
                self.edge(self.now, head, "fall")
                self.now = head
                if isinstance(s, ast.While):
                    self.facts(s.test)
                else:
                    self.facts(s.iter)
                    self.facts(s.target)
                inner, after = self.block("loop_body", s.body[0].lineno), self.block("loop_exit", s.end_lineno)
                self.edge(head, inner, "true")
                if not (isinstance(s, ast.While) and isinstance(s.test, ast.Constant) and s.test.value):
                    self.edge(head, after, "false")
                self.loops.append((head, after))
                self.now = inner
                self.body(s.body)
                self.edge(self.now, head, "back")
                self.loops.pop()
                self.now = after
                self.body(s.orelse)
            elif isinstance(s, ast.Try):
                start = self.now
                self.now = self.block("try_body", s.lineno)
                self.edge(start, self.now, "fall")
                inside = self.now
                self.body(s.body)
                self.body(s.orelse)
                ends = [self.now]
                for h in s.handlers:
                    self.now = self.block("catch", h.lineno)
                    self.edge(inside, self.now, "exception")
                    if h.name:
                        self.order += 1
                        self.rows.append(("def", self.now, self.order, h.name, h.lineno, "catch"))
                    self.body(h.body)
                    ends.append(self.now)
                after = self.block("finally" if s.finalbody else "try_end", s.end_lineno)
                for e in ends:
                    self.edge(e, after, "fall")
                self.now = after
                self.body(s.finalbody)
            elif isinstance(s, ast.With | ast.AsyncWith):
                for item in s.items:
                    self.facts(item)
                self.body(s.body)
            elif isinstance(s, ast.Match):
                self.facts(s.subject)
                start, ends = self.now, []
                for case in s.cases:
                    self.now = self.block("match_arm", case.body[0].lineno)
                    self.edge(start, self.now, "jump")
                    self.body(case.body)
                    ends.append(self.now)
                after = self.block("match_end", s.end_lineno)
                for e in ends:
                    self.edge(e, after, "fall")
                self.edge(start, after, "false")
                self.now = after
            elif isinstance(s, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                self.order += 1
                self.rows.append(("def", self.now, self.order, s.name, s.lineno, "definition"))
            else:
                self.facts(s)
                if isinstance(s, ast.Return | ast.Raise):
                    self.rows.append(("exit", self.now, 0, None, s.lineno, "return" if isinstance(s, ast.Return) else "raise"))
                    self.now = None
                elif isinstance(s, ast.Break | ast.Continue) and self.loops:
                    head, after = self.loops[-1]
                    self.edge(self.now, after if isinstance(s, ast.Break) else head, "break" if isinstance(s, ast.Break) else "back")
                    self.now = None


# fixed values: nodes that add a path
BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.match_case)


def complexity(fn: ast.AST) -> tuple[int, int, int, int, int, int]:
    """Lines, cyclomatic, deepest nesting, parameters, returns and cognitive weight of a function."""
    deepest = cognitive = 0

    def walk(node: ast.AST, depth: int) -> None:
        nonlocal deepest, cognitive
        for child in ast.iter_child_nodes(node):
            branch = isinstance(child, BRANCHES)
            deepest = max(deepest, depth + branch)
            cognitive += (depth + 1) * branch
            walk(child, depth + branch)

    walk(fn, 0)
    nodes = list(ast.walk(fn))
    paths = 1 + sum(isinstance(n, BRANCHES) for n in nodes) + sum(len(n.values) - 1 for n in nodes if isinstance(n, ast.BoolOp))
    return fn.end_lineno - fn.lineno + 1, paths, deepest, len(fn.args.args) + len(fn.args.kwonlyargs), sum(isinstance(n, ast.Return) for n in nodes), cognitive


def parsed(source: str | None) -> ast.Module:
    """The tree of a module; empty if it does not parse."""
    try:
        return ast.parse(source or "")
    except (SyntaxError, ValueError):
        return ast.Module([], [])


def functions_in(source: str | None) -> list[tuple[str, ast.FunctionDef]]:
    return functions_of(parsed(source))


def functions_of(tree: ast.Module) -> list[tuple[str, ast.FunctionDef]]:
    found, todo = [], list(tree.body)
    for n in todo:  # a statement holds statements in these fields alone
        if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
            found.append((n.name, n))
        for field in ("body", "orelse", "handlers", "finalbody", "cases"):
            todo.extend(getattr(n, field, ()))
    return found


def flow_facts(files: DataFrame) -> DataFrame:
    """Facts of all Python functions of files; other languages and broken files have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(repo, path, f"{name}@{fn.lineno}", *r) for repo, path, text in b.itertuples(index=False) for name, fn in functions_in(text) for r in Builder(fn).rows]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FACTS.split(", ")])

    return files.where("language = 'python'").select("repo", "path", "content").mapInPandas(run, FACTS)


def function_metrics(files: DataFrame) -> DataFrame:
    names = "repo string, path string, fn string, loc int, cyclomatic int, max_depth int, params int, returns int, cognitive int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(repo, path, f"{name}@{fn.lineno}", *complexity(fn)) for repo, path, text in b.itertuples(index=False) for name, fn in functions_in(text)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in names.split(", ")])

    return files.where("language = 'python'").select("repo", "path", "content").mapInPandas(run, names)


def findings_of(files: DataFrame, kinds: Collection[str] = flow.FINDINGS) -> DataFrame:
    """flow.analyse(flow_facts(files)), or some kinds of its findings, in one pass: a file holds its functions whole, so no facts are shuffled."""
    kinds = frozenset(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sources = zip(*(c.to_pylist() for c in b.columns))
            yield from flow.solved(((repo, path, f"{name}@{fn.lineno}", [r[:5] for r in Builder(fn).rows]) for repo, path, text in sources for name, fn in functions_in(text)), kinds)

    return files.where("language = 'python'").select("repo", "path", "content").mapInArrow(run, flow.FINDING_ROWS)


def dead_code(files: DataFrame, function: str | None = None, exclude_tests: bool = True) -> DataFrame:
    """Unreachable blocks, dead stores and unused imports of files, in one pass; test files are left out unless asked for.

    Blocks and stores are of Python functions, those of one name if it is given. Imports are of the whole file in every case: fn is null, var the name, def_line the import's line.
    """

    def rows(repo: str, path: str, language: str, text: str | None) -> Iterator[tuple]:
        if language == "python":
            tree = parsed(text)
            yield from flow.rows_of(((repo, path, f"{name}@{fn.lineno}", [r[:5] for r in Builder(fn).rows]) for name, fn in functions_of(tree) if function in (None, name)), ("unreachable", "dead_store"))
            found = unused.python_unused(tree)
        else:
            found = unused.shaped_unused(language, text or "")
        yield from ((repo, path, None, "unused_import", name, line, None, None) for line, name in found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from flow.in_batches(r for source in zip(*(c.to_pylist() for c in b.columns)) for r in rows(*source))

    kept = files.where(F.col("language").isin(*unused.LANGUAGES))
    return (kept.where(~is_test_file(F.concat(F.lit("/"), F.col("path")))) if exclude_tests else kept).select("repo", "path", "language", "content").mapInArrow(run, flow.FINDING_ROWS)
