"""Fixpoints over functions: a function's facts fit a task, so each is solved whole beside its rows."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Collection, Iterable, Iterator
from itertools import islice
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import is_comment_line

KEY = ["repo", "path", "fn"]
FINDING_ROWS = "repo string, path string, fn string, finding string, var string, def_line int, use_line int, block int"
Fact = tuple[str, int, int, str | None, int]  # fact, a, b, var, line


def _graph(facts: list[Fact]) -> tuple[list[int], dict[int, set[int]], dict[int, set[int]]]:
    blocks = sorted(f[1] for f in facts if f[0] == "block")
    succ: dict[int, set[int]] = {b: set() for b in blocks}
    pred: dict[int, set[int]] = {b: set() for b in blocks}
    for fact, a, b, *_ in facts:
        if fact == "edge":
            succ[a].add(b)
            pred[b].add(a)
    return blocks, succ, pred


def _steps(facts: list[Fact], blocks: list[int]) -> dict[int, list[Fact]]:
    """Each block's definitions and uses in order."""
    steps: dict[int, list[Fact]] = {b: [] for b in blocks}
    for f in facts:
        if f[0] in ("def", "use"):
            steps[f[1]].append(f)
    for found in steps.values():
        found.sort(key=itemgetter(2))
    return steps


def reachable(succ: dict[int, set[int]], start: int = 0) -> set[int]:
    seen, todo = {start}, [start]
    while todo:
        for b in succ.get(todo.pop(), ()):
            if b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def dominators(blocks: list[int], succ: dict[int, set[int]], pred: dict[int, set[int]]) -> dict[int, set[int]]:
    """The blocks on every path to each reachable block."""
    live = reachable(succ)
    dom = {b: {0} if b == 0 else set(live) for b in blocks if b in live}
    changed = True
    while changed:
        changed = False
        for b in dom:
            if b:
                new = {b} | set.intersection(*(dom[p] for p in pred[b] if p in live))
                if new != dom[b]:
                    dom[b], changed = new, True
    return dom


def reaching(steps: dict[int, list[Fact]], succ: dict[int, set[int]]) -> dict[int, set[tuple]]:
    """Definitions (var, line, order) that reach the start of each block."""
    gen = {b: {var: (var, line, order) for fact, _, order, var, line in found if fact == "def"} for b, found in steps.items()}
    into: dict[int, set[tuple]] = {b: set() for b in steps}
    todo, waiting = deque(steps), set(steps)
    while todo:
        b = todo.popleft()
        waiting.discard(b)
        out = {d for d in into[b] if d[0] not in gen[b]} | set(gen[b].values())
        for s in succ[b]:
            if not out <= into[s]:
                into[s] |= out
                if s not in waiting:
                    waiting.add(s)
                    todo.append(s)
    return into


def live_out(steps: dict[int, list[Fact]], pred: dict[int, set[int]]) -> dict[int, set[str]]:
    """Variables read later than the end of each block."""
    use: dict[int, set[str]] = {b: set() for b in steps}
    define: dict[int, set[str]] = {b: set() for b in steps}
    for b, found in steps.items():
        for fact, _, _, var, _ in found:
            if fact == "def":
                define[b].add(var)
            elif var not in define[b]:
                use[b].add(var)
    out: dict[int, set[str]] = {b: set() for b in steps}
    todo = list(steps)
    while todo:
        b = todo.pop()
        into = use[b] | (out[b] - define[b])
        for p in pred[b]:
            if not into <= out[p]:
                out[p] |= into
                todo.append(p)
    return out


FINDINGS = ("chain", "uninitialized", "dead_store", "unreachable", "loop")


def solve(facts: list[Fact], kinds: Collection[str] = FINDINGS) -> list[tuple]:
    """(finding, var, def_line, use_line, block) of one function's facts: chains, dead stores, uses without a definition, unreachable blocks and loops, or some of these kinds."""
    rows: list[tuple] = []
    blocks, succ, pred = _graph(facts)
    live = reachable(succ)
    steps = _steps(facts, blocks)
    if "chain" in kinds or "uninitialized" in kinds:
        into = reaching(steps, succ)
        params = {f[3] for f in facts if f[0] == "param"}
        own = {f[3] for f in facts if f[0] == "def"}
        for block, found in steps.items():
            have: dict[str, set[tuple]] = {}
            for d in into[block]:
                have.setdefault(d[0], set()).add(d)
            for fact, _, order, var, line in found:
                if fact == "def":
                    have[var] = {(var, line, order)}
                elif have.get(var):
                    if "chain" in kinds:
                        rows.extend(("chain", var, d[1], line, block) for d in sorted(have[var]))
                elif "uninitialized" in kinds and var in own and var not in params and block in live:
                    rows.append(("uninitialized", var, None, line, block))
    if "dead_store" in kinds:
        later = live_out(steps, pred)
        for block, found in steps.items():
            pending: dict[str, int] = {}
            for fact, _, _, var, line in found:
                if fact == "use":
                    pending.pop(var, None)
                else:
                    if var in pending:
                        rows.append(("dead_store", var, pending[var], None, block))
                    pending[var] = line
            rows.extend(("dead_store", v, n, None, block) for v, n in pending.items() if v not in later[block] and not v.startswith("_"))
    if "unreachable" in kinds and len(live) < len(blocks):
        start = {f[1]: f[4] for f in facts if f[0] == "block"}
        full = {f[1] for f in facts if f[0] == "stmt"}
        rows.extend(("unreachable", None, start[b], None, b) for b in blocks if b not in live and b in full)
    if "loop" in kinds:
        dom = dominators(blocks, succ, pred)
        rows.extend(("loop", None, None, None, b) for a in dom for b in sorted(succ[a]) if b in dom[a])
    return rows


#: Findings that go out at a time.
AT_ONCE = 50_000


def in_batches(found: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of findings in batches of bounded size."""
    schema = pa.schema([(c, pa.int32() if kind == "int" else pa.string()) for c, kind in map(str.split, FINDING_ROWS.split(", "))])
    todo = iter(found)
    while rows := list(islice(todo, AT_ONCE)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def rows_of(functions: Iterable[tuple], kinds: Collection[str] = FINDINGS) -> Iterator[tuple]:
    """Findings of functions (repo, path, fn, facts)."""
    for repo, path, fn, facts in functions:
        yield from ((repo, path, fn, *r) for r in solve(facts, kinds))


def solved(functions: Iterable[tuple], kinds: Collection[str] = FINDINGS) -> Iterator[pa.RecordBatch]:
    return in_batches(rows_of(functions, kinds))


def analyse(facts: DataFrame) -> DataFrame:
    """Findings of all functions of flow facts; a function without facts has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from solved((r["repo"], r["path"], r["fn"], [tuple(f.values()) for f in r["facts"]]) for r in b.to_pylist())

    return facts.groupBy(*KEY).agg(F.collect_list(F.struct("fact", "a", "b", "var", "line")).alias("facts")).mapInArrow(run, FINDING_ROWS)


def unused_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Imported names (alias or name) that occur nowhere else in their file."""
    named = imports.select("repo", "path", "line", F.coalesce("alias", "name", F.element_at(F.split("module", r"\.|/|::"), -1)).alias("used")).where("used is not null and used <> '*'")
    body = files.select("repo", "path", F.regexp_replace("content", r"(?m)^\s*(from\s|import\s|use\s|#include)[^\n]*", "").alias("body"))
    words = F.array_distinct(F.regexp_extract_all("body", F.lit(r"([A-Za-z_]\w*)"), 1))
    return named.join(body.select("repo", "path", words.alias("words")), ["repo", "path"]).where(~F.array_contains("words", F.col("used"))).select("repo", "path", "line", F.col("used").alias("name"))


# fixed values: calls that bring outside data in, that are dangerous with it, and that make it safe
SOURCES = [("user_input", r"\b(input|request\.(args|form|get_json|params|query)|sys\.argv|os\.environ|req\.(body|query|params))\b"), ("file", r"\b(open|read_text|readFile(Sync)?)\s*\("), ("network", r"\b(requests\.get|urlopen|fetch)\s*\(")]
SINKS = [("sql", r"\b(execute|executemany|raw|query)\s*\("), ("command", r"\b(os\.system|subprocess\.\w+|popen|exec|eval)\s*\("), ("path", r"\b(open|unlink|rmtree|sendFile)\s*\("), ("xss", r"\b(innerHTML|document\.write|render_template_string|Markup)\b")]
SANITIZERS = {"sql": r"\b(escape|parameterize|quote_identifier)\s*\(", "command": r"\b(shlex\.quote|escapeshellarg)\s*\(", "path": r"\b(secure_filename|basename|realpath)\s*\(", "xss": r"\b(escape|bleach\.clean|sanitize\w*)\s*\("}
FLOWS = "repo string, path string, source_kind string, sink_kind string, variable string, source_line int, sink_line int, sanitized boolean"
_ASSIGN = re.compile(r"^\s*(?:let |const |var |auto |final )?([A-Za-z_]\w*)\s*(?::[^=]+)?(?<![<>=!])=(?!=)\s*(.+)$")


def _taint(f: pd.DataFrame) -> pd.DataFrame:
    f = f.sort_values("line")
    lines = list(f[["line", "text"]].itertuples(index=False))
    rows, held = [], {}
    for n, text in lines:
        text = text or ""
        bare = "" if re.match(r"\s*(//|#|\*)", text) else text
        for kind, sink in SINKS:
            m = re.search(sink, bare)
            if m:
                args = bare[m.end() :]
                for var, (origin, start) in held.items():
                    if re.search(rf"\b{re.escape(var)}\b", args):
                        safe = any(re.search(SANITIZERS[kind], t or "") for k, t in lines if start <= k < n)
                        rows.append((f.repo.iloc[0], f.path.iloc[0], origin, kind, var, start, n, safe))
        m = _ASSIGN.match(bare)
        if m:
            var, rhs = m.groups()
            origin = next((k for k, p in SOURCES if re.search(p, rhs)), None)
            came = next((held[v] for v in held if re.search(rf"\b{re.escape(v)}\b", rhs)), None)
            if origin:
                held[var] = (origin, n)
            elif came:
                held[var] = came
            else:
                held.pop(var, None)
    return pd.DataFrame(rows, columns=[c.split()[0] for c in FLOWS.split(", ")])


def taint_flows(lines: DataFrame) -> DataFrame:
    """Flows of lines(repo, path, line, text) from sources through assignments to sinks; a file is one ordered scan."""
    return lines.select("repo", "path", "line", "text").groupBy("repo", "path").applyInPandas(_taint, FLOWS)


def severity_of_flow(flows: DataFrame) -> DataFrame:
    """Flows with severity: by the kind of sink, one lower for files and for sanitised flows."""
    rank = F.when(F.col("sink_kind").isin("sql", "command"), 4).otherwise(3) - F.when(F.col("source_kind") == "file", 1).otherwise(0) - F.when(F.col("sanitized"), 2).otherwise(0)
    names = F.array(*[F.lit(x) for x in ("info", "low", "medium", "high", "critical")])
    return flows.withColumn("severity", F.element_at(names, rank + 1))


def infer_type(expr: str, known: dict[str, str]) -> str:
    """The type of an expression's text: literals, known variables, containers, calls of constructors, operators."""
    e = expr.strip()
    if re.fullmatch(r"[-+]?\d+", e):
        return "int"
    if re.fullmatch(r"[-+]?\d*\.\d+(e[-+]?\d+)?", e):
        return "float"
    if re.match(r"[rbfu]*(\"|')", e) and e[-1] in "\"'":
        return "str"
    if e in ("True", "False", "true", "false") or re.search(r"(==|!=|<=|>=|<|>|\bnot\b|\bin\b)", e):
        return "bool"
    if e in ("None", "null", "undefined"):
        return "none"
    if e in known:
        return known[e]
    if e.startswith("["):
        inner = [infer_type(x, known) for x in re.split(r",\s*", e[1:-1]) if x]
        return f"list[{inner[0] if inner and len(set(inner)) == 1 else 'any'}]"
    if e.startswith("{"):
        return "dict" if ":" in e or e == "{}" else "set"
    m = re.fullmatch(r"(int|float|str|bool|list|dict|set|tuple|len)\(.*\)", e)
    if m:
        return "int" if m[1] == "len" else m[1]
    for op in (" + ", " - ", " * ", " / ", " % "):
        if op in e:
            a, b = (infer_type(x, known) for x in e.split(op, 1))
            return "float" if op == " / " and {a, b} <= {"int", "float"} else a if a == b else "float" if {a, b} == {"int", "float"} else "unknown"
    return "unknown"


def infer_types(lines: DataFrame) -> DataFrame:
    """(repo, path, line, variable, type) of the assignments of each file, in order."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        known, rows = {}, []
        for repo, path, n, text in f.sort_values("line")[["repo", "path", "line", "text"]].itertuples(index=False):
            m = _ASSIGN.match(text or "")
            if m:
                known[m[1]] = infer_type(m[2].split("#")[0], known)
                rows.append((repo, path, n, m[1], known[m[1]]))
        return pd.DataFrame(rows, columns=["repo", "path", "line", "variable", "type"])

    return lines.select("repo", "path", "line", "text").groupBy("repo", "path").applyInPandas(run, "repo string, path string, line int, variable string, type string")


def taint_points(lines: DataFrame) -> DataFrame:
    """(repo, path, line, role, kind) of every line that brings outside data in (source) or is dangerous with it (sink); comments have none."""
    bare = lines.where(~is_comment_line(F.col("text")))
    made = [F.when(F.col("text").rlike(p), F.struct(F.lit(role).alias("role"), F.lit(kind).alias("kind"))) for role, table in (("source", SOURCES), ("sink", SINKS)) for kind, p in table]
    found = bare.select("repo", "path", "line", F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("m"))
    return found.select("repo", "path", "line", "m.role", "m.kind")


def trace(flows: DataFrame, path: str | None = None, line: int | None = None) -> DataFrame:
    """The flows through a file, or from or to one of its lines."""
    here = flows if path is None else flows.where(F.col("path") == path)
    return here if line is None else here.where((F.col("source_line") == line) | (F.col("sink_line") == line))
