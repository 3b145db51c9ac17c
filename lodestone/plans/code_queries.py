"""Queries over source code: files written from the parts table, and the SQL that says what each must find."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.text import is_sensitive_file, is_test_file
from lodestone.operators import flow, graphs, layers, rdf
from lodestone.operators.search import lines_of
from lodestone.operators.shared import settle
from lodestone.plans.adapters import MODULES_SQL, source_files
from lodestone.sources import code, flowfacts, manifests


def _symbols(spark, d):
    return code.symbols_of(source_files(spark, d))


def find_symbols(spark, d):
    return _symbols(spark, d).where("kind in ('function', 'method')").select("path", "name", "kind", "start_line", "end_line")


def call_graph(spark, d):
    s = _symbols(spark, d).where("kind in ('function', 'method')").select(F.concat_ws("::", "path", "name").alias("key"), "name", F.col("path").alias("file"))
    calls = code.calls_of(source_files(spark, d)).select("caller", F.col("path").alias("file"), "callee", F.coalesce("scope_hint", F.lit("")).alias("scope_hint"))
    return graphs.resolve_calls(calls, s).select("caller", "callee", "target")


def imports(spark, d):
    return code.imports_of(source_files(spark, d)).select("path", "line", "module", "name", "alias")


def import_edges(spark, d):
    f = source_files(spark, d)
    return code.resolve_imports(code.imports_of(f), f).select("src", "dst").distinct()


def circular(spark, d):
    return graphs.short_cycles(settle(import_edges(spark, d)), 4)


def unused_exports(spark, d):
    f = source_files(spark, d)
    return graphs.unused(code.exports_of(code.symbols_of(f)).where("kind = 'function'"), code.imports_of(f).select(F.coalesce("name", F.element_at(F.split("module", "::"), -1)).alias("name")), F.col("file").rlike(r"(^|/)(main|index|__init__|mod)\.\w+$") | is_test_file(F.concat(F.lit("/"), F.col("file")))).select("file", "name")


def _analysis(*kinds):
    def run(spark, d):
        return flowfacts.findings_of(source_files(spark, d), kinds).select("path", "fn", "finding", "var", "def_line", "use_line", "block")

    return run


def dead_code(spark, d):
    return flowfacts.dead_code(source_files(spark, d)).drop("repo")


def control_flow(spark, d):
    return flowfacts.flow_facts(source_files(spark, d)).where("fact = 'edge'").select("path", "fn", "a", "b", "kind")


def complexity(spark, d):
    return flowfacts.function_metrics(source_files(spark, d)).drop("repo")


def unused_imports(spark, d):
    f = source_files(spark, d).where("language = 'python'")
    return flow.unused_imports(code.imports_of(f), f).select("path", "line", "name")


def injections(spark, d):
    return flow.severity_of_flow(flow.taint_flows(lines_of(source_files(spark, d)))).drop("repo")


def types(spark, d):
    return flow.infer_types(lines_of(source_files(spark, d).where("language = 'python'"))).drop("repo")


def dependencies(spark, d):
    return manifests.dependencies_of(source_files(spark, d)).drop("repo")


def sensitive(spark, d):
    return source_files(spark, d).where(is_sensitive_file(F.col("path"))).select("path", "language")


def ccg_manifest(spark, d):
    return layers.manifest(_symbols(spark, d), source_files(spark, d)).select("symbols", "functions", "classes", "traits")


def ccg_index(spark, d):
    return rdf.parse_nquads(layers.index_layer(_symbols(spark, d))).groupBy("p").agg(F.count("*").alias("n"))


def ccg_access(spark, d):
    return layers.access(spark)


def functions_by_template(spark, d):
    """All functions; the triples are read by each pattern, so they are settled first."""
    return rdf.run_template(settle(rdf.symbol_triples(_symbols(spark, d))), "find_functions", limit=None)


def symbol_at(spark, d):
    """The first symbol around the tenth line of each module."""
    s = _symbols(spark, d)
    return code.symbol_at(s, source_files(spark, d).where("language = 'python'").select("repo", "path", F.lit(10).alias("line"))).select("path", "line", "name")


def definition(spark, d):
    return code.definitions(_symbols(spark, d), "run_8").select("path", "name", "start_line", "end_line")


def filtered_symbols(spark, d):
    return code.find_symbols(_symbols(spark, d), "UN_1", "function", "pkg/*5.py").select("path", "name")


def usages(spark, d):
    f = source_files(spark, d)
    return code.usages(code.symbols_of(f), lines_of(f)).select("name", "path", "line")


def export_map(spark, d):
    return code.exports_of(_symbols(spark, d)).select("file", "name", "kind", "line")


def taint_points(spark, d):
    return flow.taint_points(lines_of(source_files(spark, d))).select("path", "line", "role", "kind")


def traced(spark, d):
    return flow.trace(flow.taint_flows(lines_of(source_files(spark, d))), line=11).select("path", "source_line", "sink_line", "variable", "sanitized")


def _sql(body: str, tables: str = "") -> str:
    return f"WITH RECURSIVE {MODULES_SQL}{tables} {body}"


def _facts(rows: list[str], columns: str = "finding, var, def_line, use_line, block") -> str:
    """Facts that every module has, or those for which the condition before '?' holds."""
    made = []
    for row in rows:
        when, values = row.split("?") if "?" in row else ("true", row)
        made.append(f"SELECT path, fn, {', '.join(f'{v} AS {c}' for v, c in zip(values.split(','), columns.split(', ')))} FROM m WHERE {when}")
    return _sql(" UNION ALL ".join(made))


_NO = "NULL::INTEGER"
_EDGES = ", e AS (SELECT DISTINCT m.path AS src, o.path AS dst FROM m JOIN m o ON o.k = m.dst WHERE m.k <> o.k)"
_CALLS = ", c AS (SELECT k, s, unnest(list_concat(['run_' || dst, 'system'], CASE WHEN s % 3 = 0 THEN ['input'] ELSE [] END, CASE WHEN s % 6 = 0 THEN ['quote'] ELSE [] END, CASE WHEN s % 5 = 0 THEN ['print'] ELSE [] END)) AS callee FROM m)"
_DEAD, _GONE = f"s % 2 = 1?'dead_store','z',13,{_NO},5", f"s % 5 = 0?'unreachable',NULL::VARCHAR,15,{_NO},6"
_CHAINS = ["'chain','x',6,7,1", "'chain','a',8,7,1", "'chain','a',8,8,2", "'chain','a',8,10,4", "'chain','a',8,13,5", "s % 2 = 1?'chain','a',8,14,5", "s % 2 = 0?'chain','z',13,14,5", "'chain','q',11,12,5"]
QUERIES = {
    "find_symbols": (find_symbols, _sql("SELECT path, 'run_' || k AS name, 'function' AS kind, 5 AS start_line, CASE WHEN s % 5 = 0 THEN 15 ELSE 14 END AS end_line FROM m")),
    "find_symbols_filtered": (filtered_symbols, _sql("SELECT path, 'run_' || k AS name FROM m WHERE k::VARCHAR LIKE '1%' AND k % 10 = 5")),
    "get_symbol_definition": (definition, _sql("SELECT path, 'run_8' AS name, 5 AS start_line, CASE WHEN s % 5 = 0 THEN 15 ELSE 14 END AS end_line FROM m WHERE k = 8")),
    "find_symbol_usages": (usages, _sql("SELECT 'run_' || m.dst AS name, m.path, unnest([3, 10]) AS line FROM m JOIN m o ON o.k = m.dst")),
    "get_export_map": (export_map, _sql("SELECT path AS file, 'run_' || k AS name, 'function' AS kind, 5 AS line FROM m")),
    "get_call_graph": (call_graph, _sql("SELECT m.path || '::run_' || c.k AS caller, callee, coalesce(o.path || '::' || callee, callee) AS target FROM c JOIN m USING (k) LEFT JOIN m o ON callee = 'run_' || o.k", _CALLS)),
    "parse_imports": (imports, _sql("SELECT path, 1 AS line, 'os' AS module, NULL AS name, NULL AS alias FROM m UNION ALL SELECT path, 2, 'json', NULL, 'js' FROM m UNION ALL SELECT path, 3, 'pkg.p' || dst, 'run_' || dst, NULL FROM m")),
    "resolve_import": (import_edges, _sql("SELECT src, dst FROM e", _EDGES)),
    "import_cycles": (circular, _sql("SELECT CAST(len(path) AS INTEGER) AS length, path FROM r JOIN e ON e.src = r.cur AND e.dst = r.start", _EDGES + ", r AS (SELECT src AS start, dst AS cur, [src, dst] AS path FROM e WHERE src < dst UNION ALL SELECT start, e.dst, list_append(path, e.dst) FROM r JOIN e ON e.src = r.cur WHERE e.dst > start AND NOT list_contains(path, e.dst) AND len(path) < 4)")),
    "dead_code_unused_exports": (unused_exports, _sql("SELECT path AS file, 'run_' || k AS name FROM m WHERE k NOT IN (SELECT dst FROM m)")),
    "get_control_flow": (control_flow, _facts(["0,1,'fall'", "1,2,'true'", "1,3,'false'", "2,1,'back'", "3,4,'true'", "3,5,'false'"], "a, b, kind")),
    "get_reaching_definitions": (_analysis("chain"), _facts(_CHAINS)),
    "find_dead_stores": (_analysis("dead_store"), _facts([_DEAD])),
    "find_uninitialized": (_analysis("uninitialized"), _facts([f"s % 3 = 1?'uninitialized','z',{_NO},9,3"])),
    "find_dead_code": (dead_code, _facts([_DEAD, _GONE]) + f" UNION ALL SELECT path, NULL, 'unused_import', 'js', 2, {_NO}, {_NO} FROM m"),
    "find_loops": (_analysis("loop"), _facts([f"'loop',NULL::VARCHAR,{_NO},{_NO},1"])),
    "get_complexity": (complexity, _sql("SELECT path, fn, CASE WHEN s % 5 = 0 THEN 11 ELSE 10 END AS loc, CASE WHEN s % 3 = 1 THEN 4 ELSE 3 END AS cyclomatic, 1 AS max_depth, 2 AS params, 2 AS returns, 2 AS cognitive FROM m")),
    "find_unused_imports": (unused_imports, _sql("SELECT path, 2 AS line, 'js' AS name FROM m")),
    "find_injection_vulnerabilities": (injections, _sql("SELECT path, 'user_input' AS source_kind, 'command' AS sink_kind, 'q' AS variable, 11 AS source_line, 12 AS sink_line, s % 6 = 0 AS sanitized, CASE WHEN s % 6 = 0 THEN 'medium' ELSE 'critical' END AS severity FROM m WHERE s % 3 = 0")),
    "get_taint_sources": (taint_points, _sql("SELECT path, 11 AS line, 'source' AS role, 'user_input' AS kind FROM m WHERE s % 3 = 0 UNION ALL SELECT path, 12, 'sink', 'command' FROM m")),
    "trace_taint": (traced, _sql("SELECT path, 11 AS source_line, 12 AS sink_line, 'q' AS variable, s % 6 = 0 AS sanitized FROM m WHERE s % 3 = 0")),
    "infer_types": (types, _sql("SELECT path, unnest([6, 8, 11, 13]) AS line, unnest(['x', 'a', 'q', 'z']) AS variable, unnest(['int', 'unknown', CASE WHEN s % 3 = 0 THEN 'unknown' ELSE 'str' END, 'unknown']) AS type FROM m")),
    "scan_manifests": (dependencies, "SELECT 'req/p' || p_partkey || '/requirements.txt' AS path, unnest(['requests', 'flask']) AS name, unnest([p_size || '.' || p_partkey % 30 || '.0', '*']) AS version, 'pypi' AS ecosystem, NULL AS license, false AS dev FROM part WHERE p_size % 7 <> 0 AND p_size % 11 = 0"),
    "is_sensitive_file": (sensitive, "SELECT 'conf/p' || p_partkey || '/.env' AS path, 'unknown' AS language FROM part WHERE p_size % 7 = 0"),
    "get_ccg_manifest": (ccg_manifest, _sql("SELECT count(*) AS symbols, count(*) AS functions, 0::BIGINT AS classes, 0::BIGINT AS traits FROM m")),
    "export_ccg_index": (ccg_index, _sql("SELECT p, count(*) AS n FROM m, (SELECT unnest(['signature', 'filePath', 'kind', 'endLine', 'type', 'name', 'startLine', 'definesSymbol']) AS p) GROUP BY p")),
    "get_ccg_access_info": (ccg_access, None),
    "run_sparql_template": (functions_by_template, _sql("SELECT path AS file, '5' AS line, 'run_' || k AS name FROM m")),
    "get_hover_info": (symbol_at, _sql("SELECT path, 10 AS line, 'run_' || k AS name FROM m")),
}
