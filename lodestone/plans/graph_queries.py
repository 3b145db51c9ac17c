"""Graph, history and time queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import graphs as gr
from lodestone.operators import history as hi
from lodestone.plans.adapters import commits, edges, symbols, table

_E = "e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem)"


def _reach(start: int, depth: int, back: bool = False) -> str:
    a, b = ("dst", "src") if back else ("src", "dst")
    return f"WITH RECURSIVE {_E}, r AS (SELECT CAST({start} AS BIGINT) AS node, 0 AS depth UNION SELECT e.{b}, r.depth + 1 FROM r JOIN e ON e.{a} = r.node WHERE r.depth < {depth}) SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY node HAVING min(depth) > 0"


def hotspots(spark, d):
    return gr.hotspots(edges(spark, d), 5, 50)


def callers(spark, d):
    return gr.reach(edges(spark, d), [7], 2, backwards=True)


def callees(spark, d):
    return gr.reach(edges(spark, d), [150], 3)


def call_path(spark, d):
    return gr.shortest_path(edges(spark, d), 150, 7, 5)


def cycles(spark, d):
    return gr.short_cycles(edges(spark, d), 2)


def import_components(spark, d):
    return gr.strong_components(edges(spark, d))


def topological(spark, d):
    """Customers over nations over regions."""
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("src"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("dst"))
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("src"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("dst"))
    return gr.peel(c.unionByName(n), True)


def clusters(spark, d):
    return gr.clusters(symbols(spark, d), F.concat_ws("/", "kind", "brand"))


def code_graph(spark, d):
    return gr.code_graph(edges(spark, d), [150], 3, 100)[1]


def resolve(spark, d):
    """Customers as calls, suppliers as functions: the same nation is the same file."""
    calls = table(spark, d, "customer").select(F.col("c_name").alias("caller"), F.concat(F.lit("/n/"), F.col("c_nationkey").cast("string"), F.lit(".rs")).alias("file"), F.concat(F.lit("m::f"), F.pmod("c_custkey", F.lit(12)).cast("string")).alias("callee"), F.lit("").alias("scope_hint"))
    functions = table(spark, d, "supplier").select(F.col("s_name").alias("key"), F.concat(F.lit("f"), F.pmod("s_suppkey", F.lit(10)).cast("string")).alias("name"), F.concat(F.lit("/n/"), F.col("s_nationkey").cast("string"), F.lit(".rs")).alias("file"))
    return gr.resolve_calls(calls, functions).groupBy("target").agg(F.count("*").alias("n"))


def unused_exports(spark, d):
    exports = table(spark, d, "part").select(F.col("p_partkey").alias("file"), F.col("p_partkey").alias("name"))
    imports = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("name"))
    return gr.unused(exports, imports, F.pmod("file", F.lit(10)) == 0)


def merged(spark, d):
    ranges = table(spark, d, "conversations").select(F.pmod("conv_id", F.lit(5)).alias("path"), F.greatest(F.lit(1), F.col("conv_id") - 1).alias("start"), (F.col("conv_id") + F.col("turn")).alias("end"))
    return gr.merge_ranges(ranges)


def churn(spark, d):
    return hi.churn(commits(spark, d), None).drop("last_modified")


def contributors(spark, d):
    return hi.contributors(commits(spark, d))


def recent(spark, d):
    c = commits(spark, d)
    now = c.agg(F.max("ts")).first()[0]
    return hi.recent(c, 7, F.lit(now)).groupBy("path").agg(F.count("*").alias("n"))


def history_of(spark, d):
    c = commits(spark, d).select("hash", "author", "path", "ts", F.col("value").cast("int").alias("ins"), F.lit(1).alias("del"))
    return hi.file_history(c, "error", 20).select("hash", "author", "ins", "del")


def metrics(spark, d):
    return hi.run_metrics(table(spark, d, "events").select(F.col("event_type").alias("tool"), F.col("value").alias("duration")))


def required(spark, d):
    e = table(spark, d, "events")
    return hi.required_before(e, "user_id", ["ts", "event_id"], F.col("event_type") == "purchase", F.col("event_type") == "signup").select("event_id", "user_id")


def symbol_history(spark, d):
    lines = table(spark, d, "conversations").select(F.col("conv_id").alias("hash"), F.col("conv_id").alias("ts"), F.when(F.col("role") == "user", "+").otherwise("-").alias("sign"), "text")
    return hi.symbol_history(lines, "the", 20)


QUERIES = {
    "get_function_hotspots": (hotspots, "WITH x AS (SELECT l_partkey AS node, 1 AS o, 0 AS i FROM lineitem UNION ALL SELECT l_suppkey, 0, 1 FROM lineitem) SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) + sum(i) AS BIGINT) AS degree FROM x GROUP BY node HAVING count(*) >= 5 ORDER BY degree DESC, node LIMIT 50"),
    "get_callers": (callers, _reach(7, 2, True)),
    "get_callees": (callees, _reach(150, 3)),
    "find_call_path": (call_path, f"WITH RECURSIVE {_E}, p AS (SELECT CAST(150 AS BIGINT) AS here, [CAST(150 AS BIGINT)] AS path UNION ALL SELECT e.dst, list_append(p.path, e.dst) FROM p JOIN e ON e.src = p.here WHERE len(p.path) < 4 AND NOT list_contains(p.path, e.dst) AND p.here <> 7), b AS (SELECT path FROM p WHERE here = 7 ORDER BY len(path), path LIMIT 1) SELECT CAST(generate_subscripts(path, 1) - 1 AS INTEGER) AS step, unnest(path) AS node FROM b"),
    "find_circular_imports": (cycles, f"WITH {_E} SELECT 1 AS length, [src] AS path FROM e WHERE src = dst UNION ALL SELECT 2, [a.src, a.dst] FROM e a JOIN e b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst"),
    "find_import_components": (import_components, f"WITH RECURSIVE {_E}, i AS (SELECT src, dst FROM e WHERE src IN (SELECT dst FROM e) AND dst IN (SELECT src FROM e)), r AS (SELECT src AS a, dst AS b FROM i UNION SELECT r.a, i.dst FROM r JOIN i ON i.src = r.b) SELECT min(y.b) AS component, x.a AS node FROM r x JOIN r y ON x.a = y.a JOIN r z ON z.a = y.b AND z.b = x.a WHERE x.a = x.b GROUP BY x.a"),
    "topological_sort": (topological, "WITH n AS (SELECT n_nationkey, n_regionkey, CASE WHEN n_nationkey IN (SELECT c_nationkey FROM customer) THEN 1 ELSE 0 END AS level FROM nation) SELECT 'c' || c_custkey AS node, CAST(0 AS INTEGER) AS level FROM customer UNION ALL SELECT 'n' || n_nationkey, CAST(level AS INTEGER) FROM n UNION ALL SELECT 'r' || n_regionkey, CAST(1 + max(level) AS INTEGER) FROM n GROUP BY 1"),
    "graph_clusters": (clusters, "SELECT p_type || '/' || p_brand AS cluster, count(*) AS n_nodes, min(p_partkey) AS first_id, max(p_partkey) AS last_id FROM part GROUP BY 1"),
    "get_code_graph": (code_graph, f"WITH RECURSIVE {_E}, r AS (SELECT CAST(150 AS BIGINT) AS node, 0 AS depth UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 3), n AS (SELECT node, min(depth) AS depth FROM r GROUP BY node ORDER BY depth, node LIMIT 100) SELECT src, dst FROM e WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n)"),
    "resolve_callee": (resolve, "WITH c AS (SELECT c_custkey, '/n/' || c_nationkey || '.rs' AS file, 'f' || (c_custkey % 12) AS bare FROM customer), f AS (SELECT s_name AS key, 'f' || (s_suppkey % 10) AS name, '/n/' || s_nationkey || '.rs' AS file FROM supplier), r AS (SELECT c_custkey, bare, key FROM c LEFT JOIN f ON bare = name QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY c.file <> f.file, key) = 1) SELECT coalesce(key, bare) AS target, count(*) AS n FROM r GROUP BY 1"),
    "find_unused_exports": (unused_exports, "SELECT p_partkey AS file, p_partkey AS name FROM part WHERE p_partkey % 10 <> 0 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)"),
    "merge_ranges": (merged, "WITH r AS (SELECT conv_id % 5 AS path, greatest(1, conv_id - 1) AS s, conv_id + turn AS e FROM conversations), m AS (SELECT *, max(e) OVER (PARTITION BY path ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM r), i AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT path, min(s) AS start, max(e) AS \"end\" FROM i GROUP BY path, g"),
    "get_hotspots": (churn, "WITH c AS (SELECT event_type AS path, count(DISTINCT event_id) AS commits, count(DISTINCT user_id) AS authors FROM events GROUP BY 1) SELECT path, commits, authors, round(commits / (SELECT max(commits) FROM c) * sqrt(authors), 6) AS churn FROM c"),
    "get_contributors": (contributors, "SELECT user_id AS author, count(DISTINCT event_id) AS commits FROM events GROUP BY 1"),
    "get_recent_changes": (recent, "SELECT event_type AS path, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1"),
    "get_file_history": (history_of, "SELECT event_id AS hash, user_id AS author, CAST(trunc(value) AS BIGINT) AS ins, CAST(1 AS BIGINT) AS del FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 20"),
    "get_metrics": (metrics, "SELECT event_type AS tool, count(value) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, percentile_disc(0.5) WITHIN GROUP (ORDER BY value) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95, percentile_disc(0.99) WITHIN GROUP (ORDER BY value) AS p99 FROM events GROUP BY 1"),
    "rule_control_flow": (required, "SELECT event_id, user_id FROM (SELECT *, max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ok FROM events) WHERE event_type = 'purchase' AND coalesce(ok, 0) = 0"),
    "get_symbol_history": (symbol_history, "WITH c AS (SELECT conv_id AS hash, sum(CASE WHEN role = 'user' THEN len(regexp_extract_all(text, '\\bthe\\b')) ELSE 0 END) AS added, sum(CASE WHEN role <> 'user' THEN len(regexp_extract_all(text, '\\bthe\\b')) ELSE 0 END) AS removed FROM conversations GROUP BY 1) SELECT hash, hash AS ts, CAST(added AS BIGINT) AS added, CAST(removed AS BIGINT) AS removed FROM c WHERE added <> removed ORDER BY hash DESC LIMIT 20"),
}
