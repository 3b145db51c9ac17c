"""Security, supply-chain, RDF, repository and incremental queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import packages as pk
from lodestone.functions import text as tx
from lodestone.operators import incremental as inc
from lodestone.operators import rdf
from lodestone.operators import rules as ru
from lodestone.operators import supply as su
from lodestone.operators.search import lines_of
from lodestone.plans.adapters import DEPS_SQL, deps, files, pages, table

RULES = [
    {"id": "WEB-001", "severity": "medium", "patterns": ["http://"], "safe_patterns": ["http://localhost"], "languages": ["html"], "cwe": ["CWE-319"], "owasp": ["A02"]},
    {"id": "WEB-002", "severity": "high", "patterns": ["<script[^>]*>"], "languages": ["*"], "cwe": ["CWE-79"], "owasp": ["A03"]},
    {"id": "WEB-003", "severity": "low", "patterns": ["<style"], "languages": ["html"], "cwe": ["CWE-1021"], "owasp": ["A05", "A03"]},
    {"id": "WEB-004", "severity": "info", "patterns": ["<!--"], "languages": ["html"], "cwe": [], "owasp": []},
]
SECRETS = [{"id": "SEC-001", "severity": "critical", "rule_type": "secret", "patterns": ["[a-f0-9]{40}"], "threshold": 3.0, "cwe": ["CWE-798"], "owasp": ["A07"]}]
_PG = "pg AS (SELECT CAST(page_id AS VARCHAR) AS path, unnest(string_split(html, '<')) AS t FROM pages)"


def scan(spark, d):
    return ru.scan(pages(spark, d), RULES).select("rule_id", "severity", "path", "line").groupBy("rule_id", "severity", "path").agg(F.count("*").alias("n"))


def scan_page(spark, d):
    return ru.page(ru.scan(pages(spark, d), RULES, "high"), 10, 20).select("rule_id", "path")


def owasp(spark, d):
    return ru.by_category(ru.scan(pages(spark, d), RULES))


def cwe_top(spark, d):
    return ru.cwe_top25(ru.scan(pages(spark, d), RULES))


def fixes(spark, d):
    return ru.suggest(ru.scan(pages(spark, d), RULES)).select("rule_id", "fix").distinct()


def explained(spark, d):
    return ru.explain(ru.scan(pages(spark, d), RULES)).select("rule_id", "cwe_id", "title").distinct()


def security_summary(spark, d):
    return ru.summary(ru.scan(pages(spark, d), RULES))


def secrets(spark, d):
    lines = lines_of(files(spark, d)).withColumn("language", F.lit("text"))
    return ru.scan(lines, SECRETS, every=False).select("path", "line", "snippet")


def secrets_all(spark, d):
    lines = lines_of(files(spark, d)).withColumn("language", F.lit("text"))
    return ru.scan(lines, SECRETS).select("path", "line", "col", "snippet")


def redacted(spark, d):
    """Every document after all replacements."""
    return table(spark, d, "documents").select("doc_id", F.md5(tx.redact_secrets(F.coalesce("text", F.lit("")))).alias("redacted_md5"))


def entropies(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(tx.entropy(F.col("c_name")), 6).alias("bits"))


def check_dependencies(spark, d):
    return su.vulnerable(deps(spark, d), su.advisories(spark)).groupBy("id", "severity", "breaking").agg(F.count("*").alias("n"))


def upgrade_path(spark, d):
    return su.upgrades(su.vulnerable(deps(spark, d), su.advisories(spark))).select("name", "version", "to_version", "severity", "breaking", "n")


def licences(spark, d):
    return su.licence_counts(su.classify_licences(deps(spark, d), "MIT"))


def sbom(spark, d):
    return su.sbom(deps(spark, d), "json").groupBy("name").agg(F.count("*").alias("n"), F.sum(F.length("component")).alias("n_chars"))


def purls(spark, d):
    return deps(spark, d).select("id", pk.purl(F.col("ecosystem"), F.col("name"), F.col("version")).alias("purl"))


def geo_triples(spark, d):
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    return rdf.triples_of(n, F.concat(F.lit("n:"), F.col("n_nationkey")), {"type": F.lit("Nation"), "name": F.col("n_name"), "inRegion": F.concat(F.lit("r:"), F.col("n_regionkey"))}).unionByName(
        rdf.triples_of(table(spark, d, "region"), F.concat(F.lit("r:"), F.col("r_regionkey")), {"type": F.lit("Region"), "name": F.col("r_name")})
    ).unionByName(rdf.triples_of(c, F.concat(F.lit("c:"), F.col("c_custkey")), {"type": F.lit("Customer"), "name": F.col("c_name"), "inNation": F.concat(F.lit("n:"), F.col("c_nationkey")), "segment": F.col("c_mktsegment")}))


def sparql_select(spark, d):
    return rdf.sparql(geo_triples(spark, d), "SELECT ?customer ?nation ?region WHERE { ?c type Customer . ?c name ?customer . ?c inNation ?n . ?n name ?nation . ?n inRegion ?r . ?r name ?region . ?c segment BUILDING } ORDER BY ?customer LIMIT 200")


def sparql_union(spark, d):
    return rdf.sparql(geo_triples(spark, d), "SELECT DISTINCT ?name WHERE { { ?x type Region . ?x name ?name } UNION { ?x type Nation . ?x name ?name . FILTER(CONTAINS(LCASE(?name), 'nation_1')) } }")


def sparql_ask(spark, d):
    return rdf.sparql(geo_triples(spark, d), "PREFIX x: <urn:x> ASK { ?x type Region . ?x name ASIA }")


def nquads(spark, d):
    return rdf.nquads(geo_triples(spark, d)).select(F.col("value").alias("quad"))


def nquads_read(spark, d):
    return rdf.parse_nquads(rdf.nquads(geo_triples(spark, d))).groupBy("p").agg(F.count("*").alias("n"), F.count_distinct("o").alias("objects"))


def structure(spark, d):
    """Folders region/nation and how many customers stand below each."""
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    path = F.split(F.concat_ws("/", "r_name", "n_name", "c_name"), "/")
    return c.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(2)), lambda i: F.array_join(F.slice(path, 1, i), "/"))).alias("path")).groupBy("path").agg(F.count("*").alias("n"))


def list_repos(spark, d):
    f = files(spark, d)
    return f.rollup("repo", "language").agg(F.count("*").alias("files"), F.sum(F.size(F.split("content", "\n"))).alias("lines"), F.sum(F.octet_length("content")).alias("bytes")).where("repo is not null")


def index_status(spark, d):
    return files(spark, d).groupBy("language").agg(F.count("*").alias("n"), F.round(F.avg(F.length("content")), 6).alias("avg_chars"))


def merkle(spark, d):
    return inc.file_hashes(files(spark, d))


def merkle_folders(spark, d):
    f = files(spark, d).select(F.concat_ws("/", F.lit("root"), "path").alias("path"), "content")
    return inc.folder_hashes(inc.file_hashes(f), 3).where("path <> ''")


def snapshot_diff(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_totalprice").alias("sha256"), "o_orderstatus")
    old = o.where("o_orderstatus <> 'P'")
    new = o.where("o_orderstatus <> 'F'").select("path", F.when(F.pmod("path", F.lit(7)) == 0, F.col("sha256") + 1).otherwise(F.col("sha256")).alias("sha256"))
    return inc.difference(old, new)


def upserted(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_custkey").alias("v"))
    ch = table(spark, d, "events").select(F.pmod("event_id", F.lit(500)).alias("path"), F.col("user_id").alias("v"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "deleted").otherwise("modified").alias("op"))
    return inc.upsert(o, ch, "path", "seq")


def lru(spark, d):
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("key")).agg(F.max("ts").alias("last_access"), F.count("*").alias("hits"))
    return inc.least_recent_out(e, 20).select("key", "hits")


def ttl(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("key"), F.col("ts").alias("created"))
    now = e.agg(F.max("created")).first()[0]
    return inc.live_entries(e, F.lit(now), 86400).agg(F.count("*").alias("n"))


def labels_join(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("n"))


def json_functions(spark, d):
    return table(spark, d, "events").groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"))


def language_share(spark, d):
    from pyspark.sql import Window

    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n")).withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))


def url_parts(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"))


def import_graph(spark, d):
    """Links of pages as import edges."""
    links = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), 1)).alias("target"))
    return links.groupBy("target").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"))


def _redacted_sql() -> str:
    """All replacements, one around the other."""
    made = "coalesce(text, '')"
    for pattern, into in tx.REDACTIONS:
        p, i = pattern.replace("'", "''"), into.replace("$1", "\\1")
        made = f"regexp_replace({made}, '{p}', '{i}', 'g')"
    return f"SELECT doc_id, md5({made}) AS redacted_md5 FROM documents"


_VULN = DEPS_SQL + ", hit AS (SELECT d.*, a.adv_id, a.severity, a.fixed, v[1] <> f[1] AS breaking FROM deps d JOIN adv a ON d.ecosystem = a.eco AND d.name = a.package AND d.v < a.f)"
_TR = "tr AS (SELECT 'n:' || n_nationkey AS s, unnest(['type', 'name', 'inRegion']) AS p, unnest(['Nation', n_name, 'r:' || n_regionkey]) AS o FROM nation UNION ALL SELECT 'r:' || r_regionkey, unnest(['type', 'name']), unnest(['Region', r_name]) FROM region UNION ALL SELECT 'c:' || c_custkey, unnest(['type', 'name', 'inNation', 'segment']), unnest(['Customer', c_name, 'n:' || c_nationkey, c_mktsegment]) FROM customer)"
_SCAN = f"{_PG}, sc AS (SELECT path, '<' || t AS t FROM pg), f AS (SELECT 'WEB-001' AS rule_id, 'medium' AS severity, path FROM sc WHERE contains(t, 'http://') AND NOT contains(t, 'http://localhost') UNION ALL SELECT 'WEB-002', 'high', path FROM sc WHERE regexp_matches(t, '<script[^>]*>') UNION ALL SELECT 'WEB-003', 'low', path FROM sc WHERE starts_with(t, '<style'))"

QUERIES = {
    "scan_security": (scan, f"WITH {_SCAN} SELECT rule_id, severity, path, count(*) AS n FROM f GROUP BY 1, 2, 3"),
    "scan_security_page": (scan_page, f"WITH {_SCAN} SELECT rule_id, path FROM f WHERE severity = 'high' ORDER BY path, rule_id LIMIT 20 OFFSET 10"),
    "check_owasp_top10": (owasp, f"WITH {_SCAN}, c AS (SELECT unnest(CASE rule_id WHEN 'WEB-001' THEN ['A02'] WHEN 'WEB-002' THEN ['A03'] ELSE ['A05', 'A03'] END) AS category, severity FROM f) SELECT category, severity, count(*) AS n FROM c GROUP BY ROLLUP (category, severity)"),
    "get_security_summary": (security_summary, f"WITH {_SCAN} SELECT rule_id, count(*) AS n, max(severity) AS risk FROM f GROUP BY 1"),
    "rule_secret": (secrets, "WITH ln AS (SELECT source || '/' || doc_id AS path, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS line, unnest(string_split(text, chr(10))) AS t FROM documents), m AS (SELECT path, line, regexp_extract(t, '[a-f0-9]{40}') AS s FROM ln WHERE regexp_matches(t, '[a-f0-9]{40}')) SELECT path, line, left(s, 4) || '...' || right(s, 4) AS snippet FROM m WHERE (SELECT -sum(n / 40.0 * log2(n / 40.0)) FROM (SELECT count(*) AS n FROM (SELECT unnest(string_split(s, '')) AS ch) GROUP BY ch)) >= 3.0"),
    "rule_secret_all": (secrets_all, "WITH ln AS (SELECT source || '/' || doc_id AS path, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS line, unnest(string_split(text, chr(10))) AS t FROM documents), a AS (SELECT path, line, regexp_extract_all(t, '[a-f0-9]{40}') AS hits, regexp_split_to_array(t, '[a-f0-9]{40}') AS parts FROM ln WHERE regexp_matches(t, '[a-f0-9]{40}')), m AS (SELECT path, line, hits, parts, unnest(hits) AS s, generate_subscripts(hits, 1) AS i FROM a) SELECT path, line, CAST(1 + length(array_to_string(parts[1:i], '')) + 40 * (i - 1) AS INTEGER) AS col, left(s, 4) || '...' || right(s, 4) AS snippet FROM m WHERE (SELECT -sum(n / 40.0 * log2(n / 40.0)) FROM (SELECT count(*) AS n FROM (SELECT unnest(string_split(s, '')) AS ch) GROUP BY ch)) >= 3.0"),
    "suggest_fix": (fixes, f"WITH {_SCAN} SELECT DISTINCT rule_id, CASE rule_id WHEN 'WEB-001' THEN 'Use an encrypted connection.' WHEN 'WEB-002' THEN 'Escape data before it goes into a page.' ELSE 'Review the line against its rule.' END AS fix FROM f"),
    "explain_vulnerability": (explained, f"WITH {_SCAN}, c AS (SELECT rule_id, unnest(CASE rule_id WHEN 'WEB-001' THEN ['CWE-319'] WHEN 'WEB-002' THEN ['CWE-79'] ELSE ['CWE-1021'] END) AS cwe_id FROM f) SELECT DISTINCT rule_id, cwe_id, CASE cwe_id WHEN 'CWE-79' THEN 'Cross-site Scripting' END AS title FROM c"),
    "check_cwe_top25": (cwe_top, f"WITH {_SCAN} SELECT 'CWE-79' AS cwe_id, 'Cross-site Scripting' AS title, 'high' AS severity, count(*) AS n FROM f WHERE rule_id = 'WEB-002' HAVING count(*) > 0"),
    "redact_secrets": (redacted, _redacted_sql()),
    "calculate_entropy": (entropies, "SELECT c_custkey, round((SELECT -sum(n / strlen(c_name) * log2(n / strlen(c_name))) FROM (SELECT count(*) AS n FROM (SELECT unnest(string_split(c_name, '')) AS ch) GROUP BY ch)), 6) AS bits FROM customer"),
    "check_dependencies": (check_dependencies, _VULN + " SELECT adv_id AS id, severity, breaking, count(*) AS n FROM hit GROUP BY 1, 2, 3"),
    "find_upgrade_path": (upgrade_path, _VULN + " SELECT name, version, min(fixed) AS to_version, min(severity) AS severity, bool_or(breaking) AS breaking, count(*) AS n FROM hit GROUP BY name, version, ecosystem"),
    "check_licenses": (licences, DEPS_SQL + " SELECT CASE WHEN license IN ('GPL-3.0', 'MPL-2.0') THEN 'copyleft' WHEN license IN ('MIT', 'Apache-2.0', 'BSD-3-Clause') THEN 'permissive' ELSE 'unknown' END AS class, count(*) AS n, count(*) FILTER (license IN ('GPL-3.0', 'MPL-2.0')) AS n_clash FROM deps GROUP BY 1"),
    "generate_sbom": (sbom, DEPS_SQL + " SELECT name, count(*) AS n, CAST(sum(length('{\"name\":\"' || name || '\",\"version\":\"' || version || '\",\"ecosystem\":\"' || ecosystem || '\"' || coalesce(',\"license\":\"' || license || '\"', '') || '}')) AS BIGINT) AS n_chars FROM deps GROUP BY 1"),
    "purl": (purls, DEPS_SQL + " SELECT id, 'pkg:' || ecosystem || '/' || name || '@' || version AS purl FROM deps"),
    "sparql_query": (sparql_select, "SELECT c_name AS customer, n_name AS nation, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_mktsegment = 'BUILDING' ORDER BY c_name LIMIT 200"),
    "sparql_union": (sparql_union, "SELECT r_name AS name FROM region UNION SELECT n_name FROM nation WHERE contains(lower(n_name), 'nation_1')"),
    "sparql_ask": (sparql_ask, "SELECT count(*) > 0 AS answer FROM region WHERE r_name = 'ASIA'"),
    "export_nquads": (nquads, f"WITH {_TR} SELECT '<' || s || '> <urn:code:' || p || '> \"' || o || '\" <urn:graph:default> .' AS quad FROM tr"),
    "import_nquads": (nquads_read, f"WITH {_TR} SELECT p, count(*) AS n, count(DISTINCT o) AS objects FROM tr GROUP BY 1"),
    "get_project_structure": (structure, "WITH c AS (SELECT r_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT r_name AS path, count(*) AS n FROM c GROUP BY 1 UNION ALL SELECT r_name || '/' || n_name, count(*) FROM c GROUP BY 1"),
    "list_repos": (list_repos, "SELECT source AS repo, lang AS language, count(*) AS files, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY ROLLUP (source, lang) HAVING source IS NOT NULL"),
    "get_index_status": (index_status, "SELECT lang AS language, count(*) AS n, round(avg(length(text)), 6) AS avg_chars FROM documents GROUP BY 1"),
    "merkle_build": (merkle, "SELECT source || '/' || doc_id AS path, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS size FROM documents"),
    "merkle_folders": (merkle_folders, "WITH f AS (SELECT source, doc_id || sha256(text) AS x FROM documents), s AS (SELECT source, sha256(string_agg(x, '' ORDER BY x)) AS h FROM f GROUP BY 1) SELECT 'root/' || source AS path, h AS sha256 FROM s UNION ALL SELECT 'root', sha256(string_agg(source || h, '' ORDER BY source || h)) FROM s"),
    "merkle_diff": (snapshot_diff, "WITH a AS (SELECT o_orderkey AS k, o_totalprice AS m FROM orders WHERE o_orderstatus <> 'P'), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS m FROM orders WHERE o_orderstatus <> 'F') SELECT coalesce(a.k, b.k) AS path, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'deleted' ELSE 'modified' END AS op FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.m <> b.m"),
    "process_file_changes": (upserted, "WITH c AS (SELECT event_id % 500 AS path, user_id AS v, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_id % 500 ORDER BY event_id DESC) = 1) SELECT o_orderkey AS path, o_custkey AS v FROM orders WHERE o_orderkey NOT IN (SELECT path FROM c) UNION ALL SELECT path, v FROM c WHERE event_type <> 'error'"),
    "lru_eviction": (lru, "SELECT user_id AS key, count(*) AS hits FROM events GROUP BY 1 ORDER BY max(ts) DESC, user_id LIMIT 20"),
    "ttl_expiry": (ttl, "SELECT count(*) AS n FROM events WHERE floor(epoch((SELECT max(ts) FROM events))) - floor(epoch(ts)) <= 86400"),
    "findings_anti_join": (labels_join, "SELECT lang, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1"),
    "json_functions": (json_functions, "SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1"),
    "aggregate_languages": (language_share, "SELECT lang, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM documents GROUP BY 1"),
    "parse_url": (url_parts, "SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages"),
    "get_import_graph": (import_graph, "WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1)) AS target FROM pages) SELECT target, count(*) AS n, count(DISTINCT page_id) AS pages FROM l GROUP BY 1"),
}
