"""Layers that describe a repository: manifest, architecture, symbol index, full detail; and who may read them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators import rdf

# fixed values: tiers and the layers they open, from the first on
TIERS = {"public": 1, "authenticated": 2, "member": 3, "triple-heart": 3, "owner": 4}
LAYERS = ["manifest", "architecture", "index", "full"]
ENTRY_POINTS = ["main", "run", "start", "init", "handler", "app"]


def manifest(symbols: DataFrame, files: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """One row of counts and a JSON document: symbols by family, shares of languages, at most five entry points, findings by severity."""
    count = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    s = symbols.agg(F.count("*").alias("symbols"), count("function", "method").alias("functions"), count("class", "struct").alias("classes"), count("trait", "interface").alias("traits"))
    w = Window.partitionBy(F.lit(1))
    langs = files.groupBy("language").agg(F.count("*").alias("n")).withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(w), 2)).agg(F.array_sort(F.collect_list(F.struct("language", "n", "pct"))).alias("languages"))
    first = symbols.where(F.col("name").isin(ENTRY_POINTS)).orderBy("path", "start_line").limit(5).agg(F.array_sort(F.collect_list(F.struct("path", "name"))).alias("entry_points"))
    parts = [s, langs, first]
    if findings is not None:
        parts.append(findings.agg(*[F.count_if(F.col("severity") == x).alias(x) for x in ("critical", "high", "medium", "low", "info")]))
    row = parts[0]
    for p in parts[1:]:  # rows of aggregates: one each
        row = row.crossJoin(p)
    return row.withColumn("document", F.to_json(F.struct(*row.columns)))


def modules(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("module")).agg(F.count("*").alias("symbols"), F.count_distinct("path").alias("files"))


def module_dependencies(import_edges: DataFrame) -> DataFrame:
    folder = lambda c: F.regexp_extract(c, r"^(.*)/[^/]*$", 1)
    return import_edges.groupBy(folder("src").alias("from_module"), folder("dst").alias("to_module")).agg(F.count("*").alias("n"))


def architecture(symbols: DataFrame, exports: DataFrame, import_edges: DataFrame) -> dict[str, DataFrame]:
    """Modules, at most 100 public names, dependencies of modules, and at most 20 abstractions."""
    return {"modules": modules(symbols), "public_api": exports.orderBy("file", "line").limit(100), "dependencies": module_dependencies(import_edges), "abstractions": symbols.where(F.col("kind").isin("trait", "interface", "class")).orderBy("path", "start_line").limit(20)}


def index_layer(symbols: DataFrame) -> DataFrame:
    return rdf.nquads(rdf.symbol_triples(symbols))


def full_layer(symbols: DataFrame, calls: DataFrame, import_edges: DataFrame, findings: DataFrame) -> DataFrame:
    """The index with calls, imports and findings."""
    c = rdf.triples_of(calls, F.concat(F.lit("urn:code/"), F.col("caller")), {"calls": F.concat(F.lit("urn:code/"), F.col("target"))})
    i = rdf.triples_of(import_edges, F.concat(F.lit("urn:code/"), F.col("src")), {"imports": F.concat(F.lit("urn:code/"), F.col("dst"))})
    f = rdf.triples_of(findings, F.concat_ws("/", F.lit("urn:finding"), "rule_id", "path", F.col("line").cast("string")), {"ruleId": F.col("rule_id"), "severity": F.upper("severity"), "filePath": F.col("path"), "startLine": F.col("line")})
    return rdf.nquads(rdf.symbol_triples(symbols).unionByName(c).unionByName(i).unionByName(f))


def export(layers: dict[str, DataFrame], folder: str) -> None:
    """Each layer as gzipped lines below folder."""
    for name, lines in layers.items():
        lines.select(F.col(lines.columns[-1]).alias("value")).write.mode("overwrite").option("compression", "gzip").text(f"{folder}/{name}")


def load_layer(spark: SparkSession, path: str) -> DataFrame:
    """Triples of an exported index or full layer, plain or gzipped."""
    return rdf.parse_nquads(spark.read.text(path))


def access(spark: SparkSession) -> DataFrame:
    """(tier, layer, allowed) of all tiers."""
    return spark.createDataFrame([(t, name, i < n) for t, n in TIERS.items() for i, name in enumerate(LAYERS)], "tier string, layer string, allowed boolean")


def readable(acl: DataFrame, agent: str, authenticated: bool = False) -> DataFrame:
    """Resources of acl(resource, tier, modes, agents) that the agent may read."""
    open_to = (F.col("tier") == "public") | ((F.col("tier") == "authenticated") & F.lit(authenticated)) | F.array_contains("agents", agent)
    return acl.where(F.array_contains("modes", "Read") & open_to)
