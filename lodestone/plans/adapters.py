"""The driver's tables in the roles of the engine's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import language_of


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("source").alias("repo"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("lang").alias("language"), F.col("text").alias("content"))


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the pages' markup: one line for each tag's start, so that rules see short lines."""
    raw = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("path"), F.posexplode(F.split(F.coalesce("html", F.lit("")), "(?=<)")))
    return raw.select("path", (F.col("pos") + 1).alias("line"), F.col("col").alias("text"), F.lit("html").alias("language"))


def conversation_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.lit("conversations").alias("repo"), F.col("conv_id").cast("string").alias("path"), (F.col("turn") + 1).cast("int").alias("line"), "text")


def commits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("hash"), F.col("user_id").alias("author"), F.col("event_type").alias("path"), "ts", "value")


def edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))


def symbols(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))


def deps(spark: SparkSession, d: str) -> DataFrame:
    """Parts as packages: the version from size and key, ecosystem and licence from fixed lists by key."""
    p = table(spark, d, "part")
    pick = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(by, F.lit(len(values))) + 1).cast("int"))
    return p.select(
        pick(["lodash", "axios", "requests", "regex", "golang.org/x/net", "other"], F.col("p_partkey")).alias("name"),
        F.concat_ws(".", F.pmod("p_size", F.lit(5)).cast("string"), F.pmod("p_size", F.lit(40)).cast("string"), F.pmod("p_partkey", F.lit(30)).cast("string")).alias("version"),
        pick(["npm", "npm", "pypi", "cargo", "golang", "npm"], F.col("p_partkey")).alias("ecosystem"),
        pick(["MIT", "GPL-3.0", "Apache-2.0", "BSD-3-Clause", "Proprietary", "MPL-2.0", None], F.col("p_partkey")).alias("license"),
        (F.pmod("p_partkey", F.lit(4)) == 0).alias("dev"), F.col("p_partkey").alias("id"),
    )


def source_files(spark: SparkSession, d: str) -> DataFrame:
    """files(repo, path, language, content) written from parts: Python modules that import and call one another, settings and requirement lists.

    Part k of size s calls the part (k * s) % 97 + 1; sizes decide which lines a module has, so every finding follows from the table.
    """
    s, k = F.col("p_size"), F.col("p_partkey").cast("long")
    number = lambda c: c.cast("string")
    to = number(F.pmod(k * s, F.lit(97)) + 1)
    lines = [
        F.lit("import os"), F.lit("import json as js"), F.concat(F.lit("from pkg.p"), to, F.lit(" import run_"), to), F.lit(""),
        F.concat(F.lit("def run_"), number(k), F.lit("(a, b):")), F.concat(F.lit("    x = "), number(s)), F.lit("    while a > x:"), F.lit("        a = a - 1"),
        F.when(s % 3 == 1, F.lit("    if b and z:")).otherwise(F.lit("    if b:")), F.concat(F.lit("        return run_"), to, F.lit("(a, b)")),
        F.when(s % 6 == 0, F.lit("    q = shlex.quote(input())")).when(s % 3 == 0, F.lit("    q = input()")).otherwise(F.lit('    q = "text"')),
        F.lit("    os.system(q)"), F.lit("    z = a"), F.when(s % 2 == 0, F.lit("    return z")).otherwise(F.lit("    return a")), F.when(s % 5 == 0, F.lit("    print(z)")),
    ]
    settings, wanted = s % 7 == 0, s % 11 == 0
    path = F.when(settings, F.concat(F.lit("conf/p"), number(k), F.lit("/.env"))).when(wanted, F.concat(F.lit("req/p"), number(k), F.lit("/requirements.txt"))).otherwise(F.concat(F.lit("pkg/p"), number(k), F.lit(".py")))
    content = F.when(settings, F.concat(F.lit("KEY="), number(s))).when(wanted, F.concat(F.lit("requests=="), number(s), F.lit("."), number(F.pmod(k, F.lit(30))), F.lit(".0\nflask\n"))).otherwise(F.concat_ws("\n", *lines))
    # a part's row is small and its module is parsed, so a file of parts that Spark would read in one task is dealt out first
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return table(spark, d, "part").select("p_partkey", "p_size").repartition(tasks, "p_partkey").select(F.lit("parts").alias("repo"), path.alias("path"), content.alias("content")).withColumn("language", language_of(F.col("path")))


#: The modules of source_files in SQL: k, its size s and the part that it calls.
MODULES_SQL = "m AS (SELECT p_partkey AS k, p_size AS s, (p_partkey * p_size) % 97 + 1 AS dst, 'pkg/p' || p_partkey || '.py' AS path, 'run_' || p_partkey || '@5' AS fn FROM part WHERE p_size % 7 <> 0 AND p_size % 11 <> 0)"

DEPS_SQL = """
WITH deps AS (SELECT (['lodash','axios','requests','regex','golang.org/x/net','other'])[p_partkey % 6 + 1] AS name,
  (p_size % 5)::VARCHAR || '.' || (p_size % 40)::VARCHAR || '.' || (p_partkey % 30)::VARCHAR AS version,
  (['npm','npm','pypi','cargo','golang','npm'])[p_partkey % 6 + 1] AS ecosystem,
  (['MIT','GPL-3.0','Apache-2.0','BSD-3-Clause','Proprietary','MPL-2.0',NULL])[p_partkey % 7 + 1] AS license,
  p_partkey % 4 = 0 AS dev, p_partkey AS id, [p_size % 5, p_size % 40, p_partkey % 30] AS v FROM part),
adv AS (SELECT * FROM (VALUES ('GHSA-jf85-cpcp-j695','npm','lodash','4.17.21','high',[4,17,21]), ('GHSA-wf5p-g6vw-rhxx','npm','axios','1.6.0','medium',[1,6,0]),
  ('GHSA-j8r2-6x86-q33q','pypi','requests','2.31.0','medium',[2,31,0]), ('RUSTSEC-2022-0013','cargo','regex','1.5.5','high',[1,5,5]), ('GO-2023-2102','golang','golang.org/x/net','0.17.0','high',[0,17,0])) a(adv_id, eco, package, fixed, severity, f))
"""
