"""Dependencies against advisories and licences, and bills of materials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.packages import ADVISORIES, COMPATIBLE, LICENCES, major_change, purl, severity_of_cvss, version_lt

RANK = ["unknown", "low", "medium", "high", "critical"]


def advisories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ADVISORIES, "id string, ecosystem string, package string, fixed string, cvss double").withColumn("severity", severity_of_cvss(F.col("cvss")))


def vulnerable(deps: DataFrame, known: DataFrame, least: str = "unknown", include_dev: bool = True) -> DataFrame:
    """(name, version, ecosystem, id, severity, fixed, breaking) of deps below a fixed version; Go packages match by part of their name."""
    rank = F.array_position(F.array(*[F.lit(x) for x in RANK]), F.col("severity"))
    a = known.select("id", F.col("ecosystem").alias("eco"), "package", "fixed", "severity").where(rank >= RANK.index(least) + 1)
    d = deps if include_dev or "dev" not in deps.columns else deps.where(~F.coalesce("dev", F.lit(False)))
    d = d.select("name", "version", "ecosystem")
    exact = d.join(a, (d["ecosystem"] == a["eco"]) & (d["name"] == a["package"]))
    part = d.where("ecosystem = 'golang'").join(a.where("eco = 'golang'"), (F.col("ecosystem") == F.col("eco")) & F.contains("name", F.col("package")) & (F.col("name") != F.col("package")))
    met = exact.unionByName(part).where(version_lt(F.col("version"), F.col("fixed")))
    return met.select("name", "version", "ecosystem", "id", "severity", "fixed", major_change(F.col("version"), F.col("fixed")).alias("breaking"))


def upgrades(found: DataFrame) -> DataFrame:
    """The first fixed version of each vulnerable dependency, its worst severity, and whether the major version changes."""
    rank = F.array_position(F.array(*[F.lit(x) for x in RANK]), F.col("severity"))
    by = found.groupBy("name", "version", "ecosystem").agg(F.min_by("fixed", "id").alias("to_version"), F.max(rank).alias("r"), F.count("*").alias("n"))
    return by.select("name", "version", "ecosystem", "to_version", F.element_at(F.array(*[F.lit(x) for x in RANK]), F.col("r").cast("int")).alias("severity"), major_change(F.col("version"), F.col("to_version")).alias("breaking"), "n")


def licence_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in LICENCES.items()], "licence_id string, copyleft boolean, permissive boolean, osi boolean")


def classify_licences(deps: DataFrame, project: str | None = None) -> DataFrame:
    """deps with class (copyleft, permissive, other, unknown) and compatible; only copyleft licences can clash with the project's."""
    spark = deps.sparkSession
    joined = deps.join(licence_table(spark), F.lower("license") == F.col("licence_id"), "left")
    kind = F.when(F.col("license").isNull() | F.col("licence_id").isNull(), "unknown").when(F.col("copyleft"), "copyleft").when(F.col("permissive"), "permissive").otherwise("other")
    fine = COMPATIBLE.get((project or "").lower())
    clash = F.lit(False) if fine is None else F.coalesce(F.col("copyleft"), F.lit(False)) & ~F.lower("license").isin(fine)
    return joined.select(*deps.columns, kind.alias("class"), (~clash).alias("compatible"))


def licence_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("class").agg(F.count("*").alias("n"), F.count_if(~F.col("compatible")).alias("n_clash"))


def sbom(deps: DataFrame, form: str = "cyclonedx") -> DataFrame:
    """One JSON line for each component, in CycloneDX, SPDX or plain form; the document is their list."""
    p = purl(F.col("ecosystem"), F.col("name"), F.col("version"))
    if form == "spdx":
        body = F.struct(F.concat(F.lit("SPDXRef-"), F.regexp_replace("name", "[^A-Za-z0-9.-]", "-")).alias("SPDXID"), F.col("name"), F.col("version").alias("versionInfo"), F.coalesce("license", F.lit("NOASSERTION")).alias("licenseConcluded"), p.alias("referenceLocator"))
    elif form == "cyclonedx":
        body = F.struct(F.lit("library").alias("type"), F.col("name"), F.col("version"), p.alias("purl"), F.col("license"))
    else:
        body = F.struct("name", "version", "ecosystem", "license")
    return deps.select("name", "version", F.to_json(body).alias("component"))
