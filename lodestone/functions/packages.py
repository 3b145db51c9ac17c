"""Column functions over package versions, licences and ecosystems."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: licences as (copyleft, permissive, approved)
LICENCES = {
    "mit": (False, True, True), "apache-2.0": (False, True, True), "bsd-2-clause": (False, True, True), "bsd-3-clause": (False, True, True), "isc": (False, True, True),
    "unlicense": (False, True, False), "cc0-1.0": (False, True, False), "gpl-2.0": (True, False, True), "gpl-2.0-only": (True, False, True), "gpl-3.0": (True, False, True), "gpl-3.0-only": (True, False, True),
    "lgpl-2.1": (True, False, True), "lgpl-3.0": (True, False, True), "agpl-3.0": (True, False, True), "mpl-2.0": (True, False, True), "eupl-1.2": (True, False, True), "bsl-1.0": (False, True, True),
}
# fixed values: licences that a project's licence goes with
COMPATIBLE = {"mit": "apache-2.0 bsd-2-clause bsd-3-clause isc unlicense cc0-1.0 bsl-1.0".split(), "apache-2.0": "mit bsd-2-clause bsd-3-clause isc gpl-3.0 lgpl-3.0".split()}
# fixed values: known advisories (id, ecosystem, package, fixed in, cvss)
ADVISORIES = [("GHSA-jf85-cpcp-j695", "npm", "lodash", "4.17.21", 7.2), ("GHSA-wf5p-g6vw-rhxx", "npm", "axios", "1.6.0", 6.5), ("GHSA-j8r2-6x86-q33q", "pypi", "requests", "2.31.0", 6.1), ("RUSTSEC-2022-0013", "cargo", "regex", "1.5.5", 7.5), ("GO-2023-2102", "golang", "golang.org/x/net", "0.17.0", 7.5)]
# fixed values: package URL types by manifest
ECOSYSTEMS = {"Cargo.toml": "cargo", "Cargo.lock": "cargo", "package.json": "npm", "package-lock.json": "npm", "yarn.lock": "npm", "requirements.txt": "pypi", "pyproject.toml": "pypi", "Pipfile": "pypi", "setup.py": "pypi", "go.mod": "golang", "go.sum": "golang", "pom.xml": "maven", "packages.config": "nuget"}


def version_parts(version: Column) -> Column:
    """Numbers of a version; operators in front go, and parts that are no numbers are left out."""
    bare = F.regexp_replace(version, r"^[=><~^v ]+", "")
    return F.filter(F.transform(F.split(bare, r"[.\-]"), lambda p: F.when(p.rlike(r"^[0-9]{1,9}$"), p.cast("int"))), lambda p: p.isNotNull())


def version_lt(a: Column, b: Column) -> Column:
    """Number by number; a shorter version that agrees so far is less."""
    return version_parts(a) < version_parts(b)


def major_change(a: Column, b: Column) -> Column:
    return ~F.get(version_parts(a), 0).eqNullSafe(F.get(version_parts(b), 0))


def severity_of_cvss(score: Column) -> Column:
    return F.when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").when(score > 0, "low").otherwise("unknown")


def purl(ecosystem: Column, name: Column, version: Column) -> Column:
    return F.concat(F.lit("pkg:"), F.coalesce(ecosystem, F.lit("generic")), F.lit("/"), name, F.lit("@"), version)


def ecosystem_of(file_name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in ECOSYSTEMS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, file_name), F.when(F.endswith(file_name, F.lit(".csproj")), "nuget"), F.lit("unknown"))
