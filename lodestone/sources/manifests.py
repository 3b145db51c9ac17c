"""Package manifests, git logs and rule files as tables."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEPS = "repo string, path string, name string, version string, ecosystem string, license string, dev boolean"


def parse_manifest(name: str, text: str) -> list[tuple]:
    """(name, version, ecosystem, license, dev) of a manifest; nothing from a broken one."""
    try:
        if name == "Cargo.toml":
            doc, out = tomllib.loads(text), []
            for key, dev in (("dependencies", False), ("dev-dependencies", True), ("build-dependencies", True)):
                for n, v in doc.get(key, {}).items():
                    out.append((n, v if isinstance(v, str) else str(v.get("version", "*")), "cargo", None, dev))
            return out
        if name == "Cargo.lock":
            return [(p["name"], p["version"], "cargo", None, False) for p in tomllib.loads(text).get("package", [])]
        if name == "pyproject.toml":
            found = tomllib.loads(text).get("project", {}).get("dependencies", [])
            return [r for line in found for r in parse_manifest("requirements.txt", line)]
        if name == "package.json":
            doc = json.loads(text)
            return [(n, v, "npm", None, dev) for key, dev in (("dependencies", False), ("devDependencies", True)) for n, v in doc.get(key, {}).items()]
        if name == "package-lock.json":
            doc = json.loads(text)
            if "packages" in doc:
                return [(p.rpartition("node_modules/")[2], v.get("version", ""), "npm", v.get("license"), bool(v.get("dev"))) for p, v in doc["packages"].items() if p]
            return [(n, v.get("version", ""), "npm", None, bool(v.get("dev"))) for n, v in doc.get("dependencies", {}).items()]
        if name == "requirements.txt":
            out = []
            for line in text.split("\n"):
                m = re.match(r"^\s*([A-Za-z0-9._-]+)(?:\[[^\]]*\])?\s*(?:(==|>=|<=|~=|!=|>|<)\s*([^\s,;#]+))?", line)
                if m and not line.lstrip().startswith(("#", "-")):
                    out.append((m[1], m[3] or "*", "pypi", None, False))
            return out
        if name == "go.mod":
            body = re.sub(r"//[^\n]*", "", text)
            block = "\n".join(re.findall(r"require\s*\((.*?)\)", body, re.S)) + "\n" + "\n".join(re.findall(r"^require\s+([^(\n]+)$", body, re.M))
            return [(m[1], m[2], "golang", None, False) for m in re.finditer(r"^\s*(\S+)\s+(v\S+)", block, re.M)]
    except (ValueError, KeyError, AttributeError, TypeError):
        return []
    return []


def dependencies_of(files: DataFrame) -> DataFrame:
    """Dependencies of files(repo, path, content) that are manifests."""
    wanted = files.where(F.col("path").rlike(r"(^|/)(Cargo\.(toml|lock)|pyproject\.toml|package(-lock)?\.json|requirements\.txt|go\.mod)$"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(repo, path, *d) for repo, path, text in b.itertuples(index=False) if text for d in parse_manifest(path.rpartition("/")[2], text)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DEPS.split(", ")])

    return wanted.select("repo", "path", "content").mapInPandas(run, DEPS)


def git_log(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Commits and their files from lines(repo, n, value) of `git log --numstat --format=%H|%an|%ae|%at|%s`.

    A file line takes the last commit line above it; '-' counts as 0.
    """
    head = r"^([0-9a-f]{40})\|([^|]*)\|([^|]*)\|([0-9]+)\|(.*)$"
    part = lambda i: F.regexp_extract("value", head, i)
    marked = lines.withColumn("hash", F.when(F.col("value").rlike(head), part(1)))
    commits = marked.where("hash is not null").select("repo", "hash", part(2).alias("author"), part(3).alias("email"), F.timestamp_seconds(part(4).cast("long")).alias("ts"), part(5).alias("subject"))
    w = Window.partitionBy("repo").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    stat = r"^(-|[0-9]+)\t(-|[0-9]+)\t(.+)$"
    stats = marked.withColumn("hash", F.last("hash", ignorenulls=True).over(w)).where(F.col("value").rlike(stat))
    count = lambda i: F.coalesce(F.regexp_extract("value", stat, i).try_cast("int"), F.lit(0))
    return commits, stats.select("repo", "hash", F.regexp_extract("value", stat, 3).alias("path"), count(1).alias("ins"), count(2).alias("del"))


def git_blame(lines: DataFrame) -> DataFrame:
    """(path, line, hash, author, ts) from lines(path, n, value) of `git blame --line-porcelain`."""
    w = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    head = r"^([0-9a-f]{40}) [0-9]+ ([0-9]+)"
    fill = lambda c: F.last(c, ignorenulls=True).over(w)
    rows = lines.withColumns({"h": F.when(F.col("value").rlike(head), F.regexp_extract("value", head, 1)), "l": F.when(F.col("value").rlike(head), F.regexp_extract("value", head, 2).cast("int")), "a": F.when(F.startswith("value", F.lit("author ")), F.substring("value", 8, 1000)), "t": F.when(F.startswith("value", F.lit("author-time ")), F.regexp_extract("value", "([0-9]+)$", 1).cast("long"))})
    rows = rows.select("path", "value", fill("h").alias("hash"), fill("l").alias("line"), fill("a").alias("author"), fill("t").alias("t"))
    return rows.where(F.startswith("value", F.lit("\t"))).select("path", "line", "hash", "author", F.timestamp_seconds("t").alias("ts"))


def validate_input(text: str) -> str:
    """The text, or an error if it could reach a shell or leave its folder."""
    if re.search(r"[;&|`$<>\n\r\0]", text) or ".." in text.split("/") or text.startswith("-"):
        raise ValueError("characters that are not allowed")
    return text


_LOOK_AROUND = re.compile(r"\(\?(=|!|<=|<!)")


def load_rules(text: str, dialect: str = "re2") -> list[dict]:
    """Rules of a YAML or TOML rule set; patterns with look-around are left out in the re2 dialect, repeated ids keep the last."""
    if re.match(r"\s*(\[|\w+\s*=)", text):
        doc = tomllib.loads(text)
    else:
        import yaml

        doc = yaml.safe_load(text)
    found = {}
    for r in doc.get("rules", []) if isinstance(doc, dict) else doc or []:
        kind = r.get("type", r.get("rule_type", "pattern"))
        patterns = r.get("patterns") or ([r["pattern"]] if r.get("pattern") else []) or [rf"\b{re.escape(a)}\b" for a in r.get("weak_algorithms", [])]
        patterns = [p for p in patterns if dialect == "java" or not _LOOK_AROUND.search(p)]
        if r.get("enabled", True) and patterns:
            found[r["id"]] = {"id": r["id"], "name": r.get("name", r["id"]), "severity": str(r.get("severity", "low")).lower(), "rule_type": kind, "patterns": patterns, "safe_patterns": r.get("safe_patterns", []), "languages": r.get("languages") or ["*"], "cwe": r.get("cwe", []), "owasp": r.get("owasp", []), "tags": r.get("tags", []), "threshold": r.get("entropy_threshold", r.get("threshold", 0.0))}
    return list(found.values())
