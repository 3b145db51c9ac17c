"""Security rules over lines and files, findings, secrets, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import entropy, is_comment_line, redact_secret

SEVERITIES = ["info", "low", "medium", "high", "critical"]
RULE_SCHEMA = "id string, name string, severity string, rule_type string, patterns array<string>, safe_patterns array<string>, languages array<string>, cwe array<string>, owasp array<string>, tags array<string>, threshold double"


def severity_rank(severity: Column) -> Column:
    """Place of a severity; unknown ones count as low."""
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.lower(severity)).cast("int") - 1, F.lit(1))


def scan(lines: DataFrame, rules: list[dict], least: str = "low", every: bool = True) -> DataFrame:
    """Findings (rule_id, severity, path, line, col, snippet, cwe, owasp) of pattern and secret rules.

    Rules are data of bounded size, so they become one expression: an array of the matching rules of each line. A line is
    read once for all rules; only lines with a match leave the scan. Every match of a pattern on a line is a finding, secrets
    by their own entropy; without every only the first one counts. A safe pattern on the line clears its matches. Matches
    of no characters are none. lines(path, line, text, language).
    """
    low = SEVERITIES.index(least)
    made = []
    for r in {r["id"]: r for r in rules}.values():
        if SEVERITIES.index(r["severity"]) < low or r.get("rule_type", "pattern") not in ("pattern", "secret", "crypto"):
            continue
        langs = r.get("languages") or ["*"]
        fits = F.lit(True) if "*" in langs else F.col("language").isin(langs)
        safe = F.lit(False)
        for p in r.get("safe_patterns") or []:
            safe = safe | F.col("text").rlike(p)
        if r.get("rule_type") == "crypto":
            safe = safe | is_comment_line(F.col("text"))
        bound = float(r.get("threshold") or 0.0) if r.get("rule_type") == "secret" else None
        strings = lambda x: F.array(*[F.lit(v) for v in x or []]).cast("array<string>")
        for p in r["patterns"]:
            own = F.struct(F.lit(r["id"]).alias("rule_id"), F.lit(r["severity"]).alias("severity"), F.lit(bound).cast("double").alias("bound"), strings(r.get("cwe")).alias("cwe"), strings(r.get("owasp")).alias("owasp"), F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias("hits"), F.split("text", p, -1).alias("between"))
            made.append(F.when(fits & ~safe & F.col("text").rlike(p), own))
    if not made:
        return lines.sparkSession.createDataFrame([], "rule_id string, severity string, path string, line int, col int, snippet string, cwe array<string>, owasp array<string>")
    found = lines.select("path", "line", F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("f"))
    # a match stands behind the matches before it and what lies between them
    hits = F.col("f.hits") if every else F.slice("f.hits", 1, 1)
    before = lambda i: F.length(F.array_join(F.slice("f.between", 1, i + 1), "")) + F.length(F.array_join(F.slice("f.hits", 1, i), ""))
    each = found.select("path", "line", "f", F.explode(F.transform(hits, lambda h, i: F.struct(h.alias("hit"), (before(i) + 1).alias("col")))).alias("m")).where("m.hit <> ''")
    each = each.where(F.col("f.bound").isNull() | (entropy(F.col("m.hit")) >= F.col("f.bound")))
    shown = F.when(F.col("f.bound").isNull(), F.col("m.hit")).otherwise(redact_secret(F.col("m.hit")))
    return each.select("f.rule_id", "f.severity", "path", "line", "m.col", shown.alias("snippet"), "f.cwe", "f.owasp").dropDuplicates(["rule_id", "path", "line", "col"])


def page(findings: DataFrame, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Findings by falling severity, then path, line and rule."""
    ordered = findings.orderBy(severity_rank(F.col("severity")).desc(), "path", "line", "rule_id").offset(offset)
    return ordered.limit(limit) if limit is not None else ordered


def by_category(findings: DataFrame, column: str = "owasp") -> DataFrame:
    """Counts by category and severity, and over both (null stands for all)."""
    return findings.select(F.explode(column).alias("category"), "severity").rollup("category", "severity").agg(F.count("*").alias("n"))


def summary(findings: DataFrame) -> DataFrame:
    """Counts by severity and kind, and the risk: the highest severity found."""
    names = F.array(*[F.lit(s) for s in SEVERITIES])
    return findings.groupBy("rule_id").agg(F.count("*").alias("n"), F.element_at(names, F.max(severity_rank(F.col("severity"))) + 1).alias("risk"))


def covering(findings: DataFrame, path: str, line: int, around: int = 0) -> DataFrame:
    return findings.where((F.col("path") == path) & (F.abs(F.col("line") - line) <= around))


# fixed values: weaknesses of the yearly list of 25, with their names
CWE_TOP25 = {
    "CWE-787": "Out-of-bounds Write", "CWE-79": "Cross-site Scripting", "CWE-89": "SQL Injection", "CWE-416": "Use After Free", "CWE-78": "OS Command Injection",
    "CWE-20": "Improper Input Validation", "CWE-125": "Out-of-bounds Read", "CWE-22": "Path Traversal", "CWE-352": "Cross-Site Request Forgery", "CWE-434": "Unrestricted Upload of File with Dangerous Type",
    "CWE-862": "Missing Authorization", "CWE-476": "NULL Pointer Dereference", "CWE-287": "Improper Authentication", "CWE-190": "Integer Overflow or Wraparound", "CWE-502": "Deserialization of Untrusted Data",
    "CWE-77": "Command Injection", "CWE-119": "Improper Restriction of Operations within the Bounds of a Memory Buffer", "CWE-798": "Use of Hard-coded Credentials", "CWE-918": "Server-Side Request Forgery", "CWE-306": "Missing Authentication for Critical Function",
    "CWE-362": "Race Condition", "CWE-269": "Improper Privilege Management", "CWE-94": "Code Injection", "CWE-863": "Incorrect Authorization", "CWE-276": "Incorrect Default Permissions",
}
#: What to do about a weakness, for the rules that name it.
FIXES = {"CWE-79": "Escape data before it goes into a page.", "CWE-89": "Bind values as parameters of the statement.", "CWE-78": "Pass arguments as a list, without a shell.", "CWE-22": "Resolve the path and compare it with its root.", "CWE-798": "Read the secret from the environment or a vault.", "CWE-319": "Use an encrypted connection."}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def cwe_top25(findings: DataFrame) -> DataFrame:
    """(cwe_id, title, severity, n) for the weaknesses of the list that findings name."""
    each = findings.select(F.explode("cwe").alias("cwe_id"), "severity").where(F.col("cwe_id").isin(*CWE_TOP25))
    return each.groupBy("cwe_id", "severity").agg(F.count("*").alias("n")).select("cwe_id", _lookup(CWE_TOP25, F.col("cwe_id")).alias("title"), "severity", "n")


def explain(findings: DataFrame) -> DataFrame:
    """findings with cwe_id and title, a row for each weakness named; title is null for those beyond the list."""
    return findings.withColumn("cwe_id", F.explode_outer("cwe")).withColumn("title", _lookup(CWE_TOP25, F.col("cwe_id")))


def suggest(findings: DataFrame) -> DataFrame:
    """findings with fix: the advice for the first weakness that has one, else a general one."""
    known = F.filter(F.transform("cwe", lambda c: _lookup(FIXES, c)), lambda x: x.isNotNull())
    return findings.withColumn("fix", F.coalesce(F.get(known, 0), F.lit("Review the line against its rule.")))
