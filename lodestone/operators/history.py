"""Statistics over commits(hash, author, path, ts, ins, del) and tool runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def churn(commits: DataFrame, k: int | None = 20) -> DataFrame:
    """(path, commits, authors, churn): commits by the most of any path, times the root of the number of authors."""
    by = commits.groupBy("path").agg(F.count_distinct("hash").alias("commits"), F.count_distinct("author").alias("authors"), F.max("ts").alias("last_modified"))
    most = by.agg(F.max("commits").alias("most"))
    scored = by.join(F.broadcast(most)).select("path", "commits", "authors", F.round(F.col("commits") / F.col("most") * F.sqrt("authors"), 6).alias("churn"), "last_modified")
    return scored.orderBy(F.desc("churn"), "path").limit(k) if k else scored


def contributors(commits: DataFrame, path: str | None = None) -> DataFrame:
    rows = commits if path is None else commits.where(F.col("path") == path)
    return rows.groupBy("author").agg(F.count_distinct("hash").alias("commits"))


def recent(commits: DataFrame, days: int = 7, now: Column | None = None) -> DataFrame:
    """Commits of the last days before now (the clock, if not given)."""
    return commits.where(F.col("ts") >= (now if now is not None else F.current_timestamp()) - F.expr(f"interval {int(days)} days"))


def file_history(commits: DataFrame, path: str, k: int = 20) -> DataFrame:
    by = commits.where(F.col("path") == path).groupBy("hash", "author", "ts").agg(F.sum(F.coalesce("ins", F.lit(0))).alias("ins"), F.sum(F.coalesce("del", F.lit(0))).alias("del"))
    return by.orderBy(F.desc("ts"), "hash").limit(k)


def symbol_history(diff_lines: DataFrame, symbol: str, k: int = 10) -> DataFrame:
    """Commits whose added and removed lines hold the symbol differently often."""
    n = F.regexp_count("text", F.lit(r"\b" + symbol + r"\b"))
    by = diff_lines.groupBy("hash").agg(F.max("ts").alias("ts"), F.sum(F.when(F.col("sign") == "+", n).otherwise(0)).alias("added"), F.sum(F.when(F.col("sign") == "-", n).otherwise(0)).alias("removed"))
    return by.where("added <> removed").orderBy(F.desc("ts"), "hash").limit(k)


def run_metrics(runs: DataFrame, by: str = "tool", value: str = "duration") -> DataFrame:
    """Count, total, extremes, mean and nearest-rank percentiles."""
    at = lambda p: F.expr(f"percentile_disc({p}) within group (order by {value})")
    return runs.groupBy(by).agg(F.count(value).alias("n"), F.round(F.sum(value), 4).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"), F.round(F.avg(value), 6).alias("mean"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


def blame_range(blame: DataFrame, path: str, start: int | None = None, end: int | None = None) -> DataFrame:
    rows = blame.where(F.col("path") == path)
    if start is not None:
        rows = rows.where(F.col("line") >= start)
    return rows.where(F.col("line") <= end) if end is not None else rows


def required_before(events: DataFrame, key: str, order: list[str], sink: Column, required: Column) -> DataFrame:
    """Sink rows without an earlier required row of the same key."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("__ok", F.max(F.when(required, 1).otherwise(0)).over(w)).where(sink & (F.coalesce("__ok", F.lit(0)) == 0)).drop("__ok")
