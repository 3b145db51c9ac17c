"""Snapshots, differences, upserts and caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def file_hashes(files: DataFrame) -> DataFrame:
    """(path, sha256, size) of files(path, content)."""
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size"))


def folder_hashes(hashed: DataFrame, depth: int) -> DataFrame:
    """(path, sha256) of all folders: the hash of the sorted names and hashes of their children, from the deepest level up."""
    level = hashed.select("path", "sha256", F.size(F.split("path", "/")).alias("d"))
    found = None
    for d in range(depth, 0, -1):
        here = level.where(F.col("d") == d).select("path", "sha256")
        both = here if found is None else here.unionByName(found.where(F.size(F.split("path", "/")) == d).select("path", "sha256"))
        parent = F.array_join(F.slice(F.split("path", "/"), 1, d - 1), "/") if d > 1 else F.lit("")
        up = both.groupBy(parent.alias("folder")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat(F.element_at(F.split("path", "/"), -1), F.col("sha256")))), ""), 256).alias("sha256")).select(F.col("folder").alias("path"), "sha256")
        found = up if found is None else found.unionByName(up)
    return found


def difference(old: DataFrame, new: DataFrame, key: str = "path", mark: str = "sha256") -> DataFrame:
    """(key, op) of what was added, modified or deleted; one full outer join."""
    a, b = old.select(F.col(key).alias("k1"), F.col(mark).alias("m1")), new.select(F.col(key).alias("k2"), F.col(mark).alias("m2"))
    op = F.when(F.col("k1").isNull(), "added").when(F.col("k2").isNull(), "deleted").when(~F.col("m1").eqNullSafe(F.col("m2")), "modified")
    return a.join(b, F.col("k1") == F.col("k2"), "full").select(F.coalesce("k1", "k2").alias(key), op.alias("op")).where("op is not null")


def upsert(table: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """table with the newest change of each key applied; op 'deleted' removes the key. changes has table's columns, order and op."""
    latest = changes.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("__r = 1").drop("__r")
    gone = latest.select(F.col(key).alias("__k"))
    return table.join(gone, table[key] == gone["__k"], "left_anti").unionByName(latest.where("op <> 'deleted'").select(*table.columns))


def live_entries(entries: DataFrame, now: Column, ttl_seconds: int = 1800) -> DataFrame:
    return entries.where(F.unix_timestamp(now) - F.unix_timestamp("created") <= ttl_seconds)


def least_recent_out(entries: DataFrame, capacity: int) -> DataFrame:
    """The capacity entries used last; a top-k, not a full sort."""
    return entries.orderBy(F.desc("last_access"), "key").limit(capacity)


def invalidate(entries: DataFrame, changed: DataFrame) -> DataFrame:
    """Entries none of whose files(array) changed(path)."""
    hit = entries.select("key", F.explode("files").alias("f")).join(changed, F.col("f") == F.col("path"), "left_semi").select(F.col("key").alias("k")).distinct()
    return entries.join(hit, F.col("key") == F.col("k"), "left_anti")


def hit_rate(counters: DataFrame) -> DataFrame:
    total = F.col("hits") + F.col("misses")
    return counters.select("*", F.when(total > 0, F.round(100.0 * F.col("hits") / total, 6)).otherwise(0.0).alias("hit_rate"))
