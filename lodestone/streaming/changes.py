"""File changes as streams: newest change of each path applied to a table, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.incremental import difference, upsert


def watch(spark: SparkSession, folder: str, suffix: str = "*") -> DataFrame:
    """A stream of files(path, modified, content) that appear below folder."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", suffix).load(folder).select("path", F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("content"))


def debounced(changes: DataFrame, window: str = "2 seconds") -> DataFrame:
    """Changes(path, ts, ...) without repeats of a path within a watermark."""
    return changes.withWatermark("ts", window).dropDuplicatesWithinWatermark(["path"])


def apply_changes(changes: DataFrame, target: str, columns: list[str], checkpoint: str, order: str = "seq") -> StreamingQuery:
    """Upserts changes(path, ..., op, seq) into the parquet table at target.

    Each batch writes a new version beside the last and then names it current, so a batch that is run again after a
    failure starts from the version before it, and readers never see half a batch.
    """

    def batch(rows: DataFrame, n: int) -> None:
        spark = rows.sparkSession
        before = current(spark, target, columns, rows, n)
        upsert(before, rows, "path", order).write.mode("overwrite").parquet(f"{target}/v={n}")

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def versions(spark: SparkSession, target: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path)]
    return sorted(int(p.getName()[2:]) for p in found if p.getName().startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def current(spark: SparkSession, target: str, columns: list[str], like: DataFrame | None = None, before: int | None = None) -> DataFrame:
    """The newest whole version of a table (below version before, if given); empty, with like's types, if there is none."""
    found = [v for v in versions(spark, target) if before is None or v < before]
    if found:
        return spark.read.parquet(f"{target}/v={found[-1]}")
    return like.select(*columns).limit(0)


def deletions(before: DataFrame, listing: DataFrame) -> DataFrame:
    """Paths of a table that a listing(path, sha256) no longer has: file streams do not report them."""
    return difference(before, listing).where("op = 'deleted'")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events(ts, path) by window and path, late ones within the watermark included."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "path").agg(F.count("*").alias("n"))


def pages(df: DataFrame, size: int = 50):
    """Rows in lists of size, without holding more than one partition on the driver; with the share done."""
    total, held, done = df.count(), [], 0
    for row in df.toLocalIterator():
        held.append(row)
        if len(held) == size:
            done += size
            yield held, 100 * done // total
            held = []
    if held or not total:
        yield held, 100
