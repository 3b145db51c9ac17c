"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


_written: list[tuple[SparkSession, str]] = []


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended; the folder's owner sweeps it
        pass


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        _drop(spark, path)


def cut(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder: short lineage, and nothing is lost with an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete a table that cut() wrote and that no later result reads."""
    for name in df.inputFiles()[:1]:
        _drop(df.sparkSession, name.rsplit("/", 1)[0])


def arrow_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or len(at) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def text_chunks(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows with at most limit bytes, or one row."""
    if not batch.num_rows:
        return
    data, offs = arrow_text(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, one key after another, from batches that are sorted by the keys."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            key = tuple(c[a] for c in cols)
            if last is not None and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def crc_fold(column: str = "doc_id", folds: int = 5) -> str:
    """SQL of the fold of a row: crc32 of the id's text modulo the number of folds."""
    return f"pmod(crc32(cast({column} as string)), {folds})"


def even_labels(parts: int) -> np.ndarray:
    """An int for each of so many parts, such that Spark's hash partitioning (murmur3 of an int, seed 42) deals each to a partition of its own."""
    found = np.full(parts, -1, np.int64)
    at = 0
    while (found < 0).any():
        label = np.arange(at, at + max(1024, parts), dtype=np.uint32)
        at += len(label)
        with np.errstate(over="ignore"):
            h = label * np.uint32(0xCC9E2D51)
            h = np.uint32(42) ^ ((h << np.uint32(15) | h >> np.uint32(17)) * np.uint32(0x1B873593))
            h = (h << np.uint32(13) | h >> np.uint32(19)) * np.uint32(5) + np.uint32(0xE6546B64)
            h ^= np.uint32(4)
            h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
            h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
            h ^= h >> np.uint32(16)
        part, first = np.unique(h.view(np.int32).astype(np.int64) % parts, return_index=True)
        new = found[part] < 0
        found[part[new]] = label[first[new]]
    return found.astype(np.int32)


def join_hot(rows: DataFrame, per_key: DataFrame, on: list[str], count: str, how: str = "inner", counts: DataFrame | None = None, least: int = 5000) -> DataFrame:
    """rows joined with per_key, which has one row for each key; per_key, or else counts, says in count how many of rows hold a key.

    Keys that more than a 256th of all rows hold (and more than least) are fewer than 256: these, and only these, are broadcast, so
    that no task gets all rows of a hot key. What holds the counts should be a written table, as it is read more than once.
    """
    known = counts if counts is not None else per_key
    total, top = known.agg(F.sum(count), F.max(count)).first()
    most = max(least, (total or 0) // 256)
    side = per_key.select(*[c for c in per_key.columns if c != count or counts is not None])
    if (top or 0) <= most:
        return rows.join(side, on, how)
    hot = F.broadcast(known.where(F.col(count) > most).select(*on))
    cold = rows.join(hot, on, "left_anti").join(side, on, how)
    return rows.join(F.broadcast(side.join(hot, on, "left_semi")), on).unionByName(cold)


Mapper = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
