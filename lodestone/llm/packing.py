"""Best-fit packing into bins of several permitted sizes.

Texts are cut into pieces of at most the largest size and dealt by hash into shards of bounded
size. In a shard, pieces go in falling length, each into the open bin that it fills best. Where none has room, a bin is
opened, and the permitted sizes compete for it: each is filled, on trial, with the longest pieces still to come that
fit, and the size that then costs least for each word it holds is opened, the larger one of equals. So bins of
different sizes stand open together. At the end every bin comes down to the smallest size that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import wordscan as ws
from lodestone.llm.common import Mapper, grouped, list_array, text_chunks

#: Pieces, and bytes of text, of a shard, about.
SHARD_PIECES, SHARD_BYTES = 4096, 8 << 20
#: Rows of one id that may land in one shard.
SHARD_COPIES = 64
#: Pieces that the trial filling of a new bin places one by one; smaller ones count as filling what is left.
TRIAL_PIECES = 8
SIZES = (512, 1024, 2048, 4096)


def pack(lengths: list[int], sizes: tuple[int, ...], overhead: int = 0) -> tuple[list[int], list[int]]:
    """Bin of each piece (given in falling length) and size of each bin; a bin costs its size and overhead."""
    rising = lengths[::-1]
    below = [0]
    for n in rising:
        below.append(below[-1] + n)
    room: list[tuple[int, int]] = []
    bins: list[int] = []
    fill: list[int] = []

    def cheapest(n: int, to_come: int) -> int:
        best = None
        for size in sizes[bisect_left(sizes, n) :]:
            gap, left, tried = size - n, to_come, 0
            while gap and left and tried < TRIAL_PIECES:
                left = max(0, bisect_right(rising, gap, 0, left) - 1)
                gap -= rising[left] if rising[left] <= gap else 0
                tried += 1
            gap -= min(gap, below[left])
            held = size - gap
            cost = ((sizes[bisect_left(sizes, held)] + overhead) / held, -size)
            best = min(best, cost) if best else cost
        return -best[1]

    for i, n in enumerate(lengths):
        at = bisect_left(room, (n, -1))
        if at < len(room):
            left, b = room.pop(at)
            fill[b] += n
        else:
            b, left = len(fill), cheapest(n, len(lengths) - i - 1)
            fill.append(n)
        bins.append(b)
        if left > n:
            insort(room, (left - n, b))
    return bins, [sizes[bisect_left(sizes, f)] for f in fill]


def _cut_up(top: int, shards: int) -> Mapper:
    """The pieces of every text with their shard; a text without words is one piece of length 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in text_chunks(batch, "__text"):
                starts, ends, first = ws.words(data, offs)
                n = np.diff(first)
                pieces = np.maximum(1, -(-n // top))
                row = np.repeat(np.arange(hi - lo), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                length = np.minimum(top, n[row] - piece * top)
                raw, a = data.tobytes(), first[row] + piece * top
                texts = [raw[starts[i] : ends[i + k - 1]] if k else b"" for i, k in zip(a.tolist(), length.tolist())]
                key = batch.column("__key").slice(lo, hi - lo).to_numpy().view(np.uint64)[row]
                shard = (ws.mix(key + piece.astype(np.uint64) * ws.SHINGLE[0]) % np.uint64(shards)).astype(np.int64)
                ids = batch.column("__id").slice(lo, hi - lo).take(pa.array(row))
                yield pa.record_batch([pa.array(shard), ids, pa.array(piece.astype(np.int32)), pa.array(piece * top), pa.array(length), pa.array(texts, pa.binary()).cast(pa.string())], names=["shard", "id", "piece", "start", "n_tokens", "text"])

    return run


def _pack(sizes: tuple[int, ...], overhead: int) -> Mapper:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, ["shard"]):
            rows = rows.combine_chunks()
            shard, lengths = rows.column("shard")[0].as_py(), rows.column("n_tokens").to_numpy()
            filled = int((lengths > 0).sum())  # pieces come in falling length
            bins, final = pack(lengths[:filled].tolist(), sizes, overhead)
            # each piece without words stands in a row of its own
            b = np.concatenate((np.array(bins, np.int64), len(final) + np.arange(len(lengths) - filled)))
            by = np.argsort(b, kind="stable")
            n = np.bincount(b)
            text = rows.column("text").to_pylist()
            ordered, ends = [text[i] for i in by.tolist()], np.cumsum(n).tolist()
            held = rows.take(pa.array(by))
            run_sum = np.cumsum(lengths[by]) - lengths[by]
            offset = run_sum - np.repeat(run_sum[np.cumsum(n) - n], n)
            whole = len(n) - len(final)
            lists = [pa.ListArray.from_arrays(list_array(lengths, n).offsets, held.column(c).combine_chunks()) for c in ("id", "piece", "start", "n_tokens")]
            columns = [
                pa.array([*((shard << 32) + np.arange(len(final))).tolist(), *[None] * whole], pa.int64()), pa.array([*final, *[None] * whole], pa.int64()), pa.array(np.bincount(b, lengths).astype(np.int64)),
                *lists, list_array(offset, n, pa.int64()), pa.array(["\n".join(ordered[e - k : e]) for e, k in zip(ends, n.tolist())], pa.string()),
            ]
            yield pa.record_batch(columns, names=["bin_id", "bin_size", "n_tokens", "ids", "pieces", "starts", "lengths", "offsets", "text"])

    return run


def packed_sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sizes: tuple[int, ...] = SIZES, overhead: int = 0) -> DataFrame:
    """One row for each bin: (bin_id, bin_size, n_tokens, ids, pieces, starts, lengths, offsets, text).

    The lists tell, piece by piece, whose piece it is, its number in its text, the word of the text with which it begins, its words, and where
    in the sequence they begin. text is the sequence: the pieces, a line end between two. A row longer than the largest
    size gives several pieces. A null or empty text gives a row of its own without a bin (bin_id and bin_size null).
    Every row is packed, repeated ones and those with a null id too. Pieces of equal length go by id and number. Other columns
    are not read; an empty table gives no bins.
    """
    sizes = tuple(sorted(sizes))
    spark_n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, size = docs.agg(F.count("*"), F.sum(F.octet_length(F.col(text_col).cast("string")))).first()
    copies = docs.groupBy(id_col).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    size = size or 0
    shards = max(1, -(-rows // SHARD_PIECES), -(-size // SHARD_BYTES))
    # rows that share an id are spread only if they are many, so that shards otherwise don't hang on the order of rows
    salts = -(-copies // SHARD_COPIES)
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(salts)) if salts > 1 else F.lit(0).cast("long")
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("__id"), F.xxhash64(id_col, salt).alias("__key"), F.col(text_col).cast("string").alias("__text"))
    pieces = slim.mapInArrow(_cut_up(sizes[-1], shards), f"shard long, id {kind}, piece int, start long, n_tokens long, text string")
    dealt = pieces.repartition(min(shards, max(spark_n, -(-size // (4 * SHARD_BYTES)))), "shard").sortWithinPartitions("shard", F.desc("n_tokens"), F.col("id").asc_nulls_first(), "piece", "text")
    return dealt.mapInArrow(_pack(sizes, overhead), f"bin_id long, bin_size long, n_tokens long, ids array<{kind}>, pieces array<int>, starts array<long>, lengths array<long>, offsets array<long>, text string")


def best_fit_packing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sizes: tuple[int, ...] = SIZES, overhead: int = 0) -> DataFrame:
    """(id_col, piece, start, n_tokens, bin_id, bin_size, bin_offset): the place of every piece in the sequences of packed_sequences().

    Null and empty texts give one piece of length 0 without a bin (nulls).
    """
    bins = packed_sequences(docs, id_col, text_col, sizes, overhead)
    each = bins.select("bin_id", "bin_size", F.explode(F.arrays_zip("ids", "pieces", "starts", "lengths", "offsets")).alias("p"))
    offset = F.when(F.col("bin_id").isNotNull(), F.col("p.offsets"))
    return each.select(F.col("p.ids").alias(id_col), F.col("p.pieces").alias("piece"), F.col("p.starts").alias("start"), F.col("p.lengths").alias("n_tokens"), "bin_id", "bin_size", offset.alias("bin_offset"))
