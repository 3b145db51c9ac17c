"""Exact top-k inner products by Fagin's threshold algorithm.

Candidates are dealt by hash into shards of bounded size. A shard holds one list for
each dimension, sorted by that dimension's component. A query reads all lists in step, from the
top where its own component is positive and from the bottom where it is negative, scores every
vector when it first appears, and stops once the sum of the last components read, each times
the query's, is below its k-th score. That score goes on from shard to shard of a group, so
later shards stop sooner.

Lists are sorted once, when a shard is packed. Every query must meet every shard, so a shard goes once to each block of
queries and a block once to each group of shards: blocks are large, and there are about as many pairs as tasks are wanted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import Mapper, grouped

SHARD_ROWS = 4096
#: Queries that one task holds, with their k best.
BLOCK_QUERIES = 4096
#: Shards that one task searches, one after another.
GROUP_SHARDS = 16


def sorted_lists(rows: np.ndarray) -> np.ndarray:
    """Row numbers of a shard by each dimension's component, a line for each dimension."""
    return np.argsort(rows, axis=0, kind="stable").T.astype(np.uint16 if len(rows) < 1 << 16 else np.uint32)


class Shard:
    def __init__(self, ids: np.ndarray, rows: np.ndarray, order: np.ndarray | None = None):
        self.ids, self.rows = ids, rows
        self.order = sorted_lists(rows) if order is None else order
        self.sorted = np.take_along_axis(rows.T, self.order, axis=1)

    def search(self, query: np.ndarray, own: int, k: int, best: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The k best (scores, ids) of best and this shard; higher scores first, then smaller ids."""
        scores, ids = best
        n = len(self.ids)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        seen, depth, step = self.ids == own, 0, 8
        if not len(up) and not len(down):  # every score is 0
            fresh = np.flatnonzero(~seen)
            return _best(np.concatenate((scores, np.zeros(len(fresh), np.int64))), np.concatenate((ids, self.ids[fresh])), k)
        while depth < n:
            to = min(n, depth + step)
            found = np.zeros(n, bool)
            found[self.order[up, n - to : n - depth].ravel()] = True
            found[self.order[down, depth:to].ravel()] = True
            fresh = np.flatnonzero(found & ~seen)
            seen |= found
            if len(fresh):
                scores, ids = _best(np.concatenate((scores, self.rows[fresh] @ query)), np.concatenate((ids, self.ids[fresh])), k)
            most = self.sorted[up, n - to] @ query[up] + self.sorted[down, to - 1] @ query[down]
            if len(scores) >= k and scores[-1] > most:
                break
            depth, step = to, step * 2
        return scores, ids


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    by = np.lexsort((ids, -scores))[:k]
    return scores[by], ids[by]


def _pack(lists: bool) -> Mapper:
    """One row for each shard or block: its ids, its matrix and, for shards, its sorted lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, ["dim", "part"]):
            ids = rows.column("id").to_numpy()
            flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in rows.column("v").chunks])
            order = sorted_lists(flat.reshape(len(ids), -1)).tobytes() if lists else b""
            yield pa.record_batch([pa.array([rows.column("dim")[0].as_py()], pa.int32()), pa.array([rows.column("part")[0].as_py()], pa.int64()), *(pa.array([x], pa.binary()) for x in (ids.tobytes(), flat.tobytes(), order))], names=["dim", "part", "ids", "flat", "lists"])

    return run


def _matrix(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["flat"], np.int64).reshape(len(ids), -1)


def _lists(row: dict, shape: tuple[int, int]) -> np.ndarray:
    return np.frombuffer(row["lists"], np.uint16 if shape[0] < 1 << 16 else np.uint32).reshape(shape[1], shape[0])


def _search(k: int) -> Mapper:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, ["dim", "block", "grp"]):
            queries = [_matrix(r) for r in rows.filter(pc.equal(rows.column("kind"), 0)).to_pylist()]
            ids = np.concatenate([q for q, _ in queries]) if queries else np.zeros(0, np.int64)
            vectors = np.concatenate([v for _, v in queries]) if queries else np.zeros((0, 0), np.int64)
            best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
            for i in range(rows.num_rows):
                r = rows.slice(i, 1).to_pylist()[0]
                if r["kind"] == 1:
                    own, rows_of = _matrix(r)
                    shard = Shard(own, rows_of, _lists(r, rows_of.shape))
                    best = [shard.search(v, int(i), k, b) for i, v, b in zip(ids, vectors, best)]
            n = np.array([len(s) for s, _ in best], int)
            if n.sum():
                whose = np.repeat(np.arange(len(ids)), n)
                yield pa.record_batch([pa.array(ids[whose]), pa.array(np.concatenate([i for _, i in best])), pa.array(np.concatenate([s for s, _ in best]))], names=["query_id", "vec_id", "score"])

    return run


def exact_topk(vectors: DataFrame, query_filter: str, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each row that query_filter (SQL) selects.

    Components become floor(scale * x). A score is the integer inner product; ties go to the
    smaller id. Rows whose id or vector is null, or whose vector holds a null or a non-finite number, take no part; vectors
    meet vectors of their own length. A query never meets rows of its own id; repeated candidates count each time. Equal
    rows that are queries count once. Fewer than k candidates give fewer ranks; an empty table gives none.
    """
    spark = vectors.sparkSession
    spark_n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sound = F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    clean = vectors.where(sound).select(F.col(id_col).cast("long").alias("id"), F.size(vector_col).alias("dim"), whole.alias("v"), F.expr(query_filter).alias("q"))
    counts = clean.agg(F.count("*").alias("n"), F.count_if("q").alias("q")).first()
    shards, blocks = max(1, -(-counts["n"] // SHARD_ROWS)), max(1, -(-counts["q"] // BLOCK_QUERIES))
    groups = min(shards, max(-(-shards // GROUP_SHARDS), -(-2 * spark_n // blocks)))

    def packed(rows: DataFrame, parts: int, salt: int) -> DataFrame:
        dealt = rows.withColumn("part", F.pmod(F.xxhash64("id", "v", F.lit(salt), F.monotonically_increasing_id() if salt else F.lit(0)), F.lit(parts)))
        return dealt.select("dim", "part", "id", "v").repartition(spark_n, "dim", "part").sortWithinPartitions("dim", "part").mapInArrow(_pack(bool(salt)), "dim int, part long, ids binary, flat binary, lists binary")

    queries = packed(clean.where("q").select("id", "dim", "v").distinct(), blocks, 0).select("dim", F.col("part").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("shard"), "ids", "flat", "lists")
    stored = packed(clean, shards, 1).select("dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")).alias("block"), F.pmod("part", F.lit(groups)).cast("int").alias("grp"), F.lit(1).alias("kind"), F.col("part").alias("shard"), "ids", "flat", "lists")
    met = queries.unionByName(stored).repartition(spark_n, "dim", "block", "grp").sortWithinPartitions("dim", "block", "grp", "kind", "shard")
    found = met.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 20 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) WHERE rank <= 20
"""
