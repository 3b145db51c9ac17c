"""Vector search by cosine, with array functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries of a block and vectors of a slice, about.
BLOCK, SLICE = 1024, 8192


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where the lengths differ or a norm is 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def nearest(vectors: DataFrame, query: list[float], k: int = 10, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """The k vectors nearest to one literal query; ties by id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(F.col(id_col).alias("id"), F.round(cosine(F.col(vector_col), q), 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def nearest_each(vectors: DataFrame, queries: DataFrame, k: int = 20, threshold: float = -1.0, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, id, score): up to k other vectors of each stated query, at or above threshold.

    Queries are dealt into blocks and vectors into slices, both of bounded size, and each block meets each slice in one task; no side is
    broadcast whole. A query never meets its own id.
    """
    blocks, slices = (max(1, -(-df.count() // size)) for df, size in ((queries, BLOCK), (vectors, SLICE)))
    part = lambda n: F.pmod(F.xxhash64(id_col), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    q = queries.select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("q"), part(blocks).alias("block"), every(slices).alias("slice"))
    v = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), part(slices).alias("slice"), every(blocks).alias("block"))
    pairs = v.hint("shuffle_hash").join(q, ["block", "slice"]).where("id <> query_id")
    scored = pairs.select("query_id", "id", F.round(cosine(F.col("v"), F.col("q")), 6).alias("score")).where(F.col("score") >= threshold)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")


def vector_stats(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    return vectors.agg(F.count("*").alias("n"), F.max(F.size(vector_col)).alias("dim"), F.min(F.size(vector_col)).alias("min_dim"))
