"""Connected components of an edge table, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, join_hot, release


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(v, component) of every vertex of edges(a, b): the smallest vertex that links reach.

    Alternating large-star and small-star rounds. Every round is a combined minimum for
    each vertex and one join of edges with minima, in which vertices with very many edges are
    joined apart, without gathering their edges; each round's edges are written to the shared folder. Null ends and loops count as no edge; an empty table gives none.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u is not null and v is not null and u <> v").distinct()
    now = cut(pairs)
    for _ in range(most_rounds):
        # large star: every larger neighbour of u hangs on u's smallest neighbour (u included)
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_hot(both, least, ["u"], "n").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours hang on the smallest of them; both are few after the large star
        least2 = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.unionByName(least2.withColumnRenamed("m", "v")).distinct()
        following = cut(small)
        stars = following.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("v"))
        # done when every vertex has one parent and no parent has a parent
        many = stars.where("n > 1").limit(1).count()
        chain = 0 if many else following.join(following.select(F.col("u").alias("p")), F.col("v") == F.col("p"), "left_semi").limit(1).count()
        release(now)
        now = following
        if not many and not chain:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("u")).distinct().select(F.col("u").alias("v"), F.col("u").alias("component"))
    return now.select(F.col("u").alias("v"), F.col("v").alias("component")).unionByName(roots)
