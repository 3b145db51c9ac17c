"""Lexical search: lines, BM25, TF-IDF, fusion, chunks and snippets."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import counted_tokens, glob_regex, is_test_file, relevance, synonyms, tokenize, trigrams
from lodestone.operators.shared import settle

K1, B = 1.2, 0.75
RRF_K, EXACT_BOOST, FUNCTION_BOOST = 60.0, 2.0, 1.5


def lines_of(files: DataFrame) -> DataFrame:
    """(repo, path, line, text) of files(repo, path, content); lines count from 1."""
    return files.select("repo", "path", F.posexplode(F.split("content", "\n"))).select("repo", "path", (F.col("pos") + 1).alias("line"), F.col("col").alias("text"))


def search_code(lines: DataFrame, query: str, k: int = 10, file_pattern: str | None = None, exclude_tests: bool = False) -> DataFrame:
    """The k best lines that hold query in any case; ties by path and line."""
    found = lines.where(F.contains(F.lower("text"), F.lit(query.lower())))
    if file_pattern:
        found = found.where(F.col("path").rlike(glob_regex(file_pattern)))
    if exclude_tests:
        found = found.where(~is_test_file(F.col("path")))
    return found.select("path", "line", F.round(relevance(F.col("text"), query), 6).alias("score")).orderBy(F.desc("score"), "path", "line").limit(k)


def with_context(lines: DataFrame, hits: DataFrame, before: int = 3, after: int = 3) -> DataFrame:
    """Each hit (repo, path, line) with the text of its neighbours; only hits fan out, by before + after + 1."""
    near = hits.select("repo", "path", F.col("line").alias("hit"), F.explode(F.sequence(F.col("line") - before, F.col("line") + after)).alias("line"))
    return near.join(lines.select("repo", "path", "line", "text"), ["repo", "path", "line"]).groupBy("repo", "path", "hit").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s["text"]), "\n").alias("context"))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files give fewer partitions than there are cores; larger inputs stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def postings(docs: DataFrame, text: str = "text", key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(id, term, tf) and (id, dl) of docs: the index that rankings read, tokenised once and written to the shared folder."""
    slim = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    counted = settle(counted_tokens(spread(slim)).groupBy("id", "term").agg(F.sum("n").alias("tf")))
    return counted.where("term is not null"), counted.groupBy("id").agg(F.sum("tf").alias("dl"))


def check_query(query: str) -> None:
    """A query must be a regex of at most 1000 characters and 20 of + * ?."""
    re.compile(query)
    if len(query) > 1000 or sum(c in "+*?" for c in query) > 20:
        raise ValueError("query too long or with too many repetitions")


def query_terms(docs: DataFrame, query: str, expand: bool = False) -> list[str]:
    """Tokens of a query, repeated ones kept; with expand, each with its synonyms."""
    check_query(query)
    found = docs.sparkSession.range(1).select(tokenize(F.lit(query)).alias("t")).first()[0]
    return found + [s for t in found for s in synonyms().get(t, [])] if expand else found


Index = tuple[DataFrame, DataFrame]


def bm25(docs: DataFrame, query: str, k: int = 10, compat: bool = False, expand: bool = False, text: str = "text", key: str = "id", index: Index | None = None) -> DataFrame:
    """(id, score, rank from 0) of the k best documents, from index, which postings() gives, or from docs.

    A query term that occurs twice counts twice; compat multiplies a term's score by its frequency. An id that holds the query doubles its score. Ties go by id.
    """
    terms = query_terms(docs, query, expand)
    wanted = sorted(set(terms))
    tf, dl = index or postings(docs, text, key)
    held = tf.where(F.col("term").isin(wanted) if wanted else F.lit(False))
    df = {r["term"]: r["df"] for r in held.groupBy("term").agg(F.count("*").alias("df")).collect()}  # as many rows as the query has words
    n, avgdl = dl.agg(F.count("*"), F.avg("dl")).first()
    weight = F.lit(0.0)
    for w in wanted:
        seen = df.get(w, 0)
        weight = F.when(F.col("term") == w, math.log((n - seen + 0.5) / (seen + 0.5) + 1.0) * terms.count(w)).otherwise(weight)
    f = F.col("tf").cast("double")
    one = weight * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl or 1.0))) * (f if compat else 1.0)
    boost = F.when(F.contains(F.lower(F.col("id").cast("string")), F.lit(query.lower())), EXACT_BOOST).otherwise(1.0)
    scored = held.join(dl, "id").groupBy("id").agg(F.sum(one).alias("s")).select("id", F.round(F.col("s") * boost, 6).alias("score"))
    return ranked(scored, k)


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """The k best of (id, score) with their rank from 0; the window sees k rows."""
    best = scored.orderBy(F.desc("score"), "id").limit(k)
    return best.withColumn("rank", (F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1).cast("int"))


def _weighed(index: Index, vocabulary: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, term, w) with w = tf * (ln((N + 1) / (df + 1)) + 1), tf being the share of a text's tokens, and (term, idf)."""
    tf, dl = index
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    if vocabulary:
        df = df.orderBy(F.desc("df"), "term").limit(vocabulary)
    idf = df.select("term", (F.log(F.lit(dl.count() + 1.0) / (F.col("df") + 1)) + 1).alias("idf"))
    return tf.join(idf, "term").join(dl, "id").select("id", "term", (F.col("tf") / F.col("dl") * F.col("idf")).alias("w")), idf


def tfidf_weights(docs: DataFrame, text: str = "text", key: str = "id", vocabulary: int | None = None, index: Index | None = None) -> DataFrame:
    """(id, term, w): unit vectors of the documents; vocabulary keeps the terms of highest document frequency."""
    weighed, _ = _weighed(index or postings(docs, text, key), vocabulary)
    norm = weighed.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighed.join(norm, "id").select("id", "term", (F.col("w") / F.col("norm")).alias("w"))


def tfidf(docs: DataFrame, query: str, k: int = 10, text: str = "text", key: str = "id", index: Index | None = None) -> DataFrame:
    """(id, score, rank) by cosine of TF-IDF vectors, the query's with the documents' statistics."""
    terms = query_terms(docs, query)
    wanted = sorted(set(terms))
    weighed, idf = _weighed(index or postings(docs, text, key))
    known = idf.where(F.col("term").isin(wanted) if wanted else F.lit(False)).collect()  # as many rows as the query has words
    weights = {r["term"]: terms.count(r["term"]) / len(terms) * r["idf"] for r in known}
    norm = sum(w * w for w in weights.values()) ** 0.5 or 1.0
    of_query = F.lit(0.0)
    for t, w in sorted(weights.items()):
        of_query = F.when(F.col("term") == t, w / norm).otherwise(of_query)
    scored = weighed.groupBy("id").agg(F.sum(of_query * F.col("w")).alias("d"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("n")).where("d > 0").select("id", F.round(F.col("d") / F.col("n"), 6).alias("score"))
    return ranked(scored, k)


def similar(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "id", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, id, score): for each text of items the document of the highest cosine between TF-IDF vectors, ties to the smaller id.

    Both vectors are weighed by the documents' statistics and normalised; terms that no document has have no weight. Only terms of items meet
    the documents' vectors.
    """
    weighed, idf = _weighed(postings(docs, text, key))
    weighed = settle(weighed)
    norm = weighed.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    count = counted_tokens(items, item_text, item_key).where("term is not null").groupBy("id", "term").agg(F.sum("n").alias("n"))
    total = count.groupBy("id").agg(F.sum("n").alias("total"))
    q = settle(count.join(total, "id").join(idf, "term").select(F.col("id").alias("item"), "term", (F.col("n") / F.col("total") * F.col("idf")).alias("qw")))
    size = q.groupBy("item").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("size"))
    dots = weighed.join(q, "term").groupBy("item", "id").agg(F.sum(F.col("w") * F.col("qw")).alias("d"))
    scored = dots.join(norm, "id").join(size, "item").select("item", "id", F.round(F.col("d") / F.col("norm") / F.col("size"), 6).alias("score"))
    best = scored.groupBy("item").agg(F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("b"))
    return best.select("item", F.col("b.id").alias("id"), (-F.col("b.s")).alias("score"))


def fuse(lexical: DataFrame, vector: DataFrame, query: str, k: int = 10, bm25_weight: float = 1.0, tfidf_weight: float = 1.0, functions: Column | None = None) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (id, score, rank): weight / (60 + rank + 1), doubled for ids that hold the query."""
    boost = F.when(F.contains(F.lower(F.col("id").cast("string")), F.lit(query.lower())), EXACT_BOOST).otherwise(1.0)
    own = boost * (F.when(functions, FUNCTION_BOOST).otherwise(1.0) if functions is not None else 1.0)
    both = lexical.select("id", (bm25_weight / (RRF_K + F.col("rank") + 1) * own).alias("s"), F.col("rank").alias("bm25_rank"), F.lit(None).cast("int").alias("tfidf_rank")).unionByName(
        vector.select("id", (tfidf_weight / (RRF_K + F.col("rank") + 1) * boost).alias("s"), F.lit(None).cast("int").alias("bm25_rank"), F.col("rank").alias("tfidf_rank"))
    )
    fused = both.groupBy("id").agg(F.round(F.sum("s"), 6).alias("score"), F.max("bm25_rank").alias("bm25_rank"), F.max("tfidf_rank").alias("tfidf_rank"))
    return fused.orderBy(F.desc("score"), "id").limit(k)


def hybrid(docs: DataFrame, query: str, k: int = 10, mode: str = "hybrid", text: str = "text", key: str = "id") -> DataFrame:
    """BM25 and TF-IDF over three times as many candidates, fused; or one of them alone."""
    if mode == "bm25":
        return bm25(docs, query, k, text=text, key=key)
    if mode == "tfidf":
        return tfidf(docs, query, k, text=text, key=key)
    index = postings(docs, text, key)
    return fuse(bm25(docs, query, 3 * k, index=index), tfidf(docs, query, 3 * k, index=index), query, k)


def chunk_by_lines(lines: DataFrame, size: int = 100) -> DataFrame:
    """(repo, path, chunk, start_line, end_line, n_lines, content): runs of size lines without overlap."""
    part = F.floor((F.col("line") - 1) / size).cast("int")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s["text"]), "\n")
    return lines.groupBy("repo", "path", part.alias("chunk")).agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.count("*").alias("n_lines"), joined.alias("content"))


def search_chunks(chunks: DataFrame, query: str, k: int = 10) -> DataFrame:
    """The k chunks that hold the largest share of the query's distinct tokens."""
    wanted = sorted(set(query_terms(chunks, query)))
    share = F.size(F.array_intersect(tokenize(F.col("content")), F.array(*[F.lit(w) for w in wanted]).cast("array<string>"))) / float(max(1, len(wanted)))
    return chunks.select("path", "chunk", F.round(share, 6).alias("score")).where("score > 0").orderBy(F.desc("score"), "path", "chunk").limit(k)


def chunk_stats(chunks: DataFrame, kind: Column) -> DataFrame:
    """Count, share and line statistics by kind of chunk."""
    by = chunks.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.round(F.avg("n_lines"), 6).alias("avg_lines"), F.max("n_lines").alias("max_lines"), F.min("n_lines").alias("min_lines"))
    return by.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))


def fuzzy_symbols(symbols: DataFrame, query: str, k: int = 20, boosts: dict[str, float] | None = None) -> DataFrame:
    """Symbols by shared trigrams, a prefix bonus of 0.3 and an exact bonus of 0.5, times the boost of their kind."""
    q = query.lower()
    grams = sorted({q[i : i + 3] for i in range(len(q) - 2)} if len(q) >= 3 else {q})
    name = F.lower("name")
    shared = F.size(F.array_intersect(trigrams(name), F.array(*[F.lit(g) for g in grams])))
    near = F.startswith(name, F.lit(q)) | F.startswith(F.lit(q), name)
    base = F.when(shared > 0, shared).when(near, len(grams)).otherwise(0) / float(len(grams)) + F.when(F.startswith(name, F.lit(q)), 0.3).otherwise(0.0) + F.when(name == q, 0.5).otherwise(0.0)
    weight = F.lit(1.0)
    for kind, w in (boosts or {}).items():
        weight = F.when(F.col("kind") == kind, w).otherwise(weight)
    return symbols.where((shared > 0) | near).select("id", "name", "kind", F.round(base * weight, 6).alias("score")).orderBy(F.desc("score"), "name", "id").limit(k)


def best_snippet_line(lines: DataFrame, terms: list[str]) -> DataFrame:
    """(repo, path, line, n_terms): the first line of each path with the most of the terms."""
    low = F.lower("text")
    hits = sum((F.when(F.contains(low, F.lit(t)), 1).otherwise(0) for t in terms), F.lit(0))
    return lines.select("repo", "path", "line", hits.alias("n_terms")).where("n_terms > 0").groupBy("repo", "path").agg(F.max(F.struct("n_terms", (-F.col("line")).alias("l"))).alias("b")).select("repo", "path", (-F.col("b.l")).alias("line"), F.col("b.n_terms").alias("n_terms"))
