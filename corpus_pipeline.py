"""A corpus pipeline in five stages, each one operator over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import toxicity as tox
from lodestone.llm.common import cut, table
from lodestone.llm.fm_dedup import substring_dedup
from lodestone.llm.ngram_join import near_duplicates_removed
from lodestone.llm.packing import packed_sequences
from lodestone.llm.pii import personal_data


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon calls toxic go."""
    lexicon = tox.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return tox.toxicity(docs.withColumn("t", F.col("text")), lexicon, "t").where("predicted = 0").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents alike in 0.8 or more of their five-word shingles, the one with the smallest id stays."""
    return near_duplicates_removed(docs).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 50 words that a document with a smaller id holds go from the texts; other texts stay as they are."""
    done = substring_dedup(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return done.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    done = personal_data(docs.withColumn("t", F.col("text")), "t")
    return done.withColumn("text", F.when(F.col("text").isNotNull(), F.col("masked"))).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 512 to 4096 words with the ids of the documents in them; documents without words stand alone, without a bin."""
    return packed_sequences(docs).withColumnRenamed("ids", "doc_ids")


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("privacy", privacy), ("packing", packing)]

#: SQL cannot express the learnt lexicon and the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
