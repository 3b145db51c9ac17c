"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import quality as _quality
from lodestone.llm import topk as _topk
from lodestone.llm import toxicity as _toxicity
from lodestone.llm.chat import quotation_links
from lodestone.llm.common import crc_fold, table
from lodestone.llm.extract import extract_main_text
from lodestone.llm.fm_dedup import substring_dedup
from lodestone.llm.ngram_join import ngram_jaccard_join
from lodestone.llm.packing import packed_sequences
from lodestone.llm.pii import personal_data
from lodestone.llm.pieces import sentencepiece_encode

#: Where the public vocabulary files are.
TOKENIZERS = "/opt/tokenizers"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; a null text counts as empty and fails."""
    return _quality.quality(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document by three-word shingles in lower case; a text without words stands alone."""
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), n=3, num=90, den=100, fold_case=True)


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of every vector whose id 20 divides, against all others; unsound vectors take no part."""
    return _topk.exact_topk(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; empty for a null page."""
    return extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str, model: str = f"{TOKENIZERS}/piece_bpe_32k.model") -> DataFrame:
    """Ids of every document, their number, their digest and whether they decode to the normalised text; a null text has none."""
    return sentencepiece_encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and digest of the fixed patterns' spans, and all spans; a null text has none."""
    return personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"), mask=False).drop("text")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every packed sequence: the pieces in it by document, and its text as a digest."""
    bins = packed_sequences(table(spark, sf_dir, "documents"))
    return bins.withColumn("text_sha256", F.sha2("text", 256)).withColumnRenamed("ids", "doc_ids").drop("text")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every message answers and its place in reply order; see quotation_links() for nulls and repeats."""
    return quotation_links(table(spark, sf_dir, "conversations"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by a lexicon learnt outside the held-out fold; a null text scores like an empty one, a null id is in no fold."""
    docs = table(spark, sf_dir, "documents")
    lexicon = _toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = _toxicity.toxicity(docs.select("doc_id", "text").withColumnRenamed("text", "t"), lexicon, "t").drop("t")
    return scored.withColumn("held_out", F.coalesce(F.expr(f"{crc_fold()} = 0"), F.lit(False))).select("doc_id", "held_out", "score", "predicted")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that go from every document as parts of passages of smaller ids; a null text has no words."""
    return substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_exact_topk": op3_exact_topk,
    "op4_html_extraction": op4_html_extraction,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_pii": op6_pii,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_toxicity": op9_toxicity,
    "op10_substring_dedup": op10_substring_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": _quality.ORACLE,
    "op3_exact_topk": _topk.ORACLE,
}
