"""Queries of this subpackage: ``QUERIES`` by name, and ``ORACLE`` where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.llm.chat import CHAT_SQL, format_chats
from lattica.llm.common import read_table
from lattica.llm.decontaminate import find_leaks
from lattica.llm.html_text import extract_pages
from lattica.llm.jaccard import jaccard_classes
from lattica.llm.language import identify
from lattica.llm.perplexity import judge
from lattica.llm.pii import find_pii
from lattica.llm.pieces import encode_documents
from lattica.llm.shards import shard_documents
from lattica.llm.topk import TOP_K_SQL, top_k

PIECE_MODEL = "piece_bpe_32k.model"


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(PIECE_MODEL)


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(read_table(spark, sf_dir, "conversations"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read_table(spark, sf_dir, "documents"), piece_model())


def op6_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents"))


def op8_perplexity_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read_table(spark, sf_dir, "pages"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_decontamination": op2_decontamination,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_sharding": op4_sharding,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_pivot_top_k": op6_pivot_top_k,
    "op7_language_id": op7_language_id,
    "op8_perplexity_quality": op8_perplexity_quality,
    "op9_html_extraction": op9_html_extraction,
    "op10_pii": op10_pii,
}

ORACLE: dict[str, str] = {
    "op1_chat_formatting": CHAT_SQL,
    "op6_pivot_top_k": TOP_K_SQL,
}
