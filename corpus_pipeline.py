"""A corpus pipeline: each stage works on the documents that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import forget, merges_partitions, read_table, stored
from lattica.llm.decontaminate import without_leaks
from lattica.llm.jaccard import first_of_class
from lattica.llm.language import keep_identified
from lattica.llm.pieces import encode_documents
from lattica.llm.pii import redact
from lattica.llm.queries import piece_model

#: Least share of a document's text in its main language.
LEAST_LANGUAGE_SHARE = 0.35


def _as_many_files(out: DataFrame, docs: DataFrame) -> DataFrame:
    """``out`` in no more partitions than ``docs`` is read in, where Spark doesn't put the small
    partitions of a shuffle together itself: each would be a small file."""
    return out if merges_partitions(out.sparkSession) else out.coalesce(max(1, docs.rdd.getNumPartitions()))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those of which no language has a fair share."""
    return keep_identified(docs, LEAST_LANGUAGE_SHARE)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest doc_id stays."""
    return _as_many_files(first_of_class(docs), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the text are replaced by their kind; n_chars follows."""
    clean = _as_many_files(redact(docs), docs)
    kind = docs.schema["n_chars"].dataType
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind)).select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of what is left, as digests."""
    return encode_documents(docs, piece_model())


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("pii", pii),
    ("sentencepiece", sentencepiece),
]

#: Learnt models, alignment and tokenizer have no SQL form; the tests hold run() against the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = read_table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, old = stored(stage(spark, docs, sf_dir)), last
        last = docs
        if old is not None:
            forget(old)
    return STAGES[-1][1](spark, docs, sf_dir)
