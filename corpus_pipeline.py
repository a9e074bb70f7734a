"""From raw documents to token ids: quality, near-duplicates, repeated passages, the mix of sources, tokens.

Each stage works on all that its predecessor kept and is written and read again in between. All but the last return
the columns of documents; the last returns doc_id, lang, source, the ids, the ends of the pieces in source bytes and
the SHA-256 of the decoded text. Nulls, ties, repeated rows and empty tables: see the operator of each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.llm import base, mixing, quality_rules, sentencepiece_codec, simhash, substring_dedup

#: What the stages themselves read and set; other columns go along.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail the base rules or lie far out among those of their language and source."""
    return quality_rules.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose five-word shingles are similar to 0.8, by SimHash, the one with the smallest id stays."""
    return simhash.representatives(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out passages of 13 words or more that also stand in a document with a smaller id."""
    return substring_dedup.without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents whole, once or twice or not at all, towards the targets of their sources, in training order."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with the source bytes of every piece."""
    return sentencepiece_codec.encoded(docs, sentencepiece_codec.model_path(), ("doc_id", "lang", "source"))


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("mixing", mix),
    ("sentencepiece", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again as the next one's documents."""
    docs = base.read(spark, sf_dir, "documents")
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    for name, stage in STAGES:
        docs = base.written(stage(spark, docs, sf_dir), name)
    return docs


#: SQL can't express the stages; tests/llm compares them with plain versions.
ORACLE_SQL = None
