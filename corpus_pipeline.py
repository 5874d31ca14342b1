"""A corpus pipeline of the operators in pairloom.llm: quality rules, near-duplicate removal, masking of personal data,
mixing of sources, byte-level BPE. Each stage takes all that the one before has written and kept; all but the last return the
columns of `documents`, the last each copy's token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import byte_bpe, mixing, near_dedup, pii, quality_rules
from pairloom.llm.common import table, written
from pairloom.llm.queries import TARGETS


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail a rule of the current policy."""
    return quality_rules.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each component of documents of similarity 0.8 or more."""
    return near_dedup.deduplicated(docs, size=80, of=100)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data; n_chars follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents to the sources' target weights, in shuffled order."""
    return mixing.mix(docs, TARGETS, seed=5).drop("copy", "shuffle_key")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each copy."""
    return byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("quality rules", quality), ("near-duplicates", near_duplicates), ("personal data", private), ("mixture", mixture), ("byte-level BPE", tokens)]
#: Shingle signatures, the random field and the tokenizer are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, _ = written(docs, f"pipeline-{k}")
    return docs
