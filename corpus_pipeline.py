"""The training-data pipeline: language ID, line dedup, near-duplicate documents, decontamination, tokens.

Every stage takes and returns a DataFrame with the columns of ``documents``; the last returns
token ids. Between stages the documents are written as Parquet in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kbspark.llm import bpe, decontamination, language, lines, ngram_join
from kbspark.llm._store import new_path

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go: those without a letter, and those where no language has 0.4 of the mixture."""
    return language.keep_identified(docs, language.train(docs))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line go, and documents that lose all their lines."""
    return lines.drop_later_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, Jaccard 0.8) stays: that of the least doc_id."""
    return ngram_join.keep_sets(docs, num=80, den=100, k=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the decoded bytes."""
    import public_tokenizers

    return bpe.encode_documents(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [("language ID", identify_language), ("line dedup", drop_lines), ("n-gram Jaccard join", drop_near_duplicates), ("benchmark decontamination", decontaminate), ("byte-level BPE", encode)]

#: The models of the first stage, the groups of the third and the merges of the last are beyond SQL; tests/llm has brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
