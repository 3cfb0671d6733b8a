"""Corpus pipeline: language ID, near duplicates, benchmark decontamination, secrets, tokenisation.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents; the last returns token ids. run()
applies them to documents. Each stage works on all rows that the one before it kept.

1. language_id: rows in no language go (no letters, empty, null); a missing lang is filled with the prediction. The model
   learns from labelled rows outside the held-out fold.
2. near_duplicates: of each component of the Jaccard join (5 words, 0.75) the smallest doc_id stays.
3. decontamination: documents that hold a window of a benchmark item go.
4. secrets: live credentials in text become [kind]; published examples and clean texts stay; n_chars follows.
5. tokens: SentencePiece ids with the end id, and the digests of ids and of the decoded text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontamination, language_id, ngram_join, secrets, sentencepiece_codec
from lodestone.llm.common import read_table, written


def in_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.recognised(docs, language_id.learn(docs.where(~language_id.held_out(F.col("doc_id")))))


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.without_copies(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_benchmark(docs, read_table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    columns = ("ids", "n_tokens", "ids_sha256", "decoded_sha256")
    # Workers that have run the other stages have less memory left for the table of known parts.
    return sentencepiece_codec.encode_documents(docs, sentencepiece_codec.default_model(), columns, ("lang", "source"), table_bytes=40 << 20)


STAGES = [
    ("language_id", in_language),
    ("near_duplicates", unlike),
    ("decontamination", clean_of_benchmark),
    ("secrets", without_secrets),
    ("tokens", tokenised),
]

#: Language ID and the tokeniser cannot be told in SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
