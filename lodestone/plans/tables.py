"""The driver's tables in the roles of the data model: chunks, queries, vectors, messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.bounded import work_folder
from lodestone.sources import index_store


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def questions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def asked_vectors(spark, sf_dir) -> DataFrame:
    """Searches take every row whose id is divisible by 50 as a query, against all rows."""
    return vectors(spark, sf_dir).where(F.col("chunk_id") % 50 == 0).select(F.col("chunk_id").alias("query_id"), "embedding")


def events(spark, sf_dir) -> DataFrame:
    """Events with ts as an instant (UTC session)."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def messages(spark, sf_dir) -> DataFrame:
    """Events as group chat: a user's stream is a group, the event type its sender."""
    return events(spark, sf_dir).select(F.col("user_id").alias("group_id"), F.col("event_id").alias("id"), F.col("event_type").alias("sender"), F.col("props").alias("text"), "ts", F.col("event_type").alias("type"))


def scored(spark, sf_dir) -> DataFrame:
    """Labelled documents with a score that depends on their length alone: score, label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.round((F.col("n_chars") % 997).cast("double") / F.lit(997.0), 6)).alias("score"))
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "score", (F.col("quality") == 1).alias("label"))


def bm25_index(spark, sf_dir):
    """The stored BM25 index of the documents, built at first use."""
    return index_store.bm25_of(chunks(spark, sf_dir), f"{sf_dir}/documents.parquet")


def work(spark: SparkSession, name: str) -> str:
    """A folder for what a query writes before it reads it back."""
    return work_folder(spark, name)
