"""Dense retrieval: exact nearest vectors for a set of queries, thresholds, relevance.

Queries go out in blocks of bounded size; each task multiplies its vectors with a block and keeps the k best of each query,
so that only k rows a query and task are shuffled. Relevance: 1 - d / sqrt(2) of the squared distance d, or the product.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 2048
SCHEMA = "query_id long, chunk_id long, score double"


def l2_relevance(squared: Column) -> Column:
    return F.lit(1.0) - squared / F.lit(math.sqrt(2.0))


def l2_distance(a: Column, b: Column) -> Column:
    """Euclidean norm of the difference of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def normalised(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.try_divide(x.cast("double"), norm))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 30, strategy: str = "l2") -> DataFrame:
    """query_id, chunk_id, score, rank: the k most relevant vectors of each query. queries: query_id, embedding; vectors: chunk_id, embedding.

    Ties go to the smaller chunk_id. Rows without a vector are left out.
    """
    spark = vectors.sparkSession
    vectors = vectors.where("embedding is not null").select("chunk_id", "embedding")
    parts, block = [], []

    def send(block):
        ids = np.array([r[0] for r in block], np.int64)
        shared = spark.sparkContext.broadcast((ids, np.array([r[1] for r in block], np.float64)))

        def best(batches):
            ids, q = shared.value
            kept_id = np.zeros((len(ids), 0), np.int64)
            kept = np.zeros((len(ids), 0))
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = _matrix(batch.column(1))
                s = q @ v.T
                if strategy == "l2":
                    d = np.maximum((q * q).sum(1)[:, None] + (v * v).sum(1)[None] - 2 * s, 0)
                    s = 1 - d / math.sqrt(2.0)
                mine = np.broadcast_to(batch.column(0).to_numpy(), s.shape)
                kept, kept_id = np.concatenate([kept, s], 1), np.concatenate([kept_id, mine], 1)
                order = np.lexsort((kept_id, -np.round(kept, 9)), axis=1)[:, :k]
                kept, kept_id = np.take_along_axis(kept, order, 1), np.take_along_axis(kept_id, order, 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, kept.shape[1])), pa.array(kept_id.ravel()), pa.array(kept.ravel())], names=["query_id", "chunk_id", "score"])

        parts.append(vectors.mapInArrow(best, SCHEMA))

    for row in queries.where("embedding is not null").select("query_id", "embedding").toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == BLOCK:
            send(block)
            block = []
    if block:
        send(block)
    if not parts:
        return spark.createDataFrame([], SCHEMA + ", rank int")
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def above(found: DataFrame, threshold: float) -> DataFrame:
    """The pairs at or above threshold, with the best score of each query."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    return found.withColumn("best", best).where(F.col("score") >= threshold)


def relevant(found: DataFrame, threshold: float) -> DataFrame:
    """query_id, is_relative, top_score: the best score if any reaches threshold, else -1."""
    best = found.groupBy("query_id").agg(F.max("score").alias("best"))
    ok = F.col("best") >= threshold
    return best.select("query_id", ok.alias("is_relative"), F.when(ok, F.col("best")).otherwise(F.lit(-1.0)).alias("top_score"))


def ranked_fusion(lists: list[DataFrame], constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (query_id, chunk_id, rank): sum of 1 / (constant + rank)."""
    every = lists[0].select("query_id", "chunk_id", "rank")
    for x in lists[1:]:
        every = every.unionByName(x.select("query_id", "chunk_id", "rank"))
    return every.groupBy("query_id", "chunk_id").agg(F.sum(F.lit(1.0) / (F.lit(float(constant)) + F.col("rank"))).alias("score"))


def weighted_fusion(sparse: DataFrame, dense: DataFrame, weights: list[float]) -> DataFrame:
    """w * sparse + (1 - w) * dense for each weight; a pair missing on one side counts 0 there."""
    both = sparse.select("query_id", "chunk_id", F.col("score").alias("s")).join(dense.select("query_id", "chunk_id", F.col("score").alias("d")), ["query_id", "chunk_id"], "full_outer")
    both = both.withColumn("weight", F.explode(F.array(*map(F.lit, weights))))
    zero = F.lit(0.0)
    return both.select("query_id", "chunk_id", "weight", (F.col("weight") * F.coalesce("s", zero) + (F.lit(1.0) - F.col("weight")) * F.coalesce("d", zero)).alias("score"))
