"""Knowledge graph over typed edges: undirected deduplication, entity to chunk to file in two hops, graph bonus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def undirected(edges: DataFrame) -> DataFrame:
    """One row for each unordered pair (src < dst): the description with the largest seq wins. edges: src, dst, desc, seq."""
    pair = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "desc", "seq")
    return pair.groupBy("src", "dst").agg(F.max_by("desc", F.struct("seq", "desc")).alias("desc"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "desc").union(edges.select(F.col("dst"), F.col("src"), F.col("desc")))


def two_hop(entities: DataFrame, edges: DataFrame, page: str = "page") -> DataFrame:
    """entity, file, chunk: every neighbour of an entity is a chunk, every neighbour of it by an edge whose desc contains page is a file."""
    every = both_ways(edges)
    first = entities.select("entity").join(every.select(F.col("src").alias("entity"), F.col("dst").alias("chunk")), "entity")
    second = every.where(F.contains("desc", F.lit(page))).select(F.col("src").alias("chunk"), F.col("dst").alias("file"))
    return first.join(second, "chunk").select("entity", "file", "chunk")


def evidence(hops: DataFrame) -> DataFrame:
    """entity, file, chunks (their number), first and last chunk."""
    return hops.groupBy("entity", "file").agg(F.count("*").alias("chunks"), F.min("chunk").alias("first_chunk"), F.max("chunk").alias("last_chunk"))


def bonus(hops: DataFrame, weight: float = 0.2, most: int = 100) -> DataFrame:
    """entity, files, bonus: weight * min(most, files) / most, to be taken off the threshold."""
    files = hops.select("entity", "file").distinct().groupBy("entity").agg(F.count("*").alias("files"))
    return files.withColumn("bonus", F.lit(weight) * F.least(F.lit(most), F.col("files")).cast("double") / F.lit(float(most)))


def retrieved(asked: DataFrame, edges: DataFrame, page: str = "page") -> DataFrame:
    """query_id, place, file, chunks: the files behind a query's entities with the chunks that lead to them (once for each entity), smallest lists first.

    asked: query_id, entity.
    """
    hops = two_hop(asked.select("entity").distinct(), edges, page)
    lists = asked.join(hops, "entity").groupBy("query_id", "file").agg(F.sort_array(F.collect_list("chunk")).alias("chunks"))
    return lists.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.size("chunks"), "file")))


def decided(scores: DataFrame, bonuses: DataFrame, threshold: float) -> DataFrame:
    """query_id, score, bonus, accepted: a query is answered if its best score reaches the threshold less its graph bonus.

    scores: query_id, score (the best dense one; null counts as -1); bonuses: query_id, bonus.
    """
    rows = scores.join(bonuses.select("query_id", "bonus"), "query_id", "left").withColumn("bonus", F.coalesce("bonus", F.lit(0.0)))
    return rows.select("query_id", "score", "bonus", (F.coalesce("score", F.lit(-1.0)) >= F.lit(threshold) - F.col("bonus")).alias("accepted"))


def labelled_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """src, dst, relation, src_label, dst_label, src_data, dst_data: edges with the labels of their nodes; edges without both nodes go.

    nodes: uuid, type, data.
    """
    side = lambda end: nodes.select(F.col("uuid").alias(end), F.initcap("type").alias(f"{end}_label"), F.col("data").alias(f"{end}_data"))
    return edges.select("src", "dst", relation_type(F.col("desc")).alias("relation")).join(side("src"), "src").join(side("dst"), "dst")


def relation_type(desc):
    """Label of a stored relation by its description."""
    return F.when(F.contains(desc, F.lit("page")), "PAGE_OF").when(desc == "file", "FILE_OF").otherwise(F.upper(F.regexp_replace(desc, "[^A-Za-z0-9]+", "_")))
