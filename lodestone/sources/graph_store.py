"""The knowledge graph as JSON lines: nodes and relations appended file by file, with a record of the files that are done."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.files import unprocessed

NODES = "_type string, uuid string, data string"
RELATIONS = "_from string, to string, desc string"


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a schema; lines that are no such object are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_graph(folder: str, files: DataFrame, nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """Appends the nodes and relations (each with path) of the files (path) that no earlier call has recorded; returns those files.

    The record is written last: a call that fails is done again as a whole, and repeated nodes are dropped by reading.
    """
    spark = files.sparkSession
    spark.createDataFrame([], "path string").write.mode("append").parquet(f"{folder}/processed")
    new = unprocessed(files.select("path").distinct(), spark.read.schema("path string").parquet(f"{folder}/processed")).persist()
    new.count()
    nodes.join(new, "path", "left_semi").select(F.col("type").alias("_type"), "uuid", "data").write.mode("append").json(f"{folder}/nodes")
    relations.join(new, "path", "left_semi").select(F.col("src").alias("_from"), F.col("dst").alias("to"), "desc").write.mode("append").json(f"{folder}/relations")
    new.write.mode("append").parquet(f"{folder}/processed")
    return new


def read_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(nodes: uuid, type, data; edges: src, dst, desc) of a folder, each node once."""
    nodes = read_lines(spark, f"{folder}/nodes", NODES).groupBy("uuid").agg(F.min("_type").alias("type"), F.min("data").alias("data"))
    edges = read_lines(spark, f"{folder}/relations", RELATIONS).select(F.col("_from").alias("src"), F.col("to").alias("dst"), "desc").distinct()
    return nodes, edges
