"""Indexes as Parquet tables in a folder: chunks, dense, bm25, entities; written once, overwritten as a whole, read by the queries."""

from __future__ import annotations

import uuid
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lodestone.operators import bm25, entity
from lodestone.operators.bounded import work_folder

_built: dict[tuple, str] = {}


def write_bm25(folder: str, chunks: DataFrame, p: bm25.Bm25 = bm25.Bm25(), tokens: bm25.Tokenizer = bm25.words) -> None:
    """The BM25 index of chunks (chunk_id, text) under folder/bm25, by one pass over the texts, which are counted where they are read."""
    spark = chunks.sparkSession
    bm25.bags(chunks, tokens=tokens).write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/bm25/bags")
    held = bm25.postings_of(spark.read.parquet(f"{folder}/bm25/bags"))
    bm25.corpus_stats(chunks, held).write.mode("overwrite").parquet(f"{folder}/bm25/stats")
    stats = spark.read.parquet(f"{folder}/bm25/stats")
    bm25.idf(bm25.document_frequencies(held), stats, p).write.mode("overwrite").parquet(f"{folder}/bm25/idf")


def read_bm25(spark: SparkSession, folder: str, ids: DataFrame) -> bm25.Index:
    """A stored index; ids: chunk_id of all chunks."""
    part = lambda name: spark.read.parquet(f"{folder}/bm25/{name}")
    held = part("bags")
    return bm25.Index(bm25.postings_of(held), part("idf"), part("stats"), ids, held)


def bm25_of(chunks: DataFrame, source: str) -> bm25.Index:
    """The stored index of chunks, built at the first call for these source files (by path, length and time) in this application."""
    spark = chunks.sparkSession
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(source)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    info = fs.listStatus(path)
    key = (spark.sparkContext.applicationId, source, *[(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in info])
    if key not in _built:
        folder = f"{work_folder(spark, 'index')}"
        write_bm25(folder, chunks)
        _built[key] = folder
    return read_bm25(spark, _built[key], chunks.select("chunk_id"))


def write_index(folder: str, chunks: DataFrame, vectors: DataFrame | None = None, entities: DataFrame | None = None, strategy: str = "l2") -> None:
    """chunks: chunk_id, text and any metadata; vectors: chunk_id, embedding; entities: eid, entity. Strategy and dimension go to meta."""
    spark = chunks.sparkSession
    chunks.write.mode("overwrite").parquet(f"{folder}/chunks")
    chunks = spark.read.parquet(f"{folder}/chunks")
    write_bm25(folder, chunks)
    dim = 0
    if vectors is not None:
        dim = (vectors.select(F.size("embedding").alias("n")).first() or [0])[0]
        vectors.write.mode("overwrite").parquet(f"{folder}/dense")
    if entities is not None:
        entities.write.mode("overwrite").parquet(f"{folder}/entities/names")
        entity.inverted_lists(entity.entity_hits(chunks, entities)).write.mode("overwrite").parquet(f"{folder}/entities/chunks")
    spark.createDataFrame([(strategy, dim)], "strategy string, dim int").write.mode("overwrite").json(f"{folder}/meta")


def read_index(spark: SparkSession, folder: str, part: str, strategy: str | None = None, dim: int | None = None) -> DataFrame:
    """A table of the index: chunks, dense, bm25/idf, entities/names and so on. Raises if it was built for another strategy or dimension."""
    meta = spark.read.schema("strategy string, dim int").json(f"{folder}/meta").first()
    if strategy is not None and meta["strategy"] != strategy:
        raise ValueError(f"the index was built for {meta['strategy']}, not {strategy}")
    if dim is not None and meta["dim"] != dim:
        raise ValueError(f"the index holds vectors of {meta['dim']} dimensions, not {dim}")
    return spark.read.parquet(f"{folder}/{part}")


def looked_up(keys: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """keys with the columns of the rows of table that have their key: a point lookup as a join, the smaller side broadcast if it is checked to be small."""
    return keys.join(table, key, "left")


def per_group(rows: DataFrame, group: str, least: int, folder: str) -> None:
    """A folder for each group of at least least rows (folder/group=value/part-0.parquet), and a list of them in folder/_groups.

    Tasks write the files themselves: Spark's own commit and listing take milliseconds for each folder. A group's rows come
    in runs, so a task holds one batch. Files get their name when they are whole; a second attempt writes the same.
    """
    spark = rows.sparkSession
    big = rows.groupBy(F.col(group).alias("_big")).count().where(F.col("count") >= least).select("_big")
    kept = rows.join(big, F.col(group).eqNullSafe(F.col("_big")), "left_semi")

    def write(batches):
        fs, base = FileSystem.from_uri(folder)
        now, made, out = None, [], None

        def close():
            out.close()
            fs.move(f"{now[1]}/.{now[2]}", f"{now[1]}/part-0.parquet")

        for batch in batches:
            names = batch.column(group).to_pylist()
            rest = batch.select([c for c in batch.schema.names if c != group])
            i = 0
            while i < len(names):
                j = i + 1
                while j < len(names) and names[j] == names[i]:
                    j += 1
                if now is None or now[0] != names[i]:
                    if now is not None:
                        close()
                    value = "__HIVE_DEFAULT_PARTITION__" if names[i] is None else quote(str(names[i]), safe="")
                    now = (names[i], f"{base}/{group}={value}", uuid.uuid4().hex)
                    fs.create_dir(now[1])
                    out = pq.ParquetWriter(f"{now[1]}/.{now[2]}", rest.schema, filesystem=fs)
                    made.append((names[i], f"{group}={value}"))
                out.write_batch(rest.slice(i, j - i))
                i = j
        if now is not None:
            close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in made], batch.schema.field(group).type), pa.array([p for _, p in made], pa.string())], names=[group, "path"])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    listed = StructType([rows.schema[group], StructField("path", StringType())])
    kept.repartition(parts, group).sortWithinPartitions(group).mapInArrow(write, listed).write.mode("overwrite").parquet(f"{folder}/_groups")


def read_groups(spark: SparkSession, folder: str, schema: StructType, group: str) -> DataFrame:
    """The rows of all groups that per_group wrote to folder, from the groups' own files. schema: of the rows."""
    listed = spark.read.parquet(f"{folder}/_groups")
    names = schema.fieldNames()

    def read(batches):
        fs, base = FileSystem.from_uri(folder)
        for batch in batches:
            value = batch.column(0)
            for k, path in enumerate(batch.column(1).to_pylist()):
                for part in pq.ParquetFile(f"{base}/{path}/part-0.parquet", filesystem=fs).iter_batches():
                    same = value.slice(k, 1).take(pa.array(np.zeros(part.num_rows, np.int64)))
                    held = dict(zip(part.schema.names, part.columns, strict=True)) | {group: same}
                    yield pa.RecordBatch.from_arrays([held[n] for n in names], names=names)

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return listed.repartition(parts, "path").mapInArrow(read, schema)


def appended_json(rows: DataFrame, folder: str) -> None:
    """Rows as JSON lines behind those that a folder has: sessions, trackers, logs."""
    rows.write.mode("append").json(folder)


def exported_hash(rows: DataFrame, prefix: str, key: list[str]) -> DataFrame:
    """name, value of each row: the rows of a keyed store as JSON under prefix:key, as a dump has them."""
    return rows.select(F.concat_ws(":", F.lit(prefix), *[F.col(k).cast("string") for k in key]).alias("name"), F.to_json(F.struct(*rows.columns)).alias("value"))


def write_labelled(rows: DataFrame, folder: str) -> None:
    """Positive and negative questions in a folder each."""
    rows.write.mode("overwrite").partitionBy("label").json(folder)


def cached_results(results: DataFrame, folder: str) -> DataFrame:
    """Appends results (query, ...) that the cache in folder has not, and returns the whole cache."""
    spark = results.sparkSession
    try:
        known = spark.read.parquet(folder).select("query").distinct()
        new = results.join(known, "query", "left_anti")
    except Exception as e:  # the first run has no cache
        if "PATH_NOT_FOUND" not in str(e):
            raise
        new = results
    new.withColumn("at", F.current_timestamp()).write.mode("append").parquet(folder)
    return spark.read.parquet(folder)


def graph_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Upsert rows for a graph store: node and edge records with their labels."""
    from lodestone.operators.graph import relation_type

    n = nodes.select(F.lit("node").alias("kind"), F.col("uuid").alias("a"), F.lit(None).cast("string").alias("b"), F.initcap("type").alias("label"), F.col("data").alias("value"))
    e = edges.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), relation_type(F.col("desc")).alias("label"), F.col("desc").alias("value"))
    return n.unionByName(e)
