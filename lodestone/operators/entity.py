"""Entity index: which chunks contain which entities (any case, inside words too), votes, and retrieval by votes.

All entities of a block are searched in one pass over each text with an Aho-Corasick automaton; where that library is
missing, a nested-loop containment join over the broadcast block does the same. Blocks are bounded.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 200_000


def _matcher(entities: list[tuple[int, str]]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for eid, word in entities:
        low = word.lower()
        found.add_word(low, (*found.get(low, ()), eid))
    found.make_automaton()
    return found


def entity_hits(texts: DataFrame, entities: DataFrame, key: str = "chunk_id") -> DataFrame:
    """key, eid for each text that contains an entity. texts: key, text; entities: eid, entity."""
    spark = texts.sparkSession
    parts, block = [], []

    def send(block):
        try:
            import ahocorasick  # noqa: F401
        except ImportError:
            side = spark.createDataFrame(block, "eid long, entity string").withColumn("entity", F.lower("entity"))
            low = texts.select(key, F.lower("text").alias("low"))
            parts.append(low.join(F.broadcast(side), F.contains("low", "entity")).select(key, "eid"))
            return
        shared = spark.sparkContext.broadcast(block)

        def scan(batches):
            machine = _matcher(shared.value)
            for batch in batches:
                keys, ids = [], []
                for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    hits = {e for _, es in machine.iter(text.lower()) for e in es} if text else ()
                    keys += [k] * len(hits)
                    ids += sorted(hits)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.int64())], names=[key, "eid"])

        parts.append(texts.select(key, "text").mapInArrow(scan, f"{key} long, eid long"))

    for row in entities.where("entity is not null and entity <> ''").select("eid", "entity").toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == BLOCK:
            send(block)
            block = []
    if block or not parts:
        send(block or [(-1, "\x00" * 8)])
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def inverted_lists(hits: DataFrame, width: int = 1024) -> DataFrame:
    """eid, block, chunk_ids, n: the chunks of each entity in order, in lists over width ids each, so that no list grows without bound."""
    return hits.groupBy("eid", F.floor(F.col("chunk_id") / width).cast("long").alias("block")).agg(F.sort_array(F.collect_set("chunk_id")).alias("chunk_ids")).withColumn("n", F.size("chunk_ids").cast("long"))


def by_votes(asked: DataFrame, hits: DataFrame, k: int = 100) -> DataFrame:
    """query_id, chunk_id, votes, rank: chunks by the number of the query's entities they hold, ties by first entity then id.

    asked: query_id, eid; hits: chunk_id, eid. Votes are partial counts; only the k best of a query leave a task.
    """
    votes = hits.join(asked, "eid").groupBy("query_id", "chunk_id").agg(F.count("*").alias("votes"), F.min("eid").alias("first_eid"))
    order = Window.partitionBy("query_id").orderBy(F.col("votes").desc(), "first_eid", "chunk_id")
    return votes.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
