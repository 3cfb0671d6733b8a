"""Streams of chat messages: deduplication, per-user state with an idle trigger, request limits, request-response matching, dispatch.

Event time is the message's time; the watermark is two hours, as long as a talk is kept.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.operators.bounded import numbered, work_folder

WATERMARK = "2 hours"
KEEP_S = 7200.0


def read_messages(spark: SparkSession, folder: str, schema: str, per_trigger: int = 100, late: str | None = WATERMARK) -> DataFrame:
    """JSON files dropped into folder as a stream, ts as event time; late None leaves the watermark to the operator behind."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", late) if late else rows


def once(messages: DataFrame, key: str = "new_msg_id") -> DataFrame:
    """Each message number once within the watermark."""
    return messages.dropDuplicatesWithinWatermark([key])


def per_minute(requests: DataFrame, limit: int) -> DataFrame:
    """Requests of each key and minute, and whether they exceed limit."""
    n = requests.groupBy("key", F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))
    return n.select("key", F.col("w.start").alias("slot"), "n", "tokens", (F.col("n") > limit).alias("limited"))


def talks(messages: DataFrame, idle_s: float = 12.0, least: int = 8) -> DataFrame:
    """user, query, n, first_ts, last_ts, answerable for each burst of a user's messages (user, query, type, ts).

    A burst ends when the user is silent for idle_s (in event time). Its messages are joined by newlines; those more than
    two hours older than the last are dropped; it can be answered if it is long enough and does not end in an image or link.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: list = [tuple(h) for h in json.loads(state.get[0])] if state.exists else []
        out = []

        def close():
            nonlocal held
            if held:
                last = held[-1][0]
                fresh = [h for h in held if last - h[0] <= KEEP_S]
                text = "\n".join(h[1] for h in fresh if h[1])
                out.append((key[0], text, len(fresh), pd.Timestamp(fresh[0][0], unit="s"), pd.Timestamp(last, unit="s"), len(text) >= least and held[-1][2] not in ("image", "link")))
            held = []

        if state.hasTimedOut:
            close()
            state.remove()
        else:
            rows = [(t.timestamp(), q or "", k) for b in batches for t, q, k in zip(b["ts"], b["query"], b["type"], strict=True)]
            for row in sorted(rows):
                if held and row[0] - held[-1][0] >= idle_s:
                    close()
                held.append(row)
            state.update((json.dumps(held),))
            mark = state.getCurrentWatermarkMs()
            state.setTimeoutTimestamp(max(int((held[-1][0] + idle_s) * 1000), mark + 1))
        yield pd.DataFrame(out, columns=["user", "query", "n", "first_ts", "last_ts", "answerable"])

    return messages.groupBy("user").applyInPandasWithState(
        step, "user string, query string, n long, first_ts timestamp, last_ts timestamp, answerable boolean", "held string", "append", GroupStateTimeout.EventTimeTimeout
    )


def matched(requests: DataFrame, responses: DataFrame, within: str = "1 day") -> DataFrame:
    """Requests with their responses by (store, query_id), at most within later. Both sides need ts and no watermark: it is within."""
    a = requests.withColumnRenamed("ts", "asked_at").withWatermark("asked_at", within)
    b = responses.withColumnRenamed("ts", "replied_at").withWatermark("replied_at", within)
    late = (F.col("a.store") == F.col("b.store")) & (F.col("a.query_id") == F.col("b.query_id")) & (F.col("replied_at") >= F.col("asked_at")) & (F.col("replied_at") <= F.col("asked_at") + F.expr(f"INTERVAL {within}"))
    return a.alias("a").join(b.alias("b"), late).select("a.store", "a.query_id", "asked_at", "replied_at", "b.reply")


def dispatch(tasks: DataFrame, handlers: dict[str, Callable[[DataFrame, int], None]], checkpoint: str):
    """Starts a query that gives each micro-batch's tasks of a type to its handler, urgent types (earlier in handlers) first."""

    def each(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        try:
            for kind, handle in handlers.items():
                handle(batch.where(F.col("type") == kind), n)
        finally:
            batch.unpersist()

    return tasks.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reverted(sent: DataFrame, commands: DataFrame, within_s: int = 120) -> DataFrame:
    """Own messages of a group that a revert command at most within_s later takes back. Batch or micro-batch."""
    hit = (F.col("s.group_id") == F.col("c.group_id")) & (F.col("c.ts") >= F.col("s.ts")) & (F.unix_timestamp("c.ts") - F.unix_timestamp("s.ts") <= within_s)
    return sent.alias("s").join(commands.alias("c"), hit, "left_semi")


def read_table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder as a stream, ts as event time."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", WATERMARK)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream yields until its input is used up, as a table: batches go to Parquet, the last of a complete one counts."""
    spark = stream.sparkSession
    folder = work_folder(spark, "stream")

    def keep(batch: DataFrame, n: int) -> None:
        # A batch that is tried again overwrites its own folder.
        batch.write.mode("overwrite").parquet(f"{folder}/rows/{f'b{n:09d}' if mode == 'append' else 'all'}")

    spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/rows/none")
    query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows/*")


def bursts(messages: DataFrame, key: str, idle: str = "12 seconds") -> DataFrame:
    """key, first_ts, last_ts, n of bursts of a key's messages with at most idle between neighbours, by session windows."""
    s = messages.groupBy(F.session_window("ts", idle).alias("w"), F.col(key)).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return s.select(key, "first_ts", "last_ts", "n")


def live(responses: DataFrame, now: Column, keep_s: int = 86_400) -> DataFrame:
    """Responses not older than keep_s: what a poll finds. Batch or micro-batch; responses: ts and any columns."""
    return responses.where(F.unix_timestamp(now) - F.unix_timestamp("ts") <= keep_s)


def deltas(replies: DataFrame, size: int = 40) -> DataFrame:
    """query_id, seq, delta: replies in pieces of size characters, as an incremental answer sends them."""
    starts = F.sequence(F.lit(0), F.greatest(F.floor((F.length("reply") - 1) / size), F.lit(0)).cast("int"))
    pieces = replies.where(F.length("reply") > 0).select("query_id", "reply", F.explode(starts).alias("seq"))
    return pieces.select("query_id", "seq", F.substring("reply", F.col("seq") * size + 1, F.lit(size)).alias("delta"))


def by_priority(queue: DataFrame, ties: list[str]) -> DataFrame:
    """queue (priority below 1024, ts) plus place: lower priority numbers first, each first in, first out. A drained queue or a micro-batch."""
    at = F.shiftleft(F.col("priority").cast("long"), 52) + F.unix_micros(F.col("ts").cast("timestamp"))
    return numbered(queue.withColumn("_at", at), "_at", ties, "place").drop("_at")


def replies_to(stream: DataFrame, send: Callable[[list], None], checkpoint: str, tries: int = 3):
    """Starts a query that hands each partition's replies to send (a webhook, a chat, an event stream), a failed call again up to tries times."""

    def each(batch: DataFrame, n: int) -> None:
        def part(rows):
            held = [r.asDict() for r in rows]
            for attempt in range(tries):
                try:
                    return send(held) if held else None
                except OSError:
                    if attempt == tries - 1:
                        raise

        batch.foreachPartition(part)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
