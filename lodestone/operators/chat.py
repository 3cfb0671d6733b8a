"""Conversations: merging messages, history windows, pairing, speaker letters, idle triggers, rate limits.

Windows are partitioned by conversation or group; a group's rows are the unit of work, as in the data model.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators.bounded import few, numbered


def seconds(ts: Column) -> Column:
    """Seconds since the epoch, with fractions."""
    return F.unix_micros(ts.cast("timestamp")).cast("double") / F.lit(1e6)


def with_runs(rows: DataFrame, group: list[str], order: list[str], breaks: Column, name: str = "run") -> DataFrame:
    """rows plus the number of their run from 1: a new run begins where breaks is true (gaps and islands)."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("_new", F.coalesce(breaks.cast("int"), F.lit(1))).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def merged_messages(messages: DataFrame, gap: float = 18.0) -> DataFrame:
    """Runs of one sender with less than gap seconds between neighbours. messages: group_id, id, sender, text, ts.

    group_id, run, sender, first_id, last_id, n, start_ts, end_ts, text (joined by newlines). Equality of the gap does not merge.
    References (column show, if there is one, is ref) are left out first.
    """
    if "show" in messages.columns:
        messages = messages.where(F.coalesce("show", F.lit("")) != "ref")
    w = Window.partitionBy("group_id").orderBy("ts", "id")
    at = seconds(F.col("ts"))
    stay = (F.lag("sender").over(w) == F.col("sender")) & (at - F.lag(at).over(w) < gap)
    runs = with_runs(messages, ["group_id"], ["ts", "id"], ~stay)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ts", "id", "text"))), lambda m: m["text"]), "\n")
    return runs.groupBy("group_id", "run").agg(
        F.first("sender").alias("sender"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count("*").alias("n"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), joined.alias("text")
    )


def previous(messages: DataFrame, size: int = 12, skip: str | None = None, newest_first: bool = True) -> DataFrame:
    """messages plus window: ids of the at most size messages of the group before each, without those of type skip."""
    kept = messages.where(F.col("type") != skip) if skip else messages
    w = Window.partitionBy("group_id").orderBy("id").rowsBetween(-size, -1)
    ids = F.collect_list("id").over(w)
    return kept.withColumn("window", F.reverse(ids) if newest_first else ids)


def history_pairs(turns: DataFrame) -> DataFrame:
    """conv_id, pair, user, bot: runs of one role joined by newlines, then each user run with the bot run behind it.

    turns: conv_id, turn, role (user or another), text. A bot run without a user run has user ''; a user run without a bot has bot ''.
    """
    w = Window.partitionBy("conv_id").orderBy("turn")
    user = F.col("role") == "user"
    runs = with_runs(turns.withColumn("is_user", user), ["conv_id"], ["turn"], F.lag("is_user").over(w) != F.col("is_user"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]), "\n")
    runs = runs.groupBy("conv_id", "run").agg(F.first("is_user").alias("is_user"), text.alias("text"))
    r = Window.partitionBy("conv_id").orderBy("run")
    after, before = F.lead("text").over(r), F.lag("is_user").over(r)
    pairs = runs.select("conv_id", "run", F.when(F.col("is_user"), F.col("text")).otherwise("").alias("user"), F.when(F.col("is_user"), F.coalesce(after, F.lit(""))).otherwise(F.col("text")).alias("bot"), (F.col("is_user") | before.isNull()).alias("head"))
    return pairs.where("head").select("conv_id", F.row_number().over(r).alias("pair"), "user", "bot")


def sender_letters(messages: DataFrame) -> DataFrame:
    """group_id, sender, letter: A, B, C by a sender's first appearance in its group."""
    first = messages.groupBy("group_id", "sender").agg(F.min("id").alias("first_id"))
    w = Window.partitionBy("group_id").orderBy("first_id")
    return first.withColumn("n", F.row_number().over(w)).select("group_id", "sender", F.when(F.col("n") <= 26, F.char(F.lit(64) + F.col("n"))).otherwise(F.concat(F.lit("#"), F.col("n"))).alias("letter"))


def idle_triggers(messages: DataFrame, idle: float = 12.0) -> DataFrame:
    """group_id, id, ts of messages that nobody of the group follows within idle seconds (once for each burst)."""
    w = Window.partitionBy("group_id").orderBy("ts", "id")
    at = seconds(F.col("ts"))
    wait = F.lead(at).over(w) - at
    return messages.withColumn("_w", wait).where(F.col("_w").isNull() | (F.col("_w") >= idle)).select("group_id", "id", "ts")


def batches(rows: DataFrame, order: str, size: int) -> DataFrame:
    """rows plus batch: fixed-size blocks in the order of a unique column."""
    return numbered(rows, order, [], "_n").withColumn("batch", F.floor((F.col("_n") - 1) / size)).drop("_n")


def message_ids(messages: DataFrame) -> DataFrame:
    """messages plus seq: 0, 1, 2 in each group."""
    return messages.withColumn("seq", F.row_number().over(Window.partitionBy("group_id").orderBy("ts", "id")) - 1)


def rate_limited(requests: DataFrame, limit: int) -> DataFrame:
    """requests plus slot (minute), n (number in its slot) and waits (more than limit came before it). requests: key, id, ts."""
    slot = F.date_trunc("minute", "ts")
    w = Window.partitionBy("key", "slot").orderBy("ts", "id")
    return requests.withColumn("slot", slot).withColumn("n", F.row_number().over(w)).withColumn("waits", F.col("n") > limit)


def token_limited(requests: DataFrame, limit: float) -> DataFrame:
    """requests plus slot, used (tokens of its slot before it) and waits (used and its own exceed limit). requests: key, id, ts, tokens."""
    w = Window.partitionBy("key", "slot").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    out = requests.withColumn("slot", F.date_trunc("minute", "ts")).withColumn("used", F.coalesce(F.sum("tokens").over(w), F.lit(0)))
    return out.withColumn("waits", F.col("used") + F.col("tokens") > limit)


def concatenated(history: Column, now: Column, keep: float = 7200.0) -> Column:
    """An array of (query, reply, at): replied talks stay, unreplied ones become one last talk joined by newlines; older than keep go."""
    fresh = F.filter(history, lambda t: now - t["at"] <= keep)
    done = F.filter(fresh, lambda t: F.length(F.coalesce(t["reply"], F.lit(""))) > 0)
    open_ = F.filter(fresh, lambda t: F.length(F.coalesce(t["reply"], F.lit(""))) == 0)
    last = F.struct(F.array_join(F.transform(open_, lambda t: t["query"]), "\n").alias("query"), F.lit("").alias("reply"), F.array_max(F.transform(open_, lambda t: t["at"])).alias("at"))
    return F.when(F.size(open_) > 0, F.concat(done, F.array(last))).otherwise(done)


def forwarded(messages: DataFrame, groups: DataFrame, bot: str) -> DataFrame:
    """Fan-out: each message of a whitelisted group, not the bot's, once for each other whitelisted group. groups: group_id (a short list, counted)."""
    if not few(groups, 100_000):
        raise ValueError("a whitelist of over 100,000 groups would multiply every message")
    own = messages.join(F.broadcast(groups), "group_id", "left_semi").where(F.col("sender") != bot)
    target = F.broadcast(groups.select(F.col("group_id").alias("target")))
    return own.join(target, F.col("group_id") != F.col("target"))


def least_recently_used(accesses: DataFrame, capacity: int = 4) -> DataFrame:
    """accesses (cache, key, at) plus n, last (the access before by the same key) and hit: the cache of capacity keys still held the key.

    One pass over each cache's accesses in order, with no more state than its keys' last places; a cache's accesses are one sequence by nature.
    """
    columns = [c for c in accesses.columns if c not in ("n", "last", "hit")]
    rows = accesses.withColumn("n", F.row_number().over(Window.partitionBy("cache").orderBy("at")))
    rows = rows.withColumn("last", F.lag("n").over(Window.partitionBy("cache", "key").orderBy("at"))).select(*columns, "n", "last")

    def step(batches):
        cache, held = None, {}
        for batch in batches:
            hits = []
            for c, k in zip(batch.column("cache").to_pylist(), batch.column("key").to_pylist(), strict=True):
                if c != cache:
                    cache, held = c, {}
                hits.append(held.pop(k, None) is not None)
                held[k] = True  # insertion order is the order of use
                if len(held) > capacity:
                    del held[next(iter(held))]
            yield batch.append_column("hit", pa.array(hits, pa.bool_()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.repartition("cache").sortWithinPartitions("cache", "n").mapInArrow(step, f"{fields}, hit boolean")
