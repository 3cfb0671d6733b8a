"""Queries over conversations, message streams and usage, with their SQL twins.

Groups here are users' event streams, which last for weeks, so that the merge gap and the idle time are hours.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import chat
from lodestone.plans import tables as t

GAP, IDLE = 21600.0, 43200.0


def message_merge(spark, sf_dir):
    merged = chat.merged_messages(t.messages(spark, sf_dir), GAP)
    return merged.select("group_id", "run", "sender", "first_id", "last_id", "n", F.sha2("text", 256).alias("text_sha256"))


def groupchat_window(spark, sf_dir):
    out = chat.previous(t.messages(spark, sf_dir), 12, "error")
    return out.select("group_id", "id", F.array_join(F.transform("window", lambda x: x.cast("string")), ",").alias("window_ids"))


def cr_window(spark, sf_dir):
    out = chat.previous(t.messages(spark, sf_dir), 11, newest_first=False).where("type = 'purchase' or type = 'error'")
    return out.select("group_id", "id", F.array_join(F.transform("window", lambda x: x.cast("string")), ",").alias("window_ids"))


def history_pairs(spark, sf_dir):
    turns = t.table(spark, sf_dir, "conversations").where("role <> 'system'")
    return chat.history_pairs(turns).select("conv_id", "pair", F.sha2("user", 256).alias("user_sha256"), F.sha2("bot", 256).alias("bot_sha256"))


def sender_letters(spark, sf_dir):
    return chat.sender_letters(t.messages(spark, sf_dir))


def idle_trigger(spark, sf_dir):
    return chat.idle_triggers(t.messages(spark, sf_dir), IDLE).select("group_id", "id")


def fixed_batches(spark, sf_dir):
    out = chat.batches(t.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 1024)
    return out.groupBy(F.col("batch").cast("long").alias("batch")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


def message_numbers(spark, sf_dir):
    out = chat.message_ids(t.messages(spark, sf_dir))
    return out.select("group_id", "id", F.col("seq").cast("long").alias("seq"))


def big_groups(spark, sf_dir):
    return t.messages(spark, sf_dir).groupBy("group_id").agg(F.count("*").alias("n")).where("n >= 5")


def rpm_limit(spark, sf_dir):
    requests = t.events(spark, sf_dir).select(F.col("event_type").alias("key"), F.col("event_id").alias("id"), "ts")
    return chat.rate_limited(requests, 1).select("key", "id", F.col("n").cast("long").alias("n"), "waits")


def tpm_limit(spark, sf_dir):
    requests = t.events(spark, sf_dir).select(F.col("event_type").alias("key"), F.col("event_id").alias("id"), "ts", F.get_json_object("props", "$.k").cast("long").alias("tokens"))
    return chat.token_limited(requests, 60).select("key", "id", F.col("used").cast("long").alias("used"), "waits")


def usage_stats(spark, sf_dir):
    return t.events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("inferences"), F.count_distinct("user_id").alias("users"), F.count_distinct(F.to_date("ts")).alias("days"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("tokens"))


def monthly_active(spark, sf_dir):
    return t.events(spark, sf_dir).groupBy(F.date_format("ts", "yy-MM").alias("month")).agg(F.count_distinct("user_id").alias("users"), F.count("*").alias("n"))


def work_time(spark, sf_dir):
    from lodestone.functions import text as tx

    return t.events(spark, sf_dir).select("event_id", tx.at_work(F.col("ts"), "09:00:00", "18:00:00").alias("at_work"))


def forward_fanout(spark, sf_dir):
    """Event types as whitelisted groups: each message goes to all groups but its own, user 0 being the bot."""
    m = t.events(spark, sf_dir).select(F.col("event_type").alias("group_id"), F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("sender"))
    return chat.forwarded(m, m.select("group_id").distinct(), "0").select("id", "group_id", "target")


def history_window(spark, sf_dir):
    """Talks of the last two hours that are joined for a group before each message (unreplied ones as one)."""
    m = t.messages(spark, sf_dir).withColumn("at", chat.seconds(F.col("ts")))
    from pyspark.sql.window import Window

    w = Window.partitionBy("group_id").orderBy("at").rangeBetween(-7200, 0)
    return m.select("id", F.count("*").over(w).alias("talks"), F.min("id").over(w).alias("first_id"))


def lru_cache(spark, sf_dir):
    """Hits of a cache of four entries for each event type, whose keys are the users modulo 16."""
    e = t.events(spark, sf_dir)
    accesses = e.select(F.to_date("ts").alias("day"), "event_type", (F.col("user_id") % 16).alias("key"), F.col("event_id").alias("at")).select(F.concat_ws("/", "day", "event_type").alias("cache"), "key", "at")
    return chat.least_recently_used(accesses).select(F.col("at").alias("event_id"), "hit")


M = "m AS (SELECT user_id AS group_id, event_id AS id, event_type AS sender, props AS text, ts, event_type AS type, epoch_us(ts) / CAST(1000000 AS DOUBLE) AS sec FROM events)"

QUERIES = {
    f.__name__: f
    for f in (
        message_merge, groupchat_window, cr_window, history_pairs, sender_letters, idle_trigger, fixed_batches, message_numbers, big_groups, rpm_limit, tpm_limit, usage_stats,
        monthly_active, work_time, forward_fanout, history_window, lru_cache,
    )
}
ORACLE = {
    "message_merge": f"""WITH {M}, b AS (SELECT *, CASE WHEN lag(sender) OVER w = sender AND sec - lag(sec) OVER w < {GAP} THEN 0 ELSE 1 END AS brk FROM m WINDOW w AS (PARTITION BY group_id ORDER BY ts, id)),
r AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY group_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM b)
SELECT group_id, run, min(sender) AS sender, min(id) AS first_id, max(id) AS last_id, count(*) AS n, sha256(string_agg(text, chr(10) ORDER BY ts, id)) AS text_sha256 FROM r GROUP BY group_id, run""",
    "groupchat_window": f"WITH {M} SELECT group_id, id, coalesce(array_to_string(list_reverse(list(id) OVER (PARTITION BY group_id ORDER BY id ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)), ','), '') AS window_ids FROM m WHERE type <> 'error'",
    "cr_window": f"WITH {M}, w AS (SELECT *, coalesce(array_to_string(list(id) OVER (PARTITION BY group_id ORDER BY id ROWS BETWEEN 11 PRECEDING AND 1 PRECEDING), ','), '') AS window_ids FROM m) SELECT group_id, id, window_ids FROM w WHERE type IN ('purchase', 'error')",
    "history_pairs": """WITH t AS (SELECT *, role = 'user' AS u FROM conversations WHERE role <> 'system'), b AS (SELECT *, CASE WHEN lag(u) OVER w = u THEN 0 ELSE 1 END AS brk FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, sum(brk) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM b), g AS (SELECT conv_id, run, bool_and(u) AS u, string_agg(text, chr(10) ORDER BY turn) AS text FROM r GROUP BY conv_id, run),
p AS (SELECT conv_id, run, CASE WHEN u THEN text ELSE '' END AS usr, CASE WHEN u THEN coalesce(lead(text) OVER w, '') ELSE text END AS bot, u OR lag(u) OVER w IS NULL AS head FROM g WINDOW w AS (PARTITION BY conv_id ORDER BY run))
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY run) AS INTEGER) AS pair, sha256(usr) AS user_sha256, sha256(bot) AS bot_sha256 FROM p WHERE head""",
    "sender_letters": f"WITH {M}, f AS (SELECT group_id, sender, min(id) AS f FROM m GROUP BY ALL) SELECT group_id, sender, chr(CAST(64 + row_number() OVER (PARTITION BY group_id ORDER BY f) AS INTEGER)) AS letter FROM f",
    "idle_trigger": f"WITH {M}, w AS (SELECT *, lead(sec) OVER (PARTITION BY group_id ORDER BY ts, id) - sec AS wait FROM m) SELECT group_id, id FROM w WHERE wait IS NULL OR wait >= {IDLE}",
    "fixed_batches": "WITH n AS (SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 1024) AS BIGINT) AS batch FROM documents) SELECT batch, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM n GROUP BY batch",
    "message_numbers": f"WITH {M} SELECT group_id, id, row_number() OVER (PARTITION BY group_id ORDER BY ts, id) - 1 AS seq FROM m",
    "big_groups": f"WITH {M} SELECT group_id, count(*) AS n FROM m GROUP BY group_id HAVING count(*) >= 5",
    "rpm_limit": "SELECT event_type AS key, event_id AS id, row_number() OVER w AS n, row_number() OVER w > 1 AS waits FROM events WINDOW w AS (PARTITION BY event_type, date_trunc('minute', ts) ORDER BY ts, event_id)",
    "tpm_limit": "WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) SELECT event_type AS key, event_id AS id, CAST(coalesce(sum(k) OVER w, 0) AS BIGINT) AS used, coalesce(sum(k) OVER w, 0) + k > 60 AS waits FROM e WINDOW w AS (PARTITION BY event_type, date_trunc('minute', ts) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    "usage_stats": "SELECT event_type, count(*) AS inferences, count(DISTINCT user_id) AS users, count(DISTINCT CAST(ts AS DATE)) AS days, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY event_type",
    "monthly_active": "SELECT strftime(ts, '%y-%m') AS month, count(DISTINCT user_id) AS users, count(*) AS n FROM events GROUP BY 1",
    "work_time": "SELECT event_id, strftime(ts, '%H:%M:%S') > '09:00:00' AND strftime(ts, '%H:%M:%S') < '18:00:00' AS at_work FROM events",
    "forward_fanout": "WITH g AS (SELECT DISTINCT event_type AS target FROM events) SELECT event_id AS id, event_type AS group_id, target FROM events JOIN g ON event_type <> target WHERE user_id <> 0",
    "history_window": f"WITH {M} SELECT id, count(*) OVER w AS talks, min(id) OVER w AS first_id FROM m WINDOW w AS (PARTITION BY group_id ORDER BY sec RANGE BETWEEN 7200 PRECEDING AND CURRENT ROW)",
    "lru_cache": """WITH a AS (SELECT strftime(ts, '%Y-%m-%d') || '/' || event_type AS cache, user_id % 16 AS key, event_id AS sec FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY cache ORDER BY sec) AS n FROM a),
l AS (SELECT *, lag(n) OVER (PARTITION BY cache, key ORDER BY sec) AS last FROM n)
SELECT l.sec AS event_id, l.last IS NOT NULL AND count(DISTINCT b.key) < 4 AS hit FROM l LEFT JOIN n b ON b.cache = l.cache AND b.n > l.last AND b.n < l.n GROUP BY l.sec, l.last""",
}
