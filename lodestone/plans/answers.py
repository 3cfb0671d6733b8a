"""Queries over prompts, replies, history hygiene, feedback and streams, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import calibrate
from lodestone.plans import tables as t
from lodestone.streaming import chats


def reply_format(spark, sf_dir):
    q = t.questions(spark, sf_dir)
    return q.select("query_id", F.sha2(tx.reply_text(F.col("text"), F.lit("done")), 256).alias("sha256"))


def reference_lists(spark, sf_dir):
    """The sources of each language's documents as a bullet list."""
    refs = t.table(spark, sf_dir, "documents").groupBy("lang").agg(F.sort_array(F.collect_set("source")).alias("refs"))
    return refs.select("lang", tx.reference_list(F.col("refs")).alias("list"))


def citation_prompt(spark, sf_dir):
    texts = F.array(F.concat(F.lit("# head "), "text"), F.lit("second"))
    return t.questions(spark, sf_dir).select("query_id", F.sha2(tx.cited_prompt(texts, F.lit("why?"), F.lit(False)), 256).alias("sha256"))


def history_hygiene(spark, sf_dir):
    """Pairs of each conversation's turns that stay: neither side empty or rejected (turns of three characters' multiples count as rejected)."""
    c = t.table(spark, sf_dir, "conversations")
    bot = F.when(F.length("text") % 3 == 0, F.lit("<reject>")).otherwise(F.col("text"))
    h = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.col("role").alias("user"), bot.alias("bot")))).alias("h"))
    return h.select("conv_id", F.size(tx.history_pairs_kept(F.col("h"))).cast("long").alias("kept"), F.size("h").cast("long").alias("all_pairs"))


def throttle_feedback(spark, sf_dir):
    return t.scored(spark, sf_dir).select("doc_id", F.round(calibrate.throttle_feedback(F.col("score")), 9).alias("throttle"))


def page_prefix(spark, sf_dir):
    """Names of text copies and image kinds from addresses."""
    from lodestone.sources.files import stored_name

    return t.table(spark, sf_dir, "pages").select("page_id", stored_name(F.col("url"), 24).alias("name"), tx.image_kind(F.concat(F.lit("data:image/"), F.when(F.col("page_id") % 2 == 0, "png").otherwise("gif"), F.lit(";base64,"))).alias("kind"))


def quoted_lines(spark, sf_dir):
    """Comments without their quoted lines: every second line of a text is quoted first."""
    d = t.table(spark, sf_dir, "documents")
    marked = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 2 == 1, F.concat(F.lit("> "), x)).otherwise(x)), "\n")
    return d.select("doc_id", F.sha2(tx.without_quotes(marked), 256).alias("sha256"))


def dedup_stream(spark, sf_dir):
    """Events that arrive twice in a stream, kept once within the watermark."""
    e = chats.read_table_stream(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    once = chats.once(e.union(e), "event_id")
    return chats.drained(once.select("event_id", "event_type")).groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("events"))


def limit_stream(spark, sf_dir):
    """Requests by event type and minute over a stream, and whether they exceed two."""
    e = chats.read_table_stream(spark, sf_dir, "events")
    requests = e.select(F.col("event_type").alias("key"), "ts", F.get_json_object("props", "$.k").cast("long").alias("tokens"))
    return chats.drained(chats.per_minute(requests, 2), "complete").select("key", F.unix_timestamp("slot").alias("slot"), "n", "tokens", "limited")


QUERIES = {f.__name__: f for f in (reply_format, reference_lists, citation_prompt, history_hygiene, throttle_feedback, page_prefix, quoted_lines, dedup_stream, limit_stream)}
ORACLE = {
    "reply_format": "SELECT item_id AS query_id, sha256(CASE WHEN length(text) > 30 THEN substr(text, 1, 30) || '..' ELSE text END || chr(10) || '---' || chr(10) || 'done') AS sha256 FROM benchmark",
    "reference_lists": "SELECT lang, '**References:**' || chr(10) || string_agg('* ' || source, chr(10) ORDER BY source) AS list FROM (SELECT DISTINCT lang, source FROM documents) GROUP BY lang",
    "citation_prompt": "SELECT item_id AS query_id, sha256('[1] head ' || text || chr(10) || chr(10) || '[2] second' || chr(10) || chr(10) || 'Answer from the numbered passages above and cite their numbers. Question: why?') AS sha256 FROM benchmark",
    "history_hygiene": "SELECT conv_id, count_if(length(text) > 0 AND length(text) % 3 <> 0) AS kept, count(*) AS all_pairs FROM conversations GROUP BY conv_id",
    "throttle_feedback": "SELECT doc_id, round(least(s + greatest(0, 1 - s) * CAST(0.02 AS DOUBLE), CAST(0.5 AS DOUBLE)), 9) AS throttle FROM (SELECT doc_id, round(CAST(n_chars % 997 AS DOUBLE) / CAST(997.0 AS DOUBLE), 6) AS s FROM documents JOIN labels USING (doc_id))",
    "page_prefix": "SELECT page_id, right(replace(url, '/', '_'), 24) AS name, CASE WHEN page_id % 2 = 0 THEN 'png' ELSE 'INVALID' END AS kind FROM pages",
    "quoted_lines": "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), k AS (SELECT doc_id, len(ls) AS n, list_transform(list_filter(range(1, len(ls) + 1), lambda i: i % 2 = 1), lambda i: ls[i]) AS odd FROM l) SELECT doc_id, sha256(array_to_string(odd, chr(10)) || CASE WHEN n % 2 = 0 THEN chr(10) ELSE '' END) AS sha256 FROM k",
    "dedup_stream": "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS events FROM events GROUP BY event_type",
    "limit_stream": "SELECT event_type AS key, CAST(epoch(date_trunc('minute', ts)) AS BIGINT) AS slot, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens, count(*) > 2 AS limited FROM events GROUP BY 1, 2",
}
