"""Queries over stores, sinks, lookups, prompts, slots and the graph's decisions, with their SQL twins. What is written is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import prompts as pr
from lodestone.functions import slots
from lodestone.functions import text as tx
from lodestone.operators import bm25, calibrate, fuse, graph, ranking, topics
from lodestone.plans import tables as t
from lodestone.plans.retrieval import HOPS_SQL, _edges, _hops
from lodestone.sources import files, graph_store, index_store, records
from lodestone.streaming import chats

# ---------------------------------------------------------------- graph


def graph_threshold(spark, sf_dir):
    """Parts as queries: a score from the price, the graph bonus taken off the threshold."""
    price = (F.floor("p_retailprice") % 100).cast("double") / F.lit(100.0)
    asked = t.table(spark, sf_dir, "part").select(F.concat(F.lit("e"), F.col("p_partkey")).alias("query_id"), F.when(F.col("p_partkey") % 7 > 0, F.round(price, 6)).alias("score"))
    rows = graph.decided(asked, graph.bonus(_hops(spark, sf_dir)).withColumnRenamed("entity", "query_id"), 0.41)
    return rows.select("query_id", "score", F.round("bonus", 6).alias("bonus"), "accepted")


def kg_retrieve(spark, sf_dir):
    """Every 50th part asks for itself and the next one: files with their chunks, the smallest lists first."""
    mine = t.table(spark, sf_dir, "part").where("p_partkey % 50 = 0")
    asked = mine.select(F.col("p_partkey").alias("query_id"), F.explode(F.array(F.concat(F.lit("e"), F.col("p_partkey")), F.concat(F.lit("e"), F.col("p_partkey") + 1))).alias("entity"))
    return graph.retrieved(asked, _edges(spark, sf_dir)).select("query_id", "place", "file", F.array_join("chunks", ",").alias("chunks"))


def _graph_nodes(spark, sf_dir):
    named = lambda table, letter, key, data: t.table(spark, sf_dir, table).select(F.concat(F.lit(letter), F.col(key)).alias("uuid"), F.lit(table).alias("type"), F.col(data).cast("string").alias("data"))
    return named("orders", "c", "o_orderkey", "o_orderpriority").unionByName(named("customer", "f", "c_custkey", "c_name"))


def kg_labels(spark, sf_dir):
    """Edges between orders and customers with the labels and data of both ends."""
    return graph.labelled_edges(_edges(spark, sf_dir), _graph_nodes(spark, sf_dir))


def kg_upserts(spark, sf_dir):
    """Upsert records of the graph, counted by kind and label."""
    return index_store.graph_rows(_graph_nodes(spark, sf_dir), _edges(spark, sf_dir)).groupBy("kind", "label").agg(F.count("*").alias("n"), F.count_distinct("a").alias("sources"))


def kg_append(spark, sf_dir):
    """Nodes appended in two runs, the second over all files: the files of the first are not done again."""
    folder = t.work(spark, "graph")
    path = F.concat(F.lit("file"), F.col("o_orderkey") % 5)
    orders = t.table(spark, sf_dir, "orders")
    nodes = orders.select(path.alias("path"), F.lit("chunk").alias("type"), F.concat(F.lit("c"), F.col("o_orderkey")).alias("uuid"), F.col("o_orderpriority").alias("data"))
    relations = orders.select(path.alias("path"), F.concat(F.lit("c"), F.col("o_orderkey")).alias("src"), F.concat(F.lit("f"), F.col("o_custkey")).alias("dst"), F.lit("page").alias("desc"))
    for part in ("path < 'file2'", "true"):
        graph_store.append_graph(folder, nodes.where(part).select("path"), nodes, relations)
    lines = graph_store.read_lines(spark, f"{folder}/nodes", graph_store.NODES).groupBy("data").agg(F.count("*").alias("lines"))
    read, edges = graph_store.read_graph(spark, folder)
    ends = edges.groupBy(F.col("src").alias("uuid")).agg(F.count("*").alias("n"))
    return read.join(ends, "uuid").groupBy("data").agg(F.count("*").alias("nodes"), F.sum("n").alias("edges")).join(lines, "data")


# ---------------------------------------------------------------- lookups and sinks


def entity_lookup(spark, sf_dir):
    """Names by number: every 50th key asks a stored table, keys without a row stay."""
    keys = t.table(spark, sf_dir, "orders").where("o_orderkey % 50 = 0").select((F.col("o_orderkey") * 3).alias("o_orderkey"))
    found = index_store.looked_up(keys, t.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("long").alias("o_custkey")), "o_orderkey")
    return found.select("o_orderkey", F.coalesce("o_custkey", F.lit(-1)).alias("o_custkey"))


def library_lookup(spark, sf_dir):
    """From a name's last four characters to a library, from the library to its information."""
    c = t.table(spark, sf_dir, "customer")
    suffixes = c.select(tx.suffix4(F.col("c_name")).alias("suffix"), F.col("c_custkey").alias("library"))
    info = c.select(F.col("c_custkey").alias("library"), "c_mktsegment")
    asked = t.table(spark, sf_dir, "supplier").select("s_suppkey", tx.suffix4(F.col("s_name")).alias("suffix"))
    found = index_store.looked_up(index_store.looked_up(asked, suffixes, "suffix"), info, "library")
    return found.select("s_suppkey", "suffix", F.coalesce(F.col("library").cast("long"), F.lit(-1)).alias("library"), "c_mktsegment")


def query_export(spark, sf_dir):
    """The rows of a keyed store as JSON under their keys."""
    rows = t.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return index_store.exported_hash(rows, "store:query", ["user_id", "event_id"])


def session_log(spark, sf_dir):
    """Sessions appended to a log of JSON lines in two runs and read back."""
    folder = t.work(spark, "sessions")
    for part in (0, 1):
        index_store.appended_json(t.table(spark, sf_dir, "conversations").where(F.col("turn") % 2 == part).select("conv_id", "turn", "role"), folder)
    return spark.read.schema("conv_id long, turn long, role string").json(folder).groupBy("role").agg(F.count("*").alias("n"), F.count_distinct("conv_id").alias("conversations"))


def group_files(spark, sf_dir):
    """A folder for each user with at least 60 events, read back."""
    folder = t.work(spark, "groups")
    rows = t.table(spark, sf_dir, "events").select("user_id", "event_id")
    index_store.per_group(rows, "user_id", 60, folder)
    return index_store.read_groups(spark, folder, rows.schema, "user_id").groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


def text_by_hash(spark, sf_dir):
    """Each text once under its hash."""
    d = t.table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"), "text")
    return files.files_text(d).select("hash", F.length("text").alias("n_chars"), "n_files", "first_path")


def table_columns(spark, sf_dir):
    """The columns of a table that lack no value, as JSON by row number."""
    n = t.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("row"), "n_name", F.when(F.col("n_nationkey") > 3, F.col("n_name")).alias("holes"), F.col("n_regionkey").cast("long").alias("region"))
    return files.table_json(n, "row")


def closed_issues(spark, sf_dir):
    """Pages as issues and pull requests, open and closed."""
    kind = F.when(F.col("page_id") % 3 == 0, "/issues/").otherwise("/pull/")
    rows = t.table(spark, sf_dir, "pages").select(F.concat("url", kind, "page_id").alias("html_url"), F.when(F.col("page_id") % 2 == 0, "closed").otherwise("open").alias("state"))
    return records.closed_issues(rows).select("html_url")


def issue_pages(spark, sf_dir):
    """Conversations as issues: the first turn is the body, the others comments, each with a quoted line that goes."""
    c = t.table(spark, sf_dir, "conversations")
    text = F.concat(F.lit("> said before\n"), F.col("text"))
    first = c.where("turn = 0").select(F.col("conv_id").alias("number"), F.concat(F.lit("About "), F.col("role")).alias("title"), text.alias("body"))
    rest = c.where("turn > 0").select(F.col("conv_id").alias("number"), F.col("turn").alias("seq"), text.alias("text"))
    return records.issue_markdown(first, rest).select("name", F.sha2("md", 256).alias("sha256"))


# ---------------------------------------------------------------- chunks, prompts, slots


def modal_filter(spark, sf_dir):
    """Chunks by kind that a text embedder takes."""
    modal = F.when(F.col("doc_id") % 3 == 0, "image").when(F.col("doc_id") % 3 == 1, "qa").otherwise("text")
    return fuse.for_embedder(t.table(spark, sf_dir, "documents").select("doc_id", modal.alias("modal")), False).groupBy("modal").agg(F.count("*").alias("n"))


def chunk_sources(spark, sf_dir):
    """What ranked chunks stand for: themselves behind an address, a question with its answer, or their file's text."""
    d = t.table(spark, sf_dir, "documents")
    n = F.col("doc_id") % 4
    modal = F.when(n == 0, "qa").otherwise("text")
    source = F.when(n == 1, F.concat(F.lit("http://x/"), F.col("doc_id"))).when(n == 2, F.concat(F.lit("gone"), F.col("doc_id"))).otherwise(F.concat(F.lit("f"), F.col("doc_id")))
    ranked = d.select(F.col("lang").alias("query_id"), F.col("doc_id").alias("rank"), modal.alias("modal"), source.alias("source"), F.col("source").alias("content"), F.concat_ws(": ", "source", "lang").alias("qa"))
    texts = d.select(F.concat(F.lit("f"), F.col("doc_id")).alias("source"), F.col("text").alias("file_text"))
    return fuse.with_source_text(ranked, texts).select(F.col("rank").alias("doc_id"), F.sha2("text", 256).alias("sha256"))


def all_chunks(spark, sf_dir):
    """Questions with answers first, then the lines of files, each with its modal."""
    pair = F.to_json(F.create_map(F.concat(F.lit("q"), F.col("item_id")), F.col("text")))
    qa = records.qa_json(t.table(spark, sf_dir, "benchmark").select(pair.alias("text"))).select("content", "modal")
    lines = t.table(spark, sf_dir, "documents").select(F.explode(F.filter(F.split("text", "\n"), lambda x: x != "")).alias("content"), F.lit("text").alias("modal"))
    return fuse.united(qa, lines).groupBy("modal", "source_rank").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("n_chars"))


def web_context(spark, sf_dir):
    """The best documents of each question as articles, one behind the other, cut to 3000 characters."""
    top = bm25.top_chunks(t.questions(spark, sf_dir), t.bm25_index(spark, sf_dir), 4)
    d = t.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.concat(F.lit("http://x/"), F.col("doc_id")).alias("link"), "text")
    out = fuse.web_context(top.join(d, "chunk_id"), 3000)
    return out.select("query_id", F.sha2("context", 256).alias("sha256"), F.array_join("refs", ",").alias("refs"))


def prompts(spark, sf_dir):
    """Every template over the questions, in both languages."""
    q = t.questions(spark, sf_dir)
    chinese = F.col("query_id") % 2 == 1
    made = F.array(*[F.struct(F.lit(name).alias("name"), F.sha2(pr.prompt(name, chinese, F.col("text"), F.col("query_id").cast("string")), 256).alias("sha256")) for name in pr.TEMPLATES])
    return q.select("query_id", F.inline(made))


def slot_calls(spark, sf_dir):
    """A slot that fails twice on every third text before it answers, under the cap of tasks and with retries."""

    def make():
        failed: dict[str, int] = {}

        def reverse(x: str) -> str:
            if len(x) % 3 == 0 and failed.setdefault(x, 0) < 2:
                failed[x] += 1
                raise TimeoutError
            return x[::-1]

        return reverse

    rows = slots.called(t.questions(spark, sf_dir), "text", "reply", make(), most=4, wait_s=0.0)
    return rows.select("query_id", F.sha2("reply", 256).alias("sha256"))


def embed_texts(spark, sf_dir):
    """Vectors of texts by the built-in stand-in of an embedder: buckets that hold anything, and the length."""
    v = t.questions(spark, sf_dir).select("query_id", slots.word_vector(F.col("text")).alias("v"))
    return v.select("query_id", F.posexplode("v").alias("bucket", "x")).select("query_id", "bucket", F.round("x", 6).alias("x"))


def json_events(spark, sf_dir):
    """Answers with fences, plain strings and objects that list events."""
    answer = F.concat(F.lit("Sure: ```json ['a"), F.col("event_id"), F.lit("', {'events': ['b', 'c"), F.col("user_id"), F.lit("']}, {'x': 1}] ```"))
    return t.table(spark, sf_dir, "events").select("event_id", F.array_join(tx.json_events(answer), "|").alias("events"))


def query_limits(spark, sf_dir):
    d = t.table(spark, sf_dir, "documents")
    return d.select("doc_id", *[F.sha2(tx.cut_query(F.col("text"), w), 256).alias(w) for w in tx.QUERY_MOST])


def upload_limits(spark, sf_dir):
    """Whether each source's files may be uploaded together."""
    sums = t.table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(F.octet_length("text")).alias("size"))
    return sums.select("source", "size", tx.within_upload(F.col("size"), 400_000).alias("allowed"))


def rerank_fallback(spark, sf_dir):
    """A reranker that fails for every second question: its candidates keep their order."""
    n = t.table(spark, sf_dir, "conversations").select((F.col("conv_id") % 20).alias("query_id"), F.col("text").alias("query"), (F.col("conv_id") * 100 + F.col("turn")).alias("chunk_id"), "text", F.col("turn").alias("place"))
    failing = lambda q, x: F.when(F.col("query_id") % 2 == 0, (F.length(x) % 50).cast("double")).when(F.col("chunk_id") % 3 == 0, F.lit(1.0))
    return ranking.reranked(n, 5, failing).select("query_id", "rank", "chunk_id")


def truth_join(spark, sf_dir):
    """Labels beside predictions by document, and their agreement."""
    truth = t.table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("truth"))
    guess = t.table(spark, sf_dir, "documents").where("doc_id % 5 > 0").select("doc_id", (F.col("n_chars") > 1500).alias("predicted"))
    out = calibrate.agreement(calibrate.with_truth(truth, guess, ["doc_id"]))
    return out.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def topic_bags(spark, sf_dir):
    """Words of topics of documents that have 300 characters of them."""
    d = t.table(spark, sf_dir, "documents").select("doc_id", topics.topic_words(F.col("text"), ["the", "que", "les", "und"]).alias("words"))
    return topics.long_enough(d).select("doc_id", F.size("words").cast("long").alias("n"), F.sha2(F.array_join("words", " "), 256).alias("sha256"))


def topic_sources(spark, sf_dir):
    """Topic rows under hashed names with the paths behind them. Names are whole hashes: eight digits of them collide among 100,000 documents."""
    name = tx.short_hash(F.col("doc_id").cast("string"), 64).alias("name")
    d = t.table(spark, sf_dir, "documents").select(name, F.concat("source", F.lit("/"), "doc_id").alias("path"))
    given = t.table(spark, sf_dir, "labels").select(name, F.col("quality").alias("topic"), F.lit(0.5).alias("share"))
    return topics.topic_sources(given, d).groupBy("topic").agg(F.count("*").alias("n"), F.min("path").alias("first_path"))


# ---------------------------------------------------------------- streams


def merge_stream(spark, sf_dir):
    """Bursts of each user's events in a stream."""
    e = chats.read_table_stream(spark, sf_dir, "events")
    out = chats.drained(chats.bursts(e, "user_id", "1 hour"), "complete")
    return out.select("user_id", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "n")


def queue_drain(spark, sf_dir):
    """A drained queue: purchases first, each priority first in, first out."""
    e = t.table(spark, sf_dir, "events").select("event_id", "ts", F.when(F.col("event_type") == "purchase", 0).otherwise(1).alias("priority"))
    return chats.by_priority(e, ["event_id"]).select("event_id", "priority", "place")


def live_responses(spark, sf_dir):
    """Responses that a poll on the last day still finds."""
    e = t.events(spark, sf_dir)
    last = e.agg(F.max("ts").alias("now"))
    return chats.live(e.crossJoin(F.broadcast(last)), F.col("now")).select("event_id")


def reply_deltas(spark, sf_dir):
    return chats.deltas(t.questions(spark, sf_dir).select("query_id", F.col("text").alias("reply")), 40)


def reverted_messages(spark, sf_dir):
    """Own messages that an error event of the same user takes back within two minutes."""
    e = t.events(spark, sf_dir).withColumnRenamed("user_id", "group_id")
    return chats.reverted(e.where("event_type <> 'error'").select("group_id", "event_id", "ts"), e.where("event_type = 'error'").select("group_id", "ts"), 6000).select("event_id")


QUERIES = {
    f.__name__: f
    for f in (
        graph_threshold, kg_retrieve, kg_labels, kg_upserts, kg_append, entity_lookup, library_lookup, query_export, session_log, group_files, text_by_hash, table_columns, closed_issues, issue_pages,
        modal_filter, chunk_sources, all_chunks, web_context, prompts, slot_calls, embed_texts, json_events, query_limits, upload_limits, rerank_fallback, truth_join, topic_bags, topic_sources,
        merge_stream, queue_drain, live_responses, reply_deltas, reverted_messages,
    )
}


def _prompt_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    filled = lambda x: f"replace(replace({quoted(x)}, '{{0}}', text), '{{1}}', CAST(item_id AS VARCHAR))"
    return " UNION ALL ".join(f"SELECT item_id AS query_id, '{n}' AS name, sha256(CASE WHEN item_id % 2 = 1 THEN {filled(zh)} ELSE {filled(en)} END) AS sha256 FROM benchmark" for n, (en, zh) in pr.TEMPLATES.items())


def _top_sql(k: int) -> str:
    from lodestone.plans.ingest import _top_sql as top

    return top(k)


EDGES_SQL = "lines AS (SELECT DISTINCT 'e' || l_partkey AS src, 'c' || l_orderkey AS dst, 'type' AS \"desc\" FROM lineitem), pages2 AS (SELECT 'c' || o_orderkey AS src, 'f' || o_custkey AS dst, 'page' || o_orderkey % 7 AS \"desc\" FROM orders), edges AS (SELECT * FROM lines UNION ALL SELECT * FROM pages2)"
ORACLE = {
    "graph_threshold": f"""{HOPS_SQL}, b AS (SELECT entity, CAST(0.2 AS DOUBLE) * least(100, count(DISTINCT file)) / CAST(100 AS DOUBLE) AS bonus FROM hops GROUP BY entity),
q AS (SELECT 'e' || p_partkey AS query_id, CASE WHEN p_partkey % 7 > 0 THEN round(CAST(CAST(floor(p_retailprice) AS BIGINT) % 100 AS DOUBLE) / CAST(100 AS DOUBLE), 6) END AS score FROM part)
SELECT query_id, score, round(coalesce(bonus, 0), 6) AS bonus, coalesce(score, -1) >= CAST(0.41 AS DOUBLE) - coalesce(bonus, 0) AS accepted FROM q LEFT JOIN b ON entity = query_id""",
    "kg_retrieve": """WITH asked AS (SELECT p_partkey AS query_id, unnest([p_partkey, p_partkey + 1]) AS partkey FROM part WHERE p_partkey % 50 = 0),
h AS (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem), l AS (SELECT query_id, 'f' || o_custkey AS file, list('c' || l_orderkey ORDER BY 'c' || l_orderkey) AS chunks FROM asked JOIN h ON l_partkey = partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY len(chunks), file) AS INTEGER) AS place, file, array_to_string(chunks, ',') AS chunks FROM l""",
    "kg_labels": "SELECT 'c' || o_orderkey AS src, 'f' || o_custkey AS dst, 'PAGE_OF' AS relation, 'Orders' AS src_label, 'Customer' AS dst_label, CAST(o_orderpriority AS VARCHAR) AS src_data, c_name AS dst_data FROM orders JOIN customer ON c_custkey = o_custkey",
    "kg_upserts": f"WITH {EDGES_SQL}, n AS (SELECT 'node' AS kind, 'Orders' AS label, 'c' || o_orderkey AS a FROM orders UNION ALL SELECT 'node', 'Customer', 'f' || c_custkey FROM customer UNION ALL SELECT 'edge', CASE WHEN \"desc\" = 'type' THEN 'TYPE' ELSE 'PAGE_OF' END, src FROM edges) SELECT kind, label, count(*) AS n, count(DISTINCT a) AS sources FROM n GROUP BY ALL",
    "kg_append": "SELECT o_orderpriority AS data, count(*) AS nodes, count(*) AS edges, count(*) AS lines FROM orders GROUP BY o_orderpriority",
    "entity_lookup": "SELECT k.o_orderkey, CAST(coalesce(o.o_custkey, -1) AS BIGINT) AS o_custkey FROM (SELECT o_orderkey * 3 AS o_orderkey FROM orders WHERE o_orderkey % 50 = 0) k LEFT JOIN orders o USING (o_orderkey)",
    "library_lookup": "SELECT CAST(coalesce(library, -1) AS BIGINT) AS library, suffix, s_suppkey, c.c_mktsegment FROM (SELECT s_suppkey, right(s_name, 4) AS suffix FROM supplier) s LEFT JOIN (SELECT right(c_name, 4) AS suffix, c_custkey AS library FROM customer) l USING (suffix) LEFT JOIN customer c ON c_custkey = library",
    "query_export": """SELECT 'store:query:' || user_id || ':' || event_id AS name, '{"user_id":' || user_id || ',"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS value FROM events""",
    "session_log": "SELECT role, count(*) AS n, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY role",
    "group_files": "SELECT user_id, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY user_id HAVING count(*) >= 60",
    "text_by_hash": "SELECT sha256(text) AS hash, CAST(any_value(length(text)) AS INTEGER) AS n_chars, count(*) AS n_files, min(source || '/' || lpad(CAST(doc_id AS VARCHAR), 9, '0')) AS first_path FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "table_columns": """SELECT 'n_name' AS "column", CAST(0 AS BIGINT) AS block, '{' || string_agg('"' || n_nationkey || '":"' || n_name || '"', ',' ORDER BY n_nationkey) || '}' AS value FROM nation
UNION ALL SELECT 'region', CAST(0 AS BIGINT), '{' || string_agg('"' || n_nationkey || '":"' || n_regionkey || '"', ',' ORDER BY n_nationkey) || '}' FROM nation""",
    "closed_issues": "SELECT url || '/issues/' || page_id AS html_url FROM pages WHERE page_id % 6 = 0 UNION ALL SELECT url || '/pull/' || page_id FROM pages WHERE page_id % 2 = 0 AND page_id % 3 > 0 AND contains(url, 'issues')",
    "issue_pages": "SELECT 'issue-' || conv_id || '.md' AS name, sha256('# About ' || max(CASE WHEN turn = 0 THEN role END) || chr(10) || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS sha256 FROM conversations GROUP BY conv_id HAVING count(CASE WHEN turn = 0 THEN 1 END) > 0",
    "modal_filter": "SELECT CASE WHEN doc_id % 3 = 1 THEN 'qa' ELSE 'text' END AS modal, count(*) AS n FROM documents WHERE doc_id % 3 > 0 GROUP BY 1",
    "chunk_sources": "SELECT doc_id, sha256(CASE doc_id % 4 WHEN 0 THEN source || ': ' || lang WHEN 1 THEN source WHEN 3 THEN text END) AS sha256 FROM documents",
    "all_chunks": "SELECT 'qa' AS modal, 0 AS source_rank, count(*) AS n, CAST(sum(length('q' || item_id)) AS BIGINT) AS n_chars FROM benchmark UNION ALL SELECT 'text', 1, count(*), CAST(sum(length(l)) AS BIGINT) FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents) WHERE l <> ''",
    "web_context": _top_sql(3) + " SELECT query_id, sha256(substr(string_agg(text || chr(10), '' ORDER BY rank), 1, 3000)) AS sha256, string_agg('http://x/' || doc_id, ',' ORDER BY rank) AS refs FROM top WHERE text <> '' GROUP BY query_id",
    "prompts": _prompt_sql(),
    "slot_calls": "SELECT item_id AS query_id, sha256(reverse(text)) AS sha256 FROM benchmark",
    "embed_texts": """WITH w AS (SELECT DISTINCT item_id, unnest(string_split(lower(text), ' ')) AS w FROM benchmark), b AS (SELECT item_id, CAST('0x' || substr(md5(w), 1, 4) AS INTEGER) % 16 AS bucket, count(*) AS n FROM w WHERE w <> '' GROUP BY ALL),
s AS (SELECT item_id, sqrt(sum(CAST(n * n AS DOUBLE))) AS norm FROM b GROUP BY item_id), g AS (SELECT item_id, unnest(range(16)) AS bucket FROM benchmark)
SELECT g.item_id AS query_id, CAST(g.bucket AS INTEGER) AS bucket, round(coalesce(n / norm, 0), 6) AS x FROM g LEFT JOIN b USING (item_id, bucket) LEFT JOIN s ON s.item_id = g.item_id""",
    "json_events": "SELECT event_id, 'a' || event_id || '|b|c' || user_id AS events FROM events",
    "query_limits": "SELECT doc_id, sha256(substr(coalesce(text, ''), 1, 512)) AS retrieve, sha256(substr(coalesce(text, ''), 1, 400)) AS demo, sha256(substr(coalesce(text, ''), 1, 32)) AS web FROM documents",
    "upload_limits": "SELECT source, CAST(sum(strlen(text)) AS BIGINT) AS size, sum(strlen(text)) <= 400000 AS allowed FROM documents GROUP BY source",
    "rerank_fallback": """WITH n AS (SELECT conv_id % 20 AS query_id, conv_id * 100 + turn AS chunk_id, turn AS place, CASE WHEN conv_id % 20 % 2 = 0 THEN CAST(length(text) % 50 AS DOUBLE) WHEN (conv_id * 100 + turn) % 3 = 0 THEN 1 END AS score FROM conversations),
f AS (SELECT *, max(score IS NULL) OVER (PARTITION BY query_id) AS failed FROM n)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN NOT failed THEN -score END, CASE WHEN failed THEN place END, chunk_id) AS INTEGER) AS rank, chunk_id FROM f QUALIFY rank <= 5""",
    "truth_join": """WITH r AS (SELECT quality = 1 AS truth, coalesce(n_chars > 1500 AND d.doc_id % 5 > 0, false) AS predicted FROM labels LEFT JOIN documents d USING (doc_id)), c AS (SELECT count_if(truth AND predicted) AS tp, count_if(NOT truth AND predicted) AS fp, count_if(truth AND NOT predicted) AS fn FROM r),
p AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS r FROM c)
SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM p""",
    "topic_bags": r"""WITH h AS (SELECT doc_id, regexp_split_to_array(lower(substr(text, 1, CAST(floor(length(text) * CAST(0.8 AS DOUBLE)) AS BIGINT))), '[^\p{L}\p{N}_]+') AS ws FROM documents),
k AS (SELECT doc_id, list_filter(ws, lambda w: w <> '' AND w <> 'images' AND NOT regexp_full_match(w, '[0-9a-f]{6,}') AND NOT regexp_full_match(w, '[0-9]+(\.[0-9]+)*') AND w NOT IN ('the', 'que', 'les', 'und')) AS words FROM h)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n, sha256(array_to_string(words, ' ')) AS sha256 FROM k WHERE length(array_to_string(words, ' ')) >= 300""",
    "topic_sources": "SELECT quality AS topic, count(*) AS n, min(source || '/' || doc_id) AS first_path FROM labels JOIN documents USING (doc_id) GROUP BY quality",
    "merge_stream": """WITH e AS (SELECT user_id, epoch_us(ts) AS us FROM events), b AS (SELECT *, CASE WHEN us - lag(us) OVER w <= 3600000000 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS run FROM b) SELECT user_id, min(us) AS first_us, max(us) AS last_us, count(*) AS n FROM r GROUP BY user_id, run""",
    "queue_drain": "SELECT event_id, CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END AS priority, row_number() OVER (ORDER BY CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END, ts, event_id) AS place FROM events",
    "live_responses": "SELECT event_id FROM events WHERE CAST(floor(epoch((SELECT max(ts) FROM events))) AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) <= 86400",
    "reply_deltas": "SELECT item_id AS query_id, CAST(seq AS INTEGER) AS seq, substr(text, CAST(seq * 40 + 1 AS BIGINT), 40) AS delta FROM (SELECT item_id, text, unnest(range(CAST(ceil(length(text) / 40.0) AS BIGINT))) AS seq FROM benchmark)",
    "reverted_messages": "SELECT s.event_id FROM events s WHERE event_type <> 'error' AND EXISTS (SELECT 1 FROM events c WHERE c.event_type = 'error' AND c.user_id = s.user_id AND c.ts >= s.ts AND CAST(floor(epoch(c.ts)) AS BIGINT) - CAST(floor(epoch(s.ts)) AS BIGINT) <= 6000)",
}
