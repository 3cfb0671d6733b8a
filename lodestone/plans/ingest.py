"""Queries over splitters, sources, fusion, topics and streams. Those that SQL can tell have a twin; tests hold the others against plain versions."""

from __future__ import annotations


from pyspark.sql import functions as F

from lodestone.operators import bm25, fuse, splitters, topics
from lodestone.operators.bounded import few
from lodestone.plans import tables as t
from lodestone.sources import files, records


def _split(spark, sf_dir, splitter):
    return splitters.split_table(t.table(spark, sf_dir, "documents"), splitter)


def split_character(spark, sf_dir):
    return _split(spark, sf_dir, lambda x: splitters.by_separator(x, "\n"))


def split_recursive(spark, sf_dir):
    return _split(spark, sf_dir, splitters.recursive)


def split_cjk(spark, sf_dir):
    return _split(spark, sf_dir, splitters.chinese)


def split_lines(spark, sf_dir):
    """Lines as chunks: the drop form of a split, in built-in operators."""
    return t.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.filter(F.split("text", "\n"), lambda x: x != "")).alias("pos", "chunk"))


def split_sentences(spark, sf_dir):
    """Sentences that keep their full stop."""
    return t.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.filter(F.split("text", "(?<=\\.)"), lambda x: x != "")).alias("pos", "chunk"))


def split_markdown(spark, sf_dir):
    marked = F.concat(F.lit("# "), F.col("source"), F.lit("\n"), F.regexp_replace("text", "\n", "\n\n## "))
    return splitters.split_markdown_table(t.table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit(".md")).alias("path"), marked.alias("text")))


def split_code(spark, sf_dir):
    quoted = F.concat(F.lit('"""'), F.regexp_replace("text", "[^A-Za-z ]", ""), F.lit('"""\ndef f'), F.col("doc_id"), F.lit('():\n    """'), F.col("source"), F.lit('"""\n'))
    return splitters.split_table(t.table(spark, sf_dir, "documents").select("doc_id", quoted.alias("text")), lambda x: splitters.python_code(x, "module.py")).select("doc_id", "pos", "chunk")


def graph_pages(spark, sf_dir):
    return _split(spark, sf_dir, splitters.graph_pages)


def html_text(spark, sf_dir):
    return files.html_texts(t.table(spark, sf_dir, "pages"))


def _ranked(spark, sf_dir):
    """The best chunks of each question; a chunk's file holds it between a heading and a last line."""
    top = bm25.top_chunks(t.questions(spark, sf_dir), t.bm25_index(spark, sf_dir), 4)
    if few(t.questions(spark, sf_dir), 50_000):  # four rows a question: the texts need no shuffle
        top = F.broadcast(top)
    docs = t.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "source", "text")
    file_text = F.concat(F.lit("# "), F.col("source"), F.lit("\n"), F.col("text"), F.lit("\nend"))
    return top.join(docs, "chunk_id").select("query_id", "rank", F.col("text").alias("content"), F.concat_ws("/", "source", F.col("chunk_id").cast("string")).alias("source"), file_text.alias("text"))


def context_fuse(spark, sf_dir):
    out = fuse.fused(_ranked(spark, sf_dir), 4000)
    return out.select("query_id", F.sha2("context", 256).alias("context_sha256"), F.array_join("refs", ",").alias("refs"))


def context_short(spark, sf_dir):
    """The common path: lists that fit the budget."""
    out = fuse.short_context(_ranked(spark, sf_dir), 10_000_000)
    return out.select("query_id", F.sha2("context", 256).alias("context_sha256"), "refs")


def batch_answers(spark, sf_dir):
    queries = t.questions(spark, sf_dir).select("query_id", F.col("text").alias("query"))
    out = fuse.answered(queries, fuse.fused(_ranked(spark, sf_dir)))
    return out.select("query_id", "code", F.sha2("prompt", 256).alias("prompt_sha256"), F.sha2("reply", 256).alias("reply_sha256"), F.array_join("refs", ",").alias("refs"))


def topics_lda(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents").select("doc_id", topics.topic_words(F.col("text"), ["the", "que", "les", "und"]).alias("words"))
    bag, model = topics.fit_topics(docs, topics=20, rounds=3)
    return topics.topics_of(docs, bag, model)


def message_kinds(spark, sf_dir):
    """Events as callback JSON, read back as messages with the reason for which one is skipped."""
    kinds = F.create_map(*[F.lit(x) for kv in {"view": "80001", "purchase": "80002", "click": "80014", "error": "99999", "signup": "60007"}.items() for x in kv])
    data = F.struct(F.concat(F.lit("u"), F.col("user_id")).alias("fromUser"), F.when(F.col("user_id") % 10 > 0, F.concat(F.lit("g"), F.col("user_id") % 10)).alias("fromGroup"), F.col("props").alias("content"), F.col("event_id").alias("newMsgId"), (F.col("event_id") % 7 == 0).alias("self"))
    raw = t.table(spark, sf_dir, "events").select(F.to_json(F.struct(F.coalesce(kinds[F.col("event_type")], F.lit("0")).alias("messageType"), data.alias("data"))).alias("json"))
    return records.chat_messages(raw, "bot").groupBy("type", "skip_reason").agg(F.count("*").alias("n"), F.count_distinct("new_msg_id").alias("messages"))


def code_hits(spark, sf_dir):
    """First file match of JSON search results made from pages."""
    hit = lambda kind, path: F.struct(F.lit(kind).alias("__typename"), F.struct(path.alias("path"), F.sha2("html", 256).alias("content")).alias("file"))
    both = F.to_json(F.array(hit("Repository", F.lit("none")), hit("FileMatch", F.col("url"))))
    return records.file_matches(t.table(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), both.alias("text")))


def qa_pairs(spark, sf_dir):
    pair = F.to_json(F.create_map(F.concat(F.lit("q"), F.col("item_id")), F.col("text")))
    return records.qa_json(t.table(spark, sf_dir, "benchmark").select(pair.alias("text")))


QUERIES = {
    f.__name__: f
    for f in (
        split_character, split_recursive, split_cjk, split_lines, split_sentences, split_markdown, split_code, graph_pages, html_text, context_fuse, context_short, batch_answers, topics_lda, message_kinds,
        code_hits, qa_pairs,
    )
}


def _top_sql(k: int) -> str:
    from lodestone.plans.retrieval import SCORES_CTE, TOP_SQL

    return f"WITH {SCORES_CTE}, {TOP_SQL}, top AS (SELECT query_id, rank, d.* FROM ranked JOIN documents d ON doc_id = chunk_id WHERE rank <= {k} AND best >= 1e-5)"


def _squeezed(text: str) -> str:
    for pair, one in (("chr(10) || chr(10)", "chr(10)"), ("'  '", "' '")):
        for _ in range(3):
            text = f"replace({text}, {pair}, {one})"
    return text


#: Recursive: of chunks ch (doc_id, pos, chunk) and texts l (doc_id, text) where each chunk begins, looked for from a little before the end of the one before.
_LOCATED = """s AS (SELECT doc_id, pos, chunk, strpos(text, chunk) - 1 AS start_index, CASE WHEN strpos(text, chunk) > 0 THEN strpos(text, chunk) - 1 ELSE 0 END + length(chunk) - 32 AS seen FROM ch JOIN l USING (doc_id) WHERE pos = 0
UNION ALL SELECT doc_id, pos, chunk, found, CASE WHEN found >= 0 THEN found ELSE seen END + length(chunk) - 32 FROM (SELECT ch.doc_id, ch.pos, ch.chunk, s.seen, CASE WHEN strpos(substr(text, greatest(s.seen, 0) + 1), ch.chunk) > 0 THEN strpos(substr(text, greatest(s.seen, 0) + 1), ch.chunk) - 1 + greatest(s.seen, 0) ELSE -1 END AS found FROM s JOIN ch ON ch.doc_id = s.doc_id AND ch.pos = s.pos + 1 JOIN l ON l.doc_id = ch.doc_id))
SELECT doc_id, CAST(pos AS INTEGER) AS pos, chunk, CAST(start_index AS BIGINT) AS start_index FROM s"""
_FUSED = """, f AS (SELECT *, '# ' || source || chr(10) || text || chr(10) || 'end' AS ft FROM top),
c AS (SELECT *, coalesce(sum(length(ft) + 1) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f),
o AS (SELECT *, {budget} - before AS room, min(CASE WHEN before + length(ft) > {budget} THEN rank END) OVER (PARTITION BY query_id) AS full_at FROM c),
p AS (SELECT *, CASE WHEN full_at IS NULL OR rank < full_at THEN ft || chr(10) WHEN room > 0 THEN substr(ft, CAST(greatest(room, strpos(ft, text) - 1 + length(text)) - room + 1 AS BIGINT), CAST(room AS BIGINT)) ELSE '' END AS part FROM o WHERE full_at IS NULL OR rank <= full_at),
x AS (SELECT query_id, substr(string_agg(part, '' ORDER BY rank), 1, {budget}) AS context, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank) AS refs, arg_min(CASE WHEN full_at IS NULL OR rank < full_at THEN ft ELSE part END, rank) AS first_text FROM p GROUP BY query_id)"""
_KIND = "CASE event_type WHEN 'view' THEN 'text' WHEN 'purchase' THEN 'image' WHEN 'click' THEN 'ref' WHEN 'signup' THEN 'link' ELSE 'unknown' END"
ORACLE = {
    "split_lines": "WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS ls FROM documents) SELECT doc_id, CAST(unnest(range(len(ls))) AS INTEGER) AS pos, unnest(ls) AS chunk FROM l",
    "split_sentences": "WITH l AS (SELECT doc_id, list_filter(string_split(replace(text, '.', '.' || chr(1)), chr(1)), lambda x: x <> '') AS ls FROM documents) SELECT doc_id, CAST(unnest(range(len(ls))) AS INTEGER) AS pos, unnest(ls) AS chunk FROM l",
    "split_character": f"""WITH RECURSIVE l AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS p FROM documents WHERE text <> ''),
u AS (SELECT doc_id, p, len(p) AS n, list_transform(range(0, len(p) + 1), lambda i: CAST(coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) AS BIGINT) + i) AS upto FROM l),
c AS (SELECT doc_id, p, n, upto, CAST(0 AS BIGINT) AS first, CAST(greatest(1, len(list_filter(upto, lambda x: x <= 833)) - 1) AS BIGINT) AS last, 0 AS k FROM u WHERE n > 0
UNION ALL SELECT doc_id, p, n, upto, nf, CAST(greatest(last + 1, len(list_filter(upto, lambda x: x <= upto[nf + 1] + 833)) - 1) AS BIGINT), k + 1 FROM (SELECT *, CAST(least(greatest(first, len(list_filter(upto, lambda x: x < greatest(upto[last + 1] - 32, upto[last + 2] - 832) - 1))), last) AS BIGINT) AS nf FROM c WHERE last < n)),
t AS (SELECT doc_id, k, regexp_replace(array_to_string(p[first + 1:last], chr(10)), '^\\s+|\\s+$', '', 'g') AS chunk FROM c),
ch AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS pos, chunk FROM t WHERE chunk <> ''),
{_LOCATED}""",
    "graph_pages": f"""WITH RECURSIVE l AS (SELECT doc_id, text, string_split(text, chr(10)) AS p FROM documents WHERE text <> ''),
r AS (SELECT doc_id, p, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS page, CAST(0 AS BIGINT) AS size, CAST([] AS VARCHAR[]) AS done FROM l
UNION ALL SELECT doc_id, p, i + 1, CASE WHEN long THEN page1 ELSE list_append(page1, line) END, CASE WHEN long THEN size1 ELSE size1 + length(line) + 1 END, CASE WHEN long THEN list_append(done1, line) ELSE done1 END
FROM (SELECT *, length(line) >= 2048 AS long, CASE WHEN flush THEN CAST([] AS VARCHAR[]) ELSE page END AS page1, CASE WHEN flush THEN 0 ELSE size END AS size1, CASE WHEN flush THEN list_append(done, array_to_string(page, chr(10))) ELSE done END AS done1
FROM (SELECT *, p[i + 1] AS line, size + length(p[i + 1]) >= 2048 AND len(page) > 0 AS flush FROM r WHERE i < len(p)))),
e AS (SELECT doc_id, CASE WHEN len(list_filter(page, lambda x: x <> '')) > 0 THEN list_append(done, array_to_string(page, chr(10))) ELSE done END AS chunks FROM r WHERE i = len(p)),
ch AS (SELECT doc_id, unnest(range(len(chunks))) AS pos, unnest(chunks) AS chunk FROM e),
{_LOCATED}""",
    "split_code": r"""WITH d AS (SELECT doc_id, source, regexp_replace(regexp_replace(text, '[^A-Za-z ]', '', 'g'), '^ +', '') AS doc FROM documents WHERE text IS NOT NULL)
SELECT doc_id, 0 AS pos, 'module.py' AS chunk FROM d UNION ALL SELECT doc_id, 1, doc FROM d WHERE doc <> '' UNION ALL SELECT doc_id, CASE WHEN doc <> '' THEN 2 ELSE 1 END, 'f' || doc_id || ' ' || source FROM d""",
    "html_text": rf"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS h FROM pages),
b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(h, '<[^>]*>', '', 'g'), '&lt;', '<'), '&copy;', '©'), '&middot;', '·'), '&nbsp;', chr(160)), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS t FROM a)
SELECT page_id, {_squeezed('t')} AS text FROM b""",
    "context_fuse": _top_sql(4) + _FUSED.format(budget=4000) + " SELECT query_id, sha256(context) AS context_sha256, refs FROM x",
    "batch_answers": _top_sql(4) + _FUSED.format(budget=40_000) + """, q AS (SELECT item_id AS query_id, text AS query, CASE WHEN length(text) = 0 THEN 'QUESTION_EMPTY' WHEN length(text) < 8 THEN 'QUESTION_TOO_SHORT' WHEN context IS NULL THEN 'UNRELATED' ELSE 'SUCCESS' END AS code, context, coalesce(refs, '') AS refs, first_text FROM benchmark LEFT JOIN x ON x.query_id = item_id)
SELECT query_id, code, refs, CASE WHEN code = 'SUCCESS' THEN sha256('Answer from the material alone.' || chr(10) || 'Material:' || chr(10) || context || chr(10) || 'Question: ' || query) END AS prompt_sha256, CASE WHEN code = 'SUCCESS' THEN sha256(substr(first_text, 1, 200)) END AS reply_sha256 FROM q""",
    "context_short": _top_sql(4) + " SELECT query_id, sha256(string_agg('# ' || source || chr(10) || text || chr(10) || 'end' || chr(10), '' ORDER BY rank)) AS context_sha256, string_agg(source || '/' || doc_id, ',' ORDER BY rank) AS refs FROM top GROUP BY query_id",
    "message_kinds": f"""WITH m AS (SELECT {_KIND} AS type, event_id, user_id FROM events), r AS (SELECT *, CASE WHEN user_id % 10 = 0 THEN 'no group' WHEN type = 'unknown' THEN 'unknown type' WHEN event_id % 7 = 0 THEN 'own message' END AS skip_reason FROM m)
SELECT type, skip_reason, count(*) AS n, count(DISTINCT event_id) AS messages FROM r GROUP BY ALL""",
    "code_hits": "SELECT page_id AS key, url AS path, sha256(html) AS content FROM pages",
    "qa_pairs": "SELECT 'q' || item_id AS content, 'q' || item_id || ': ' || text AS qa, 'qa' AS modal FROM benchmark",
}
