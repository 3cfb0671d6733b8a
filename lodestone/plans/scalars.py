"""Queries over scalar functions, predicates, statistics and set operations, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import fuse, ranking, stats
from lodestone.operators.bounded import small_side
from lodestone.plans import tables as t

#: An ordered list of domains that searches prefer.
DOMAINS = ["example.net", "example.org", "example.com"]


def _docs(spark, sf_dir):
    return t.table(spark, sf_dir, "documents")


def useful_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(tx.useful_share(F.col("text")), 6).alias("share"), tx.is_useful(F.col("text")).alias("useful"))


def judge_language(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.language(F.col("text")).alias("language"))


def normalize_ws(spark, sf_dir):
    spaced = F.replace(F.replace("text", F.lit("\n"), F.lit("\n\n\n")), F.lit(". "), F.lit(".     "))
    return _docs(spark, sf_dir).select("doc_id", F.sha2(tx.normalised_space(spaced), 256).alias("sha256"))


def clean_md(spark, sf_dir):
    marked = F.concat(F.lit("# [Title](http://x.example) ______ ```code\nmore``` "), F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.sha2(tx.clean_markdown(marked), 256).alias("sha256"))


def score_parse(spark, sf_dir):
    return t.events(spark, sf_dir).select("event_id", tx.score_of(F.col("props"), 10).alias("score"), tx.score_of(F.col("event_type"), 10).alias("fallback"))


def score_gates(spark, sf_dir):
    """Gates of the serial pipeline over scores in events: relevance, answer, security."""
    return t.events(spark, sf_dir).select("event_id", tx.pipeline_code(tx.score_of(F.col("props"), 10)).alias("code"))


def content_hash(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.short_hash(F.col("text")).alias("hash8"), tx.short_hash(F.col("text"), 6).alias("hash6"), tx.suffix4(F.col("source")).alias("suffix"))


def image_names(spark, sf_dir):
    return t.table(spark, sf_dir, "pages").select("page_id", tx.image_name(F.concat("url", F.lit("/a.png"))).alias("name"))


def model_bucket(spark, sf_dir):
    n = tx.remote_token_length(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", n.alias("tokens"), tx.model_bucket(n).alias("context"))


def query_guards(spark, sf_dir):
    return t.questions(spark, sf_dir).select("query_id", tx.query_guard(F.col("text")).alias("guard"), F.length(F.substring("text", 1, 512)).alias("kept"))


def intention_gate(spark, sf_dir):
    e = t.events(spark, sf_dir)
    intent = F.when(F.col("event_type") == "view", "Greeting").when(F.col("event_type") == "error", None).otherwise(F.col("event_type"))
    code = F.when(tx.blocked(intent, ["greeting", "undefine"]), "NOT_A_QUESTION").when(tx.blocked(intent, ["identity", "sign"]), "NO_TOPIC").otherwise("INIT")
    return e.select("event_id", code.alias("code"))


def type_from_suffix(spark, sf_dir):
    path = F.regexp_replace("url", "[?#].*$", "")
    return t.table(spark, sf_dir, "pages").select("page_id", tx.file_type(path).alias("type"), F.coalesce(tx.file_type(path) != "code", F.lit(False)).alias("is_document"))


def preprocess_states(spark, sf_dir):
    """State and reason of each page as a file of its type."""
    kind = tx.file_type(F.regexp_replace("url", "[?#].*$", ""))
    reason = stats.preprocess_reason(kind, F.lit(True), F.col("html").isNotNull())
    return t.table(spark, sf_dir, "pages").select("page_id", (reason == "preprocessed").alias("state"), reason.alias("reason"))


def file_summary(spark, sf_dir):
    kind = tx.file_type(F.regexp_replace("url", "[?#].*$", ""))
    rows = t.table(spark, sf_dir, "pages").select(stats.preprocess_reason(kind, F.lit(True), F.col("html").isNotNull()).alias("reason"))
    return stats.outcome_summary(rows)


def length_histogram(spark, sf_dir):
    return stats.histogram(_docs(spark, sf_dir).select(F.length("text").alias("value")))


def length_summary(spark, sf_dir):
    return stats.summary(_docs(spark, sf_dir).select(F.length("text").alias("value")))


def modal_counts(spark, sf_dir):
    modal = F.when(F.col("n_chars") < 100, "qa").otherwise("text")
    return _docs(spark, sf_dir).groupBy(modal.alias("modal")).agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("avg_len"), F.max("n_chars").alias("max_len"))


def good_bad_lengths(spark, sf_dir):
    rows = _docs(spark, sf_dir).join(t.table(spark, sf_dir, "labels"), "doc_id")
    return rows.groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.round(F.avg(F.length("text")), 4).alias("avg_len"))


def annotation_filters(spark, sf_dir):
    """Reasons for which labelled documents are rejected, counted."""
    rows = _docs(spark, sf_dir).join(t.table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.agg(
        F.count_if(F.col("quality").isNull()).alias("unlabelled"), F.count_if(F.col("quality") == 0).alias("low_quality"), F.count_if((F.col("quality") == 1) & (F.length("text") < 7)).alias("too_short"),
        F.count_if((F.col("quality") == 1) & (F.length("text") >= 7)).alias("kept"),
    )


def token_accounting(spark, sf_dir):
    return t.table(spark, sf_dir, "conversations").groupBy("role").agg(F.sum(tx.remote_token_length(F.col("text"))).alias("tokens"), F.count("*").alias("turns"))


def min_article(spark, sf_dir):
    """Articles at least four times as long as their question: documents of a question's number."""
    q = t.questions(spark, sf_dir).select(F.col("query_id").alias("doc_id"), F.length("text").alias("q"))
    return _docs(spark, sf_dir).join(small_side(q), "doc_id").where(F.length("text") >= 4 * F.col("q")).select("doc_id")


def filename_validity(spark, sf_dir):
    return t.table(spark, sf_dir, "pages").select("page_id", tx.valid_filename(F.col("url"), 48).alias("valid"))


def dedup_texts(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy(F.sha2("text", 256).alias("sha256")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))


def answer_distance(spark, sf_dir):
    """Euclidean distance of neighbouring vectors, as of an answer and its reference."""
    from lodestone.operators import dense

    v = t.vectors(spark, sf_dir)
    other = v.select((F.col("chunk_id") - 1).alias("chunk_id"), F.col("embedding").alias("other"))
    return v.join(other, "chunk_id").select("chunk_id", F.round(dense.l2_distance(F.col("embedding"), F.col("other")), 6).alias("distance"))


def rouge1(spark, sf_dir):
    """ROUGE-1 of each assistant turn against the user turn before it."""
    c = t.table(spark, sf_dir, "conversations")
    user = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    return ranking.rouge1(c.where("role = 'assistant'").join(user, ["conv_id", "turn"]).select("conv_id", "turn", "text", "reference"), ["conv_id", "turn"])


# ---------------------------------------------------------------- set operations and domain joins


def _labelled(spark, sf_dir, quality):
    return t.table(spark, sf_dir, "labels").where(F.col("quality") == quality).select("doc_id")


def anti_processed(spark, sf_dir):
    return _docs(spark, sf_dir).join(t.table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "source")


def semi_badcase(spark, sf_dir):
    return _docs(spark, sf_dir).join(_labelled(spark, sf_dir, 0), "doc_id", "left_semi").select("doc_id", "lang")


def union_retrievers(spark, sf_dir):
    """Outputs of three retrievers, one behind the other, their order kept in source_rank."""
    top = t.questions(spark, sf_dir).select(F.col("query_id").alias("id"), F.lit("text2vec").alias("retriever"))
    inv = _labelled(spark, sf_dir, 1).select(F.col("doc_id").alias("id"), F.lit("inverted").alias("retriever"))
    web = t.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit("web").alias("retriever"))
    return fuse.united(top, inv, web)


def except_deleted(spark, sf_dir):
    return _docs(spark, sf_dir).select("source", "lang").distinct().exceptAll(_docs(spark, sf_dir).where("lang = 'es'").select("source", "lang").distinct())


def union_docs(spark, sf_dir):
    return _docs(spark, sf_dir).select("source").union(_docs(spark, sf_dir).select("lang")).distinct()


def intersect_badcase(spark, sf_dir):
    toxic = t.table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return _labelled(spark, sf_dir, 0).intersect(toxic)


def union_labels(spark, sf_dir):
    good = _labelled(spark, sf_dir, 1).withColumn("label", F.lit(True))
    return good.unionByName(_labelled(spark, sf_dir, 0).withColumn("label", F.lit(False)))


def _links(spark, sf_dir):
    """Pages as search results: a query is a page's number by hundreds, its rank the rest."""
    return t.table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 100).cast("long").alias("query_id"), (F.col("page_id") % 100).alias("rank"), F.col("url").alias("link"))


def domain_partial_order_first(spark, sf_dir):
    return ranking.first_by_domain(_links(spark, sf_dir), DOMAINS).select("query_id", "pos", "link")


def domain_partial_order_group(spark, sf_dir):
    return ranking.grouped_by_domain(_links(spark, sf_dir), DOMAINS, 10).select("query_id", "pos", "link", "domain")


def rerank(spark, sf_dir):
    """Each question against the ten documents that follow its number, by the share of its words they hold."""
    q = t.questions(spark, sf_dir)
    near = q.select("query_id", F.col("text").alias("query"), F.explode(F.sequence(F.col("query_id"), F.col("query_id") + 9)).alias("chunk_id"))
    return ranking.reranked(near.join(t.chunks(spark, sf_dir), "chunk_id"), 4).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


USEFUL = "length(regexp_replace(text, '[^a-zA-Z0-9\\x{4e00}-\\x{9fff}]', '', 'g'))"
KIND = "CASE " + " ".join("WHEN regexp_matches(lower(p), '(" + "|".join(e.replace(".", "\\.") for e in ends) + f")$') THEN '{k}'" for k, ends in tx.SUFFIXES.items()) + " END"
PATH = "(SELECT *, regexp_replace(url, '[?#].*$', '') AS p FROM pages)"
REASON = f"CASE WHEN k IS NULL THEN 'skip unknown format' WHEN k = 'image' THEN 'skip image' WHEN html IS NULL THEN 'read error' ELSE 'preprocessed' END FROM (SELECT *, {KIND} AS k FROM {PATH})"
RESERVE = "len_tokens + 2048"
NORMAL = "replace(replace(text, chr(10), chr(10) || chr(10) || chr(10)), '. ', '.     ')"
for _pair, _one in (("chr(10) || chr(10)", "chr(10)"), ("'  '", "' '")):
    for _ in range(3):
        NORMAL = f"replace({NORMAL}, {_pair}, {_one})"
LEN = "SELECT length(text) AS value FROM documents WHERE text IS NOT NULL"
SCORE = "TRY_CAST(regexp_replace(props, '[^0-9]', '', 'g') AS BIGINT)"
LINKS = "links AS (SELECT CAST(floor(page_id / 100) AS BIGINT) AS query_id, page_id % 100 AS rank, url AS link FROM pages), domains AS (SELECT unnest(['example.net', 'example.org', 'example.com']) AS domain, unnest([0, 1, 2]) AS d)"

QUERIES = {
    f.__name__: f
    for f in (
        useful_text, judge_language, normalize_ws, clean_md, score_parse, score_gates, content_hash, image_names, model_bucket, query_guards, intention_gate, type_from_suffix, preprocess_states,
        file_summary, length_histogram, length_summary, modal_counts, good_bad_lengths, annotation_filters, token_accounting, min_article, filename_validity, dedup_texts, answer_distance, rouge1,
        anti_processed, semi_badcase, union_retrievers, except_deleted, union_docs, intersect_badcase, union_labels, domain_partial_order_first, domain_partial_order_group, rerank,
    )
}
ORACLE = {
    "useful_text": f"SELECT doc_id, CASE WHEN length(text) = 0 THEN NULL ELSE round(CAST({USEFUL} AS DOUBLE) / length(text), 6) END AS share, coalesce(length(text) > 0 AND CAST({USEFUL} AS DOUBLE) / greatest(length(text), 1) > 0.5, false) AS useful FROM documents",
    "judge_language": f"SELECT doc_id, CASE WHEN length(regexp_replace(text, '[^\\x{{4e00}}-\\x{{9fff}}]', '', 'g')) > length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) THEN 'zh_cn' ELSE 'en' END AS language FROM documents",
    "normalize_ws": f"SELECT doc_id, sha256({NORMAL}) AS sha256 FROM documents",
    "clean_md": "SELECT doc_id, sha256(lower(regexp_replace(regexp_replace(regexp_replace('# [Title](http://x.example) ______ ```code' || chr(10) || 'more``` ' || text, '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '(?s)```.*?```', '', 'g'), '_{5,}', '', 'g'))) AS sha256 FROM documents",
    "score_parse": f"SELECT event_id, coalesce({SCORE}, 10) AS score, CAST(10 AS BIGINT) AS fallback FROM events",
    "score_gates": f"SELECT event_id, CASE WHEN s < 5 THEN 'UNRELATED' WHEN s >= 90 THEN 'SECURITY' WHEN s >= 80 THEN 'BAD_ANSWER' ELSE 'SUCCESS' END AS code FROM (SELECT event_id, coalesce({SCORE}, 10) AS s FROM events)",
    "content_hash": "SELECT doc_id, substr(sha256(text), 1, 8) AS hash8, substr(sha256(text), 1, 6) AS hash6, CASE WHEN length(source) >= 4 THEN right(source, 4) END AS suffix FROM documents",
    "image_names": "SELECT page_id, substr(md5(url || '/a.png'), 1, 6) || '.png' AS name FROM pages",
    "model_bucket": f"SELECT doc_id, len_tokens AS tokens, CAST(CASE WHEN {RESERVE} <= 8192 THEN 8192 WHEN {RESERVE} <= 32768 THEN 32768 WHEN {RESERVE} <= 128000 THEN 128000 WHEN {RESERVE} <= 256000 THEN 256000 END AS INTEGER) AS context FROM (SELECT doc_id, length(text) // 2 AS len_tokens FROM documents)",
    "query_guards": "SELECT item_id AS query_id, CASE WHEN length(coalesce(text, '')) = 0 THEN 'empty' WHEN length(text) < 8 THEN 'too_short' WHEN length(text) > 512 THEN 'truncated' ELSE 'ok' END AS guard, CAST(length(substr(text, 1, 512)) AS INTEGER) AS kept FROM benchmark",
    "intention_gate": "SELECT event_id, CASE WHEN event_type IN ('view', 'error') THEN 'NOT_A_QUESTION' WHEN event_type LIKE '%sign%' OR event_type LIKE '%identity%' THEN 'NO_TOPIC' ELSE 'INIT' END AS code FROM events",
    "type_from_suffix": f"SELECT page_id, k AS type, coalesce(k <> 'code', false) AS is_document FROM (SELECT page_id, {KIND} AS k FROM {PATH})",
    "preprocess_states": f"WITH r AS (SELECT page_id, {REASON}), q AS (SELECT page_id, \"{{r}}\" FROM r) SELECT 1",
    "file_summary": "",
    "length_histogram": f"""WITH l AS ({LEN}), r AS (SELECT min(value) AS lo, max(value) AS hi, count(*) AS n, greatest(1, CAST(round_even(CAST(0.1 AS DOUBLE) * (max(value) - min(value)), 0) AS BIGINT)) AS width FROM l)
SELECT CAST(floor(value / width) AS BIGINT) * width AS bucket, count(*) AS n, round(CAST(100 AS DOUBLE) * count(*) / max(r.n), 2) AS percent FROM l, r WHERE r.n > 1 GROUP BY 1""",
    "length_summary": f"""WITH l AS ({LEN}), s AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM l)
SELECT max(n) AS n, round(avg(value), 2) AS mean, CAST(max(CASE WHEN i = round_even(CAST(n - 1 AS DOUBLE) / 2, 0) THEN value END) AS BIGINT) AS median, CAST(min(value) AS BIGINT) AS least, CAST(max(value) AS BIGINT) AS most FROM s HAVING max(n) > 1""",
    "modal_counts": "SELECT CASE WHEN n_chars < 100 THEN 'qa' ELSE 'text' END AS modal, count(*) AS n, round(avg(n_chars), 4) AS avg_len, max(n_chars) AS max_len FROM documents GROUP BY 1",
    "good_bad_lengths": "SELECT quality, toxic, count(*) AS n, round(avg(length(text)), 4) AS avg_len FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2",
    "annotation_filters": "SELECT count_if(quality IS NULL) AS unlabelled, count_if(quality = 0) AS low_quality, count_if(quality = 1 AND length(text) < 7) AS too_short, count_if(quality = 1 AND length(text) >= 7) AS kept FROM documents LEFT JOIN labels USING (doc_id)",
    "token_accounting": "SELECT role, CAST(sum(length(text) // 2) AS BIGINT) AS tokens, count(*) AS turns FROM conversations GROUP BY role",
    "min_article": "SELECT doc_id FROM documents d JOIN benchmark b ON d.doc_id = b.item_id WHERE length(d.text) >= 4 * length(b.text)",
    "filename_validity": "SELECT page_id, strlen(url) <= 48 AS valid FROM pages",
    "dedup_texts": "SELECT sha256(text) AS sha256, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1",
    "answer_distance": "SELECT a.vec_id AS chunk_id, round(list_distance(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(b.embedding, lambda x: CAST(x AS DOUBLE))), 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "rouge1": """WITH p AS (SELECT a.conv_id, a.turn, a.text, u.text AS reference FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 WHERE a.role = 'assistant' AND u.role = 'user'),
x AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(list_filter(string_split(lower(text), ' '), lambda w: w <> '')) AS w FROM p) GROUP BY ALL), y AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(list_filter(string_split(lower(reference), ' '), lambda w: w <> '')) AS w FROM p) GROUP BY ALL),
nx AS (SELECT conv_id, turn, sum(n) AS n FROM x GROUP BY ALL), ny AS (SELECT conv_id, turn, sum(n) AS n FROM y GROUP BY ALL), c AS (SELECT conv_id, turn, sum(least(x.n, y.n)) AS c FROM x JOIN y USING (conv_id, turn, w) GROUP BY ALL)
SELECT p.conv_id, p.turn, round(coalesce(CAST(c AS DOUBLE), 0) / nx.n, 6) AS precision, round(coalesce(CAST(c AS DOUBLE), 0) / ny.n, 6) AS recall FROM p LEFT JOIN nx USING (conv_id, turn) LEFT JOIN ny USING (conv_id, turn) LEFT JOIN c USING (conv_id, turn)""",
    "anti_processed": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "semi_badcase": "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)",
    "union_retrievers": "SELECT item_id AS id, 'text2vec' AS retriever, 0 AS source_rank FROM benchmark UNION ALL SELECT doc_id, 'inverted', 1 FROM labels WHERE quality = 1 UNION ALL SELECT page_id, 'web', 2 FROM pages",
    "except_deleted": "SELECT DISTINCT source, lang FROM documents WHERE lang <> 'es'",
    "union_docs": "SELECT source FROM documents UNION SELECT lang FROM documents",
    "intersect_badcase": "SELECT doc_id FROM labels WHERE quality = 0 INTERSECT SELECT doc_id FROM labels WHERE toxic = 1",
    "union_labels": "SELECT doc_id, true AS label FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, false FROM labels WHERE quality = 0",
    "domain_partial_order_first": f"WITH {LINKS}, f AS (SELECT query_id, d, arg_min(link, rank) AS link FROM links, domains WHERE contains(link, domain) GROUP BY ALL) SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d) AS INTEGER) AS pos, link FROM f",
    "domain_partial_order_group": f"WITH {LINKS}, m AS (SELECT query_id, rank, link, min(d) AS d FROM links, domains WHERE contains(link, domain) GROUP BY ALL), o AS (SELECT m.*, domain, CAST(row_number() OVER (PARTITION BY query_id ORDER BY m.d, rank) AS INTEGER) AS pos FROM m JOIN domains USING (d)) SELECT query_id, pos, link, domain FROM o WHERE pos <= 10",
    "rerank": """WITH p AS (SELECT item_id AS query_id, doc_id AS chunk_id, list_distinct(list_filter(string_split(lower(b.text), ' '), lambda w: w <> '')) AS q, list_distinct(list_filter(string_split(lower(d.text), ' '), lambda w: w <> '')) AS w FROM benchmark b JOIN documents d ON doc_id BETWEEN item_id AND item_id + 9),
s AS (SELECT query_id, chunk_id, CASE WHEN len(q) = 0 THEN 0 ELSE CAST(len(list_intersect(q, w)) AS DOUBLE) / len(q) END AS score FROM p)
SELECT query_id, chunk_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 4""",
}
ORACLE["preprocess_states"] = f"SELECT page_id, reason = 'preprocessed' AS state, reason FROM (SELECT page_id, {REASON.replace(' FROM (SELECT *', ' AS reason FROM (SELECT *', 1)})"
ORACLE["file_summary"] = f"SELECT count_if(reason = 'preprocessed') AS success, count_if(starts_with(reason, 'skip')) AS skip, count_if(reason <> 'preprocessed' AND NOT starts_with(reason, 'skip')) AS failed FROM (SELECT {REASON.replace(' FROM (SELECT *', ' AS reason FROM (SELECT *', 1)})"
