"""Queries over the sparse, dense, entity and graph indexes, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import bm25, calibrate, dense, entity, graph
from lodestone.operators.bounded import numbered, small_side
from lodestone.plans import tables as t

WORDS = "list_filter(string_split(lower(text), ' '), lambda w: w <> '')"
BM25_CTE = f"""
chunks AS (SELECT doc_id AS chunk_id, {WORDS} AS ws FROM documents),
stats AS (SELECT count(*) AS n, CAST(sum(len(coalesce(ws, []))) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS avgdl FROM chunks),
flat AS (SELECT chunk_id, unnest(ws) AS term FROM chunks),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM flat GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT term, df, ln(n - df + CAST(0.5 AS DOUBLE)) - ln(df + CAST(0.5 AS DOUBLE)) AS raw FROM dfs, stats),
mean AS (SELECT avg(round(raw, 9)) AS mean FROM raw),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN CAST(0.25 AS DOUBLE) * mean ELSE raw END AS idf FROM raw, mean)"""
SCORES_CTE = BM25_CTE + f""",
asked AS (SELECT query_id, term, count(*) AS asked FROM (SELECT item_id AS query_id, unnest({WORDS}) AS term FROM benchmark) GROUP BY ALL),
part AS (SELECT query_id, tf.chunk_id, asked * idf * CAST(tf AS DOUBLE) * CAST(2.5 AS DOUBLE) / (CAST(tf AS DOUBLE) + CAST(1.5 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * len(ws) / avgdl)) AS part
  FROM asked JOIN idf USING (term) JOIN tf USING (term) JOIN chunks c ON c.chunk_id = tf.chunk_id, stats),
scores AS (SELECT query_id, chunk_id, sum(part) AS score FROM part GROUP BY ALL)"""


def bm25_corpus_stats(spark, sf_dir):
    ix = t.bm25_index(spark, sf_dir)
    terms = ix.terms.agg(F.count("*").alias("n_terms"), F.sum("df").alias("n_postings"))
    return ix.stats.crossJoin(terms).select("n", F.round("avgdl", 6).alias("avgdl"), "n_terms", "n_postings")


def bm25_index(spark, sf_dir):
    """The index built from the texts, not read from the store: term, documents, occurrences and the words of the documents that hold it."""
    ix = bm25.index(t.chunks(spark, sf_dir))
    held = ix.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"), F.sum("dl").alias("dl"))
    return held.join(ix.terms.select("term", F.round("idf", 6).alias("idf")), "term")


def bm25_keywords(spark, sf_dir):
    """The index under another tokeniser: the longest words of a chunk and its whole text."""
    held = bm25.postings(t.chunks(spark, sf_dir), tokens=bm25.keywords)
    return held.groupBy("chunk_id").agg(F.count("*").alias("terms"), F.max("dl").alias("dl"), F.min("term").alias("first_term"))


def bm25_idf(spark, sf_dir):
    return t.bm25_index(spark, sf_dir).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_scores(spark, sf_dir):
    return bm25.scores(t.questions(spark, sf_dir), t.bm25_index(spark, sf_dir)).select("query_id", "chunk_id", F.round("score", 5).alias("score"))


def bm25_topk(spark, sf_dir):
    return bm25.top_chunks(t.questions(spark, sf_dir), t.bm25_index(spark, sf_dir)).select("query_id", "rank", "chunk_id", F.round("score", 5).alias("score"))


def bm25_batch_scores(spark, sf_dir):
    only = t.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id")).distinct()
    return bm25.scores(t.questions(spark, sf_dir), t.bm25_index(spark, sf_dir), only=only).select("query_id", "chunk_id", F.round("score", 5).alias("score"))


def _nearest(spark, sf_dir, strategy):
    return dense.nearest(t.asked_vectors(spark, sf_dir), t.vectors(spark, sf_dir), 30, strategy)


def dense_topk_l2(spark, sf_dir):
    return _nearest(spark, sf_dir, "l2").select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


def dense_topk_ip(spark, sf_dir):
    return _nearest(spark, sf_dir, "ip").select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


def dense_threshold(spark, sf_dir):
    return dense.above(_nearest(spark, sf_dir, "ip"), 0.3).select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.round("best", 6).alias("best"))


def is_relative(spark, sf_dir):
    others = _nearest(spark, sf_dir, "ip").where(F.col("query_id") != F.col("chunk_id"))
    return dense.relevant(others, 0.45).select("query_id", "is_relative", F.round("top_score", 6).alias("top_score"))


def _both(spark, sf_dir):
    """Sparse and dense lists of the benchmark questions; a question's vector is the one of its number."""
    sparse = bm25.top_chunks(t.questions(spark, sf_dir), t.bm25_index(spark, sf_dir), 10)
    items = t.questions(spark, sf_dir).select("query_id").join(t.vectors(spark, sf_dir).withColumnRenamed("chunk_id", "query_id"), "query_id")
    return sparse, dense.nearest(items, t.vectors(spark, sf_dir), 10, "ip")


def hybrid_rrf(spark, sf_dir):
    return dense.ranked_fusion(list(_both(spark, sf_dir))).select("query_id", "chunk_id", F.round("score", 9).alias("score"))


def hybrid_weighted(spark, sf_dir):
    weights = [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5]
    return dense.weighted_fusion(*_both(spark, sf_dir), weights).select("query_id", "chunk_id", "weight", F.round("score", 5).alias("score"))


DENSE_CTE = """
v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, list_dot_product(a.e, b.e) AS ip, list_dot_product(a.e, a.e) + list_dot_product(b.e, b.e) - 2 * list_dot_product(a.e, b.e) AS d FROM v a, v b WHERE a.vec_id % 50 = 0),
l2 AS (SELECT query_id, chunk_id, 1 - greatest(d, 0) / sqrt(CAST(2 AS DOUBLE)) AS score FROM pairs)"""


def _dense_sql(source: str) -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM {source} QUALIFY rank <= 30)"


IP = _dense_sql("(SELECT query_id, chunk_id, ip AS score FROM pairs)")
TOP_SQL = """got AS (SELECT * FROM scores), zero AS (SELECT q.query_id, d.doc_id AS chunk_id, CAST(0 AS DOUBLE) AS score FROM (SELECT DISTINCT query_id FROM got) q, documents d ANTI JOIN got g ON g.query_id = q.query_id AND g.chunk_id = d.doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank, max(score) OVER (PARTITION BY query_id) AS best FROM (SELECT * FROM got UNION ALL SELECT * FROM zero))"""
BOTH_SQL = f"""WITH {SCORES_CTE}, {TOP_SQL}, sparse AS (SELECT query_id, chunk_id, score, rank FROM ranked WHERE rank <= 10 AND best >= 1e-5),
v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
dense AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM (SELECT item_id AS query_id, b.vec_id AS chunk_id, list_dot_product(a.e, b.e) AS score FROM benchmark JOIN v a ON a.vec_id = item_id, v b) QUALIFY rank <= 10)"""


# ---------------------------------------------------------------- entities


def entities(spark, sf_dir):
    """Words of the benchmark items with nine letters and more are entities; eids follow their order."""
    found = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{9,}"), F.lit(0))
    named = t.table(spark, sf_dir, "benchmark").select(F.explode(found).alias("entity")).distinct()
    # Names are numbered by their hash's order in ranges, then by name, without a single task for all of them.
    return numbered(named.withColumn("_k", F.ascii("entity") * 256 + F.ascii(F.substring("entity", 2, 1))), "_k", ["entity"], "eid").select((F.col("eid") - 1).cast("long").alias("eid"), "entity")


def _hits(spark, sf_dir):
    return entity.entity_hits(t.chunks(spark, sf_dir), entities(spark, sf_dir))


def entity_parse(spark, sf_dir):
    return _hits(spark, sf_dir)


def inverted_index(spark, sf_dir):
    return entity.inverted_lists(_hits(spark, sf_dir)).select("eid", "block", F.array_join(F.transform("chunk_ids", lambda x: x.cast("string")), ",").alias("chunk_ids"), "n")


def entity_retrieve(spark, sf_dir):
    asked = entity.entity_hits(t.questions(spark, sf_dir), entities(spark, sf_dir), "query_id")
    return entity.by_votes(small_side(asked), _hits(spark, sf_dir)).select("query_id", "chunk_id", "votes", "rank")


ENTITY_CTE = """
named AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{9,}')) AS entity FROM benchmark),
entities AS (SELECT CAST(row_number() OVER (ORDER BY entity) - 1 AS BIGINT) AS eid, entity FROM named),
hits AS (SELECT doc_id AS chunk_id, eid FROM documents, entities WHERE contains(lower(text), entity))"""


# ---------------------------------------------------------------- graph


def _edges(spark, sf_dir):
    """Parts name entities, orders are chunks, customers are files: an order is a page of its customer."""
    lines = t.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("e"), F.col("l_partkey")).alias("src"), F.concat(F.lit("c"), F.col("l_orderkey")).alias("dst"), F.lit("type").alias("desc")).distinct()
    pages = t.table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_orderkey")).alias("src"), F.concat(F.lit("f"), F.col("o_custkey")).alias("dst"), F.concat(F.lit("page"), F.col("o_orderkey") % 7).alias("desc"))
    return lines.union(pages)


def _hops(spark, sf_dir):
    parts = t.table(spark, sf_dir, "part").select(F.concat(F.lit("e"), F.col("p_partkey")).alias("entity"))
    return graph.two_hop(parts, _edges(spark, sf_dir))


def kg_two_hop(spark, sf_dir):
    return graph.evidence(_hops(spark, sf_dir))


def kg_score(spark, sf_dir):
    return graph.bonus(_hops(spark, sf_dir)).select("entity", "files", F.round("bonus", 6).alias("bonus"))


def kg_edge_dedup(spark, sf_dir):
    lines = t.table(spark, sf_dir, "lineitem")
    edges = lines.select(F.concat(F.lit("p"), F.col("l_partkey")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("dst"), F.col("l_returnflag").alias("desc"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return graph.undirected(edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lower("desc").alias("desc"), (F.col("seq") - 1).alias("seq"))))


HOPS_SQL = "WITH h AS (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem), hops AS (SELECT 'e' || l_partkey AS entity, 'f' || o_custkey AS file, 'c' || l_orderkey AS chunk FROM h JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey)"


# ---------------------------------------------------------------- calibration


def pr_curve(spark, sf_dir):
    return calibrate.pr_curve(t.scored(spark, sf_dir)).select("threshold", F.col("tp").cast("long").alias("tp"), F.col("fp").cast("long").alias("fp"), F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def best_throttle(spark, sf_dir):
    return calibrate.best_throttle(calibrate.pr_curve(t.scored(spark, sf_dir))).select("threshold", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def max_f1(spark, sf_dir):
    return calibrate.max_f1(calibrate.pr_curve(t.scored(spark, sf_dir))).select("threshold", F.round("f1", 6).alias("f1"))


def threshold_sweep(spark, sf_dir):
    grid = [round(0.41 + 0.01 * i, 2) for i in range(10)]
    return calibrate.sweep(t.scored(spark, sf_dir), grid).select("threshold", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


SCORED_CTE = "scored AS (SELECT round(CAST(n_chars % 997 AS DOUBLE) / CAST(997.0 AS DOUBLE), 6) AS score, quality = 1 AS label FROM documents JOIN labels USING (doc_id))"
CURVE_CTE = f"""{SCORED_CTE}, by_score AS (SELECT score AS threshold, count_if(label) AS good, count_if(NOT label) AS bad FROM scored GROUP BY ALL),
cum AS (SELECT threshold, CAST(sum(good) OVER (ORDER BY threshold DESC) AS BIGINT) AS tp, CAST(sum(bad) OVER (ORDER BY threshold DESC) AS BIGINT) AS fp, CAST(sum(good) OVER () AS BIGINT) AS allgood FROM by_score),
curve AS (SELECT threshold, tp, fp, CASE WHEN tp + fp = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS precision, CASE WHEN allgood = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / allgood END AS recall FROM cum)"""

QUERIES = {
    f.__name__: f
    for f in (
        bm25_corpus_stats, bm25_index, bm25_keywords, bm25_idf, bm25_scores, bm25_topk, bm25_batch_scores, dense_topk_l2, dense_topk_ip, dense_threshold, is_relative, hybrid_rrf, hybrid_weighted,
        entity_parse, inverted_index, entity_retrieve, kg_two_hop, kg_score, kg_edge_dedup, pr_curve, best_throttle, max_f1, threshold_sweep,
    )
}
ORACLE = {
    "bm25_corpus_stats": f"WITH {BM25_CTE} SELECT n, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM dfs) AS n_terms, (SELECT CAST(sum(df) AS BIGINT) FROM dfs) AS n_postings FROM stats",
    "bm25_index": f"WITH {BM25_CTE} SELECT term, CAST(count(*) AS BIGINT) AS df, CAST(sum(tf) AS BIGINT) AS tf, CAST(sum(len(ws)) AS BIGINT) AS dl, round(any_value(idf), 6) AS idf FROM tf JOIN chunks USING (chunk_id) JOIN idf USING (term) GROUP BY term",
    "bm25_keywords": r"""WITH w AS (SELECT doc_id, lower(text) AS low, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents),
f AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM w), d AS (SELECT doc_id, w, min(i) AS i FROM f GROUP BY ALL),
k AS (SELECT doc_id, w FROM d QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(w) DESC, i) <= 20),
a AS (SELECT doc_id, w FROM k UNION SELECT doc_id, low FROM w WHERE low IS NOT NULL)
SELECT doc_id AS chunk_id, count(*) AS terms, count(*) AS dl, min(w) AS first_term FROM a GROUP BY doc_id""",
    "bm25_idf": f"WITH {BM25_CTE} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "bm25_scores": f"WITH {SCORES_CTE} SELECT query_id, chunk_id, round(score, 5) AS score FROM scores",
    "bm25_topk": f"WITH {SCORES_CTE}, {TOP_SQL} SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(score, 5) AS score FROM ranked WHERE rank <= 5 AND best >= 1e-5",
    "bm25_batch_scores": f"WITH {SCORES_CTE} SELECT query_id, chunk_id, round(score, 5) AS score FROM scores WHERE chunk_id IN (SELECT doc_id FROM labels)",
    "dense_topk_l2": f"WITH {DENSE_CTE} SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(score, 6) AS score FROM {_dense_sql('l2')}",
    "dense_topk_ip": f"WITH {DENSE_CTE} SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(score, 6) AS score FROM {IP}",
    "dense_threshold": f"WITH {DENSE_CTE} SELECT query_id, chunk_id, round(score, 6) AS score, round(best, 6) AS best FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM {IP}) WHERE score >= 0.3",
    "is_relative": f"WITH {DENSE_CTE}, best AS (SELECT query_id, max(score) AS best FROM {IP} WHERE query_id <> chunk_id GROUP BY ALL) SELECT query_id, best >= 0.45 AS is_relative, CASE WHEN best >= 0.45 THEN round(best, 6) ELSE CAST(-1 AS DOUBLE) END AS top_score FROM best",
    "hybrid_rrf": f"{BOTH_SQL} SELECT query_id, chunk_id, round(sum(CAST(1 AS DOUBLE) / (60 + rank)), 9) AS score FROM (SELECT query_id, chunk_id, rank FROM sparse UNION ALL SELECT query_id, chunk_id, rank FROM dense) GROUP BY ALL",
    "hybrid_weighted": f"{BOTH_SQL} SELECT query_id, chunk_id, weight, round(weight * coalesce(s.score, 0) + (1 - weight) * coalesce(d.score, 0), 5) AS score FROM sparse s FULL JOIN dense d USING (query_id, chunk_id), (SELECT unnest([CAST(0.05 AS DOUBLE), 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5]) AS weight)",
    "entity_parse": f"WITH {ENTITY_CTE} SELECT chunk_id, eid FROM hits",
    "inverted_index": f"WITH {ENTITY_CTE} SELECT eid, CAST(floor(chunk_id / 1024) AS BIGINT) AS block, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY chunk_id) AS chunk_ids, count(*) AS n FROM hits GROUP BY 1, 2",
    "entity_retrieve": f"WITH {ENTITY_CTE}, asked AS (SELECT item_id AS query_id, eid FROM benchmark, entities WHERE contains(lower(text), entity)), votes AS (SELECT query_id, chunk_id, count(*) AS votes, min(eid) AS f FROM asked JOIN hits USING (eid) GROUP BY ALL) SELECT query_id, chunk_id, votes, CAST(row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, f, chunk_id) AS INTEGER) AS rank FROM votes QUALIFY rank <= 100",
    "kg_two_hop": f"{HOPS_SQL} SELECT entity, file, count(*) AS chunks, min(chunk) AS first_chunk, max(chunk) AS last_chunk FROM hops GROUP BY ALL",
    "kg_score": f"{HOPS_SQL} SELECT entity, count(DISTINCT file) AS files, round(CAST(0.2 AS DOUBLE) * least(100, count(DISTINCT file)) / CAST(100 AS DOUBLE), 6) AS bonus FROM hops GROUP BY entity",
    "kg_edge_dedup": "SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, arg_max(l_returnflag, {'s': l_orderkey * 10 + l_linenumber, 'd': l_returnflag}) AS desc FROM lineitem GROUP BY 1, 2",
    "pr_curve": f"WITH {CURVE_CTE} SELECT threshold, tp, fp, round(precision, 6) AS precision, round(recall, 6) AS recall FROM curve",
    "best_throttle": f"WITH {CURVE_CTE} SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM curve ORDER BY round(precision + recall, 9) DESC, threshold LIMIT 1",
    "max_f1": f"WITH {CURVE_CTE} SELECT threshold, round(f1, 6) AS f1 FROM (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM curve) ORDER BY round(f1, 9) DESC, threshold LIMIT 1",
    "threshold_sweep": f"""WITH {SCORED_CTE}, grid AS (SELECT unnest([CAST(0.41 AS DOUBLE), 0.42, 0.43, 0.44, 0.45, 0.46, 0.47, 0.48, 0.49, 0.5]) AS threshold),
c AS (SELECT threshold, count_if(score >= threshold AND label) AS tp, count_if(score >= threshold AND NOT label) AS fp, count_if(score < threshold AND label) AS fn FROM scored, grid GROUP BY ALL),
p AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS r FROM c)
SELECT threshold, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM p""",
}
