"""Ranking: preferred domains, reranking by overlap, ROUGE-1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), " "), lambda w: w != "")


def _with_domain(links: DataFrame, domains: list[str]) -> DataFrame:
    """links with d: places of the domains that a link contains, in order. The list is a literal, so that nothing is joined."""
    hits = F.filter(F.array(*[F.when(F.contains("link", F.lit(x)), F.lit(i)) for i, x in enumerate(domains)]), lambda d: d.isNotNull())
    return links.withColumn("d", hits).where(F.size("d") > 0)


def first_by_domain(links: DataFrame, domains: list[str]) -> DataFrame:
    """query_id, pos, link: the first result of each domain, in the order of the domains. links: query_id, rank, link."""
    best = _with_domain(links, domains).withColumn("d", F.explode("d")).groupBy("query_id", "d").agg(F.min_by("link", "rank").alias("link"))
    return best.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("d")))


def grouped_by_domain(links: DataFrame, domains: list[str], limit: int) -> DataFrame:
    """query_id, pos, link, domain: each link under its first domain, grouped in the order of the domains; the first limit of a query."""
    rows = _with_domain(links, domains).withColumn("d", F.get("d", 0))
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "rank"))
    return rows.withColumn("pos", pos).where(F.col("pos") <= limit).withColumn("domain", F.get(F.array(*map(F.lit, domains)), F.col("d")))


def overlap_score(query: Column, text: Column) -> Column:
    """Share of a query's distinct words that a text holds: the deterministic stand-in of a cross-encoder."""
    q = F.array_distinct(_words(query))
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, _words(text))).cast("double") / F.size(q).cast("double"))


def reranked(pairs: DataFrame, n: int, score=overlap_score) -> DataFrame:
    """query_id, chunk_id, score, rank: the n best of each query's candidates. pairs: query_id, query, chunk_id, text; score may be any function of two columns.

    A score of null is a call that failed: all candidates of its query then keep the order they came in (column place, else chunk_id).
    """
    rows = pairs.withColumn("score", score(F.col("query"), F.col("text")))
    failed = F.max(F.col("score").isNull()).over(Window.partitionBy("query_id"))
    place = F.col("place") if "place" in pairs.columns else F.col("chunk_id")
    rows = rows.withColumn("_key", F.when(failed, F.lit(None)).otherwise(-F.round("score", 9))).withColumn("_place", F.when(F.col("_key").isNull(), place))
    order = Window.partitionBy("query_id").orderBy("_key", "_place", "chunk_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).drop("_key", "_place")


def rouge1(rows: DataFrame, key: list[str]) -> DataFrame:
    """key, precision, recall of text against reference by words, repeats counted; inside each row, nothing is shuffled."""
    rows = rows.withColumns({"_t": F.explode(F.array(_words(F.col("text"))))}).withColumns({"_r": F.explode(F.array(_words(F.col("reference"))))})
    count = lambda words, w: F.size(F.filter(words, lambda x: x == w))
    common = F.aggregate(F.array_intersect("_t", "_r"), F.lit(0), lambda acc, w: acc + F.least(count(F.col("_t"), w), count(F.col("_r"), w)))
    share = lambda of: F.round(F.try_divide(common.cast("double"), F.size(of).cast("double")), 6)
    return rows.select(*key, share("_t").alias("precision"), share("_r").alias("recall"))
