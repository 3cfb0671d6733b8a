"""Context fusion under a character budget, retrieval unions, answers as a batch."""

from __future__ import annotations

import posixpath
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.prompts import prompt

BUDGET = 40_000


def fused_context(chunks: list[tuple[str, str, str]], budget: int = BUDGET) -> tuple[str, str, list[str], list[str]]:
    """chunks: (content, source, the text it stands for), best first. Returns the joined chunks, the context, sources and their texts.

    A source's text counts once, where it stands first; each takes its length and a line end. The one place at which the
    running length passes the budget ends the list: what is left of the budget goes to a part of that text.
    """
    firsts = sorted({source: n for n, (_, source, _) in reversed(list(enumerate(chunks)))}.values())
    ends = list(accumulate((len(chunks[n][2]) + 1 for n in firsts), initial=0))
    full = next((k for k, n in enumerate(firsts) if ends[k] + len(chunks[n][2]) > budget), len(firsts))
    texts = [chunks[n][2] for n in firsts[:full]]
    context = "".join(t + "\n" for t in texts)
    used = chunks
    if full < len(firsts):
        content, _, text = chunks[firsts[full]]
        used = chunks[: firsts[full] + 1]
        if (room := budget - len(context)) > 0:
            texts.append(part_of(text, content, room))
            context += texts[-1]
    sources = [chunks[n][1] for n in firsts[: full + 1]]
    return "\n".join(c for c, _, _ in used), context[:budget], [s if "://" in s else posixpath.basename(s) for s in sources], texts


def part_of(text: str, content: str, room: int) -> str:
    """room characters of text that end with content, or begin the text where it stands earlier; content and the head if it is not there."""
    if content not in text:
        return f"{content}\n{text[: room - len(content) - 1]}"
    last = max(room, text.index(content) + len(content))
    return text[last - room : last]


def fused(ranked: DataFrame, budget: int = BUDGET) -> DataFrame:
    """query_id, chunks, context, refs, ref_texts. ranked: query_id, rank, content, source, text; a query's list is as long as its top-k."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        got = fused_context([(c or "", s or "", t or "") for c, s, t in zip(rows["content"], rows["source"], rows["text"], strict=True)], budget)
        return pd.DataFrame([(rows["query_id"].iloc[0], *got)], columns=["query_id", "chunks", "context", "refs", "ref_texts"])

    return ranked.groupBy("query_id").applyInPandas(one, "query_id long, chunks string, context string, refs array<string>, ref_texts array<string>")


def short_context(ranked: DataFrame, budget: int = BUDGET) -> DataFrame:
    """query_id, context, refs for lists that fit the budget whole, by built-in operators: first occurrences in order, running lengths."""
    first = ranked.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "source").orderBy("rank"))).where("n = 1")
    upto = F.sum(F.length("text") + 1).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    kept = first.withColumn("upto", upto).where(F.col("upto") <= budget)
    rows = F.sort_array(F.collect_list(F.struct("rank", "text", "source")))
    return kept.groupBy("query_id").agg(rows.alias("r")).select("query_id", F.array_join(F.transform("r", lambda x: F.concat(x["text"], F.lit("\n"))), "").alias("context"), F.array_join(F.transform("r", lambda x: x["source"]), ",").alias("refs"))


def text_of_chunk(modal: Column, source: Column, content: Column, file_text: Column, qa: Column) -> Column:
    """What a chunk stands for: itself if it comes from an address, its file's text, or its question and answer."""
    return F.when(F.contains(source, F.lit("://")), content).when(modal == "qa", qa).otherwise(file_text)


def with_source_text(ranked: DataFrame, texts: DataFrame) -> DataFrame:
    """ranked (query_id, rank, modal, source, content, qa) plus text: what each chunk stands for. texts: source, file_text.

    A file that could not be read gives null, and its chunk is passed over by fusion.
    """
    rows = ranked.join(texts, "source", "left")
    return rows.withColumn("text", text_of_chunk(F.col("modal"), F.col("source"), F.col("content"), F.col("file_text"), F.col("qa"))).drop("file_text")


def for_embedder(chunks: DataFrame, images: bool) -> DataFrame:
    """Chunks that an embedder takes: texts and questions, images only if it reads them."""
    return chunks.where(F.col("modal").isin("text", "qa", *(["image"] if images else [])))


def web_context(articles: DataFrame, most: int = BUDGET, n: int = 3) -> DataFrame:
    """query_id, context, refs: the first n articles of each query one behind the other, cut to most characters. articles: query_id, rank, link, text."""
    first = articles.where(F.col("text") != "").withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("_r") <= n)
    lists = first.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("_r", "text", "link"))).alias("a"))
    context = F.substring(F.array_join(F.transform("a", lambda x: F.concat(x["text"], F.lit("\n"))), ""), 1, most)
    return lists.select("query_id", context.alias("context"), F.transform("a", lambda x: x["link"]).alias("refs"))


def united(*lists: DataFrame) -> DataFrame:
    """Outputs of retrievers one behind the other; source_rank keeps their order. A retriever that failed is an empty table."""
    out = lists[0].withColumn("source_rank", F.lit(0))
    for n, x in enumerate(lists[1:], 1):
        out = out.unionByName(x.withColumn("source_rank", F.lit(n)), allowMissingColumns=True)
    return out


def answered(queries: DataFrame, fused_rows: DataFrame, llm: Column | None = None) -> DataFrame:
    """query_id, query, code, prompt, reply, refs: the batch form of the serial pipeline up to and with the model's slot.

    llm is any column over prompt and query (the deterministic stand-in repeats the first reference text).
    """
    rows = queries.join(fused_rows, "query_id", "left")
    few = F.length("query") < 8
    code = F.when(F.coalesce(F.length("query"), F.lit(0)) == 0, "QUESTION_EMPTY").when(few, "QUESTION_TOO_SHORT").when(F.col("context").isNull(), "UNRELATED").otherwise("SUCCESS")
    asked = F.when(code == "SUCCESS", prompt("generate", F.lit(False), F.col("context"), F.col("query")))
    reply = llm if llm is not None else F.substring(F.get("ref_texts", 0), 1, 200)
    return rows.withColumn("code", code).withColumn("prompt", asked).select("query_id", "query", "code", "prompt", F.when(F.col("code") == "SUCCESS", reply).alias("reply"), F.coalesce("refs", F.array().cast("array<string>")).alias("refs"))
