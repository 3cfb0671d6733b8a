"""Benchmark decontamination by winnowing.

Every test item and every document keeps the minimum k-gram hash of each window of w consecutive k-grams, so any shared
span of k + w - 1 words leaves a common fingerprint. A fingerprint hit is extended to the runs of that length around it, which
are looked up among the items' runs; what they cover together is the shared span. The work for a document is linear in its
hits, however often a text repeats itself. Items shorter than a window are one window of their own length and are found by
hashing all document grams of that length (there are fewer such lengths than words in a window).

The item side is taken in blocks whose text stays under block_chars, each block's fingerprints go to the executors as a
broadcast of that proven size (16 bytes a word), and every block runs against all documents. No shuffle of documents, one
row each: with several blocks the rows are numbered and written first, hits are written block by block and meet by that number.

Null or empty texts have no words and no hits; an empty benchmark contaminates nothing; rows that repeat are treated
alike, with or without doc_id; items of equal text all count, items without item_id as one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import PUNCT_SEP, SQL_LOWER, drop_written, gram_hashes, lean_batches, narrowed, read_table, text_slices, word_hashes, written

WINDOW, GRAM = 10, 5
BLOCK_CHARS = 16_000_000
HITS = "doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<long>"


def winnow(grams: np.ndarray, w: int) -> np.ndarray:
    """Positions of the last minimum of every window of w grams (of all grams if there are fewer)."""
    n = len(grams)
    if n <= w:
        return np.array([n - 1 - int(np.argmin(grams[::-1]))]) if n else np.zeros(0, np.int64)
    best = np.arange(n - w + 1)
    low = grams[: n - w + 1].copy()
    for j in range(1, w):
        other = grams[j : j + n - w + 1]
        take = other <= low
        low[take] = other[take]
        best[take] = np.flatnonzero(take) + j
    return np.unique(best)


def _item_words(text: str | None) -> np.ndarray:
    return next((word_hashes(d, o, PUNCT_SEP)[0] for _, _, d, o in text_slices(pa.array([text or ""]))), np.zeros(0, np.uint64))


class Index:
    """A block of items: its fingerprints, and by length the hashes of its windows (each with its item), all sorted."""

    def __init__(self, items: list[tuple[int, str | None]], window: int, k: int):
        self.window, self.k = window, k
        self.ids: list[int | None] = []
        prints, windows = [], {}
        for item_id, text in items:
            words = _item_words(text)
            if not len(words):
                continue
            n = min(len(words), window)
            runs = np.unique(gram_hashes(words, n))
            windows.setdefault(n, []).append((runs, np.full(len(runs), len(self.ids), np.int64)))
            self.ids.append(item_id)
            if n == window:
                grams = gram_hashes(words, k)
                prints.append(grams[winnow(grams, window - k + 1)])
        self.prints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64)
        self.windows = {}
        for n, parts in windows.items():
            run, item = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(run, kind="stable")
            self.windows[n] = run[order], item[order]

    def starts(self, words: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """The places around hits of fingerprints at which a whole window may begin."""
        if len(words) < self.window or not len(self.prints):
            return np.zeros(0, np.int64)
        w = self.window - self.k + 1
        at = winnow(grams, w)
        place = np.minimum(np.searchsorted(self.prints, grams[at]), len(self.prints) - 1)
        at = at[self.prints[place] == grams[at]]
        near = np.unique(at[:, None] - np.arange(w))
        return near[(near >= 0) & (near <= len(words) - self.window)]

    def hits(self, words: np.ndarray, grams: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        """The disjoint spans that windows of items cover, and the items (by number in the block) with a window there."""
        border, items = None, set()
        for n, (run, item) in self.windows.items():
            at = self.starts(words, grams) if n == self.window else np.arange(len(words) - n + 1)
            if not len(at):
                continue
            value = gram_hashes(words, n)[at]
            lo, hi = np.searchsorted(run, value, "left"), np.searchsorted(run, value, "right")
            found = hi > lo
            if found.any():
                border = np.zeros(len(words) + 1, np.int64) if border is None else border
                np.add.at(border, at[found], 1)
                np.add.at(border, at[found] + n, -1)
                for a, b in {*zip(lo[found].tolist(), hi[found].tolist(), strict=True)}:
                    items.update(item[a:b].tolist())
        if border is None:
            return [], items
        step = np.diff(np.concatenate([[0], np.cumsum(border) > 0, [0]]).astype(np.int8))
        return list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True)), items


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str | None]]]:
    """Items in blocks of bounded text; an item larger than the bound is a block of its own."""
    block, size = [], 0
    for row in benchmark.where("text is not null").toLocalIterator():
        block.append((row["item_id"], row["text"]))
        size += len(row["text"])
        if size >= block_chars:
            yield block
            block, size = [], 0
    yield block


def _found(ix: Index, texts: pa.Array) -> Iterator[tuple[int, list[tuple[int, int]], set[int]]]:
    """The words, the spans hit and the items of each text."""
    for i, j, data, off in text_slices(texts):
        words, at = word_hashes(data, off, PUNCT_SEP)
        for r in range(j - i):
            mine = words[at[r] : at[r + 1]]
            yield len(mine), *ix.hits(mine, gram_hashes(mine, ix.k))


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = GRAM, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """For each document its words, the disjoint word spans hit and the items whose windows occur (distinct ids).

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. One row for each row of docs.
    """
    spark = docs.sparkSession
    lean_batches(spark)
    docs = narrowed(docs, doc_id="doc_id", text="text")
    blocks = list(islice(all_blocks := _blocks(benchmark, block_chars), 2))
    several = len(blocks) > 1
    # The rows' numbers have to be the same for each block.
    docs = written(docs.withColumn("_row", F.monotonically_increasing_id()), "rows") if several else docs.withColumn("_row", F.lit(0).cast("long"))
    parts = []
    for n, block in enumerate(chain(blocks, all_blocks)):
        index = spark.sparkContext.broadcast(Index(block, window, k))

        def scan(batches, index=index, all_rows=not n):
            for batch in batches:
                n_words, spans, items = [], [], []
                for size, found, hit in _found(index.value, batch.column(1)):
                    n_words.append(size)
                    spans.append([{"start": a, "end": b} for a, b in found])
                    items.append(sorted({index.value.ids[x] for x in hit}, key=lambda x: (x is None, x)))
                out = pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(items, pa.list_(pa.int64())), batch.column(2)],
                    names=["doc_id", "n_words", "spans", "items", "_row"],
                )
                yield out if all_rows else out.filter(pa.array([bool(x) for x in spans], pa.bool_()))

        part = docs.select("doc_id", "text", "_row").mapInArrow(scan, f"{HITS}, _row long")
        if several:  # one index at a time
            part = written(part, "hits")
            index.destroy()
        parts.append(part)
    whole = parts[0]
    if not several:
        return whole.drop("_row")
    drop_written(docs)
    for part in parts[1:]:
        whole = whole.unionByName(part)
    whole = whole.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")).drop("_row")
    merged = F.aggregate(
        F.array_sort("spans"),
        F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda acc, s: F.when((F.size(acc) > 0) & (s["start"] <= F.element_at(acc, -1)["end"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(s))),
    )
    return whole.withColumn("spans", F.when(F.size("spans") > 0, merged).otherwise(F.col("spans")))


def without_benchmark(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs without the rows that hold a benchmark window, each row judged by its own text. One block after another."""
    spark = docs.sparkSession
    lean_batches(spark)
    held = None
    for n, block in enumerate(_blocks(benchmark, block_chars)):
        if n:  # the rows left by the blocks before, so that a worker holds one index at a time
            docs, last = written(docs, "clean"), held
            held = docs
            if last is not None:
                drop_written(last)
        index = spark.sparkContext.broadcast(Index(block, WINDOW, GRAM))

        def clean(batches, index=index):
            for batch in batches:
                keep = pa.array([not found for _, found, _ in _found(index.value, batch.column(1))], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep)], names=["row"])

        columns = docs.columns
        rows = docs.select(F.struct(*[docs[c] for c in columns]).alias("row"), docs["text"])
        docs = rows.mapInArrow(clean, rows.select("row").schema).select(*[F.col("row").getField(c).alias(c) for c in columns])
    return docs


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = contaminated_spans(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


QUERIES = {"op9_decontamination": op9_decontamination}
ORACLE = {
    "op9_decontamination": rf"""WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({SQL_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({SQL_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
q AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT *, least(len(w), 10) AS m FROM b WHERE len(w) > 0))),
g AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM q))),
h AS (SELECT doc_id, i, g.m, item_id FROM g JOIN q USING (m, gram)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)""",
}
