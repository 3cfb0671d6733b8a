"""Document fingerprints from closed syncmers, in DataFrame operations only.

A text is its tokens: its words, and of words over LONG characters (scripts without spaces, encoded data) the single
characters. A k-mer is K consecutive tokens, its inner substrings are the single tokens. A k-mer is a closed
syncmer if its least word hash stands at its first or last place. Whether a k-mer is chosen depends on its own words only,
so an edit elsewhere never moves an anchor. with_anchors gives (token position, hash) of every one for positional matching;
the fingerprint is the sketch_size smallest anchor hashes in hexadecimal, and the likeness of two fingerprints the share of common
hashes among the sketch_size smallest of their union, an estimate of the anchors' Jaccard similarity.

A text of 1 to K - 1 tokens is one anchor (the whole sequence); without words the fingerprint is empty. Two empty
fingerprints are alike (1.0), an empty and a full one are not (0.0). Null texts read as empty. A null doc_id sorts first;
rows of one doc_id sort by their text. Equal texts have equal fingerprints. Other columns are ignored.

"The next document": rows are dealt into ranges of doc_id by quantiles (one bound for 600 to 100,000 rows on the driver), each
range gets a copy of the first row of the next one, and a window runs inside each range. No task sees all rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import count_below, held, narrowed, read_table

K = 5
SKETCH = 64
RANGE_ROWS = 600
RANGES, RANGE_MOST = 4096, 100_000  # beyond RANGES ranges they grow to RANGE_MOST rows, then their number does
LONG = 32


def _word_hashes(text: Column) -> Column:
    words = F.split(F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     ")), " +")
    apart = F.flatten(F.transform(words, lambda w: F.when(F.length(w) > LONG, F.transform(F.split(w, ""), lambda c: F.xxhash64(c))).otherwise(F.array(F.xxhash64(w)))))
    return F.when(text.rlike(rf"[^\t\n\x0B\f\r ]{{{LONG + 1}}}"), apart).otherwise(F.transform(words, lambda w: F.xxhash64(w)))


def with_anchors(df: DataFrame, text: str, name: str, k: int = K) -> DataFrame:
    """df plus name: array of (pos, hash) of the closed syncmers of column text."""
    blank = F.length(F.trim(F.translate(F.col(text), "\t\n\x0b\x0c\r", "     "))) == 0
    df = held(df, "_h", F.when(blank, F.array().cast("array<bigint>")).otherwise(_word_hashes(F.col(text))))
    at = lambda i, j: F.get(F.col("_h"), i + j)
    chosen = F.filter(
        F.sequence(F.lit(0), F.size("_h") - k),
        lambda i: F.least(at(i, 0), at(i, k - 1)) <= F.least(*[at(i, j) for j in range(1, k - 1)]),
    )
    few = F.size("_h") < k
    df = held(df, "_at", F.when(few, F.array().cast("array<int>")).otherwise(chosen))
    mer = F.transform("_at", lambda i: F.struct(i.alias("pos"), F.xxhash64(*[at(i, j) for j in range(k)]).alias("hash")))
    whole = F.array(F.struct(F.lit(0).alias("pos"), F.xxhash64("_h").alias("hash")))
    none = F.array().cast("array<struct<pos:int,hash:bigint>>")
    return held(df, name, F.when(F.size("_h") == 0, none).when(few, whole).otherwise(mer)).drop("_h", "_at")


def with_sketch(df: DataFrame, text: str, name: str, k: int = K, size: int = SKETCH) -> DataFrame:
    """df plus name: the size smallest anchor hashes, ascending."""
    df = with_anchors(df, text, "_a", k)
    low = F.slice(F.array_sort(F.array_distinct(F.transform("_a", lambda a: a["hash"]))), 1, size)
    return held(df, name, low).drop("_a")


def fingerprint(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def likeness(a: Column, b: Column, size: int = SKETCH) -> Column:
    both = F.slice(F.array_sort(F.array_union(a, b)), 1, size)
    common = F.size(F.array_intersect(F.array_intersect(a, b), both))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(common / F.size(both))


def with_next(df: DataFrame, key: str, columns: dict[str, str], prepare=lambda df: df) -> DataFrame:
    """prepare(df) plus, for each pair new: old, the value of old in the next row by key (after the last: the first).

    prepare adds columns row by row; it runs once on each row, before rows are dealt out.
    """
    ids = df.select(F.coalesce(F.col(key), F.lit(-(2**63))).alias("_k"))
    rows = ids.count()
    if not rows:
        return prepare(df).withColumns({new: F.col(old) for new, old in columns.items()})
    ranges = max(1, min(RANGES, math.ceil(rows / RANGE_ROWS)), math.ceil(rows / RANGE_MOST))
    bounds = sorted(set(ids.agg(F.percentile_approx("_k", [i / ranges for i in range(1, ranges)] or [0.5], 100_000)).first()[0]))
    marks = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")  # folded to one literal

    place = lambda k: count_below(marks, len(bounds), k, last=True)
    firsts = sorted(tuple(r) for r in ids.groupBy(place(F.col("_k")).alias("r")).agg(F.min("_k")).collect())  # a row for each range
    after = [(firsts[i - 1][0], k) for i, (_, k) in enumerate(firsts)]  # i = 0: the first row of all follows the last range
    df = df.withColumn("_k", F.coalesce(F.col(key), F.lit(-(2**63))))
    guests = df.join(F.broadcast(df.sparkSession.createDataFrame(after, "_r int, _k long")), "_k").withColumn("_guest", F.lit(1))
    all_rows = prepare(df.withColumns({"_r": place(F.col("_k")), "_guest": F.lit(0)}).unionByName(guests))
    order = Window.partitionBy("_r").orderBy("_guest", "_k", *[F.col(c) for c in dict.fromkeys(columns.values()) if dict(all_rows.dtypes)[c] == "string"])
    return all_rows.withColumns({new: F.lead(old).over(order) for new, old in columns.items()}).where("_guest = 0").drop("_k", "_r", "_guest")


def edited(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) plus sketch, n_chars, edited (last quarter replaced by the start of the next text), next_sketch."""
    docs = with_next(docs, "doc_id", {"next_text": "text", "next_sketch": "sketch"}, lambda df: with_sketch(df, "text", "sketch"))
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    return held(docs, "edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("next_text", F.lit(1), cut))).drop("next_text")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = narrowed(read_table(spark, sf_dir, "documents"), doc_id="doc_id", text="text").withColumn("text", F.coalesce("text", F.lit("")))
    docs = with_sketch(edited(docs).drop("text"), "edited", "edited_sketch")
    return docs.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sketch")).alias("fingerprint"),
        fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


QUERIES = {"op2_fingerprints": op2_fingerprints}
ORACLE: dict[str, str] = {}
