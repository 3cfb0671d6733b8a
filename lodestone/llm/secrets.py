"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only.

Each text yields candidates of three base kinds (assign, access, hex) and of one wide kind (token: long mixed runs of
letters and digits outside base spans). Candidate values are hashed and counted over the whole corpus by distinct owner
and repository. A value that many owners hold is a published example; one that stays with its owner and looks live is a
credential. Base spans always stay; wide candidates become spans (kind owned) only if they are live.

Positions: a text is cut by the pattern; lengths of the pieces between matches and of the matches themselves add up to
code-point offsets. Hot values: counts are partial aggregates over (value, owner), and only examples (values of at least
example_owners owners, few by their nature) go back to the candidates, through a salted join.

Null texts read as empty; null owners and repositories count as one unknown owner; rows that repeat count once for each
owner; equal start offsets keep kind order; other columns are ignored. Several rows of one doc_id keep their own spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import count_below, few, held, narrowed, read_table, salted_join, written

#: The base patterns, and the shortest group or match that counts.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex")
#: Wide candidates: a run of 20 and more token characters with at least three digits and three letters.
WIDE = r"[A-Za-z0-9_]{20,}"
#: A value with this many distinct owners and more is a copied example.
EXAMPLE_OWNERS = 5
BLOCK = 128  # matches whose offsets are summed at a time
SPAN = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"


def _pairs(text: Column, pattern: str) -> Column:
    """All leftmost, non-overlapping matches (m), each with the length of the gap before it (g)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("long"))
    pairs = F.filter(F.arrays_zip(found.alias("m"), gaps.alias("g")), lambda p: p["m"].isNotNull())
    return F.when(text.rlike(pattern), pairs).otherwise(F.array().cast("array<struct<m:string,g:bigint>>"))


def _placed(pairs: Column, kind: str) -> Column:
    """Matches with their code-point offsets: running sums in blocks of BLOCK, so that many matches cost no square of theirs."""

    def walk(part: Column) -> Column:
        span = lambda acc, p: F.struct(F.lit(kind).alias("kind"), (acc["at"] + p["g"]).alias("start"), (acc["at"] + p["g"] + F.length(p["m"])).alias("end"), p["m"].alias("value"))
        return F.aggregate(
            part,
            F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPAN).alias("out")),
            lambda acc, p: F.struct((acc["at"] + p["g"] + F.length(p["m"])).alias("at"), F.concat(acc["out"], F.array(span(acc, p))).alias("out")),
        )

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int")), lambda b: walk(F.slice(pairs, b * BLOCK + 1, F.lit(BLOCK))))
    based = F.aggregate(
        blocks,
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<struct<base:bigint,spans:{SPAN}>>").alias("out")),
        lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("base"), b["out"].alias("spans")))).alias("out")),
        lambda acc: acc["out"],
    )
    moved = F.transform(based, lambda b: F.transform(b["spans"], lambda s: F.struct(s["kind"].alias("kind"), (b["base"] + s["start"]).alias("start"), (b["base"] + s["end"]).alias("end"), s["value"].alias("value"))))
    return F.when(F.size(pairs) == 0, F.array().cast(SPAN)).when(F.size(pairs) <= BLOCK, walk(pairs)["out"]).otherwise(F.flatten(moved))


def _within(sorted_values: Column, value: Column) -> Column:
    """Whether an ascending array holds value, by bisection."""
    return F.coalesce(F.get(sorted_values, count_below(sorted_values, F.size(sorted_values), value)) == value, F.lit(False))


def candidates(docs: DataFrame) -> DataFrame:
    """doc columns plus base and wide: arrays of (kind, start, end, value), in order of their start."""
    text = F.col("text")
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    kinds = {"a": (ASSIGN, "assign"), "k": (ACCESS, "access"), "h": (HEX, "hex"), "w": (WIDE, "owned")}
    docs = held(docs, "_pairs", F.struct(*[_pairs(text, pattern).alias(c) for c, (pattern, _) in kinds.items()]))
    docs = held(docs, "_found", F.struct(*[_placed(F.col(f"_pairs.{c}"), kind).alias(c) for c, (_, kind) in kinds.items()]))
    assign = F.filter("_found.a", lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= ASSIGN_LEAST)
    docs = held(docs, "_a", assign)
    order = lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).when(a["kind"] == b["kind"], 0).otherwise(
        F.when(F.array_position(F.array(*map(F.lit, KINDS)), a["kind"]) < F.array_position(F.array(*map(F.lit, KINDS)), b["kind"]), -1).otherwise(1)
    )
    docs = held(docs, "base", F.array_sort(F.concat("_a", "_found.k", "_found.h"), order))
    docs = held(docs, "_starts", F.struct(*[F.transform(c, lambda s: s["start"]).alias(n) for n, c in (("a", "_a"), ("k", "_found.k"), ("h", "_found.h"))]))
    live = lambda v: (F.length(F.regexp_replace(v, "[^0-9]", "")) >= 3) & (F.length(F.regexp_replace(v, "[^A-Za-z]", "")) >= 3)

    def overlaps(w: Column) -> Column:
        """Spans of one kind lie behind each other: of those that begin before w ends the last reaches farthest."""
        each = lambda n, c: F.coalesce(F.get(F.col(c), count_below(F.col(f"_starts.{n}"), F.size(c), w["end"]) - 1)["end"] > w["start"], F.lit(False))
        return each("a", "_a") | each("k", "_found.k") | each("h", "_found.h")

    wide = F.filter("_found.w", lambda w: live(w["value"]) & ~overlaps(w))
    return docs.withColumn("wide", wide).drop("_pairs", "_found", "_a", "_starts")


def _secret(kind: Column, value: Column) -> Column:
    """The part of a match that is compared over the corpus."""
    return F.when(kind == "assign", F.regexp_extract(value, ASSIGN, 2)).otherwise(value)


def scanned(docs: DataFrame, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """One row for each row of docs (doc_id, text, owner, repo): doc_id, row (a key of the row), base, spans.

    base and spans are arrays of (kind, start, end, example); example tells that at least example_owners owners and
    repositories hold the value. Wide candidates are in spans only if they are not examples.
    """
    docs = narrowed(docs, doc_id="doc_id", text="text", owner="owner", repo="repo")
    # A row is known by its id and text: equal rows have equal spans, so they may share a key.
    docs = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    found = candidates(docs).select("doc_id", "row", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repo", F.lit("")).alias("repo"), "base", "wide")
    found = written(
        found.withColumns({c: F.transform(c, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.xxhash64(_secret(s["kind"], s["value"])).alias("hash"))) for c in ("base", "wide")}),
        "secrets",
    )
    each = found.where("size(base) > 0 or size(wide) > 0").select("doc_id", "row", "owner", "repo", F.explode(F.array_distinct(F.transform(F.concat("base", "wide"), lambda s: s["hash"]))).alias("hash"))
    held = each.select("hash", "owner", "repo").distinct().groupBy("hash").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repo").alias("repos"))
    examples = written(held.where((F.col("owners") >= example_owners) & (F.col("repos") >= example_owners)).select("hash"), "examples")
    copied = salted_join(each.select("row", "hash"), examples, ["hash"], F.col("row"), 64).groupBy("row").agg(F.array_sort(F.collect_set("hash")).alias("copied"))
    out = found.join(copied, "row", "left").withColumn("copied", F.coalesce("copied", F.array().cast("array<bigint>")))
    mark = lambda c: F.transform(c, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), _within(F.col("copied"), s["hash"]).alias("example")))
    out = out.select("doc_id", "row", mark("base").alias("base"), F.filter(mark("wide"), lambda s: ~s["example"]).alias("wide"))
    both = F.array_sort(
        F.concat("base", "wide"),
        lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(a["kind"] == b["kind"], 0).otherwise(
            F.when(F.array_position(F.array(*map(F.lit, (*KINDS, "owned"))), a["kind"]) < F.array_position(F.array(*map(F.lit, (*KINDS, "owned"))), b["kind"]), -1).otherwise(1)
        ),
    )
    return out.select("doc_id", "row", "base", both.alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(docs: DataFrame, owner: str = "source", repo: str = "source") -> DataFrame:
    """docs with live credentials in text replaced by [kind]; copied examples and clean texts stay as they are. n_chars follows."""
    rows = docs.withColumns({"owner": F.col(owner), "repo": F.col(repo)})
    marks = scanned(rows).select(F.col("row").alias("_row"), F.filter("spans", lambda s: ~s["example"]).alias("_live")).where("size(_live) > 0").dropDuplicates(["_row"])
    marks = written(marks, "marks")
    # Texts stay where they are while the marks are few (64 bytes a span); beyond that both sides meet by row.
    marks = F.broadcast(marks) if few(marks, 200_000) else marks
    out = docs.withColumn("_row", F.xxhash64("doc_id", "text")).join(marks, "_row", "left")
    # Overlapping spans go as one: each keeps only what lies behind the ones before it.
    cut = F.aggregate(
        "_live",
        F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("["), s["kind"], F.lit("]"))).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text"))),
    )
    text = F.when(F.col("_live").isNull(), F.col("text")).otherwise(cut)
    return out.withColumn("text", text).withColumn("n_chars", F.when(F.col("_live").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumns({"owner": F.col("source"), "repo": F.col("source")})
    found = scanned(docs)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    live = F.size(F.filter("spans", lambda s: ~s["example"])).cast("long").alias("n_live")
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), live)


QUERIES = {"op3_secret_scan": op3_secret_scan}


def _found_sql(kind: str, order: int, pattern: str) -> str:
    quoted = "'" + pattern.replace("'", "''") + "'"
    return f"SELECT doc_id, source, '{kind}' AS kind, {order} AS ord, regexp_extract_all(text, {quoted}) AS m, regexp_split_to_array(text, {quoted}) AS g FROM d"


ORACLE = {
    "op3_secret_scan": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS source FROM documents),
a AS ({" UNION ALL ".join(_found_sql(k, n, p) for n, (k, p) in enumerate([("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("owned", WIDE)]))}),
f AS (SELECT doc_id, source, kind, ord, unnest(m) AS v, unnest(range(1, len(m) + 1)) AS i, m, g FROM a),
p AS (SELECT doc_id, source, kind, ord, v, CAST(coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a FROM f),
q AS (SELECT *, a + length(v) AS b, CASE WHEN kind = 'assign' THEN regexp_extract(v, '{ASSIGN.replace("'", "''")}', 2) ELSE v END AS secret FROM p),
base AS (SELECT * FROM q WHERE kind <> 'owned' AND (kind <> 'assign' OR length(secret) >= {ASSIGN_LEAST})),
wide AS (SELECT * FROM q WHERE kind = 'owned' AND length(regexp_replace(v, '[^0-9]', '', 'g')) >= 3 AND length(regexp_replace(v, '[^A-Za-z]', '', 'g')) >= 3
  AND NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = q.doc_id AND base.a < q.b AND q.a < base.b)),
allc AS (SELECT * FROM base UNION ALL SELECT * FROM wide), held AS (SELECT secret, count(DISTINCT source) >= {EXAMPLE_OWNERS} AS example FROM allc GROUP BY secret),
spans AS (SELECT * FROM allc JOIN held USING (secret) WHERE kind <> 'owned' OR NOT example),
n AS (SELECT doc_id, count_if(kind = 'assign') AS n_assign, count_if(kind = 'access') AS n_access, count_if(kind = 'hex') AS n_hex, sha256(coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, ord) FILTER (kind <> 'owned'), '')) AS base_sha256,
  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, ord) AS spans, count_if(NOT example) AS n_live FROM spans GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans, CAST(coalesce(n_live, 0) AS BIGINT) AS n_live FROM d LEFT JOIN n USING (doc_id)""",
}
