"""N-gram Jaccard self-join by prefix trees, and the classes its links form.

A document's set is its distinct 5-word shingles (64-bit hashes). Two documents link at Jaccard >= 0.75. The answer is
each document's component; copies and near copies are never expanded into pairs.

1. Equal sets become classes; the smallest doc_id stands for its class (grouped by a 128-bit digest of the set).
2. Reduction. In any fixed global order two linked sets share a token among their first n - ceil(.75 n) + 1. With hash
   order that prefix is a random quarter of the set, so a linked document must also find many of its prefix tokens in
   other prefixes. Documents below a Chernoff bound for that (chance of losing a link under 1e-15, as for the hashes) are
   done. Tokens travel as packed blocks by token bucket, combined on the map side, so a token that a third of all
   documents hold costs one entry for each flush of a task.
3. The rest is ordered globally by (document frequency, hash), rarest first; exact prefix filtering; documents that share
   a prefix token form blocks (connected components of document - first document of the token, never all pairs).
4. Each block is joined in a trie of its globally ordered sets: sets that begin alike share a path and its overlap with
   the probe, subtrees fall when none of their sets shares a token of its prefix (the rare end of the order) with the
   probe's (a few that do are compared without a walk), when even their remaining lengths cannot reach the needed overlap, or when all of their sets are already
   in the probe's component. A block above chunk_tokens is dealt in chunks; each pair of chunks is a task.

The reduction can be switched off (reduce=False): then every class goes into step 3 and the join is exact throughout.

Bounds: a flush holds FLUSH_TOKENS entries, a token bucket BUCKET_TOKENS on average, a trie two chunks of chunk_tokens.

Null or wordless texts have n_shingles 0 and link with nothing. Rows of one doc_id are one document: it links by each of
its texts, and what they reach is one component. A null doc_id has a null component. Repeated rows are repeated in the
result. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import SQL_LOWER, components, drop_written, few, lean_batches, narrowed, read_table, salted_join, semi_by_id, shingle_sets, trim, written

SHINGLE = 5
FLUSH_TOKENS = 400_000
BUCKET_TOKENS = 700_000
CHUNK_TOKENS = 2_000_000
FEW = 64  # sets that share a prefix token with a probe and are compared one by one; more are met through the trie
TABLED = 2000  # prefix lengths with a bound of their own


def prefix_length(n: int) -> int:
    """Of a set of n: as many tokens that a linked set must share one of them."""
    return n - (3 * n + 3) // 4 + 1


def least_shared(p: int) -> int:
    """Prefix tokens, of p in hash order, that a linked set shares but for a chance of 1e-15 (success rate .6 for .75)."""
    lo, hi = 0.0, 0.6
    for _ in range(40):
        x = (lo + hi) / 2
        kl = (x * math.log(x / 0.6) if x > 0 else 0.0) + (1 - x) * math.log((1 - x) / 0.4)
        lo, hi = (x, hi) if p * kl >= 34.6 else (lo, x)
    return max(1, math.floor(p * lo))


def _pack(out: list, bucket: int, *arrays: np.ndarray) -> None:
    out.append((bucket, *[a.tobytes() for a in arrays]))


def _rows(out: list, *names: str) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) if out else [[] for _ in range(len(names) + 1)]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["bucket", *names])


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    ordered = bucket[order]
    cuts = np.flatnonzero(np.diff(ordered)) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(bucket[part[0]]), part


def _of_token(tokens: np.ndarray, buckets: int) -> np.ndarray:
    return ((tokens >> np.uint64(17)) % np.uint64(buckets)).astype(np.int64)


def _of_doc(docs: np.ndarray, buckets: int) -> np.ndarray:
    return ((docs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def _totals(docs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids, at = np.unique(docs, return_inverse=True)
    return ids, np.bincount(at, weights=counts, minlength=len(ids)).astype(np.int64)


def _gathered(batches, *kinds) -> list[np.ndarray]:
    parts = [[] for _ in kinds]
    for b in batches:
        for c, kind in enumerate(kinds):
            parts[c] += [np.frombuffer(x, kind) for x in b.column(c + 1).to_pylist() if x]
    return [np.concatenate(p) if p else np.zeros(0, kind) for p, kind in zip(parts, kinds, strict=True)]


# ---------------------------------------------------------------- 1. sets and classes


def shingle_counts(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest (null for an empty set) for each row."""

    def scan(batches):
        for batch in batches:
            n, digest = [], []
            for _, s in shingle_sets(batch.column(1), SHINGLE):
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary())], names=["doc_id", "n_shingles", "digest"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, n_shingles long, digest binary")


# ---------------------------------------------------------------- 2. reduction


def _shared_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """doc_id, shared: how many of a document's prefix tokens (hash order) other documents' prefixes hold as well.

    Of equal sets in one task only the first counts.
    """

    def send(batches):
        seen: set[bytes] = set()
        tokens, owners, held = [], [], 0

        def flush():
            t, d = np.concatenate(tokens), np.repeat(np.array([x for x, _ in owners], np.int64), [n for _, n in owners])
            order = np.argsort(t, kind="stable")
            t, d = t[order], d[order]
            first = np.ones(len(t), bool)
            first[1:] = t[1:] != t[:-1]
            size = np.diff(np.append(np.flatnonzero(first), len(t)))
            known = np.repeat(size > 1, size)  # counted here, for all of this flush
            ids, n = _totals(d[known], np.ones(int(known.sum())))
            t, d, known = t[first], d[first], size > 1
            out: list = []
            for b, part in _by_bucket(_of_token(t, buckets)):
                _pack(out, b, t[part], d[part], known[part])
            e = np.zeros(0, np.uint64).tobytes()
            sent = [(b, x, y, z, e, e) for b, x, y, z in out]
            for b, part in _by_bucket(_of_doc(ids, buckets)):
                sent.append((b, e, e, e, ids[part].tobytes(), n[part].tobytes()))
            return _rows(sent, "tokens", "docs", "known", "ids", "counts")

        for batch in batches:
            names = batch.column(0).to_pylist()
            for r, s in shingle_sets(batch.column(1), SHINGLE):
                if names[r] is None or not len(s) or (key := hashlib.blake2b(s.tobytes(), digest_size=16).digest()) in seen:
                    continue
                seen.add(key)
                tokens.append(s[: prefix_length(len(s))])
                owners.append((names[r], len(tokens[-1])))
                held += len(tokens[-1])
                if held >= FLUSH_TOKENS:
                    yield flush()
                    tokens, owners, held = [], [], 0
        if tokens:
            yield flush()
        trim()

    def meet(batches):
        t, d, known, ids, n = _gathered(batches, np.uint64, np.int64, bool, np.int64, np.int64)
        order = np.argsort(t, kind="stable")
        t, d, known = t[order], d[order], known[order]
        if len(t):
            start = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            size = np.diff(np.append(start, len(t)))
            new = np.repeat(size > 1, size) & ~known
            ids, n = np.concatenate([ids, d[new]]), np.concatenate([n, np.ones(int(new.sum()), np.int64)])
        ids, n = _totals(ids, n)
        out: list = []
        for b, part in _by_bucket(_of_doc(ids, buckets)):
            _pack(out, b, ids[part], n[part])
        yield _rows(out, "ids", "counts")
        trim()

    def total(batches):
        ids, n = _totals(*_gathered(batches, np.int64, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], names=["doc_id", "shared"])

    kinds = ", ".join(f"{c} binary" for c in ("tokens", "docs", "known", "ids", "counts"))
    sent = docs.select("doc_id", "text").mapInArrow(send, f"bucket int, {kinds}")
    met = sent.repartition(buckets, "bucket").mapInArrow(meet, "bucket int, ids binary, counts binary")
    return met.repartition(buckets, "bucket").mapInArrow(total, "doc_id long, shared long")


# ---------------------------------------------------------------- 3. global order and blocks


def _ordered_sets(docs: DataFrame, buckets: int) -> DataFrame:
    """doc_id, n, tokens (by document frequency then hash, packed), prefix (those of the prefix that another set holds, packed)."""

    def send(batches):
        tokens, owners, held = [], [], 0

        def flush():
            t, d = np.concatenate(tokens), np.repeat(np.array([x for x, _ in owners], np.int64), [n for _, n in owners])
            out: list = []
            for b, part in _by_bucket(_of_token(t, buckets)):
                _pack(out, b, t[part], d[part])
            return _rows(out, "tokens", "docs")

        for batch in batches:
            names = batch.column(0).to_pylist()
            for r, s in shingle_sets(batch.column(1), SHINGLE):
                if len(s):
                    tokens.append(s)
                    owners.append((names[r], len(s)))
                    held += len(s)
                if held >= FLUSH_TOKENS:
                    yield flush()
                    tokens, owners, held = [], [], 0
        if tokens:
            yield flush()
        trim()

    def count(batches):
        t, d = _gathered(batches, np.uint64, np.int64)
        if len(t):
            order = np.argsort(t, kind="stable")
            t, d = t[order], d[order]
            start = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            size = np.diff(np.append(start, len(t)))
            df = np.minimum(np.repeat(size, size), (1 << 31) - 1).astype(np.int32)
            out: list = []
            for b, part in _by_bucket(_of_doc(d, buckets)):
                _pack(out, b, t[part], d[part], df[part])
            yield _rows(out, "tokens", "docs", "df")
        trim()

    def order(batches):
        t, d, df = _gathered(batches, np.uint64, np.int64, np.int32)
        if not len(t):
            return
        by = np.lexsort((t, df, d))
        t, d, df = t[by], d[by], df[by]
        start = np.append(np.flatnonzero(np.append(True, d[1:] != d[:-1])), len(d))
        for lot in range(0, len(start) - 1, 2000):
            ids, n, tokens, prefix = [], [], [], []
            for a, b in zip(start[lot : lot + 2000], start[lot + 1 : lot + 2001], strict=False):
                p = prefix_length(b - a)
                ids.append(d[a])
                n.append(b - a)
                tokens.append(t[a:b].tobytes())
                prefix.append(t[a : a + p][df[a : a + p] > 1].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(tokens, pa.binary()), pa.array(prefix, pa.binary())], names=["doc_id", "n", "tokens", "prefix"])

    counted = docs.select("doc_id", "text").mapInArrow(send, "bucket int, tokens binary, docs binary").repartition(buckets, "bucket").mapInArrow(count, "bucket int, tokens binary, docs binary, df binary")
    return counted.repartition(buckets, "bucket").mapInArrow(order, "doc_id long, n long, tokens binary, prefix binary")


def _stars(sets: DataFrame, buckets: int) -> DataFrame:
    """Edges (a, b) from each document to the first document of each of its shared prefix tokens; combined on the map side."""

    def star(t, d):
        order = np.lexsort((d, t))
        t, d = t[order], d[order]
        start = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        size = np.diff(np.append(start, len(t)))
        lead = np.repeat(d[start], size)
        edges = np.unique(np.stack([d, lead], 1)[d != lead], axis=0) if len(d) else np.zeros((0, 2), np.int64)
        return t[start], d[start], edges

    def send(batches):
        for b in batches:
            t = [np.frombuffer(x, np.uint64) for x in b.column(1).to_pylist()]
            if not sum(map(len, t)):
                continue
            t, d, edges = star(np.concatenate(t), np.repeat(b.column(0).to_numpy(), [len(x) for x in t]))
            out: list = []
            for k, part in _by_bucket(_of_token(t, buckets)):
                _pack(out, k, t[part], d[part], np.zeros(0, np.int64), np.zeros(0, np.int64))
            for k, part in _by_bucket(_of_doc(edges[:, 0], buckets)) if len(edges) else ():
                _pack(out, k, np.zeros(0, np.uint64), np.zeros(0, np.int64), edges[part, 0], edges[part, 1])
            yield _rows(out, "tokens", "docs", "a", "b")

    def meet(batches):
        t, d, a, b = _gathered(batches, np.uint64, np.int64, np.int64, np.int64)
        if len(t):
            edges = star(t, d)[2]
            a, b = np.concatenate([a, edges[:, 0]]), np.concatenate([b, edges[:, 1]])
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return sets.select("doc_id", "prefix").mapInArrow(send, "bucket int, tokens binary, docs binary, a binary, b binary").repartition(buckets, "bucket").mapInArrow(meet, "a long, b long").distinct()


# ---------------------------------------------------------------- 4. the trie


class _Node:
    __slots__ = ("edge", "kids", "ends", "lo", "hi", "rep")

    def __init__(self, edge, rep, n):
        self.edge, self.kids, self.ends, self.lo, self.hi, self.rep = edge, {}, [], n, n, rep


def trie_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (i, j) that span the components of all pairs of sets with Jaccard >= 0.75.

    Sets are inserted one by one, each as its tokens in one global order (most widely held first, so that sets which are
    alike share paths), after a probe of the tree built so far.
    """
    if len(sets) < 2:
        return []
    flat = np.concatenate(sets)
    vocabulary, local, held = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(vocabulary), np.int64)
    rank[np.argsort(-held, kind="stable")] = np.arange(len(vocabulary))
    ordered = [np.sort(rank[x]) for x in np.split(local, np.cumsum([len(s) for s in sets])[:-1])]
    several = held[np.argsort(-held, kind="stable")] > 1
    present = np.zeros(len(vocabulary), bool)
    parent = list(range(len(sets)))
    below: dict[int, int | set[int]] = {}  # a prefix token: the subtrees of the root (by first token) that have it in a prefix
    holders: dict[int, list[int]] = {}  # a prefix token: the sets that have it in their prefix, FEW and one at most

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    root, links = None, []
    for i, x in enumerate(ordered):
        n = len(x)
        rare = x[n - prefix_length(n) :]
        rare = rare[several[rare]].tolist()
        if root is None:
            root = _Node(x[:0], i, n)
        else:
            present[x] = True
            tops: set[int] = set()
            met = {j for t in rare for j in holders.get(t, ())}
            if len(met) <= FEW:  # all of them: they are compared without a walk through what else their subtrees hold
                for j in sorted(met):
                    if find(j) != find(i) and 7 * int(np.count_nonzero(present[ordered[j]])) >= 3 * (n + len(ordered[j])):
                        links.append((i, j))
                        parent[find(j)] = find(i)
            else:
                for t in rare:
                    if (k := below.get(t)) is not None:
                        tops.update(k) if isinstance(k, set) else tops.add(k)
            # node, tokens before its edge, overlap so far, tokens of x not passed
            stack = [(root.kids[k], 0, 0, n) for k in sorted(tops)]
            while stack:
                node, depth, common, left = stack.pop()
                if node.rep is not None and find(node.rep) == find(i):
                    continue
                e = node.edge
                if len(e):
                    common += int(np.count_nonzero(present[e]))
                    depth += len(e)
                    left = n - int(np.searchsorted(x, e[-1], "right"))
                at = min(max(depth + left, node.lo), node.hi)  # the length below that allows the most
                if 7 * (common + min(left, at - depth)) < 3 * (n + at):
                    continue
                for j in node.ends:
                    if 7 * common >= 3 * (n + depth) and find(j) != find(i):
                        links.append((i, j))
                        parent[find(j)] = find(i)
                stack += [(kid, depth, common, left) for kid in node.kids.values()]
            present[x] = False
        first = int(x[0]) if n else -1
        for t in rare:
            if len(some := holders.setdefault(t, [])) <= FEW:
                some.append(i)
            if (k := below.setdefault(t, first)) != first:
                if isinstance(k, set):
                    k.add(first)
                else:
                    below[t] = {k, first}
        node, at = root, 0
        while True:
            node.lo, node.hi = min(node.lo, n), max(node.hi, n)
            if node.rep is not None and find(node.rep) != find(i):
                node.rep = None
            if at == n:
                node.ends.append(i)
                break
            kid = node.kids.get(int(x[at]))
            if kid is None:
                kid = _Node(x[at:], i, n)
                kid.ends.append(i)
                node.kids[int(x[at])] = kid
                break
            m = min(len(kid.edge), n - at)
            unlike = np.flatnonzero(kid.edge[:m] != x[at : at + m])
            same = int(unlike[0]) if len(unlike) else m
            if same < len(kid.edge):
                top = _Node(kid.edge[:same], kid.rep, kid.lo)
                top.hi = kid.hi
                kid.edge = kid.edge[same:]
                top.kids[int(kid.edge[0])] = kid
                node.kids[int(x[at])] = top
                kid = top
            node, at = kid, at + same
    return links


def _block_links(sets: DataFrame, blocks: DataFrame, chunk_tokens: int) -> DataFrame:
    """Links (a, b) within blocks; blocks: id, comp. A large block goes out as pairs of chunks of bounded size."""
    rows = sets.select("doc_id", "n", "tokens").join(blocks.select(F.col("id").alias("doc_id"), "comp"), "doc_id")
    size = written(rows.groupBy("comp").agg(F.sum("n").alias("held")).where(F.col("held") > chunk_tokens).select("comp", F.ceil(F.col("held") / chunk_tokens).cast("int").alias("chunks")), "large")
    rows = salted_join(rows, size, ["comp"], F.col("doc_id"), 16, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    mine = F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int")
    pairs = F.when(F.col("chunks") == 1, F.array(F.lit("0"))).otherwise(
        F.transform(F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: c != F.col("mine")), lambda c: F.concat_ws("-", F.least(c, F.col("mine")), F.greatest(c, F.col("mine"))))
    )
    rows = rows.withColumn("mine", mine).select("doc_id", "tokens", "comp", F.explode(pairs).alias("task"))

    def join(batches):
        def done(group):
            links = trie_links([x for _, x in group])
            return [group[i][0] for i, _ in links], [group[j][0] for _, j in links]

        now, group, a, b = None, [], [], []
        for batch in batches:
            comp, task, ids, tokens = (batch.column(c).to_pylist() for c in ("comp", "task", "doc_id", "tokens"))
            for c, k, doc, t in zip(comp, task, ids, tokens, strict=True):
                if (c, k) != now:
                    x, y = done(group)
                    a, b = a + x, b + y
                    now, group = (c, k), []
                group.append((doc, np.frombuffer(t, np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            a, b = [], []
        x, y = done(group)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    return rows.repartition("comp", "task").sortWithinPartitions("comp", "task", "doc_id").mapInArrow(join, "a long, b long")


# ---------------------------------------------------------------- the operator


def jaccard_classes(docs: DataFrame, chunk_tokens: int = CHUNK_TOKENS, reduce: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), class_id (smallest of equal sets) for each row of docs (doc_id, text)."""
    lean_batches(docs.sparkSession)
    docs = narrowed(docs, doc_id="doc_id", text="text")
    counts = written(shingle_counts(docs), "sets")
    texts = counts.where("doc_id is not null and digest is not null").groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b"))
    if texts.where("a <> b").isEmpty():
        return _classes(docs, counts, chunk_tokens, reduce)
    return _by_row(docs, counts, chunk_tokens, reduce)


def _by_row(docs: DataFrame, counts: DataFrame, chunk_tokens: int, reduce: bool) -> DataFrame:
    """The same where some doc_id has several texts: rows are joined under numbers of their own, then the rows of a doc_id united."""
    rows = written(docs.where("doc_id is not null").withColumn("row", F.monotonically_increasing_id()), "rows")
    numbered = rows.select(F.col("row").alias("doc_id"), "text")
    found = _classes(numbered, written(shingle_counts(numbered), "sets"), chunk_tokens, reduce).withColumnRenamed("doc_id", "row")
    found = written(found.join(rows.select("row", "doc_id"), "row"), "found")
    first = found.groupBy("doc_id").agg(F.min("component_id").alias("b"), F.max("component_id").alias("c")).where("b <> c").select("doc_id", "b")
    united = components(found.join(first, "doc_id").select(F.col("component_id").alias("a"), "b"))
    found = salted_join(found, united.select(F.col("id").alias("component_id"), "comp"), ["component_id"], F.col("row"), 16, "left").withColumn("comp", F.coalesce("comp", "component_id"))
    found = written(found, "united")
    names = found.groupBy("comp").agg(F.min("doc_id").alias("name"))
    classes = found.groupBy("class_id").agg(F.min("doc_id").alias("rep"))
    out = salted_join(salted_join(found, names, ["comp"], F.col("row"), 16), classes, ["class_id"], F.col("row"), 16)
    out = out.select("doc_id", "n_shingles", F.col("name").alias("component_id"), F.col("rep").alias("class_id"))
    nowhere = F.lit(None).cast("long")
    return out.unionByName(counts.where("doc_id is null").select("doc_id", "n_shingles", nowhere.alias("component_id"), nowhere.alias("class_id")))


def _classes(docs: DataFrame, counts: DataFrame, chunk_tokens: int, reduce: bool) -> DataFrame:
    """The classes of docs (doc_id, text) in which all texts of a doc_id have one set; counts are its shingle_counts."""
    spark = docs.sparkSession
    full = counts.where("doc_id is not null and n_shingles > 0")
    classes = written(full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("n_shingles").alias("n")), "classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism) if total > BUCKET_TOKENS else 4

    if reduce:
        ids = _likely(docs, counts, classes, max(least, math.ceil(total / 4 / BUCKET_TOKENS)))
    else:
        ids = classes.select(F.col("rep").alias("doc_id"), "n")
    left = ids.agg(F.sum("n")).first()[0] or 0

    buckets = max(least, math.ceil(left / BUCKET_TOKENS))
    sets = written(_ordered_sets(semi_by_id(docs, ids.select("doc_id").distinct(), "doc_id").dropDuplicates(["doc_id"]) if _repeats(ids, counts) else semi_by_id(docs, ids.select("doc_id"), "doc_id"), buckets), "ordered")
    blocks = components(_stars(sets, buckets))
    links = written(_block_links(sets, blocks, chunk_tokens), "links")
    joined = components(links)
    for work in (sets, links):
        drop_written(work)

    comp = classes.join(joined.select(F.col("id").alias("rep"), "comp"), "rep", "left").select("digest", "rep", "copies", F.coalesce("comp", "rep").alias("comp"))
    comp = written(comp.where("copies > 1 or comp <> rep"), "mapping")
    copies = salted_join(full.select("doc_id", "digest"), comp.where("copies > 1"), ["digest"], F.col("doc_id"), 64).select("doc_id", "comp", "rep")
    mapping = copies.union(comp.where("copies = 1").select(F.col("rep").alias("doc_id"), "comp", "rep")).groupBy("doc_id").agg(F.min("comp").alias("comp"), F.min("rep").alias("rep"))
    out = counts.join(mapping, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"), F.coalesce("rep", "doc_id").alias("class_id"))


def _likely(docs: DataFrame, counts: DataFrame, classes: DataFrame, buckets: int) -> DataFrame:
    """doc_id, n of the classes' representatives that the reduction leaves."""
    spark = docs.sparkSession
    shared = _shared_counts(docs, buckets)
    p = F.col("n_shingles") - F.floor((3 * F.col("n_shingles") + 3) / 4) + 1
    exact = F.broadcast(spark.createDataFrame([(p, least_shared(p)) for p in range(1, TABLED + 1)], "p long, need long"))
    kept = shared.join(counts.select("doc_id", "n_shingles", "digest").dropDuplicates(["doc_id", "digest"]), "doc_id").withColumn("p", p).join(exact, "p", "left")
    beyond = F.floor(0.6 * F.col("p") - F.sqrt(17.3 * F.col("p")))  # the same chance by Hoeffding's bound, which is lower
    kept = kept.where(F.col("shared") >= F.coalesce("need", beyond))
    return written(kept.groupBy("digest").agg(F.first("n_shingles").alias("n_shingles")).join(classes, "digest").select(F.col("rep").alias("doc_id"), F.col("n").alias("n")).distinct(), "ids")


def _repeats(ids: DataFrame, counts: DataFrame) -> bool:
    """Whether some wanted doc_id stands on several rows (its text would enter a block twice)."""
    return not counts.join(ids.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").count().where("count > 1").isEmpty()


def without_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: the smallest doc_id's (of its repeated rows one). Rows without doc_id stay."""
    classes = written(jaccard_classes(docs), "components")
    drop = written(classes.where("doc_id <> component_id").select("doc_id").distinct(), "copies")
    again = classes.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").isEmpty()
    drop = F.broadcast(drop) if few(drop, 2_000_000) else drop
    out = docs.join(drop, "doc_id", "left_anti").select(*docs.columns)
    return out if again else out.where("doc_id is null").unionByName(out.where("doc_id is not null").dropDuplicates(["doc_id"]))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(read_table(spark, sf_dir, "documents"))


QUERIES = {"op1_ngram_jaccard_join": op1_ngram_jaccard_join}
ORACLE = {
    "op1_ngram_jaccard_join": rf"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({SQL_LOWER}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT *, unnest(CASE WHEN len(w) >= 5 THEN range(1, len(w) - 3) WHEN len(w) > 0 THEN [1] ELSE [] END) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n, sha256(string_agg(g, chr(10) ORDER BY g)) AS sig FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
e2 AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e2.y FROM r JOIN e2 ON r.b = e2.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(b) FROM r WHERE r.a = d.doc_id) AS component_id, coalesce(min(n.doc_id) OVER (PARTITION BY coalesce(sig, CAST(d.doc_id AS VARCHAR))), d.doc_id) AS class_id FROM d LEFT JOIN n USING (doc_id)""",
}
