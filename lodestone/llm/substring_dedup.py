"""Substring deduplication with compact windows.

A text is its 5-word shingles. Under each of HASHES hash functions the Cartesian tree over the shingles' hashes groups all
subsequences that share a minimum into one compact window; a window stands for the runs of LEAST shingles (50 words) whose
minimum it holds, an interval of places where such runs begin. Windows whose minimum no other text has are dropped. The
interval join inside a text meets the windows of two functions: where their intervals overlap, the runs there have both
minima, and these two are the signature under which texts meet (ENOUGH of HASHES functions agree).

Every text of a signature is compared with the smallest one, its leader. Neighbouring signatures of one text and leader on
about one diagonal are one region, and two regions are verified on their shingles: some run of LEAST must have Jaccard
similarity 0.75 or more with the other side. A signature of three texts and more under which some text was not alike its
leader is then gone through as a whole: of the others, those that share a shingle which the leader lacks there (two that are
alike do, unless both are alike the leader) lead in turn, and each meets all that it is not yet connected with.

Nothing depends on how the rows are dealt out: equal texts are one unit, known by a 64-bit hash of the text (two unlike texts
share one with a chance of 3 % among a billion texts); leaders are the smallest units of the whole table; links go
through connected components. Hot passages: a minimum that several texts of one task hold goes on as one marker and its windows go
to their units at once; leaders are partial aggregates; leaders' regions go once to each bucket of followers; a signature of
over GROUP places or GROUP_SHINGLES shingles is dealt in pairs of chunks; of one of over PAIRED chunks only those places whose
shingles are others' as well over a run, counted over the whole signature.

Result: a row for each repeated passage of each document: doc_id, class_id (the smallest doc_id that the passage is linked
with, over any number of links), start and end (words, end exclusive), n_words (50 at least). A document whose whole text
others have has a row for that as well. Documents without a repeated passage have no row.

Null texts and texts under 50 words have no passage; rows without doc_id are left out; rows of one doc_id with different
texts have the passages of each; repeated rows count once; passages that repeat within one text alone are not looked for;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import gc
import math
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import BROADCAST_ROWS, SPACE_SEP, components, drop_written, few, gram_hashes, lean_batches, mix, narrowed, read_table, salted_join, semi_by_id, text_slices, trim, word_hashes, written

SHINGLE, LEAST = 5, 46  # 46 shingles of 5 words: 50 words
HASHES, ENOUGH = 4, 2
FLUSH_WINDOWS = 200_000
BUCKET_WINDOWS = 250_000
GRID = 32
GROUP, GROUP_SHINGLES = 2000, 400_000  # of a chunk of a large signature
PAIRED = 5  # chunks that are dealt in pairs as they are: counting shingles costs more than as many rows of each place
BLOCK_ROWS, BLOCK_BYTES = 4000, 4_000_000
LOT = 1_000_000  # entries looked at together
SEEDS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: A window is its minimum (the function in the low bits), its unit, and the first and last place where its runs begin.
WINDOW = (("key", np.uint64), ("unit", np.int64), ("first", np.int32), ("last", np.int32), ("mark", np.uint8))
NEED = -(-6 * LEAST // 7)  # common shingles of a run at Jaccard similarity 0.75
PAIR = "unit long, start long, end long, lead long, lead_start long, lead_end long"


# ---------------------------------------------------------------- windows


def _doubled(x: np.ndarray, size: int, op) -> np.ndarray:
    """op over each run of size entries (one result for each start)."""
    have, w = x, 1
    while 2 * w <= size:
        have = op(have[: len(have) - w], have[w:])
        w *= 2
    return op(have[: len(have) - (size - w)], have[size - w :]) if size > w else have


def compact_windows(values: np.ndarray, valid: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of all windows of at least least entries in which values[c] is a minimum; no window holds an invalid entry.

    These are the nodes of the Cartesian tree whose subtree is that large, found by neighbours that are smaller.
    """
    n = len(values)
    if n < least:
        return (np.zeros(0, np.int64),) * 3
    v = np.where(valid, values | np.uint64(1), np.uint64(0))
    low = _doubled(v, least, np.minimum)  # minimum of each run of least entries
    high = _doubled(np.concatenate([np.zeros(least - 1, np.uint64), low, np.zeros(least - 1, np.uint64)]), least, np.maximum)
    c = np.flatnonzero(valid & (high[:n] == v))
    levels = [v]
    while len(levels[-1]) > 1 << (len(levels) - 1) and len(levels) < 20:
        w = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-w], levels[-1][w:]))
    l, r, mine = c.copy(), c.copy(), v[c]
    for k in range(len(levels) - 1, -1, -1):
        w, level = 1 << k, levels[k]
        go = l - w >= 0
        go[go] = level[(l - w)[go]] >= mine[go]
        l[go] -= w
        go = r + 1 + w <= n
        go[go] = level[(r + 1)[go]] >= mine[go]
        r[go] += w
    return l, c, r


def merged_windows(grams: np.ndarray, valid: np.ndarray, row: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    """(key, row, first, last) of the windows of all functions; those of one row with one minimum that touch are one.

    Equal shingles near each other (a repeated line, a repeated word) are minima side by side.
    """
    out = []
    for fn, seed in enumerate(SEEDS):
        values = mix(grams ^ seed)
        l, c, r = compact_windows(values, valid)
        key = mix(values[c] + seed) // np.uint64(HASHES) * np.uint64(HASHES) + np.uint64(fn)
        out.append((key, row[c], np.maximum(l, c - LEAST + 1) - begin[c], np.minimum(c, r - LEAST + 1) - begin[c]))
    key, row, first, last = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((first, row, key))
    key, row, first, last = key[order], row[order], first[order], last[order]
    if not len(key):
        return [key, row, first, last]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1]) | (first[1:] > last[:-1] + 1)
    at = np.flatnonzero(new)
    return [key[at], row[at], first[at], np.maximum.reduceat(last, at)]


def _packed(cols: list[np.ndarray], bucket: np.ndarray):
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(bucket[part[0]]), [np.ascontiguousarray(x[part]).astype(k).tobytes() for x, (_, k) in zip(cols, WINDOW, strict=True)]


def _batch(rows: list) -> pa.RecordBatch:
    cols = list(zip(*[(kind, b, *x) for kind, b, x in rows], strict=True)) if rows else [[] for _ in range(len(WINDOW) + 2)]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int8()), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[2:]]], names=["kind", "bucket", *[n for n, _ in WINDOW]])


def _unpacked(rows: list[tuple]) -> list[np.ndarray]:
    return [np.concatenate([np.frombuffer(r[i], k) for r in rows]) if rows else np.zeros(0, k) for i, (_, k) in enumerate(WINDOW)]


def _read(batches) -> tuple[list, list]:
    """The packed rows of kind 0 and of kind 1."""
    rows: tuple[list, list] = ([], [])
    for b in batches:
        for kind, *cols in zip(b.column(0).to_pylist(), *[b.column(i).to_pylist() for i in range(2, 2 + len(WINDOW))], strict=True):
            rows[kind].append(tuple(cols))
    return rows


def _unit_bucket(unit: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(unit.astype(np.int64).view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _several(key: np.ndarray, unit: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """For windows in order of (key, unit): whether their key has two units, or a marker of a task that had."""
    if not len(key):
        return np.zeros(0, bool)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(first, len(key)))
    other = np.append(False, (unit[1:] != unit[:-1]) & (key[1:] == key[:-1])) | (mark > 0)
    return np.repeat(np.maximum.reduceat(other, first), size)


def doc_shingles(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes at each word of all rows, whether a whole shingle begins there, and where the rows' words begin."""
    words, at = word_hashes(data, off, SPACE_SEP)
    grams = np.append(gram_hashes(words, SHINGLE), np.zeros(min(SHINGLE - 1, len(words)), np.uint64))[: len(words)]
    valid = np.ones(len(words), bool)
    for back in range(1, SHINGLE):
        ends = at[1:] - back
        valid[ends[ends >= at[:-1]]] = False
    return grams, valid, at


def signatures(docs: DataFrame, buckets: int) -> DataFrame:
    """sig, unit, first, last: where runs of a unit begin that have two minima which other units have as well. docs: unit, text."""
    names = ", ".join(f"{n} binary" for n, _ in WINDOW)

    def send(batches):
        seen: set[int] = set()
        held: list[list[np.ndarray]] = []
        size = 0

        def flush():
            key, unit, first, last = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((unit, key))
            key, unit, first, last = key[order], unit[order], first[order], last[order]
            none = np.zeros(len(key), np.uint8)
            known = _several(key, unit, none)
            # Windows of a minimum that several units of this task have need not wait for others: a marker goes in their place.
            rows = [(1, b, x) for b, x in _packed([key[known], unit[known], first[known], last[known], none[known]], _unit_bucket(unit[known], buckets))]
            alone = ~known
            markers = np.unique(key[known])
            zero = np.zeros(len(markers), np.int64)
            sent = [np.concatenate(x) for x in ((key[alone], markers), (unit[alone], zero), (first[alone], zero), (last[alone], zero), (none[alone], zero + 1))]
            return _batch(rows + [(0, b, x) for b, x in _packed(sent, ((sent[0] >> np.uint64(17)) % np.uint64(buckets)).astype(np.int64))])

        for batch in batches:
            units = batch.column(0).to_numpy()
            for i, j, data, off in text_slices(batch.column(1)):
                grams, valid, at = doc_shingles(data, off)
                fresh = np.array([u not in seen and not seen.add(u) for u in units[i:j].tolist()], bool)
                row = np.repeat(np.arange(j - i), np.diff(at))
                found = merged_windows(grams, valid & fresh[row], row, at[row])
                held.append([found[0], units[i:j][found[1]], found[2], found[3]])
                size += len(found[0])
                if size >= FLUSH_WINDOWS:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()
        trim()

    def meet(batches):
        alone, known = _read(batches)
        key, unit, first, last, mark = _unpacked(alone)
        order = np.lexsort((first, unit, mark, key))
        key, unit, first, last, mark = (x[order] for x in (key, unit, first, last, mark))
        go = _several(key, unit, mark) & (mark == 0)
        cols = [x[go] for x in (key, unit, first, last, mark)]
        kept = _unpacked(known)
        cols = [np.concatenate(x) for x in zip(cols, kept, strict=True)]
        yield _batch([(1, b, x) for b, x in _packed(cols, _unit_bucket(cols[1], buckets))])
        trim()

    def compose(batches):
        key, unit, first, last, _ = _unpacked(_read(batches)[1])
        order = np.lexsort((key, first, unit))
        key, unit, first, last = key[order], unit[order], first[order].astype(np.int64), last[order].astype(np.int64)
        if len(key):
            new = np.append(True, (key[1:] != key[:-1]) | (unit[1:] != unit[:-1]) | (first[1:] != first[:-1]))
            key, unit, first, last = key[new], unit[new], first[new], last[new]
        at, step = np.arange(len(key)), 1
        while len(at):
            at = at[at + step < len(key)]
            at = at[(unit[at + step] == unit[at]) & (first[at + step] <= last[at])]
            x, y = key[at], key[at + step]
            unlike = x % np.uint64(HASHES) != y % np.uint64(HASHES)
            x, y, i = x[unlike], y[unlike], at[unlike]
            sig = mix(np.minimum(x, y) * np.uint64(3) + mix(np.maximum(x, y)))
            cols = [sig.view(np.int64), unit[i], first[i + step], np.minimum(last[i], last[i + step])]
            for lot in range(0, len(i), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[lot : lot + 100_000], t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["sig", "unit", "first", "last"])
            step += 1
        trim()

    schema = f"kind byte, bucket int, {names}"
    sent = docs.select("unit", "text").mapInArrow(send, schema).repartition(buckets, "bucket").mapInArrow(meet, schema)
    return sent.repartition(buckets, "bucket").mapInArrow(compose, "sig long, unit long, first int, last int")


# ---------------------------------------------------------------- regions and their verification


def regions(matched: DataFrame, buckets: int) -> DataFrame:
    """unit, a, b, lead, la, lb: shingles of a unit and of a leader between which signatures agree on about one diagonal."""

    def chain(batches):
        held = [[c.to_numpy().astype(np.int64) for c in b.columns] for b in batches if b.num_rows]
        if not held:
            return
        unit, first, last, lead, lfirst, llast = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((lfirst - first, lead, unit))
        unit, first, last, lead, lfirst, llast = (x[order] for x in (unit, first, last, lead, lfirst, llast))
        other = np.append(True, (unit[1:] != unit[:-1]) | (lead[1:] != lead[:-1]))
        track = np.cumsum(other | np.append(True, np.diff(lfirst - first) > LEAST))
        order = np.lexsort((llast, lfirst, last, first, track))  # rows come in any order
        unit, first, last, lead, lfirst, llast, track = (x[order] for x in (unit, first, last, lead, lfirst, llast, track))
        new = np.flatnonzero(np.append(True, (track[1:] != track[:-1]) | (first[1:] > last[:-1] + LEAST)))
        low, high = lambda x: np.minimum.reduceat(x, new), lambda x: np.maximum.reduceat(x, new) + LEAST
        out = [unit[new], low(first), high(last), lead[new], low(lfirst), high(llast)]
        for lot in range(0, len(new), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[lot : lot + 100_000]) for c in out], names=["unit", "a", "b", "lead", "la", "lb"])
        trim()

    rows = matched.where("unit <> lead").select("unit", "first", "last", "lead", "lead_first", "lead_last").repartition(buckets, "unit")
    return rows.mapInArrow(chain, "unit long, a long, b long, lead long, la long, lb long")


def _texts(docs: DataFrame, units: DataFrame, parts: DataFrame) -> DataFrame:
    """unit, text, parts of the units that parts (unit, part: struct) name: the row of a unit's smallest doc_id."""
    wanted = parts.groupBy("unit").agg(F.collect_list("part").alias("parts")).join(units.select("unit", "rep"), "unit").select(F.col("rep").alias("doc_id"), "unit", "parts")
    return semi_by_id(docs, wanted.select("doc_id").distinct(), "doc_id").join(wanted.hint("merge"), ["doc_id", "unit"]).dropDuplicates(["doc_id", "unit"]).select("unit", "text", "parts")


def _cut_rows(batch):
    """(unit, shingles in 32 bits, parts) of each row."""
    units, parts = batch.column(0).to_pylist(), batch.column(2).to_pylist()
    for i, j, data, off in text_slices(batch.column(1)):
        grams, _, at = doc_shingles(data, off)
        short = (grams >> np.uint64(32)).astype("<u4")
        for k in range(i, j):
            begin = int(at[k - i])
            yield units[k], short[begin : max(begin, int(at[k - i + 1]) - SHINGLE + 1)], parts[k]


def verified(docs: DataFrame, units: DataFrame, pairs: DataFrame, buckets: int) -> DataFrame:
    """unit, start, end, lead, lead_start, lead_end (words) of the regions that are alike, and from and to, between which runs of the unit are.

    Pairs are compared in the bucket of their unit; a leader's shingles go there once, however many followers it has.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")
    own = pairs.select("unit", F.struct(place(F.col("unit")).alias("bucket"), "a", "b").alias("part"))
    down, up = F.floor(F.col("la") / GRID) * GRID, F.ceil(F.col("lb") / GRID) * GRID
    other = pairs.select(F.col("lead").alias("unit"), F.struct(place(F.col("unit")).alias("bucket"), down.alias("a"), up.alias("b")).alias("part"))
    empty = {"names": ["bucket", "unit", "spans", "shingles", "a", "b", "lead", "la", "lb"]}
    schema = "bucket int, unit long, spans binary, shingles binary, a long, b long, lead long, la long, lb long"

    def cut(batches):
        for batch in batches:
            rows = []
            for unit, shingles, parts in _cut_rows(batch):
                by_bucket: dict[int, list[tuple[int, int]]] = {}
                for p in sorted((p["bucket"], p["a"], min(p["b"], len(shingles))) for p in parts):
                    spans = by_bucket.setdefault(p[0], [])
                    if spans and p[1] <= spans[-1][1]:
                        spans[-1] = (spans[-1][0], max(spans[-1][1], p[2]))
                    else:
                        spans.append(p[1:])
                for bucket, spans in by_bucket.items():
                    rows.append((bucket, unit, np.array(spans, np.int64).tobytes(), b"".join([shingles[a:b].tobytes() for a, b in spans])))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([*[pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], *[pa.nulls(len(rows), pa.int64())] * 5], **empty)
        trim()

    def compare(batches):
        texts, todo = {}, []  # a task may have several buckets
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(9)]
            for bucket, unit, spans, shingles, *pair in zip(*cols, strict=True):
                if spans is None:
                    todo.append((bucket, unit, *pair))
                else:
                    ends = np.frombuffer(spans, np.int64).reshape(-1, 2)
                    size = np.cumsum(ends[:, 1] - ends[:, 0])
                    texts[bucket, unit] = (ends[:, 0].tolist(), (size - (ends[:, 1] - ends[:, 0])).tolist(), size.tolist(), np.frombuffer(shingles, "<u4"))

        def part(bucket: int, unit: int, a: int, b: int) -> np.ndarray:
            starts, begins, ends, shingles = texts[bucket, unit]
            i = bisect_right(starts, a) - 1
            at = begins[i] + a - starts[i]
            return shingles[at : min(at + b - a, ends[i])]

        out = []
        for bucket, unit, a, b, lead, la, lb in sorted(todo):
            mine, other = part(bucket, unit, a, b), part(bucket, lead, la, lb)
            if (span := alike_span(mine, other)) and (back := alike_span(other, mine)):
                runs = alike_runs(mine, other)[0]
                out.append((unit, a + span[0], a + span[1] + SHINGLE - 1, lead, la + back[0], la + back[1] + SHINGLE - 1, a + int(runs[0]), a + int(runs[-1])))
        cols = list(zip(*out, strict=True)) or [()] * 8
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=["unit", "start", "end", "lead", "lead_start", "lead_end", "from", "to"])
        trim()

    cuts = _texts(docs, units, own.union(other).distinct()).mapInArrow(cut, schema)
    nothing = F.lit(None).cast("binary")
    asked = pairs.select(place(F.col("unit")).alias("bucket"), "unit", nothing.alias("spans"), nothing.alias("shingles"), "a", "b", "lead", "la", "lb")
    return cuts.unionByName(asked).repartition(buckets, "bucket").mapInArrow(compare, f"{PAIR}, from long, to long")


def alike_runs(mine: np.ndarray, other: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of least of mine begin that have Jaccard similarity 0.75 or more to the other side's region, and which shingles are common."""
    if len(mine) < least or len(other) < least:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    common = np.isin(mine, other)
    sums = np.concatenate([[0], np.cumsum(common)])
    return np.flatnonzero(7 * (sums[least:] - sums[:-least]) >= 6 * least), common  # i / (2 n - i) >= 3 / 4


def alike_span(mine: np.ndarray, other: np.ndarray, least: int = LEAST) -> tuple[int, int] | None:
    """The first and last shingle of mine in runs of least with Jaccard similarity 0.75 or more to the other side's region.

    From the first common shingle to the last one, but never shorter than a run.
    """
    good, common = alike_runs(mine, other, least)
    if not len(good):
        return None
    a, b = int(good[0]), int(good[-1]) + least
    hits = np.flatnonzero(common[a:b])
    first, last = a + int(hits[0]), a + int(hits[-1]) + 1
    return (first, last) if last - first >= least else (min(first, b - least), min(first, b - least) + least)


# ---------------------------------------------------------------- signatures without a verified partner


def open_places(matched: DataFrame, spans: DataFrame, buckets: int) -> DataFrame:
    """sig, unit, first of the places of matched that do not lie whole where runs of their unit alike its leader begin."""
    runs = spans.select("unit", "lead", F.col("from").alias("x"), F.col("to").alias("y"), F.lit(None).cast("long").alias("sig"))
    asked = matched.select("unit", "lead", F.col("first").cast("long").alias("x"), F.col("last").cast("long").alias("y"), "sig")

    def check(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        cols = [pa.concat_arrays([b.column(i) for b in batches]) for i in range(5)]
        span = np.asarray(cols[4].is_null())
        unit, lead, x, y = (c.to_numpy() for c in cols[:4])
        sig = cols[4].fill_null(0).to_numpy()
        pair = np.unique(np.stack([unit, lead], 1), axis=0, return_inverse=True)[1].ravel().astype(np.int64) << 33
        order = np.argsort(pair[span] + x[span], kind="stable")
        starts, ends = (pair[span] + x[span])[order], np.maximum.accumulate((pair[span] + y[span])[order]) if span.any() else np.zeros(0, np.int64)
        ask = ~span
        at = np.searchsorted(starts, (pair + x)[ask], "right") - 1
        closed = np.zeros(int(ask.sum()), bool)
        some = at >= 0
        closed[some] = ends[at[some]] >= (pair + y)[ask][some]
        out = [c[ask][~closed] for c in (sig, unit, x)]
        for lot in range(0, len(out[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[lot : lot + 100_000]) for c in out], names=["sig", "unit", "first"])
        trim()

    return asked.unionByName(runs).repartition(buckets, "unit").mapInArrow(check, "sig long, unit long, first long")


def group_links(docs: list[int], windows: list[np.ndarray], still: list[bool]) -> list[tuple[int, int, tuple[int, int], tuple[int, int]]]:
    """(member, leader, member's span, leader's span): links that connect all that are alike, but for pairs of two that are not open.

    Open members lead in turn. A leader meets all that it is not yet connected with, open or not; two count as connected
    only where the links between them run through one passage of each (by the rule of _own_passages). Two that are not open are
    both alike the signature's leader at all their places. Two that are alike share NEED places of a run, so a leader is met
    through its rarer shingles alone.
    """
    size = np.array([len(w) for w in windows])
    begin = np.cumsum(size) - size
    flat, doc = np.concatenate(windows), np.array(docs)
    # Each shingle of a window once: a line that repeats in all windows would meet itself at every pair of places.
    pairs = np.unique((flat.astype(np.uint64) << np.uint64(32)) | np.repeat(np.arange(len(windows), dtype=np.uint64), size))
    codes, owner = (pairs >> np.uint64(32)).astype(np.uint32), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
    open_, out = np.array(still, bool), []
    label, place, spans = np.arange(len(windows)), np.arange(len(windows)), {}

    def one_passage(i: int, span: tuple[int, int]) -> bool:
        a, b = spans.setdefault(i, span)
        return 4 * (min(b, span[1]) - max(a, span[0])) >= 3 * max(b - a, span[1] - span[0])

    for lead, mine in enumerate(windows):
        if not open_[lead] or len(mine) < LEAST or (label == label[lead]).all():
            continue
        own, places = np.unique(mine, return_counts=True)
        lo, hi = np.searchsorted(codes, own, "left"), np.searchsorted(codes, own, "right")
        spread = np.argsort(hi - lo, kind="stable")
        held = np.cumsum(places[spread])
        few = int(np.searchsorted(held, len(mine) - NEED + 1)) + 1  # of all but NEED - 1 places one is common
        few = max(few, int(np.searchsorted((hi - lo)[spread], 64, "right")))
        seen, ends = np.zeros(len(windows), np.int64), np.cumsum((hi - lo)[spread[:few]])
        cuts = np.unique(np.searchsorted(ends, np.arange(0, int(ends[-1]) + LOT, LOT), "left"))
        for rare in np.split(spread[:few], cuts[(cuts > 0) & (cuts < few)]):
            n = hi[rare] - lo[rare]
            at = np.arange(int(n.sum())) + np.repeat(lo[rare] - (np.cumsum(n) - n), n)
            seen += np.bincount(owner[at], np.repeat(places[rare], n), len(windows)).astype(np.int64)
        # Open ones before the leader have met it when they led.
        met = np.flatnonzero((seen >= NEED - (len(mine) - held[few - 1])) & (doc != doc[lead]) & (size >= LEAST) & (~open_ | (place > lead)))
        for at in range(0, len(met), 4096):
            some = met[at : at + 4096]
            some = some[label[some] != label[lead]]
            for m in some[_maybe_alike(some, flat, begin, size, mine)].tolist():
                if label[m] != label[lead] and (span := alike_span(windows[m], mine)) and (back := alike_span(mine, windows[m])):
                    out.append((m, lead, span, back))
                    if one_passage(m, span) & one_passage(lead, back):
                        label[label == label[m]] = label[lead]
    return out


def _maybe_alike(some: np.ndarray, flat: np.ndarray, begin: np.ndarray, size: np.ndarray, mine: np.ndarray) -> np.ndarray:
    """Which of the windows have a run of LEAST with enough shingles of mine."""
    n = size[some]
    at = np.arange(n.sum()) + np.repeat(begin[some] - (np.cumsum(n) - n), n)
    sums = np.concatenate([[0], np.cumsum(np.isin(flat[at], mine))])
    first = np.cumsum(n) - n
    runs = n - LEAST + 1
    start = np.arange(runs.sum()) + np.repeat(first - (np.cumsum(runs) - runs), runs)
    return np.maximum.reduceat(sums[start + LEAST] - sums[start], np.cumsum(runs) - runs) >= NEED if len(some) else np.zeros(0, bool)


def sharing(rows: list[tuple]) -> list[list[tuple]]:
    """Of the rows (sig, task, unit, first, still, leads, shingles) of each (sig, task) those that may be alike one another.

    A run of one that is not alike the leader has at most NEED - 1 shingles of it; with a run that it is alike it shares NEED,
    so at least one that the leader lacks. Groups without an open row or with one row left are left out.
    """
    if not rows:
        return []
    keys = [r[:2] for r in rows]
    group = np.cumsum([False, *[a != b for a, b in zip(keys, keys[1:])]])
    size = [len(r[6]) // 4 for r in rows]
    owner = np.repeat(np.arange(len(rows)), size)
    code = (group[owner].astype(np.uint64) << np.uint64(32)) | np.frombuffer(b"".join([r[6] for r in rows]), "<u4")
    leads = np.array([r[5] for r in rows], bool)[owner]
    held = np.unique(code[leads])
    if len(held):
        at = np.minimum(np.searchsorted(held, code), len(held) - 1)
        rest = held[at] != code
    else:
        rest = np.ones(len(code), bool)
    unit = np.unique(np.array([r[2] for r in rows], np.int64), return_inverse=True)[1].ravel()
    code, owner = code[rest & ~leads], owner[rest & ~leads]
    order = np.lexsort((unit[owner], code))
    code, owner = code[order], owner[order]
    if not len(code):
        return []
    new = np.append(True, code[1:] != code[:-1])
    first = np.flatnonzero(new)
    several = np.maximum.reduceat(np.append(False, (unit[owner][1:] != unit[owner][:-1]) & ~new[1:]), first)
    kept = np.unique(owner[np.repeat(several, np.diff(np.append(first, len(code))))])
    out: dict[int, list] = {}
    for i in kept.tolist():
        out.setdefault(int(group[i]), []).append(rows[i])
    return [part for part in out.values() if any(r[4] for r in part)]


def _chunked(rows: DataFrame) -> DataFrame:
    """sig, chunks: how many chunks of GROUP places and of GROUP_SHINGLES shingles each signature of rows (sig, first, last) takes."""
    size = F.greatest(F.count("*") / GROUP, F.sum(F.col("last") - F.col("first") + LEAST) / GROUP_SHINGLES)
    return rows.groupBy("sig").agg(F.ceil(size).cast("int").alias("chunks"))


def shared_runs(docs: DataFrame, units: DataFrame, members: DataFrame) -> DataFrame:
    """Of the places members (sig, unit, first, last, still, leads) the leaders and those that may be alike another unit's.

    Such a place has a run of LEAST shingles of which other units have NEED there, and one of these the leader lacks (see
    sharing). Shingles are counted over the whole signature, in work that grows with its shingles and not with its pairs.
    """
    names = ["sig", "unit", "first", "last", "still", "leads"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.list_(pa.int32())]

    def cut(batches):
        for batch in batches:
            out = [(p["sig"], unit, p["first"], p["last"], p["still"], p["leads"], shingles[p["first"] : p["last"] + LEAST].view("<i4")) for unit, shingles, parts in _cut_rows(batch) for p in parts]
            cols = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], names=[*names, "codes"])
        trim()

    parts = members.select("unit", F.struct("sig", "first", "last", "still", "leads").alias("part"))
    windows = written(_texts(docs, units, parts).mapInArrow(cut, "sig long, unit long, first long, last long, still boolean, leads boolean, codes array<int>"), "windows")
    codes = windows.select(*names, F.posexplode("codes").alias("at", "code"))
    member = F.when(~F.col("leads"), F.col("unit"))
    held = codes.groupBy("sig", "code").agg(F.min(member).alias("a"), F.max(member).alias("b"), F.max("leads").alias("led")).where("a <> b")
    held = written(held.select("sig", "code", "led"), "held")
    hits = salted_join(codes.where("not leads"), held, ["sig", "code"], F.col("unit"), 8)
    found = hits.groupBy(names).agg(F.array_sort(F.collect_list("at")).alias("at"), F.min("led").alias("led")).where("not led").where(F.size("at") >= NEED)
    run = F.exists(F.sequence(F.lit(0), F.size("at") - NEED), lambda i: F.get("at", i + NEED - 1) - F.get("at", i) < LEAST)
    out = written(found.where(run).select(names).union(windows.where("leads").select(names)), "left")
    drop_written(windows)
    drop_written(held)
    return out


def whole_groups(docs: DataFrame, units: DataFrame, matched: DataFrame, spans: DataFrame, buckets: int) -> DataFrame:
    """Verified spans, as verified gives them, of the signatures that have open places, each gone through as a whole."""
    # All have met the leader: what is left are signatures of at least two others.
    place = lambda *c: [F.col(x).cast("long").alias(y) for x, y in zip(c, ("unit", "first", "last"), strict=True)]
    first_of = matched.select("sig", *place("lead", "lead_first", "lead_last"))
    matched = matched.where("unit <> lead")
    several = matched.where("unit <> top").select("sig").distinct()
    still = written(open_places(matched, spans, buckets).join(several, "sig", "left_semi"), "open")
    sigs = still.select("sig").distinct()
    sigs = F.broadcast(sigs) if few(sigs, 200_000) else sigs
    members = matched.join(sigs, "sig", "left_semi").select("sig", *place("unit", "first", "last"))
    members = members.join(still.withColumn("still", F.lit(True)), ["sig", "unit", "first"], "left").withColumn("still", F.coalesce("still", F.lit(False)))
    leaders = first_of.join(sigs, "sig", "left_semi").distinct().withColumn("still", F.lit(False))
    kinds = ["sig", "unit", "first", "last", "still", "leads"]
    members = written(members.withColumn("leads", F.lit(False)).select(kinds).union(leaders.withColumn("leads", F.lit(True)).select(kinds)), "members")
    large = written(_chunked(members).where("chunks > 1"), "large")
    work = [still, members, large]
    if few(large, 0):
        rows = members.withColumn("chunks", F.lit(1))
    else:
        hot = F.broadcast(large) if few(large, BROADCAST_ROWS) else large
        rows = members.join(hot.select("sig"), "sig", "left_anti").withColumn("chunks", F.lit(1))
        rest = members.join(hot, "sig")
        rows = rows.union(rest.where(F.col("chunks") <= PAIRED).select(rows.columns))
        if not few(large.where(F.col("chunks") > PAIRED), 0):
            work.append(shared_runs(docs, units, rest.where(F.col("chunks") > PAIRED).drop("chunks")))
            rows = rows.union(salted_join(work[-1], _chunked(work[-1]), ["sig"], F.col("unit"), 8).select(rows.columns))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("unit"), F.col("chunks")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: c != F.col("mine"))
    some = F.transform(others, lambda c: F.concat_ws("-", F.least(c, F.col("mine")), F.greatest(c, F.col("mine"))))
    every = F.flatten(F.transform(F.sequence(F.lit(1), F.col("chunks") - 1), lambda j: F.transform(F.sequence(F.lit(0), j - 1), lambda i: F.concat_ws("-", i, j))))
    tasks = F.when(F.col("chunks") == 1, F.array(F.lit("0"))).when(F.col("leads"), every).otherwise(some)
    parts = rows.select("unit", F.struct("sig", "first", "last", "still", "leads", tasks.alias("tasks")).alias("part"))
    names = ["sig", "task", "unit", "first", "still", "leads", "shingles"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]

    def cut(batches):
        for batch in batches:
            out = []
            for unit, shingles, wanted in _cut_rows(batch):
                for p in wanted:
                    mine = shingles[p["first"] : p["last"] + LEAST].tobytes()
                    out += [(p["sig"], task, unit, p["first"], p["still"], p["leads"], mine) for task in p["tasks"]]
            cols = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], names=names)
        trim()

    def compare(batches):
        found: set = set()

        def block(rows):
            for part in sharing(rows):
                _, _, unit, first, open_, _, packed = zip(*part, strict=True)
                for m, lead, span, back in group_links(unit, [np.frombuffer(x, "<u4") for x in packed], open_):
                    found.add((unit[m], first[m] + span[0], first[m] + span[1] + SHINGLE - 1, unit[lead], first[lead] + back[0], first[lead] + back[1] + SHINGLE - 1))

        rows: list = []
        size = 0
        for batch in batches:
            for row in zip(*[batch.column(k).to_pylist() for k in range(7)], strict=True):
                if (len(rows) >= BLOCK_ROWS or size >= BLOCK_BYTES) and rows[-1][:2] != row[:2]:
                    block(rows)
                    rows, size = [], 0
                    trim()
                rows.append(row)
                size += len(row[6])
        block(rows)
        cols = list(zip(*sorted(found), strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=["unit", "start", "end", "lead", "lead_start", "lead_end"])
        trim()

    cuts = _texts(docs, units, parts).mapInArrow(cut, "sig long, task string, unit long, first long, still boolean, leads boolean, shingles binary")
    out = written(cuts.repartition(buckets, "sig", "task").sortWithinPartitions("sig", "task", "unit", "first").mapInArrow(compare, PAIR), "groups")
    _released(*work)
    return out


# ---------------------------------------------------------------- passages and classes


def _own_passages(spans: list[tuple[int, int, int]]) -> list[tuple[tuple[int, int], list[tuple[int, int, int]]]]:
    """The passages of one unit, each with its spans (lead, start, end): spans of one leader that touch are one, and so are
    such unions of several leaders if one covers three quarters of the other's hull."""
    unions: list[tuple[int, int, list]] = []
    for lead, start, end in sorted(spans):
        if unions and unions[-1][2][0][0] == lead and start <= unions[-1][1]:
            a, b, held = unions[-1]
            unions[-1] = (a, max(b, end), [*held, (lead, start, end)])
        else:
            unions.append((start, end, [(lead, start, end)]))
    out: list[list] = []
    live: list[list] = []
    for a, b, held in sorted(unions):
        live = [p for p in live if p[1] > a]
        near = next((p for p in live if 4 * (min(p[1], b) - max(p[0], a)) >= 3 * max(p[1] - p[0], b - a)), None)
        if near is None:
            near = [a, b, []]
            out.append(near)
            live.append(near)
        near[0], near[1] = min(near[0], a), max(near[1], b)
        near[2] += held
    return [((a, b), held) for a, b, held in out]


def passages(pairs: DataFrame, copies: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """(unit, node, start, end of each passage; span, node) with span the hash of (unit, lead, start, end).

    pairs: verified spans; copies: unit, end of the texts that several documents have whole.
    """
    spans = pairs.select("unit", "lead", "start", "end").union(pairs.select("lead", "lead", "lead_start", "lead_end")).union(copies.select("unit", F.bitwise_not("unit"), F.lit(0).cast("long"), "end")).distinct()
    spans = spans.withColumn("span", F.xxhash64("unit", "lead", "start", "end"))

    def merge(batches):
        rows = sorted(r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
        out, i = [], 0
        while i < len(rows):
            j = i
            while j < len(rows) and rows[j][0] == rows[i][0]:
                j += 1
            names = {r[1:4]: r[4] for r in rows[i:j]}
            for (a, b), held in _own_passages([r[1:4] for r in rows[i:j]]):
                out += [(rows[i][0], a, b, names[x]) for x in held]
            i = j
        cols = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=["unit", "start", "end", "span"])
        trim()

    merged = written(spans.repartition(buckets, "unit").mapInArrow(merge, "unit long, start long, end long, span long").withColumn("node", F.xxhash64("unit", "start", "end")), "passages")
    return merged.select("unit", "node", "start", "end").distinct(), merged.select("span", "node")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, start, end, n_words for each repeated passage of docs (doc_id, text)."""
    spark = docs.sparkSession
    lean_batches(spark)
    docs = narrowed(docs, doc_id="doc_id", text="text").where("doc_id is not null and text is not null").withColumn("unit", F.xxhash64("text"))
    words = docs.agg(F.sum(F.length("text") / 6)).first()[0] or 0
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism) if words > 1_000_000 else 4
    buckets = max(least, math.ceil(words * HASHES * 1.2 / LEAST / BUCKET_WINDOWS))
    rows = written(_sizes(docs), "units")
    units = written(rows.groupBy("unit").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last_doc"), F.max("n_words").alias("end")), "texts")

    matched = _with_leaders(docs, buckets)
    found = written(regions(matched, buckets), "regions")
    near = written(verified(docs, units, found, buckets), "verified")
    _released(found)
    pairs = written(near.drop("from", "to").union(whole_groups(docs, units, matched, near, buckets)).distinct(), "pairs")
    _released(matched, near)
    copies = units.where("rep <> last_doc").where(F.col("end") >= LEAST + SHINGLE - 1)
    places, nodes = passages(pairs, copies, buckets)
    side = lambda *c: F.xxhash64(*c)
    links = pairs.select(side("unit", "lead", "start", "end").alias("x"), side("lead", "lead", "lead_start", "lead_end").alias("y")).distinct()
    node = lambda a, b: nodes.select(F.col("span").alias(a), F.col("node").alias(b))
    edges = salted_join(links.join(node("x", "a"), "x"), node("y", "b"), ["y"], F.col("x"), 8).select("a", "b")
    joined = components(edges)
    of_class = places.join(units.select("unit", "rep"), "unit").join(joined.withColumnRenamed("id", "node"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    of_class = written(of_class, "classes")
    names = of_class.groupBy("comp").agg(F.min("rep").alias("class_id"))
    named = salted_join(of_class, names, ["comp"], F.col("unit"), 8).select("unit", "class_id", "start", "end")
    # Passages of one class that touch are one.
    kind = "array<struct<start:bigint,end:bigint>>"
    touches = lambda acc, s: (F.size(acc) > 0) & (s["start"] <= F.get(acc, F.size(acc) - 1)["end"])
    longer = lambda acc, s: F.struct(F.get(acc, F.size(acc) - 1)["start"].alias("start"), F.greatest(F.get(acc, F.size(acc) - 1)["end"], s["end"]).alias("end"))
    join = lambda acc, s: F.when(touches(acc, s), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer(acc, s)))).otherwise(F.concat(acc, F.array(s)))
    spans = F.aggregate(F.array_sort(F.collect_set(F.struct("start", "end"))), F.array().cast(kind), join)
    named = written(named.groupBy("unit", "class_id").agg(spans.alias("spans")).select("unit", "class_id", F.inline("spans")), "named")
    out = salted_join(rows.select("doc_id", "unit").distinct(), named, ["unit"], F.col("doc_id"), 8)
    return out.select("doc_id", "class_id", "start", "end", (F.col("end") - F.col("start")).alias("n_words"))


def _sizes(docs: DataFrame) -> DataFrame:
    """doc_id, unit, n_words of each row."""

    def count(batches):
        for b in batches:
            sizes = [n for _, _, data, off in text_slices(b.column(2)) for n in np.diff(word_hashes(data, off, SPACE_SEP)[1]).tolist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64())], names=["doc_id", "unit", "n_words"])

    return docs.select("doc_id", "unit", "text").mapInArrow(count, "doc_id long, unit long, n_words long")


def _with_leaders(docs: DataFrame, buckets: int) -> DataFrame:
    """sig, unit, first, last, lead, lead_first, lead_last, top: places of the signatures that two units have, with the smallest unit's place and the largest unit."""
    found = written(signatures(docs, buckets), "signatures")
    leaders = found.groupBy("sig").agg(F.min(F.struct("unit", "first", "last")).alias("f"), F.max("unit").alias("top")).where("f.unit <> top")
    leaders = leaders.select("sig", F.col("f.unit").alias("lead"), F.col("f.first").alias("lead_first"), F.col("f.last").alias("lead_last"), "top")
    matched = written(found.join(leaders, "sig"), "matched")
    _released(found)
    return matched


def _released(*tables: DataFrame) -> None:
    """Drops work tables, and lets the driver find the shuffles that nothing refers to any more."""
    for t in tables:
        drop_written(t)
    gc.collect()
    tables[0].sparkSession.sparkContext._jvm.System.gc()


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read_table(spark, sf_dir, "documents"))


QUERIES = {"op4_substring_dedup": op4_substring_dedup}
ORACLE: dict[str, str] = {}
