"""Substring deduplication: a function of the table, whole repeated passages, classes, recall of near-duplicate passages."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import substring_dedup as sd

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(rng, n, size=4000):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def rows_of(df):
    return sorted(tuple(r) for r in sd.repeated_passages(df).select("doc_id", "class_id", "start", "end", "n_words").collect())


def exact_repeats(texts):
    """The words of each text that lie in a run of 50 words which another text has."""
    found = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)) for i, t in texts.items()}
    seen = defaultdict(set)
    for i, w in found.items():
        for j in range(len(w) - 49):
            seen[tuple(w[j : j + 50])].add(i)
    return {i: {k for j in range(len(w) - 49) if len(seen[tuple(w[j : j + 50])]) > 1 for k in range(j, j + 50)} for i, w in found.items()}


@pytest.fixture(scope="module")
def given(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")


def test_rows_are_a_function_of_the_table(spark, given, monkeypatch):
    want = rows_of(given.repartition(1))
    assert len(want) > 20
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n, flush, group in ((4, 300, 3), (16, 200_000, 2000)):
            monkeypatch.setattr(sd, "FLUSH_WINDOWS", flush)
            monkeypatch.setattr(sd, "BUCKET_WINDOWS", 500 * n)
            monkeypatch.setattr(sd, "GROUP", group)
            spark.conf.set("spark.sql.shuffle.partitions", str(n + 3))
            assert rows_of(given.repartition(n)) == want
            assert rows_of(given.union(given.where("doc_id % 3 = 0")).orderBy(F.rand(n))) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)


def test_every_exact_repeat_is_covered(given):
    texts = {r.doc_id: r.text for r in given.collect()}
    covered = defaultdict(set)
    for doc, cls, start, end, n in rows_of(given):
        assert n == end - start >= 50 and cls <= doc
        covered[doc] |= set(range(start, end))
    repeats = exact_repeats(texts)
    assert sum(map(len, repeats.values())) > 1000
    assert all(r <= covered[i] for i, r in repeats.items())


def test_one_passage_is_one_class(spark):
    """A passage in forty texts of their own, another in ten of these, whole copies, and a text that holds a passage twice."""
    rng = random.Random(3)
    p, q = words(rng, 60), words(rng, 70)
    rows = [(i + 5, " ".join(words(rng, 80) + p + words(rng, 30) + (q if i < 10 else []) + words(rng, 40))) for i in range(40)]
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, rows[3][1]), (200, " ".join(words(rng, 300))), (201, " ".join(words(rng, 49))), (202, None), (None, rows[3][1])]
    rows += [(300, " ".join(p + words(rng, 90) + p))]
    got = rows_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    of_doc = defaultdict(list)
    for doc, cls, start, end, _ in got:
        of_doc[doc].append((cls, start, end))
    assert not {200, 201, 202, None} & set(of_doc)
    for i in range(40):
        near = lambda at, size: [c for c, s, e in of_doc[i + 5] if abs(s - at) < 16 and abs(e - at - size) < 16]  # noqa: E731, B023
        assert near(80, 60) == [5], of_doc[i + 5]
        if i < 10:
            assert near(170, 70) == [5]
    assert (8, 0, 280) in of_doc[100] and of_doc[100] == of_doc[101] == of_doc[8]
    assert len(of_doc[300]) == 2 and {c for c, _, _ in of_doc[300]} == {5}


@pytest.mark.parametrize("size", [50, 65, 80])
def test_recall_of_near_passages(spark, size):
    """Pairs of texts that share a passage with edits, so that its best run of 50 words stays at 0.75 or more: nine tenths are found."""
    rng = random.Random(size)
    rows, alike = [], set()
    for n in range(200):
        p = words(rng, size, 100_000)
        edited = list(p)
        for at in rng.sample(range(size), 1 if size == 50 else 2):
            edited[at] = "edit" + str(rng.randrange(10**6))
        for side, passage in ((0, p), (1, edited)):
            rows.append((2 * n + side, " ".join(words(rng, 60, 10**7) + passage + words(rng, 60, 10**7))))
        grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (p, edited)]
        runs = [[{tuple(w[i : i + 5]) for i in range(a, a + 46)} for a in range(len(w) - 49)] for w in (p, edited)]
        if max(len(x & y) / len(x | y) for x in runs[0] for y in runs[1]) >= 0.75 and grams[0] & grams[1]:
            alike.add(n)
    found = {doc // 2 for doc, *_ in rows_of(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert len(alike) > 100 and len(found & alike) >= 0.9 * len(alike)
    for doc, cls, *_ in rows_of(spark.createDataFrame(rows, "doc_id long, text string")):
        assert cls == doc // 2 * 2


def test_signatures_are_those_of_all_runs():
    """The merged windows of a text against the minima of each run, repeated words included."""
    rng = random.Random(8)
    grams = np.array([rng.randrange(1 << 60) if rng.random() < 0.7 else 7 for _ in range(200)], np.uint64)
    valid = np.ones(200, bool)
    valid[[60, 61, 62, 63, 196, 197, 198, 199]] = False
    key, _, first, last = sd.merged_windows(grams, valid, np.zeros(200, np.int64), np.zeros(200, np.int64))
    got = {(int(k), s) for k, a, b in zip(key, first, last, strict=True) for s in range(a, b + 1)}
    want = set()
    for fn, seed in enumerate(sd.SEEDS):
        values = sd.mix(grams ^ seed)
        for s in range(200 - sd.LEAST + 1):
            if valid[s : s + sd.LEAST].all():
                low = values[s : s + sd.LEAST] | np.uint64(1)
                for x in values[s : s + sd.LEAST][low == low.min()]:
                    want.add((int(sd.mix(np.array([x]) + seed)[0] // np.uint64(4) * np.uint64(4)) + fn, s))
    assert got == want


def test_awkward_tables(spark):
    schema = "doc_id long, text string, unit long, sig long, lead long, part string"
    assert rows_of(spark.createDataFrame([], schema)) == []
    long = " ".join(f"x{i}" for i in range(60))
    rows = [(1, long, 0, 0, 0, "c"), (1, long, 0, 0, 0, "c"), (2, "a " * 5000, 0, 0, 0, None), (3, "a " * 700, 0, 0, 0, None), (4, "", 0, 0, 0, None), (5, "x" * 40_000, 0, 0, 0, None)]
    got = rows_of(spark.createDataFrame(rows, schema))
    assert {r[0] for r in got} <= {2, 3}  # one word over and over is a run that both texts have
    assert rows_of(spark.createDataFrame([(1, long), (1, long + " y"), (9, long + " y")], "doc_id long, text string"))
