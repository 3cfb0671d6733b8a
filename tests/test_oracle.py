"""Every registered query of the library's own operators against its SQL twin, in DuckDB, on the smallest tables."""

import os
from collections import Counter

import duckdb
import pandas as pd
import pytest

from lodestone.operators import splitters
from lodestone.plans import registry

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


def rows_of(df: pd.DataFrame) -> list:
    def cell(v):
        if hasattr(v, "item"):
            v = v.item()
        return f"{v:.9g}" if isinstance(v, float) else repr(str(v) if isinstance(v, pd.Timestamp) else v)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf, duck, name):
    mine, other = QUERIES[name](spark, sf).toPandas(), duck.sql(ORACLE[name]).df()
    assert sorted(mine.columns) == sorted(other.columns)
    assert rows_of(mine) == rows_of(other)


def docs_of(spark, sf):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.mark.parametrize(("name", "split"), [("split_recursive", splitters.recursive), ("split_cjk", splitters.chinese)])
def test_splits_are_the_function_of_each_text(spark, sf, name, split):
    want = [(i, n, c) for i, r in docs_of(spark, sf).items() for n, c in enumerate(split(r.text) if r.text else [])]
    got = [(r.doc_id, r.pos, r.chunk) for r in QUERIES[name](spark, sf).collect()]
    assert sorted(got) == sorted(want) and len(got) > 100


def test_split_markdown_is_the_function_of_each_text(spark, sf):
    want = []
    for i, r in docs_of(spark, sf).items():
        marked = "# " + r.source + "\n" + (r.text or "").replace("\n", "\n\n## ") if r.text is not None else ""
        want += [(i, n, c["modal"], c["content"]) for n, c in enumerate(splitters.markdown(marked, r.source + ".md"))]
    assert sorted((r.doc_id, r.pos, r.modal, r.content) for r in QUERIES["split_markdown"](spark, sf).collect()) == sorted(want)


def test_topics_share_documents(spark, sf):
    got = QUERIES["topics_lda"](spark, sf).collect()
    of_doc = Counter()
    for r in got:
        assert 0.1 < r.share <= 1 and 0 <= r.topic < 20
        of_doc[r.doc_id] += r.share
    assert set(of_doc) <= set(docs_of(spark, sf)) and len(of_doc) > 100 and max(of_doc.values()) <= 1 + 1e-6


def test_every_query_is_held_against_something():
    assert set(QUERIES) - set(ORACLE) == {"split_recursive", "split_cjk", "split_markdown", "topics_lda"}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_library_does_not_import_training_operators():
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "lodestone"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "lodestone.llm" not in f.read_text(), f
