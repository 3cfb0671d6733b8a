"""The registered training-data queries over the smallest tables: SQL twins, the libraries they follow, brute force."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from lodestone.llm import catalog, licenses, sentencepiece_codec, token_files


@pytest.fixture(scope="module")
def docs(spark, sf):
    return sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())


def rows(spark, sf, name):
    return {r[0]: r for r in catalog.queries()[name](spark, sf).collect()}


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql_twin(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    mine = catalog.queries()[name](spark, sf)
    other = con.sql(catalog.oracle_sql()[name])
    order = sorted(mine.columns)
    assert order == sorted(other.columns)
    plain = lambda got: sorted((tuple(r) for r in got), key=str)
    assert plain(mine.select(*order).collect()) == plain(other.project(", ".join(order)).fetchall())


def test_every_operator_has_a_query(spark):
    names = list(catalog.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names


def test_op2_query(spark, sf, docs):
    got = rows(spark, sf, "op2_fingerprints")
    for n, (i, x) in enumerate(docs):
        y, c = docs[(n + 1) % len(docs)][1], len(x) // 4
        assert tuple(got[i])[:3] == (i, len(x), hashlib.sha256((x[: len(x) - c] + y[:c]).encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    near = pd.Series([r.near_edited for i, r in got.items() if r.n_chars > 1000])
    assert near.mean() > 0.5 and near.min() > 0.3
    assert pd.Series([r.near_next for r in got.values()]).median() < 0.05


def test_op5_query(spark, sf):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = rows(spark, sf, "op5_language_id")
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in got.items())
    right = [r.lang_pred == lang[i] for i, r in got.items() if r.held_out]
    assert len(right) > 20 and sum(right) / len(right) > 0.95


def test_op8_query(spark, sf, docs):
    from tokenizers import Tokenizer

    tok, at, got = Tokenizer.from_file(token_files.default_tokenizer()), 0, rows(spark, sf, "op8_token_files")
    for i, x in docs:
        ids = [*tok.encode(x, add_special_tokens=False).ids, 0]
        assert tuple(got[i])[:4] == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_op10_query(spark, sf, docs):
    import sentencepiece

    sp, got = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model()), rows(spark, sf, "op10_sentencepiece")
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, x in docs:
        ids = [*sp.encode(x), sp.eos_id()]
        assert tuple(got[i])[:5] == (i, len(ids), digest(" ".join(map(str, ids))), digest(sp.decode(ids)), len(x.encode()))


def test_op4_query(spark, sf, docs):
    found = catalog.queries()["op4_substring_dedup"](spark, sf).collect()
    assert found and all(r.n_words == r.end - r.start >= 50 and r.class_id <= r.doc_id for r in found)


def plain_licences(text):
    """Identifiers and licences without the trigger test: every sentence against every pattern, every rule at every place."""
    found, start = [], 0
    for m in licenses._END.finditer(text):
        end = m.end() if m.group() and m.group()[0] in ".!?;" else m.start()
        found += licenses._recognised(text, start, end)
        start = m.end()
    left = [(n, i) for i, (n, _, _) in enumerate(found)]
    names = [n[5:] for n, _ in left if n.startswith("spdx:")]
    left = [x for x in left if not x[0].startswith("spdx:")]
    for licence, rule in licenses.RULES:
        start = 0
        while start < len(found):
            here = dict((i, n) for n, i in left)
            picked, at = [], start
            for want in rule:
                while picked and at < len(found) and found[at][0] in licenses.FILL and found[at][0] != want:
                    at += 1
                if here.get(at) != want:
                    break
                picked.append(at)
                at += 1
            if len(picked) == len(rule):
                names.append(licence)
                left = [x for x in left if x[1] not in picked]
            start += 1
    names += ["unknown" for n, _ in left if n not in licenses.FILL]
    return len(found), ",".join(n for n, _, _ in found), ",".join(sorted(set(names)))


def test_op6_query(spark, sf, docs):
    got = rows(spark, sf, "op6_license_scan")
    assert set(got) == {i for i, _ in docs} and sum(r.n_sentences > 0 for r in got.values()) > 3
    for i, x in docs:
        assert tuple(got[i])[:4] == (i, *plain_licences(x)), x[:200]


def test_op6_repeated_and_tied_rows(spark):
    text = "Released under the MIT License.\nSPDX-License-Identifier: MIT OR Apache-2.0\n\nAll rights reserved."
    found = licenses.licence_findings(spark.createDataFrame([(1, text), (1, text), (None, text), (2, text + "\n\n" + text), (3, None)], "doc_id long, text string")).collect()
    assert len(found) == 5 and len({tuple(map(tuple, r.licences)) for r in found if r.doc_id != 2 and r.doc_id != 3}) == 1
    for r in found:
        want = plain_licences({1: text, None: text, 2: text + "\n\n" + text, 3: ""}[r.doc_id])
        assert (len(r.sentences), ",".join(s["id"] for s in r.sentences), ",".join(sorted({x["licence"] for x in r.licences}))) == want
