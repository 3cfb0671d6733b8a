"""Collects the training-data queries and their SQL twins, the pipeline included."""

from __future__ import annotations

from lodestone.llm import decontamination, fingerprints, language_id, licenses, ngram_join, secrets, sentencepiece_codec, substring_dedup, token_files, warc

MODULES = [ngram_join, fingerprints, secrets, substring_dedup, language_id, licenses, warc, token_files, decontamination, sentencepiece_codec]


def queries() -> dict:
    import corpus_pipeline

    return {name: q for m in MODULES for name, q in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    out = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
