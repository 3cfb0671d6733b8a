"""Functions that need Python: token counts and truncation, query ids, ROUGE-L, and the deterministic stand-ins of models.

All are Arrow-batched. A slot is any function from column to column; the ones here need no model and no network.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@lru_cache(maxsize=4)
def _encoding(ranks: str, pattern: str):
    import base64

    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("slot", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def token_count(ranks: str, pattern: str):
    """Number of tokens of a text by a byte-pair vocabulary file."""

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        enc = _encoding(ranks, pattern)
        return texts.map(lambda t: None if t is None else len(enc.encode_ordinary(t))).astype("Int64")

    return count


def truncated_to_tokens(ranks: str, pattern: str, most: int):
    """A prompt cut to its first most tokens; bytes of a character that is cut go."""

    @F.pandas_udf(T.StringType())
    def cut(texts: pd.Series) -> pd.Series:
        enc = _encoding(ranks, pattern)

        def one(t):
            if t is None or len(t) <= most:
                return t
            return enc.decode_bytes(enc.encode_ordinary(t)[:most]).decode("utf-8", "ignore")

        return texts.map(one)

    return cut


@F.pandas_udf(T.StringType())
def query_id(store: pd.Series, text: pd.Series, at: pd.Series) -> pd.Series:
    """Eight digits of SHA3-512 over the store, the last eight characters of the text and the time."""
    return pd.Series([hashlib.sha3_512(f"{s}{(t or '')[-8:]}{a}".encode()).hexdigest()[:8] for s, t, a in zip(store, text, at, strict=True)])


@F.pandas_udf(T.DoubleType())
def rouge_l(text: pd.Series, reference: pd.Series) -> pd.Series:
    """F1 of the longest common subsequence of words."""

    def one(a: str | None, b: str | None) -> float:
        x, y = (a or "").lower().split(), (b or "").lower().split()
        if not x or not y:
            return 0.0
        names = {w: i for i, w in enumerate(dict.fromkeys(x + y))}
        yi = np.array([names[w] for w in y])
        row = np.zeros(len(y) + 1, np.int64)
        for w in x:
            step = row.copy()
            step[1:] = np.where(yi == names[w], row[:-1] + 1, 0)
            row = np.maximum.accumulate(np.maximum(row, step))
        n = int(row[-1])
        return 2.0 * n / (len(x) + len(y))

    return pd.Series([one(a, b) for a, b in zip(text, reference, strict=True)])


def hash_embedder(dim: int = 64):
    """The stand-in of an embedder: words hashed into dim signed buckets, unit length. Equal texts have equal vectors."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        def one(t):
            v = np.zeros(dim)
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % dim] += 1 if h >> 63 else -1
            norm = np.linalg.norm(v)
            return (v / norm if norm else v).astype(np.float32)

        return texts.map(one)

    return embed


def with_retries(call, tries: int = 3, wait_s: float = 30.0, most_s: float = 60.0, errors: tuple = (OSError, TimeoutError)):
    """call, tried again after a pause that doubles from wait_s to most_s; the last error is raised."""
    import time

    def tried(*args):
        for n in range(tries):
            try:
                return call(*args)
            except errors:
                if n == tries - 1:
                    raise
                time.sleep(min(most_s, wait_s * 2**n))

    return tried


def called(rows: DataFrame, column: str, out: str, call, most: int = 16, **retries) -> DataFrame:
    """rows plus out: call of each text, null for a null, by at most most tasks at a time (so many partitions), failed calls again."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    slot = with_retries(call, **retries)

    def run(batches):
        for batch in batches:
            got = [None if t is None else slot(t) for t in batch.column(column).to_pylist()]
            yield batch.append_column(out, pa.array(got, pa.string()))

    return rows.repartition(most).mapInArrow(run, f"{schema}, `{out}` string")


def word_vector(text: Column, dim: int = 16) -> Column:
    """The stand-in of an embedder in built-in functions: distinct words hashed into dim buckets, unit length; zeros for a text without words."""
    bucket = lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int") % dim
    hashed = F.transform(F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), " "), lambda w: w != "")), bucket)
    counts = F.aggregate(hashed, F.array_repeat(F.lit(0.0), dim), lambda acc, b: F.transform(acc, lambda x, i: F.when(i == b, x + 1.0).otherwise(x)))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(F.array(counts), lambda v: F.transform(v, lambda x: F.coalesce(F.try_divide(x, norm(v)), F.lit(0.0))))[0]


def echo_llm(prompt: Column) -> Column:
    """The stand-in of a language model: the material's first 200 characters."""
    return F.substring(F.regexp_extract(prompt, "(?s)Material:\n(.*)\nQuestion: ", 1), 1, 200)
