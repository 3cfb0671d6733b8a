"""Shared pieces of the training-data operators: work folders, column hygiene, salted joins, components, word hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: SQL for text with A-Z lower-cased and nothing else.
SQL_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# ---------------------------------------------------------------- folders and tables


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset in local mode."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None)
    if base is None:
        have = sc._jsc.sc().getCheckpointDir()
        if have.isEmpty():
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir is not set: executors cannot read a folder of the driver's machine")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
            have = sc._jsc.sc().getCheckpointDir()
        base = have.get()
    return base.rstrip("/")


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh folder of the shared one, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def discard(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table of the shared folder: lineage ends there and a lost executor costs a read, not a recomputation."""
    spark = df.sparkSession
    path = f"{workspace(spark, name)}/t"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestone_path = path
    return out


def drop_written(df: DataFrame) -> None:
    if path := getattr(df, "_lodestone_path", None):
        discard(df.sparkSession, path)


def narrowed(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named columns under fixed names, so that further columns of the input cannot clash with an operator's own."""
    return df.select(*[df[src].alias(dst) for dst, src in cols.items()])


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """withColumn whose value is computed once and stored: a generator keeps Catalyst from copying it into lambdas."""
    return df.withColumn(name, F.explode(F.array(value)))


def count_below(values: Column, size: int | Column, value: Column, last: bool = False) -> Column:
    """How many of an ascending array's values are below value (at most value if last), by bisection. size: of the array."""
    n = F.lit(size) if isinstance(size, int) else size
    steps = size.bit_length() + 1 if isinstance(size, int) else 31
    low = lambda x: x <= value if last else x < value
    half = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")
    step = lambda s, _: F.when(s["lo"] >= s["hi"], s).otherwise(
        F.when(low(F.get(values, half(s))), F.struct((half(s) + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), half(s).alias("hi")))
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0).alias("lo"), n.cast("int").alias("hi")), step, lambda s: s["lo"])


def lean_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Smaller Arrow batches for this session, unless it has smaller ones: long texts fill a worker's memory at the default of 10000 rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def trim() -> None:
    """Gives a worker's freed memory back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


_kept: dict = {}


def kept(key: tuple, make):
    """make() for this worker, kept until another key is asked for: workers live on between stages, one model at a time."""
    if key not in _kept:
        _kept.clear()
        trim()
        _kept[key] = make()
        trim()
    return _kept[key]


# ---------------------------------------------------------------- relational helpers

BROADCAST_ROWS = 100_000  # rows of a few columns: some 10 MB in the driver's memory


def few(df: DataFrame, limit: int) -> bool:
    """Whether df has at most limit rows; counts no further than that."""
    return df.limit(limit + 1).count() <= limit


def semi_by_id(df: DataFrame, ids: DataFrame, key: str, broadcast_rows: int = 2_000_000) -> DataFrame:
    """Rows of df whose key is in ids (one long column, distinct). Broadcast only up to broadcast_rows ids (16 MB), else a shuffled semi-join."""
    small = few(ids, broadcast_rows)
    return df.join(F.broadcast(ids) if small else ids.hint("merge"), key, "left_semi")


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, salts: int = 64, how: str = "inner") -> DataFrame:
    """Equi-join for a left side with hot keys: a key's rows are dealt to salts tasks by spread, the (few) right rows are repeated.

    right has at most one row for each key, so the result has no more rows than left. Up to BROADCAST_ROWS of its rows are
    broadcast as they are. More are never broadcast: Spark judges the repeated rows by the size of the files behind them, which
    is salts times too low, and they go through the driver's memory. right is evaluated once more for its count.
    """
    if few(right, BROADCAST_ROWS):
        return left.join(F.broadcast(right), keys, how)
    left = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of edges (a, b) and the smallest vertex that each can reach."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            return ids, ids[label]
        label = new


def components(edges: DataFrame, max_rounds: int = 60, at_once: int = 2_000_000) -> DataFrame:
    """Connected components of edges (a, b: long): one row (id, comp) for each vertex, comp the smallest id reachable.

    Minimum labels with pointer jumping; labels are written to the shared folder every round. Joins on hot vertices and hot
    labels are salted, aggregates on them partial. Up to at_once edges (32 MB) one task does the same in one go.
    """
    both = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    if few(both, at_once):

        def settle(batches):
            pairs = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
            if pairs:
                ids, low = least_labels(*map(np.concatenate, zip(*pairs, strict=True)))
                for i in range(0, len(ids), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 100_000]), pa.array(low[i : i + 100_000])], names=["id", "comp"])

        label = written(both.repartition(1).mapInArrow(settle, "id long, comp long"), "labels")
        drop_written(both)
        return label
    one_way, both = both, written(both.union(both.select(F.col("b"), F.col("a"))), "edges")
    drop_written(one_way)
    label = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("comp")), "labels")
    for _ in range(max_rounds):
        heard = salted_join(both, label.select(F.col("id").alias("b"), "comp"), ["b"], F.col("a"), 8).groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("heard"))
        low = label.join(heard, "id").select("id", "comp", F.least("comp", "heard").alias("low"))
        jump = label.select(F.col("id").alias("low"), F.col("comp").alias("far"))
        new = written(salted_join(low, jump, ["low"], F.col("id"), 8, "left").select("id", F.least("low", F.coalesce("far", "low")).alias("comp"), F.col("comp").alias("was")), "labels")
        drop_written(label)
        label = new
        if new.where("comp <> was").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    drop_written(both)
    return label.select("id", "comp")


# ---------------------------------------------------------------- words as hashes, over Arrow buffers


_M = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_byte_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _byte_rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POS = _byte_rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: bijective, every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("_pow", _BASE), ("_inv", _BASE_INV)):
            p = np.full(size, np.uint64(base))
            p[0] = 1
            globals()[name] = np.multiply.accumulate(p)
    return _pow, _inv


def separators(*spans: tuple[int, int]) -> np.ndarray:
    """A table of 256: True for the byte values in the inclusive spans."""
    t = np.zeros(256, bool)
    for a, b in spans:
        t[a : b + 1] = True
    return t


ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
#: [^\x20\x09-\x0D]+ and [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z
SPACE_SEP = separators((0x20, 0x20), (0x09, 0x0D))
PUNCT_SEP = separators((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def text_slices(column: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) for runs of rows of about most bytes; nulls read as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    off = np.frombuffer(off, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def word_hashes(data: np.ndarray, off: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all rows, in order, and where each row's words begin (one entry more than rows).

    Words are maximal runs of bytes outside sep; A-Z are lower-cased; no word spans two rows.
    """
    rows = len(off) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~sep[data]
    step = np.diff(inside)
    cut = np.unique(off[1:-1])
    cut = cut[(cut > 0) & (cut < len(data))]
    cut = cut[(inside[cut] == 1) & (inside[cut + 1] == 1)]  # a word runs over the border between two rows
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if len(cut):
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    pw, inv = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[ASCII_LOWER[data]] * pw[: len(data)], out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return words, np.searchsorted(starts, off)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive entries (of rows' borders the caller takes care)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = words[:n] * _POS[0]
    for j in range(1, k):
        total = total + words[j : j + n] * _POS[j]
    return mix(total + np.uint64(k))


def shingle_sets(column: pa.Array, k: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct k-word shingle hashes); fewer words: the whole sequence as one; no words: an empty array."""
    for i, j, data, off in text_slices(column):
        words, at = word_hashes(data, off, SPACE_SEP)
        grams = gram_hashes(words, k)
        for r in range(j - i):
            a, b = int(at[r]), int(at[r + 1])
            if b - a >= k:
                yield i + r, np.unique(grams[a : b - k + 1])
            elif b > a:
                yield i + r, gram_hashes(words[a:b], b - a)
            else:
                yield i + r, np.zeros(0, np.uint64)
