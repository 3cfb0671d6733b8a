"""Helpers that keep operators bounded: size-checked broadcasts, and row numbers and running sums without a single task."""

from __future__ import annotations

import json
import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RANGE_ROWS = 100_000
RANGES = 4096


def few(df: DataFrame, limit: int) -> bool:
    """Whether df has at most limit rows; counts no further."""
    return df.limit(limit + 1).count() <= limit


def small_side(df: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """df with a broadcast hint if it has at most limit rows, else as it is (a shuffled join follows)."""
    return F.broadcast(df) if few(df, limit) else df


def in_ranges(df: DataFrame, order: str, name: str = "_range") -> DataFrame:
    """df plus the number of its range of column order: ranges are cut at quantiles, ascending, nulls first."""
    rows = df.count()
    ranges = max(1, min(RANGES, math.ceil(rows / RANGE_ROWS)))
    if ranges == 1:
        return df.withColumn(name, F.lit(0))
    bounds = sorted({b for b in df.agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 100_000)).first()[0] or []})
    kind = dict(df.dtypes)[order]
    marks = F.from_json(F.lit(json.dumps([str(b) for b in bounds])), "array<string>").cast(f"array<{kind}>")  # folded to one literal
    return df.withColumn(name, F.when(F.col(order).isNull(), -1).otherwise(_at_most(marks, len(bounds), F.col(order))))


def _at_most(marks: Column, n: int, value: Column) -> Column:
    """How many of n ascending marks are at most value, by bisection."""
    half = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")
    right = lambda s: F.struct((half(s) + 1).alias("lo"), s["hi"].alias("hi"))
    left = lambda s: F.struct(s["lo"].alias("lo"), half(s).alias("hi"))
    step = lambda s, _: F.when(s["lo"] >= s["hi"], s).when(F.get(marks, half(s)) <= value, right(s)).otherwise(left(s))
    return F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length() + 1)), F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi")), step, lambda s: s["lo"])


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; a temporary one where that is unset in local mode."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors cannot read a folder of the driver's machine")
        base = tempfile.mkdtemp(prefix="lodestone-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def running(df: DataFrame, order: str, ties: list[str], sums: dict[str, Column]) -> DataFrame:
    """df plus, for each name: column of sums, the running sum in the order of (order, *ties); equal rows in any order.

    Ranges of order are summed apart; the offsets of at most RANGES ranges are added.
    """
    df = in_ranges(df, order)
    total = df.groupBy("_range").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offset = total.select("_range", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    inside = Window.partitionBy("_range").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    out = df.join(F.broadcast(offset), "_range").withColumns({n: F.col(f"_o_{n}") + F.sum(c).over(inside) for n, c in sums.items()})
    return out.drop("_range", *[f"_o_{n}" for n in sums])


def numbered(df: DataFrame, order: str, ties: list[str], name: str) -> DataFrame:
    """df plus a global row number from 1 by (order, *ties)."""
    return running(df, order, ties, {name: F.lit(1).cast("long")})
