"""Corpus statistics: length histograms, file outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.bounded import running


def histogram(values: DataFrame) -> DataFrame:
    """bucket, n, percent of integer values: buckets from 0, a tenth of the range wide (at least 1). Empty for fewer than two values."""
    values = values.where("value is not null")
    ends = values.agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("all"))
    wide = ends.select("all", F.greatest(F.lit(1), F.bround(F.lit(0.1) * (F.col("hi") - F.col("lo")), 0).cast("long")).alias("width"))
    rows = values.crossJoin(F.broadcast(wide)).where(F.col("all") > 1)
    by = rows.groupBy((F.floor(F.col("value") / F.col("width")) * F.col("width")).cast("long").alias("bucket")).agg(F.count("*").alias("n"), F.max("all").alias("all"))
    return by.select("bucket", "n", F.round(F.lit(100.0) * F.col("n") / F.col("all"), 2).alias("percent"))


def summary(values: DataFrame) -> DataFrame:
    """One row: n, mean (2 places), median (the entry at the half-to-even middle of the order), least, most; none for fewer than two values.

    The median is found by counting equal values, so that no task sorts all rows.
    """
    values = values.where("value is not null")
    total = values.agg(F.count("*").alias("n"), F.round(F.avg("value"), 2).alias("mean"), F.min("value").cast("long").alias("least"), F.max("value").cast("long").alias("most"))
    counts = values.groupBy("value").agg(F.count("*").alias("held"))
    cum = running(counts, "value", [], {"upto": F.col("held")})
    place = F.bround((F.col("n") - 1).cast("double") / 2, 0)
    mid = cum.crossJoin(F.broadcast(total)).where(F.col("upto") > place).agg(F.min("value").cast("long").alias("median"))
    return total.where("n > 1").crossJoin(F.broadcast(mid)).select("n", "mean", "median", "least", "most")


def sampled(rows: DataFrame, n: int = 10_000, seed: int = 0) -> DataFrame:
    """A sample of about n rows (the feature of this operator), for length reports."""
    total = rows.count()
    return rows if total <= n else rows.sample(fraction=n / total, seed=seed)


def preprocess_reason(kind: Column, exists: Column, readable: Column) -> Column:
    """What becomes of a file: skipped by type, missing, unreadable or preprocessed."""
    return F.when(kind.isNull(), "skip unknown format").when(kind == "image", "skip image").when(~exists, "skip not exist").when(~readable, "read error").otherwise("preprocessed")


def outcome_summary(files: DataFrame) -> DataFrame:
    """One row: success, skip, failed by reason."""
    done, skip = F.col("reason") == "preprocessed", F.startswith("reason", F.lit("skip"))
    return files.agg(F.count_if(done).alias("success"), F.count_if(skip).alias("skip"), F.count_if(~done & ~skip).alias("failed"))


