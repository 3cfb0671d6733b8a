"""Threshold calibration from scored, labelled questions: precision-recall curve, best throttle, maximum F1, sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.bounded import running


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def pr_curve(scored: DataFrame) -> DataFrame:
    """threshold, tp, fp, precision, recall for each distinct score (below 0 counts as 0). scored: score, label (boolean)."""
    by = scored.select(F.greatest("score", F.lit(0.0)).alias("threshold"), F.col("label").cast("int").alias("good")).groupBy("threshold")
    by = by.agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    total = by.agg(F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad"))
    below = running(by, "threshold", [], {"good_to": F.col("good"), "bad_to": F.col("bad")})
    at = below.crossJoin(F.broadcast(total)).withColumns({"tp": F.col("all_good") - F.col("good_to") + F.col("good"), "fp": F.col("all_bad") - F.col("bad_to") + F.col("bad")})
    return at.select("threshold", "tp", "fp", _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), _ratio(F.col("tp"), F.col("all_good")).alias("recall"))


def best_throttle(curve: DataFrame) -> DataFrame:
    """One row: the lowest threshold with the largest precision + recall."""
    total = F.round(F.col("precision") + F.col("recall"), 9)
    return curve.orderBy(total.desc(), "threshold").limit(1).select("threshold", "precision", "recall")


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall == 0, F.lit(0.0)).otherwise(F.lit(2.0) * precision * recall / (precision + recall))


def max_f1(curve: DataFrame) -> DataFrame:
    out = curve.withColumn("f1", f1(F.col("precision"), F.col("recall")))
    return out.orderBy(F.round("f1", 9).desc(), "threshold").limit(1).select("threshold", "precision", "recall", "f1")


def sweep(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """threshold, tp, fp, fn, precision, recall, f1 over a grid; scored is read once."""
    grid = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    hit = F.col("score") >= F.col("threshold")
    counts = scored.select("score", "label", grid).groupBy("threshold").agg(
        F.count_if(hit & F.col("label")).alias("tp"), F.count_if(hit & ~F.col("label")).alias("fp"), F.count_if(~hit & F.col("label")).alias("fn")
    )
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumns({"precision": p, "recall": r}).withColumn("f1", f1(F.col("precision"), F.col("recall")))


def throttle_feedback(t: Column) -> Column:
    """A step up after a bad answer: 2 % of what is left to 1, at most 0.5."""
    return F.least(t + F.greatest(F.lit(0.0), F.lit(1.0) - t) * F.lit(0.02), F.lit(0.5))


def with_truth(truth: DataFrame, predictions: DataFrame, key: list[str]) -> DataFrame:
    """key, truth, predicted: ground truth beside predictions by key, never by position. Raises if a key stands twice on a side.

    A row without a prediction has predicted false; predictions without truth go.
    """
    for side in (truth, predictions):
        if not side.groupBy(*key).count().where("count > 1").isEmpty():
            raise ValueError("a key stands on several rows")
    return truth.join(predictions, key, "left").select(*key, "truth", F.coalesce("predicted", F.lit(False)).alias("predicted"))


def agreement(rows: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1 of rows (truth, predicted)."""
    hit = lambda a, b: F.count_if((F.col("truth") == a) & (F.col("predicted") == b))
    n = rows.agg(hit(True, True).alias("tp"), hit(False, True).alias("fp"), hit(True, False).alias("fn"))
    share = lambda of: F.coalesce(F.try_divide(F.col("tp").cast("double"), of.cast("double")), F.lit(0.0))
    p, r = share(F.col("tp") + F.col("fp")), share(F.col("tp") + F.col("fn"))
    return n.select("tp", "fp", "fn", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))
