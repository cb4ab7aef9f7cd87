"""Metrics of predictions, as grouped aggregates: one job scores all models, folds and resamples.

Predictions have label and score (a value, or the probability of class 1), or label and probs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.operators.rank import cuts_of, in_cuts
from assay.session import cut

HIGHER_IS_BETTER = {"rmse": False, "mae": False, "r2": True, "roc_auc": True, "accuracy": True, "f1_macro": True}
TASK_METRICS = {"regression": ("rmse", "mae", "r2"), "classification": ("roc_auc", "accuracy", "f1_macro")}


def predicted_label(score: str | None = "score", probs: str | None = None, threshold: float = 0.5) -> Column:
    """Class of a probability (1 from the threshold on), or place of the first largest of several."""
    if probs:
        return (F.array_position(F.col(probs), F.array_max(probs)) - 1).cast("int")
    return (F.col(score) >= threshold).cast("int")


def regression(preds: DataFrame, metric: str, by: list[str], weight: str | None = None) -> DataFrame:
    """rmse, mae or r2 of each group; r2 of constant labels is null."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    y, e = F.col("label").cast("double"), F.col("label") - F.col("score")
    if metric == "mae":
        value = F.sum(w * F.abs(e)) / F.sum(w)
    elif metric == "rmse":
        value = F.sqrt(F.sum(w * e * e) / F.sum(w))
    else:
        spread = F.sum(w * y * y) - F.sum(w * y) * F.sum(w * y) / F.sum(w)
        value = 1 - F.try_divide(F.sum(w * e * e), F.when(F.min(y) < F.max(y), spread))
    return preds.groupBy(*by).agg(value.alias("value"))


def accuracy(preds: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """Share of rows whose predicted class is the label."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return preds.groupBy(*by).agg((F.sum(w * (F.col("label").cast("int") == _label(preds)).cast("double")) / F.sum(w)).alias("value"))


def _label(preds: DataFrame) -> Column:
    return predicted_label(probs="probs") if "probs" in preds.columns else predicted_label()


def f1_macro(preds: DataFrame, by: list[str], classes: int, weight: str | None = None) -> DataFrame:
    """Mean of the classes' F1 over all `classes`; a class without rows and predictions has 0."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    cells = preds.groupBy(*by, F.col("label").cast("int").alias("y"), _label(preds).alias("p")).agg(F.sum(w).alias("n"))
    each = [F.coalesce(F.try_divide(2 * F.sum(F.when((F.col("y") == k) & (F.col("p") == k), F.col("n")).otherwise(0)), F.sum(F.when(F.col("y") == k, F.col("n")).otherwise(0)) + F.sum(F.when(F.col("p") == k, F.col("n")).otherwise(0))), F.lit(0.0)) for k in range(classes)]
    return cells.groupBy(*by).agg((reduce(lambda a, b: a + b, each) / classes).alias("value"))


def roc_auc(preds: DataFrame, by: list[str], weight: str | None = None, spread: DataFrame | None = None) -> DataFrame:
    """Probability that a positive's score exceeds a negative's, ties counting half; null with one class only.

    Rows are first counted for each distinct score; running sums go over ranges of scores that hold
    about equally many, whose totals are a few hundred rows for each group. spread: where the ranges
    come from, if not from preds; results don't depend on it.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    ranges = cuts_of(preds if spread is None else spread, "score")
    points = in_cuts(preds, "score", ranges, "_b").groupBy(*by, "_b", "score").agg(F.sum(w * (F.col("label") == 1).cast("double")).alias("pos"), F.sum(w * (F.col("label") == 0).cast("double")).alias("neg"))
    inside = F.coalesce(F.sum("neg").over(Window.partitionBy(*by, "_b").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    # a row for each range, which has what its own scores add; the rest is between whole ranges
    each = points.withColumn("_inside", inside).groupBy(*by, "_b").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum(F.col("pos") * (F.col("_inside") + F.col("neg") / 2)).alias("own"))
    before = F.coalesce(F.sum("neg").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return each.withColumn("_before", before).groupBy(*by).agg(F.try_divide(F.sum(F.col("own") + F.col("pos") * F.col("_before")), F.sum("pos") * F.sum("neg")).alias("value"))


def _one_vs_rest(preds: DataFrame, kept: list[str]) -> DataFrame:
    return preds.select(*kept, "label", F.posexplode("probs").alias("_class", "score")).withColumn("label", (F.col("label") == F.col("_class")).cast("int"))


def roc_auc_ovr(preds: DataFrame, by: list[str], weight: str | None = None, spread: DataFrame | None = None) -> DataFrame:
    """Mean over classes of each against the rest; null if some class has no rows or all."""
    kept = [*by, *([weight] if weight else [])]
    # written, for what predicts is worked out again for each class and pass otherwise
    each = _one_vs_rest(cut(preds.select(*kept, "label", "probs")), kept)
    spread = None if spread is None else _one_vs_rest(spread, [])
    return roc_auc(each, [*by, "_class"], weight, spread).groupBy(*by).agg(F.when(F.count("value") == F.count("*"), F.avg("value")).alias("value"))


def score(preds: DataFrame, metric: str, by: tuple[str, ...] = ("model",), weight: str | None = None, classes: int = 2, spread: DataFrame | None = None) -> DataFrame:
    """by and value. spread: see `roc_auc`. An unknown metric is a ValueError."""
    if metric not in HIGHER_IS_BETTER:
        raise ValueError(f"unknown metric {metric}; there are {sorted(HIGHER_IS_BETTER)}")
    by = list(by)
    if metric in TASK_METRICS["regression"]:
        return regression(preds, metric, by, weight)
    if metric == "accuracy":
        return accuracy(preds, by, weight)
    if metric == "f1_macro":
        return f1_macro(preds, by, classes, weight)
    return (roc_auc_ovr if "probs" in preds.columns else roc_auc)(preds, by, weight, spread)
