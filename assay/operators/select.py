"""From candidates' scores to a recommendation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.operators.metrics import HIGHER_IS_BETTER

SUSPICIOUS, SUSPICIOUS_METRICS = 0.995, ("roc_auc", "accuracy", "r2")


def signed(metric: str, value: Column | str) -> Column:
    """Larger is better."""
    if metric not in HIGHER_IS_BETTER:
        raise ValueError(f"unknown metric {metric}; there are {sorted(HIGHER_IS_BETTER)}")
    value = F.col(value) if isinstance(value, str) else value
    return value if HIGHER_IS_BETTER[metric] else -value


def overfit_gap(df: DataFrame, metric: str) -> DataFrame:
    """Adds how much better the training side is (4 decimals)."""
    return df.withColumn("overfit_gap", F.round(signed(metric, F.col("train_mean")) - signed(metric, F.col("mean")), 4))


def flag_suspicious(df: DataFrame, metric: str) -> DataFrame:
    """Adds suspicious: a score too good to be true."""
    return df.withColumn("suspicious", F.coalesce((F.col("mean") > SUSPICIOUS) & F.lit(metric in SUSPICIOUS_METRICS), F.lit(False)))


def leaderboard(results: DataFrame, metric: str) -> DataFrame:
    """Results (a row for each candidate) with place: best first, failed ones last, ties by name."""
    order = Window.orderBy(F.desc("ok"), signed(metric, "mean").desc_nulls_last(), "candidate")
    return results.withColumn("place", F.row_number().over(order))


def best_per_family(results: DataFrame, metric: str) -> DataFrame:
    """The best working candidate of each model, in the latest setup only if results have setups and rounds."""
    ok = results.where("ok")
    if "setup" in results.columns:
        latest = ok.agg(F.max_by("setup", "round").alias("s"))
        ok = ok.where(F.col("setup") == latest.select("s").scalar())
    order = Window.partitionBy("model").orderBy(signed(metric, "mean").desc_nulls_last(), "candidate")
    return ok.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")


def top_finalists(results: DataFrame, metric: str, top: int = 3) -> DataFrame:
    """The best families' best candidates, with is_best."""
    first = best_per_family(results, metric).orderBy(signed(metric, "mean").desc_nulls_last(), "candidate").limit(top)
    best = first.agg(F.max_by("candidate", F.struct(signed(metric, F.col("mean")))).alias("b"))
    return first.withColumn("is_best", F.col("candidate") == best.select("b").scalar())


def finalist_join(finalists: DataFrame, tests: DataFrame, hidden: DataFrame) -> DataFrame:
    """Finalists with their test against the best and their hidden score; error where one is missing."""
    out = finalists.join(tests, "candidate", "left").join(hidden.withColumnRenamed("model", "candidate"), "candidate", "left")
    error = F.concat_ws("; ", F.when(F.col("p_adjusted").isNull(), "no confirmation"), F.when(F.col("score").isNull(), "no hidden score"))
    return out.withColumn("error", F.when(error != "", error))


def finalist_table(finalists: DataFrame, tests: DataFrame, hidden: DataFrame, metric: str) -> DataFrame:
    """A row for each finalist: CV mean and std, p, tie, hidden score and difference with intervals, and what is recommended."""
    joined = finalist_join(finalists, tests, hidden)
    pick = joined.where("tie").agg(F.max_by("candidate", F.struct(signed(metric, F.col("mean")))).alias("c"))
    columns = ["candidate", "model", "mean", "std", "n_folds", "p_adjusted", "tie", "score", "ci_lo", "ci_hi", "diff", "diff_lo", "diff_hi", "fit_seconds", "predict_ms_per_1k", "error"]
    return joined.select(*[c for c in columns if c in joined.columns]).withColumn("recommended", F.coalesce(F.col("candidate") == pick.select("c").scalar(), F.lit(False)))


def recommend(table: DataFrame, metric: str) -> DataFrame:
    """The first member of the tie group."""
    return table.where("tie").orderBy(signed(metric, "mean").desc_nulls_last(), "candidate").limit(1)
