"""Significance of differences between candidates, and intervals from resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.portable import text_hash, uniform
from assay.functions.student import t_sf
from assay.operators import metrics
from assay.operators.rank import rank_by_hash
from assay.operators.resample import multinomial_scores, poisson_scores

TIE = 0.05


def train_ratio(k: int, time_series: bool = False) -> float:
    """Test rows for each training row: of one fold, or in total over folds in time."""
    return 2 / (k + 1) if time_series else 1 / (k - 1)


def corrected_t(scores: DataFrame, best: str, ratio: float) -> DataFrame:
    """candidate, n_folds, mean_diff, t and p of each candidate against the best, over common folds.

    scores: candidate, repeat, fold and value, larger is better. The variance is corrected for
    training sets that overlap; p is one-sided, that the best is better. Equal differences in all
    folds give an infinite t, or 0 and p 0.5.
    """
    b = scores.where(F.col("candidate") == best).select("repeat", "fold", F.col("value").alias("b"))
    d = scores.join(b, ["repeat", "fold"]).select("candidate", (F.col("b") - F.col("value")).alias("d"))
    s = d.groupBy("candidate").agg(F.count("d").alias("n_folds"), F.avg("d").alias("mean_diff"), F.var_samp("d").alias("var"))
    s = s.withColumn("_flat", F.coalesce(F.col("var"), F.lit(0.0)) == 0)
    t = F.when(F.col("_flat"), F.when(F.col("mean_diff") > 0, float("inf")).when(F.col("mean_diff") < 0, float("-inf")).otherwise(0.0)).otherwise(F.try_divide(F.col("mean_diff"), F.sqrt((1 / F.col("n_folds") + ratio) * F.col("var"))))
    s = s.withColumn("t", t)
    p = F.when(F.col("_flat"), F.when(F.col("mean_diff") > 0, 0.0).when(F.col("mean_diff") < 0, 1.0).otherwise(0.5)).otherwise(t_sf(F.col("t"), F.greatest(F.col("n_folds") - 1, F.lit(1))))
    return s.select("candidate", "n_folds", "mean_diff", "t", p.alias("p"))


def holm(df: DataFrame, by: list[str], p: str = "p", name: str = "candidate", out: str = "p_adjusted") -> DataFrame:
    """Adds step-down adjusted p-values within groups; there are as many rows as candidates."""
    order = Window.partitionBy(*by).orderBy(p, name)
    m = F.count("*").over(Window.partitionBy(*by))
    step = F.least(F.lit(1.0), (m - F.row_number().over(order) + 1) * F.col(p))
    df = df.withColumn("_step", step)
    return df.withColumn(out, F.max("_step").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def tie_group(df: DataFrame, best: str, p: str = "p_adjusted") -> DataFrame:
    """Adds tie: the best itself, or a p-value that is at least 0.05 at 4 decimals."""
    return df.withColumn("tie", (F.col("candidate") == best) | (F.round(p, 4) >= TIE))


def resample_exact(preds: DataFrame, keys: list[str], n_boot: int, seed: int = 0) -> DataFrame:
    """Predictions once for each time they are drawn: n of n rows with replacement, alike for all models. For small tables; `resample.multinomial_scores` is for large ones."""
    ranked = rank_by_hash(preds.select(*keys).distinct(), text_hash(seed, *keys), keys, name="_row")
    n = ranked.count()
    draws = ranked.sparkSession.range(n_boot * n).select(F.floor(F.col("id") / n).cast("int").alias("rep"), (F.col("id") % n).alias("slot"))
    draws = draws.withColumn("_row", (F.floor(uniform(seed, "rep", "slot") * n) + 1).cast("long"))
    drawn = draws.groupBy("rep", "_row").agg(F.count("*").alias("weight"))
    return preds.join(ranked.join(drawn, "_row").drop("_row"), keys)


def bootstrap(preds: DataFrame, metric: str, best: str, keys: list[str], n_boot: int = 2000, seed: int = 0, method: str = "poisson", classes: int = 2, bins: int = 1000) -> DataFrame:
    """model, score, ci_lo, ci_hi, diff, diff_lo, diff_hi: 95 % percentile intervals, paired over resamples.

    diff is the model's score less the best's in the metric's own units; the best's is 0. Weights
    are Poisson numbers, or with method "exact" draws of n of n rows (see `resample`). Resamples of
    a roc_auc are scored on `bins` quantiles of the scores, over all classes together; up to as many
    rows that is exact.
    """
    scored = (poisson_scores if method == "poisson" else multinomial_scores)(preds, metric, keys, n_boot, seed, classes, bins)
    full = metrics.score(preds, metric, ("model",), classes=classes)
    return intervals(scored, full, best)


def intervals(scored: DataFrame, full: DataFrame, best: str) -> DataFrame:
    """The same from rep, model and value, and each model's value on all rows. Resamples without value are skipped."""
    of_best = F.max(F.when(F.col("model") == best, F.col("value")))
    q = lambda c: F.percentile(c, F.array(F.lit(0.025), F.lit(0.975)))
    out = scored.withColumn("b", of_best.over(Window.partitionBy("rep"))).groupBy("model").agg(q(F.col("value")).alias("ci"), q(F.col("value") - F.col("b")).alias("dci"))
    # a row for each model
    full = full.withColumn("base", of_best.over(Window.partitionBy()))
    return full.join(out, "model", "left").select("model", F.col("value").alias("score"), F.col("ci")[0].alias("ci_lo"), F.col("ci")[1].alias("ci_hi"), (F.col("value") - F.col("base")).alias("diff"), F.col("dci")[0].alias("diff_lo"), F.col("dci")[1].alias("diff_hi"))
