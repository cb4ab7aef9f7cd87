import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.functions.portable import uniform
from assay.functions.student import t_sf
from assay.operators import metrics, select, stats


def test_corrected_t(spark):
    rows = [("a", 0, i, float(v)) for i, v in enumerate((1, 2, 3, 4))] + [(c, 0, i, 0.0) for c in ("b", "b2") for i in range(4)]
    got = {r["candidate"]: r for r in stats.corrected_t(spark.createDataFrame(rows, "candidate string, repeat int, fold int, value double"), "a", 1.0).collect()}
    assert abs(got["b"]["t"] - math.sqrt(3)) < 1e-9 and abs(got["b"]["p"] - 0.09085) < 1e-4
    assert got["a"]["t"] == 0 and got["a"]["p"] == 0.5
    flat = {r["candidate"]: r for r in stats.corrected_t(spark.createDataFrame([("a", 0, i, 1.0) for i in range(4)] + [("b", 0, i, 0.0) for i in range(4)] + [("c", 0, i, 2.0) for i in range(4)], "candidate string, repeat int, fold int, value double"), "a", 1.0).collect()}
    assert flat["b"]["t"] == math.inf and flat["b"]["p"] == 0 and flat["c"]["t"] == -math.inf and flat["c"]["p"] == 1


@pytest.mark.parametrize("df", [1, 2, 3, 4, 9, 10, 29])
def test_t_tail_equals_the_integral(spark, df):
    c = math.gamma((df + 1) / 2) / math.sqrt(df * math.pi) / math.gamma(df / 2)
    for t in (-2.5, 0.0, 0.7, 3.1):
        # x = tan(a) makes the range finite
        a = np.linspace(math.atan(t), math.pi / 2, 400001)[:-1]
        x = np.tan(a)
        y = c * (1 + x * x / df) ** (-(df + 1) / 2) * (1 + x * x)
        wanted = float(((y[1:] + y[:-1]) / 2 * np.diff(a)).sum())
        got = spark.range(1).select(t_sf(F.lit(t), F.lit(df)).alias("p")).first()["p"]
        assert abs(got - wanted) < 2e-5, (df, t)


def test_holm(spark):
    got = {r["candidate"]: r["p_adjusted"] for r in stats.holm(spark.createDataFrame([("a", 0.01, 1), ("b", 0.04, 1), ("c", 0.03, 1)], "candidate string, p double, run int"), ["run"]).collect()}
    assert {k: round(v, 9) for k, v in got.items()} == {"a": 0.03, "b": 0.06, "c": 0.06}


@pytest.mark.parametrize("method", ["exact", "poisson"])
def test_bootstrap_brackets_the_difference(spark, method):
    normal = lambda s: F.sqrt(-2 * F.log(uniform(s, "id") + 1e-12)) * F.cos(2 * math.pi * uniform(s + 1, "id"))
    base = spark.range(1000).withColumn("label", 5 * normal(1))
    preds = base.select(F.lit("a").alias("model"), "id", "label", (F.col("label") + normal(3)).alias("score")).unionByName(base.select(F.lit("b").alias("model"), "id", "label", (F.col("label") + 2 * normal(5)).alias("score"))).cache()
    got = {r["model"]: r for r in stats.bootstrap(preds, "rmse", "a", ["id"], 60, method=method).collect()}
    assert 0 < got["b"]["diff_lo"] < 1 < got["b"]["diff_hi"] and got["a"]["diff_lo"] == got["a"]["diff_hi"] == 0
    assert got["a"]["ci_lo"] < got["a"]["score"] < got["a"]["ci_hi"]


def test_metrics_equal_numpy(spark):
    r = np.random.default_rng(2)
    y, p = r.integers(0, 2, 500), np.round(r.random(500), 1)
    df = spark.createDataFrame([("m", int(a), float(b)) for a, b in zip(y, p)], "model string, label int, score double")
    value = lambda m: metrics.score(df, m).first()["value"]
    pos, neg = p[y == 1], p[y == 0]
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / len(pos) / len(neg)
    assert abs(value("roc_auc") - auc) < 1e-12
    assert abs(value("accuracy") - ((p >= 0.5) == y).mean()) < 1e-12
    f = [2 * ((p >= 0.5) == k)[y == k].sum() / ((y == k).sum() + ((p >= 0.5) == k).sum()) for k in (0, 1)]
    assert abs(value("f1_macro") - np.mean(f)) < 1e-12
    assert abs(value("rmse") - np.sqrt(((y - p) ** 2).mean())) < 1e-12 and abs(value("mae") - abs(y - p).mean()) < 1e-12
    assert abs(value("r2") - (1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())) < 1e-9
    one = df.where("label = 1")
    assert metrics.score(one, "roc_auc").first()["value"] is None and metrics.score(one, "r2").first()["value"] is None
    assert metrics.score(one, "f1_macro", classes=3).first()["value"] < 1
    with pytest.raises(ValueError):
        metrics.score(df, "nope")


def test_weights_are_repeated_rows(spark):
    df = spark.createDataFrame([("m", i % 2, (i % 7) / 7, 1 + i % 3) for i in range(60)], "model string, label int, score double, weight int")
    many = df.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("weight"))))
    for m in metrics.HIGHER_IS_BETTER:
        a, b = (metrics.score(x, m, weight=w).first()["value"] for x, w in ((df, "weight"), (many, None)))
        assert abs(a - b) < 1e-9, m


def test_selection(spark):
    rows = [("a1", "a", 0.9, 0.01, 0.95, True), ("a2", "a", 0.8, 0.01, 0.8, True), ("b1", "b", 0.9, 0.02, 0.9, True), ("c1", "c", None, None, None, False), ("d1", "d", 0.999, 0.0, 1.0, True)]
    df = spark.createDataFrame(rows, "candidate string, model string, mean double, std double, train_mean double, ok boolean")
    assert [r["candidate"] for r in select.leaderboard(df, "roc_auc").orderBy("place").collect()] == ["d1", "a1", "b1", "a2", "c1"]
    assert [r["candidate"] for r in select.leaderboard(df, "rmse").orderBy("place").collect()] == ["a2", "a1", "b1", "d1", "c1"]
    assert {r["candidate"] for r in select.best_per_family(df, "roc_auc").collect()} == {"a1", "b1", "d1"}
    assert {r["candidate"]: r["overfit_gap"] for r in select.overfit_gap(df, "roc_auc").collect()}["a1"] == 0.05
    assert [r["candidate"] for r in select.flag_suspicious(df, "roc_auc").where("suspicious").collect()] == ["d1"]
    assert [r["candidate"] for r in select.top_finalists(df, "roc_auc").where("is_best").collect()] == ["d1"]
    hidden = spark.createDataFrame([("a1", 0.8)], "model string, score double")
    tests = spark.createDataFrame([("a1", 0.5, True)], "candidate string, p_adjusted double, tie boolean")
    got = {r["candidate"]: r["error"] for r in select.finalist_join(df.where("ok"), tests, hidden).collect()}
    assert got["a1"] is None and got["b1"] == "no confirmation; no hidden score"
