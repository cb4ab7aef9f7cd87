import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.operators import cv, features, models, split
from assay.operators.features import Prep
from assay.operators.models import Spec
from assay.plans import compare
from assay.queries import QUERIES
from assay.streaming.events import replay
from tests.frames import churn, houses


def matrix(df, columns):
    rows = df.orderBy("id").select(*columns).collect()
    return np.array([[float(v) for v in r] for r in rows])


def test_ridge_equals_the_closed_form(spark):
    df = houses(spark).select("id", "sqft", "age_years", "SalePrice").cache()
    spec = Spec("r", "ridge", "regression", "SalePrice", {"alpha": 50.0}, drop=("id",))
    got = cv.predict_holdout(df, df, spec, ["id"]).orderBy("id").collect()
    x = matrix(df, ["sqft", "age_years"])
    y = matrix(df, ["SalePrice"])[:, 0]
    x = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(x.T @ x + 50.0 * np.eye(2), x.T @ (y - y.mean()))
    assert np.allclose([r["score"] for r in got], x @ w + y.mean(), rtol=1e-6)


def test_logreg_is_the_penalized_maximum(spark):
    df = churn(spark).select(F.col("customer_id").alias("id"), "tenure_months", "support_tickets", "Churn").cache()
    spec = Spec("l", "logreg", "classification", "Churn", {"C": 0.5}, drop=("id",))
    got = cv.predict_holdout(df, df, spec, ["id"]).orderBy("id").collect()
    x = matrix(df, ["tenure_months", "support_tickets"])
    y = np.array([r["label"] for r in got])
    x = np.c_[(x - x.mean(0)) / x.std(0), np.ones(len(x))]
    w = np.zeros(3)
    penalty = np.diag([2.0, 2.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (p - y) + penalty @ w)
    assert np.allclose([r["score"] for r in got], 1 / (1 + np.exp(-x @ w)), atol=2e-5)


def test_cross_validation_of_churn(spark):
    parted = split.split_holdout(churn(spark), "Churn", "classification", ["customer_id"]).cache()
    dev, hidden = (parted.where(F.col("split") == s).drop("split") for s in ("dev", "hidden"))
    spec = Spec("lr", "logreg", "classification", "Churn", {"max_iter": 50}, drop=("customer_id", "refund_issued"))
    scores = cv.cross_validate(split.assign_folds(dev, 2, ["customer_id"], 1, "Churn"), spec)
    auc = cv.cv_summary(scores).where("metric = 'roc_auc'").first()
    assert auc["n_folds"] == 2 and 0.6 < auc["mean"] < 0.95 and len(auc["folds"]) == 2
    preds = cv.predict_holdout(dev, hidden, spec, ["customer_id"])
    assert preds.count() == 600
    _, status = cv.run_round(split.assign_folds(dev, 2, ["customer_id"]), [Spec("x", "nope", "classification", "Churn")])
    bad = status.first()
    assert not bad["ok"] and "not on the classification menu" in bad["error"]


def test_fold_statistics_do_not_see_test_rows(spark):
    df = houses(spark).withColumn("fold", (F.col("id") % 3).cast("int")).withColumn("repeat", F.lit(0))
    lied = df.withColumn("lot_size", F.when(F.col("fold") == 1, F.col("lot_size") * 1000).otherwise(F.col("lot_size"))).withColumn("neighborhood", F.when(F.col("fold") == 1, "elsewhere").otherwise(F.col("neighborhood")))
    for make in (lambda d: features.numeric_stats(d, ["lot_size", "sqft"], "fold"), lambda d: features.category_counts(d, ["neighborhood"], "fold")):
        a, b = (sorted(map(repr, make(d).where("fold = 1").collect())) for d in (df, lied))
        assert a == b


def test_categories(spark):
    df = spark.createDataFrame([(f"v{min(i % 40, 29)}", i // 40 % 2) for i in range(400)] + [(None, 0)], "c string, fold int")
    counts = features.category_counts(df, ["c"], "fold")
    hot = features.onehot_categories(counts, 20).where("fold = 0").collect()
    assert len({r["output"] for r in hot}) == 20 and sum(r["output"] == features.INFREQUENT for r in hot) == len(hot) - 19
    assert features.impute_mode(counts).where("fold = 0").first()["mode"] == "v29"
    codes = features.ordinal_codes(counts).where("fold = 0").orderBy("code").collect()
    assert [r["value"] for r in codes] == sorted(r["value"] for r in codes)


def test_ordinal_features_and_unseen_values(spark):
    train = spark.createDataFrame([("b", 1.0), ("a", 0.0), ("c", 1.0), (None, 1.0)], "c string, label double")
    spec = Spec("o", "random_forest", "classification", "y", prep=Prep(categorical="ordinal"))
    made = cv.learn(train.withColumn("part", F.lit(0)), spec, ("label",), "part", {0: [0]})[0]
    new = spark.createDataFrame([("c", 0.0), ("zz", 0.0), (None, 0.0)], "c string, label double")
    assert sorted(r["features"][0] for r in made.apply(new).collect()) == [-1.0, 0.0, 2.0]


def test_bad_arguments():
    with pytest.raises(ValueError):
        Prep(categorical="hashing")
    with pytest.raises(ValueError):
        models.build_estimator(Spec("x", "ridge", "regression", "y", {"depth": 3}), 1, 0, 1)
    with pytest.raises(ValueError):
        compare.check_round([Spec(str(i), "ridge", "regression", "y") for i in range(9)], [], 2)
    named = compare.check_round([Spec("a", "ridge", "regression", "y"), Spec("a", "ridge", "regression", "y"), Spec("a", "ridge", "regression", "y")], ["a"], 2)
    assert [s.name for s in named] == ["a_r2", "a_r2_2", "a_r2_3"]
    assert len(models.portfolio("classification", "y")) == 15 and len(models.portfolio("regression", "y")) == 15


def test_compare_models(spark, tmp_path):
    found = compare.compare_models(churn(spark), "Churn", ["customer_id"], specs=compare.small_portfolio, folds=2, confirm_folds=2, confirm_repeats=1, n_boot=20, model_path=str(tmp_path / "m"), log_path=str(tmp_path / "log"))
    assert found.task == "classification" and set(found.dropped) == {"customer_id", "refund_issued"}
    table = found.finalists.collect()
    tie = {r["candidate"] for r in table if r["tie"]}
    assert found.recommended in tie and all(r["score"] is not None for r in table) and sum(r["recommended"] for r in table) == 1
    assert found.summary.first()["n_hidden"] == 600 and all(r["predict_ms_per_1k"] > 0 and r["fit_seconds"] > 0 for r in table)
    kinds = [r["kind"] for r in replay(spark, str(tmp_path / "log")).collect()]
    assert kinds == ["run_start", "round_start", "leaderboard", "confirm", "hidden_test", "final_model", "report", "run_end"]
    assert found.top_features.count() > 0 and cv.load_final(spark, str(tmp_path / "m"))[1]["name"] == found.recommended


def test_save_and_load(spark, tmp_path):
    df = houses(spark).select("id", "sqft", "neighborhood", "SalePrice")
    spec = Spec("r", "ridge", "regression", "SalePrice", drop=("id",))
    top = cv.fit_final(df, spec, str(tmp_path)).collect()
    model, record = cv.load_final(spark, str(tmp_path))
    assert top[0]["name"] == "sqft__num" and record["params"] == {} and len(model.stages[0].coefficients) == len(record["features"]) == 6


def test_folds_in_time_train_on_the_past_only(spark):
    df = spark.range(103).select("id", F.expr("timestamp_ntz '2024-01-01' + make_dt_interval(cast(id as int))").alias("t"), F.col("id").cast("double").alias("x"), (2.0 * F.col("id")).alias("y"))
    spec = Spec("r", "ridge", "regression", "y", drop=("id", "t"))
    folds = cv.Folds(split.assign_folds(df, 4, ["id"], time_col="t"), spec, in_time=True)
    for i, (_, f) in folds.places.items():
        train = folds.ready.where(F.col("_own").isin(folds.trains[i])).agg(F.max("x"), F.count("*")).first()
        test = folds.ready.where(F.col("_own") == i).agg(F.min("x"), F.count("*")).first()
        assert train[0] < test[0] and train[1] == 23 + 20 * f == folds.facts[i].n and test[1] == 20
        assert {x["mean"] for x in folds.features(spec)[i].numbers.values()} == {(22 + 20 * f) / 2}
    assert "pos" not in folds.ready.columns


def test_later_rounds_see_earlier_results(spark):
    def second(results, task, target, drop):
        best = results.where("ok").orderBy("mean").first()
        return [Spec(best["candidate"], "ridge", task, target, {"alpha": 30.0}, drop=drop)]

    first = lambda task, target, drop: [Spec("r", "ridge", task, target, drop=drop), Spec("bad", "logreg", task, target, drop=drop)]
    found = compare.compare_models(houses(spark).limit(400), "SalePrice", ["id"], specs=first, later=[second], folds=2, confirm_repeats=1, n_boot=20)
    rows = {r["candidate"]: r for r in found.results.collect()}
    assert set(rows) == {"r", "bad", "r_r2"} and not rows["bad"]["ok"] and rows["r_r2"]["ok"]
    assert found.recommended in ("r", "r_r2") and [r["kind"] for r in found.events.orderBy("ts").collect()].count("round_start") == 2


def test_holdout_is_prepared_once(spark, monkeypatch):
    calls, prepare = [], cv.prepare
    monkeypatch.setattr(cv, "prepare", lambda *a: calls.append(1) or prepare(*a))
    parted = split.split_holdout(churn(spark).limit(600), "Churn", "classification", ["customer_id"])
    dev, hidden = (parted.where(F.col("split") == s).drop("split") for s in ("dev", "hidden"))
    specs = [Spec(str(i), "logreg", "classification", "Churn", {"max_iter": i}, drop=("customer_id",)) for i in (3, 9)]
    both = cv.Holdout(dev, hidden, specs[0], ["customer_id"])
    found = [sorted(both.predict(s).collect()) for s in specs]
    assert len(calls) == 2 and found[0] != found[1]
    assert found == [sorted(cv.predict_holdout(dev, hidden, s, ["customer_id"]).collect()) for s in specs]


def test_smoke_round_is_the_whole_menu_with_defaults_on_three_folds(spark, sf_dir, monkeypatch):
    seen = []

    def stopped(df, specs):
        seen.append(({r["fold"] for r in df.select("fold").distinct().collect()}, df.count(), specs))
        raise InterruptedError

    monkeypatch.setattr(cv, "run_round", stopped)
    with pytest.raises(InterruptedError):
        QUERIES["smoke_round"](spark, sf_dir)
    (folds, rows, specs), = seen
    assert folds == {0, 1, 2} and rows == spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    assert {s.model: s.params for s in specs} == {m: {} for m in models.MENU["classification"]}
