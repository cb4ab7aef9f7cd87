import pytest
from pyspark.sql import functions as F

from assay.operators import cv, split
from assay.operators.models import Spec
from assay.plans import compare
from assay.store import Store, fingerprint
from tests.frames import houses


def test_fingerprint_is_of_rows_not_of_their_order(spark):
    df = spark.range(50).select("id", (F.col("id") % 7).alias("x"), F.create_map(F.lit("k"), F.col("id")).alias("m"))
    same = [df.repartition(5), df.orderBy(F.desc("id")), df.select("x", "m", "id")]
    assert {fingerprint(d) for d in same} == {fingerprint(df)}
    other = [df.where("id > 0"), df.withColumn("x", F.col("x") + 1), df.union(df.where("id < 2")), df.withColumnRenamed("x", "y"), df.withColumn("x", F.when(F.col("id") > 3, F.col("x")))]
    assert len({fingerprint(d) for d in [df, *other]}) == 6


def test_a_run_that_died_fits_only_what_is_absent(spark, tmp_path, monkeypatch):
    df = houses(spark).limit(300)
    specs = lambda task, target, drop: [Spec("r", "ridge", task, target, drop=drop), Spec("f", "random_forest", task, target, {"n_estimators": 3, "max_depth": 3}, drop=drop)]
    run = lambda: compare.compare_models(df, "SalePrice", ["id"], specs=specs, folds=2, confirm_repeats=1, n_boot=20, store_path=str(tmp_path))
    whole, fits = cv.predict_holdout, []
    monkeypatch.setattr(cv, "predict_holdout", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        run()
    monkeypatch.setattr(cv, "predict_holdout", whole)
    one, many = cv._fit, cv.Folds.ridge_scores
    monkeypatch.setattr(cv, "_fit", lambda train, spec, *a: (fits.append(spec.name), one(train, spec, *a))[1])
    monkeypatch.setattr(cv.Folds, "ridge_scores", lambda self, specs: (fits.append("folds"), many(self, specs))[1])
    first = run()
    assert sorted(fits[:2]) == ["f", "r"] and len(fits) == 3  # two on the hidden rows' behalf, and the winner on all
    fits.clear()
    second = run()
    assert fits == [second.recommended]
    shown = lambda c: sorted(map(repr, c.finalists.select("candidate", "mean", "std", "score", "ci_lo", "diff_hi", "fit_seconds", "predict_ms_per_1k").collect()))
    assert shown(first) == shown(second)


def test_other_rows_or_parameters_are_fitted(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    folded = split.assign_folds(houses(spark).limit(200), 2, ["id"])
    spec = lambda a, name="r": Spec(name, "ridge", "regression", "SalePrice", {"alpha": a}, drop=("id",))
    value = lambda df, s: sorted(map(repr, cv.run_round(df, [s], store=store)[0].drop("candidate").collect()))
    a = value(folded, spec(1.0))
    assert value(folded, spec(1.0, "other name")) == a != value(folded, spec(99.0))
    assert value(folded.where("id > 5"), spec(1.0)) != a
