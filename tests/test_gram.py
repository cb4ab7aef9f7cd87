"""Ridge from sums of products against the closed form on each training set's features."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from assay.operators import cv, split
from assay.operators.features import Prep
from assay.operators.models import Spec
from tests.frames import houses


@pytest.mark.parametrize("prep", [Prep(), Prep(numeric_impute="mean", scale=False), Prep(max_categories=3)])
def test_scores_equal_those_of_single_fits(spark, prep):
    df = houses(spark).withColumn("neighborhood", F.when(F.col("id") % 11 > 0, F.col("neighborhood"))).withColumn("constant", F.lit(3))
    df = df.withColumn("rare", F.when(F.col("id") < 7, "x").otherwise(F.concat(F.lit("k"), (F.col("id") % 5).cast("string"))))
    folded = split.assign_folds(df, 3, ["id"])
    specs = [Spec(f"r{a}", "ridge", "regression", "SalePrice", {"alpha": a}, prep, ("id",)) for a in (0.5, 10.0, 1000.0)]
    folds = cv.Folds(folded, specs[0])
    found, status = cv.run_round(folded, [*specs, Spec("bad", "ridge", "regression", "SalePrice", {"depth": 1}, prep, ("id",))])
    found = {tuple(r)[:-1]: r["value"] for r in found.collect()}
    assert len(found) == 3 * 3 * 2 * 3 and {r["candidate"]: r["ok"] for r in status.collect()} == {"r0.5": True, "r10.0": True, "r1000.0": True, "bad": False}
    made = folds.features(specs[0])
    for i, (r, f) in folds.places.items():
        rows = made[i].apply(folds.ready.where(F.col("_own").isin([i, *folds.trains[i]]))).select("_own", "label", vector_to_array("features").alias("a")).collect()
        x, y, test = np.array([t["a"] for t in rows]), np.array([t["label"] for t in rows]), np.array([t["_own"] == i for t in rows])
        mean, level = x[~test].mean(axis=0), y[~test].mean()
        for s in specs:
            xc = x[~test] - mean
            w = np.linalg.solve(xc.T @ xc + s.params["alpha"] * np.eye(x.shape[1]), xc.T @ (y[~test] - level))
            e = y - (x - mean) @ w - level
            for side, own in (("test", test), ("train", ~test)):
                wanted = {"rmse": np.sqrt((e[own] ** 2).mean()), "mae": np.abs(e[own]).mean(), "r2": 1 - (e[own] ** 2).mean() / y[own].var()}
                for metric, value in wanted.items():
                    assert found[s.name, r, f, side, metric] == pytest.approx(value, rel=1e-9), (s.name, f, side, metric)


def test_no_features_and_one_value(spark):
    df = spark.range(30).select("id", F.lit(2.0).alias("y"))
    scores = cv.cross_validate(split.assign_folds(df, 2, ["id"]), Spec("r", "ridge", "regression", "y", drop=("id",)))
    got = {(r["metric"], r["value"]) for r in scores.collect()}
    assert got == {("rmse", 0.0), ("mae", 0.0), ("r2", None)}
