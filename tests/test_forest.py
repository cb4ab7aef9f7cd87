import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from assay.operators import cv, forest
from assay.operators.models import Spec
from tests.frames import churn, houses

PARAMS = {"max_depth": 5, "min_rows": 3, "max_features": 1.0}


def plain(x, y, w, task, depth=0):
    """A tree as nested tuples, by trying every split of every feature."""
    def purity(rows):
        n = w[rows].sum()
        return sum(w[rows & (y == c)].sum() ** 2 for c in np.unique(y)) / n if task == "classification" else (w * y)[rows].sum() ** 2 / n

    every = np.ones(len(y), bool)
    best, found = 1e-9, None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f]).astype(int)
        for a, b in zip(values, values[1:]):
            left = x[:, f] <= a
            if min(w[left].sum(), w[~left].sum()) >= PARAMS["min_rows"] and purity(left) + purity(~left) - purity(every) > best * (1 + 1e-9):
                best, found = purity(left) + purity(~left) - purity(every), (f, (a + b) // 2)
    if depth == PARAMS["max_depth"] or found is None:
        return [w[y == c].sum() / w.sum() for c in range(3)] if task == "classification" else [(w * y).sum() / w.sum()]
    left = x[:, found[0]] <= found[1]
    return (*found, plain(x[left], y[left], w[left], task, depth + 1), plain(x[~left], y[~left], w[~left], task, depth + 1))


def at(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_a_tree_equals_a_plain_one(task):
    rng = np.random.default_rng(3)
    x, w = rng.integers(0, 30, (300, 4)).astype(np.uint8), rng.integers(1, 4, 300).astype(np.uint8)
    y = ((x[:, 0] > 12).astype(np.uint8) + (x[:, 1] + rng.integers(0, 9, 300) > 20)).astype(np.uint8) if task == "classification" else np.round(x[:, 0] / 7 + rng.random(300), 3)
    tree, gains = forest.grow(x, y, w, forest.root_of(0, 1), 0, forest.Params(**PARAMS), task, 3)
    wanted = plain(x, y, w.astype(int), task)
    assert np.allclose(tree.value[tree.leaves(x)], [at(wanted, r) for r in x]) and gains.sum() > 0
    same = forest.Nodes.from_bytes(tree.to_bytes(), tree.value.shape[1])
    assert (same.leaves(x) == tree.leaves(x)).all() and (same.value == tree.value).all()


def rows_of(spark, task):
    df = churn(spark).limit(1500) if task == "classification" else houses(spark).limit(1500).withColumnRenamed("id", "customer_id")
    label = (F.col("Churn") == "Yes").cast("double") if task == "classification" else F.col("SalePrice")
    columns = ["tenure_months", "monthly_charges", "support_tickets"] if task == "classification" else ["sqft", "age_years", "bedrooms"]
    return VectorAssembler(inputCols=columns, outputCol="features").transform(df.withColumn("label", label)).select("customer_id", "features", "label").cache()


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_a_forest_depends_neither_on_parts_nor_on_passes(spark, task, monkeypatch, tmp_path):
    rows = rows_of(spark, task)
    fit = lambda df: forest.Forest(task, 2, forest.Params(6, 12, 2, "sqrt", 5), 1000.0).fit(df)
    out = "probs" if task == "classification" else "prediction"
    values = lambda m: np.array([r[0] for r in m.transform(rows).orderBy("customer_id").select(out).collect()])
    first = fit(rows)
    wanted = values(first)
    assert np.allclose(values(fit(rows.repartition(7))), wanted, rtol=1e-9)
    monkeypatch.setattr(forest, "LOCAL", 60)  # the upper nodes by passes over the table
    monkeypatch.setattr(forest, "STEP_BYTES", 1 << 16)
    monkeypatch.setattr(forest, "WAVE_BYTES", 5000)  # a tree at a time
    passes = fit(rows)
    assert len(passes.tops) == 6 and len(passes._waves()) > 2
    assert np.allclose(values(passes), wanted, rtol=1e-9) and np.allclose(passes.importances, first.importances)
    passes.save(str(tmp_path))
    assert np.allclose(values(forest.Grown.load(spark, str(tmp_path))), wanted, rtol=1e-9)
    label = np.array([r[0] for r in rows.orderBy("customer_id").select("label").collect()])
    assert np.corrcoef(wanted[:, 1] if task == "classification" else wanted, label)[0, 1] > 0.7


def test_a_large_node_that_nothing_splits_is_a_leaf(spark, monkeypatch):
    monkeypatch.setattr(forest, "LOCAL", 60)
    rows = VectorAssembler(inputCols=["c"], outputCol="features").transform(spark.range(1000).select(F.lit(1.0).alias("c"), (F.col("id") % 4 == 0).cast("double").alias("label")))
    model = forest.Forest("classification", 2, forest.Params(20)).fit(rows)
    assert model.parts.count() == 0 and abs(model.transform(rows).first()["probs"][1] - 0.25) < 0.03


def test_equal_rows_are_drawn_each_by_itself():
    h = forest.told_apart(np.full(20000, 7, np.uint64))
    w = forest.weights(h, 3, 42)
    assert len(np.unique(h)) == 20000 and abs(w.mean() - 1) < 0.03 and abs((w == 0).mean() - np.exp(-1)) < 0.02


def test_forests_of_folds_and_the_last_one(spark, tmp_path):
    spec = Spec("f", "random_forest", "classification", "Churn", {"n_estimators": 5, "max_depth": None, "max_features": 0.5}, drop=("customer_id", "refund_issued"))
    top = cv.fit_final(churn(spark).limit(500), spec, str(tmp_path))
    model, record = cv.load_final(spark, str(tmp_path))
    assert model.trees == 5 and record["kind"] == "Grown" and 0 < top.agg(F.sum("importance")).first()[0] <= 1 + 1e-9
    with pytest.raises(ValueError):
        forest.Forest("regression", 0, forest.Params(max_features="some"))
