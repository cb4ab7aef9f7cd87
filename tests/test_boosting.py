"""Boosting against a plain version that works on whole arrays, one split at a time."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from assay.operators import boosting, cv, metrics, split
from assay.operators.boosting import Boosting, Params
from assay.operators.models import Spec
from tests.frames import churn, houses


def table(spark, n=600, classes=0, seed=3):
    r = np.random.default_rng(seed)
    x = np.c_[r.integers(0, 30, n), r.integers(0, 7, n), np.round(r.normal(size=n), 1), r.integers(0, 2, n)].astype(float)
    raw = x[:, 0] / 10 + (x[:, 1] > 3) * 2 - x[:, 2] + r.normal(size=n)
    y = np.digitize(raw, np.quantile(raw, np.arange(1, classes) / classes)).astype(float) if classes else raw
    df = spark.createDataFrame([(i, Vectors.dense(v), float(t)) for i, (v, t) in enumerate(zip(x, y))], ["id", "features", "label"]).repartition(5)
    return df, x, y


def plain(x, y, task, k, p, l2):
    """Scores of the rows after all rounds: each round's gradients, then the best split of all leaves again and again."""
    codes = [np.unique(c) for c in x.T]
    z = np.stack([np.searchsorted(c, v) for c, v in zip(codes, x.T)], 1)
    n = len(y)
    if task == "regression":
        scores = np.full((1, n), y.mean())
    elif k == 1:
        scores = np.full((1, n), np.log(y.mean() / (1 - y.mean())))
    else:
        scores = np.repeat(np.log([[(y == c).mean()] for c in range(k)]), n, axis=1)
    losses = []
    for _ in range(p.n_estimators):
        if task == "regression":
            gs, hs = scores - y, np.ones_like(scores)
        elif k == 1:
            q = 1 / (1 + np.exp(-scores))
            gs, hs = q - y, q * (1 - q)
        else:
            q = np.exp(scores) / np.exp(scores).sum(0)
            gs, hs = q - (y == np.arange(k)[:, None]), k / (k - 1) * q * (1 - q)
        step = np.zeros_like(scores)
        for c in range(k):
            g, h = gs[c], hs[c]
            leaves = [(np.arange(n), 0)]

            def best(rows):
                out = (1e-9, 0, 0)
                for f in range(z.shape[1]):
                    for b in np.unique(z[rows, f])[:-1]:
                        left = rows[z[rows, f] <= b]
                        right = rows[z[rows, f] > b]
                        if min(len(left), len(right)) < max(1, p.min_rows) or min(h[left].sum(), h[right].sum()) < p.min_hessian:
                            continue
                        gain = sum(g[s].sum() ** 2 / (h[s].sum() + l2) for s in (left, right)) - g[rows].sum() ** 2 / (h[rows].sum() + l2)
                        if gain > out[0] * (1 + 1e-9):
                            out = (gain, f, b)
                return out

            done = []
            while leaves and (p.num_leaves is None or len(leaves) + len(done) < p.num_leaves):
                found = [(best(rows) if p.max_depth is None or d < p.max_depth else (1e-9, 0, 0)) for rows, d in leaves]
                i = int(np.argmax([f[0] for f in found]))
                gain, f, b = found[i]
                if gain <= 1e-9:
                    break
                rows, d = leaves.pop(i)
                leaves += [(rows[z[rows, f] <= b], d + 1), (rows[z[rows, f] > b], d + 1)]
            for rows, _ in leaves + done:
                step[c, rows] = -g[rows].sum() / (h[rows].sum() + l2) * p.learning_rate
        scores = scores + step
        if k > 1:
            q = np.exp(scores) / np.exp(scores).sum(0)
            losses.append(-np.log(q[y.astype(int), np.arange(n)]).mean())
    return scores, losses


CASES = [
    ("regression", 0, Params(n_estimators=4, learning_rate=0.3, num_leaves=8, min_rows=15, min_hessian=1e-3, reg_lambda=0.0)),
    ("regression", 0, Params(n_estimators=12, learning_rate=0.3, max_depth=2, min_hessian=3.0, reg_lambda=5.0)),
    ("classification", 2, Params(n_estimators=4, learning_rate=0.2, num_leaves=6, min_rows=20, min_hessian=1e-3, reg_lambda=2.0)),
    ("classification", 2, Params(n_estimators=3, learning_rate=0.3, max_depth=3, min_hessian=1.0, reg_lambda=1.0)),
    ("classification", 3, Params(n_estimators=4, learning_rate=0.3, num_leaves=5, min_rows=10, reg_lambda=1.0)),
]


@pytest.mark.parametrize("task,classes,p", CASES)
def test_equals_the_plain_version(spark, task, classes, p):
    df, x, y = table(spark, 400, classes)
    model = Boosting(task, classes, p).fit(df)
    k = classes if classes > 2 else 1
    wanted, losses = plain(x, y, task, k, p, p.reg_lambda)
    assert np.allclose(model.raw(x), wanted, rtol=1e-6, atol=1e-8)
    if k > 1:
        assert losses == sorted(losses, reverse=True)
        probs = model.outputs(x)
        assert np.allclose(probs.sum(axis=1), 1) and probs.shape == (len(x), k)
    if p.num_leaves:
        assert max(sum(f < 0 for f in t.feature) for trees in model.rounds for t in trees) == p.num_leaves
    again = boosting.Booster.from_json(model.to_json())
    rows = again.transform(df).orderBy("id").collect()
    got = np.array([r["prediction"] for r in rows]) if task == "regression" else np.array([r["probs"] for r in rows])
    assert np.allclose(got, model.outputs(x)[:, 0] if task == "regression" else model.outputs(x))
    assert abs(model.importances.sum() - 1) < 1e-9 and model.importances[3] < model.importances[0]


def test_sets_side_by_side_and_partitioning_change_nothing(spark, monkeypatch):
    a, x, _ = table(spark, 300, 3, 5)
    b, _, _ = table(spark, 200, 3, 6)
    p = Params(n_estimators=3, num_leaves=4, min_rows=5, subsample=0.7, every=1, columns=0.5)
    both = Boosting("classification", 3, p).fit_sets({1: a, 2: b})
    monkeypatch.setattr(boosting.blocks, "TASK_ROWS", 40)
    alone = Boosting("classification", 3, p).fit(a.repartition(3))
    assert np.allclose(both[1].raw(x), alone.raw(x))
    full = Boosting("classification", 3, Params(n_estimators=3, num_leaves=4, min_rows=5)).fit(a)
    assert not np.allclose(full.raw(x), alone.raw(x))


def test_scores_that_are_written_and_read_again(spark, monkeypatch):
    df, x, _ = table(spark, 200)
    p = Params(n_estimators=5, num_leaves=4, min_rows=5)
    wanted = Boosting("regression", 0, p).fit(df).raw(x)
    monkeypatch.setattr(boosting, "_REFRESH", 2)
    assert np.allclose(Boosting("regression", 0, p).fit(df).raw(x), wanted)


def test_constant_features_and_labels(spark):
    df = spark.createDataFrame([(Vectors.dense([1.0]), 2.0)] * 5, ["features", "label"])
    model = Boosting("regression", 0, Params(n_estimators=3)).fit(df)
    assert model.outputs(np.array([[7.0]])).tolist() == [[2.0]]
    assert model.transform(df.limit(0)).count() == 0 and [r["prediction"] for r in model.transform(df).collect()] == [2.0] * 5


def test_on_the_given_frames(spark):
    spec = Spec("g", "gbt_leaf", "classification", "Churn", {"n_estimators": 10, "num_leaves": 8}, drop=("customer_id", "refund_issued"))
    scores = cv.cross_validate(split.assign_folds(churn(spark), 2, ["customer_id"], 1, "Churn"), spec)
    auc = cv.cv_summary(scores).where("metric = 'roc_auc'").first()
    assert 0.6 < auc["mean"] < 0.95 and auc["n_folds"] == 2
    spec = Spec("d", "gbt_depth", "regression", "SalePrice", {"n_estimators": 20, "max_depth": 3}, drop=("id",))
    preds = cv.predict_holdout(houses(spark), houses(spark), spec, ["id"])
    assert metrics.score(preds, "r2", ("model",)).first()["value"] > 0.9
