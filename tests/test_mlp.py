"""The perceptron against finite differences and a plain loop over whole arrays."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from assay.operators import blocks, cv, metrics, mlp
from assay.operators.mlp import Params, Perceptron
from assay.operators.models import Spec
from tests.frames import houses


def table(spark, n=500, classes=2, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 4))
    raw = x[:, 0] - 2 * np.abs(x[:, 1]) + 0.3 * r.normal(size=n)
    y = np.digitize(raw, np.quantile(raw, np.arange(1, classes) / classes)).astype(float) if classes else 1000 + 50 * raw
    return spark.createDataFrame([(Vectors.dense(v), float(t)) for v, t in zip(x, y)], ["features", "label"]).repartition(4), x, y


@pytest.mark.parametrize("task,outs", [("regression", 1), ("classification", 1), ("classification", 3)])
def test_gradient_equals_finite_differences(task, outs):
    r = np.random.default_rng(2)
    x, sizes = r.normal(size=(20, 3)), [3, 5, 4, outs]
    y = r.normal(size=20) if task == "regression" else r.integers(0, max(2, outs), 20).astype(float)
    w = mlp.start(sizes, 7)
    loss = lambda v: mlp.loss_sum(mlp.forward(mlp.unpack(v, sizes), x)[-1], y, task)
    step = np.eye(len(w)) * 1e-6
    wanted = np.array([(loss(w + d) - loss(w - d)) / 2e-6 for d in step])
    assert np.allclose(mlp.gradient_sum(w, sizes, x, y, task), wanted, rtol=1e-4, atol=1e-6)


def plain(rows, sizes, p, batches, task, epochs):
    """Adam over the same mini-batches."""
    x, y, u = rows
    w = mlp.start(sizes, p.seed)
    m, v, t = np.zeros_like(w), np.zeros_like(w), 0
    part, rng = (u * batches).astype(int), np.random.default_rng(p.seed)
    for _ in range(epochs):
        for b in [b for b in rng.permutation(mlp.MOST_BATCHES) if b < batches]:
            own = part == b
            decay = np.concatenate([np.concatenate([a.ravel(), 0 * c]) for a, c in mlp.unpack(w, sizes)])
            g = (mlp.gradient_sum(w, sizes, x[own], y[own], task) + p.alpha * decay) / own.sum()
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - p.learning_rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8 / np.sqrt(1 - 0.999**t))
    return w


@pytest.mark.parametrize("classes", [0, 2, 3])
def test_equals_the_plain_version(spark, classes, monkeypatch):
    df, _, _ = table(spark, 500, classes)
    task = "classification" if classes else "regression"
    p = Params(hidden=(6, 3), max_iter=3, alpha=0.5, learning_rate=0.01, early_stopping=False)
    rows = blocks.arrays(df).collect()
    x, y = np.array([r["a"] for r in rows]), np.array([r["y"] for r in rows])
    u = (np.array([r["h"] for r in rows]).view(np.uint64) >> np.uint64(11)) / 2.0**53
    y = y if classes else (y - y.mean()) / y.std()
    net = Perceptron(task, classes, p).fit(df)
    sizes = [4, 6, 3, 3 if classes == 3 else 1]
    assert net.sizes == sizes and np.allclose(net.w, plain((x, y, u), sizes, p, 2, task, 3), atol=1e-9)
    monkeypatch.setattr(blocks, "TASK_ROWS", 60)
    other = Perceptron(task, classes, p).fit_sets({0: df.limit(50), 1: df.repartition(3)})[1]
    assert np.allclose(net.w, other.w)
    again = mlp.Network.from_json(net.to_json()).transform(df).collect()
    if classes:
        assert all(abs(sum(r["probs"]) - 1) < 1e-9 for r in again)


def test_all_parameters_act(spark):
    df, x, y = table(spark, 600, 2)
    fit = lambda **kw: Perceptron("classification", 2, Params(hidden=(8,), **kw)).fit(df)
    size = lambda net: np.abs(mlp.penalty(net.w, net.sizes)).sum()
    base = fit(max_iter=6, learning_rate=0.02, early_stopping=False)
    assert size(fit(max_iter=6, learning_rate=0.02, alpha=50.0, early_stopping=False)) < 0.9 * size(base)
    assert not np.allclose(base.w, fit(max_iter=6, learning_rate=0.002, early_stopping=False).w)
    stopped = fit(max_iter=60, learning_rate=0.05)
    n = len(stopped.scores)
    best = int(np.argmax(stopped.scores))
    assert n < 60 and max(stopped.scores[:-10]) + mlp.TOLERANCE >= max(stopped.scores[-10:]) and best >= 1
    assert (stopped.outputs(x).argmax(1) == y).mean() > 0.85


def test_regression_of_houses(spark):
    spec = Spec("m", "mlp", "regression", "SalePrice", {"hidden_layer_sizes": [16], "max_iter": 25, "learning_rate_init": 0.02}, drop=("id",))
    preds = cv.predict_holdout(houses(spark), houses(spark), spec, ["id"])
    assert metrics.score(preds, "r2", ("model",)).first()["value"] > 0.85


def test_a_step_reads_its_mini_batch_only(spark, monkeypatch):
    monkeypatch.setattr(mlp, "PIECE_ROWS", 40)
    df, _, _ = table(spark, 1000)
    sets = {s: blocks.arrays(df.where(F.col("label") >= s - 1)) for s in (0, 1)}
    states = {s: mlp.State(np.zeros(1), 4) for s in sets}
    written, rows, pieces = Perceptron("classification", 2, Params())._table(sets, states, {0: (0.0, 1.0), 1: (0.0, 1.0)}, 0.1, 2000)
    held = rows.map(lambda b: (b[0], b[1], len(b[3]))).glom().collect()
    assert pieces == 13 and all(part == i // pieces - 1 for i, own in enumerate(held) for _, part, _ in own)
    assert sum(n for own in held for _, _, n in own) == written.agg(F.sum("n")).first()[0] == 2000
