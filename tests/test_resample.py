"""Resamples as sums of weighted rows, against a row for each resample."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assay.operators import metrics, resample


def frame(spark, kind, n=300):
    r = np.random.default_rng(8)
    if kind == "values":
        rows = [(m, i, float(y), float(y + r.normal() * k)) for k, m in ((1, "a"), (2, "b")) for i, y in enumerate(np.random.default_rng(1).normal(size=n))]
        return spark.createDataFrame(rows, ["model", "id", "label", "score"]).repartition(3)
    if kind == "binary":
        rows = [(m, i, int(i % 3 == 0), round(float(r.random() * 0.7 + 0.3 * (i % 3 == 0)), 2)) for m in "ab" for i in range(n)]
        return spark.createDataFrame(rows, "model string, id long, label int, score double").repartition(3)
    rows = [(m, i, i % 3, [float(x) for x in np.round(r.dirichlet(1 + 3 * (np.arange(3) == i % 3)), 2)]) for m in "ab" for i in range(n)]
    return spark.createDataFrame(rows, "model string, id long, label int, probs array<double>").repartition(3)


CASES = [("values", "rmse"), ("values", "mae"), ("values", "r2"), ("binary", "accuracy"), ("binary", "f1_macro"), ("binary", "roc_auc"), ("classes", "accuracy"), ("classes", "f1_macro"), ("classes", "roc_auc")]


@pytest.mark.parametrize("kind,metric", CASES)
def test_scores_equal_those_of_weighted_rows(spark, kind, metric, monkeypatch):
    monkeypatch.setattr(resample, "_ROWS", 64)
    monkeypatch.setattr(resample, "_CHUNK", 4)
    preds, k = frame(spark, kind), 3 if kind == "classes" else 2
    w = resample.poisson_weights([f"|{i}" for i in range(300)], 6, 5)
    rows = spark.createDataFrame([(rep, i, int(w[i, rep])) for rep in range(6) for i in range(300) if w[i, rep]], "rep int, id long, weight int")
    wanted = {(r["rep"], r["model"]): r["value"] for r in metrics.score(preds.join(rows, "id"), metric, ("rep", "model"), "weight", k).collect()}
    found = {(r["rep"], r["model"]): r["value"] for r in resample.poisson_scores(preds, metric, ["id"], 6, 5, k, bins=3000).collect()}
    assert found.keys() == wanted.keys() and len(found) == 12
    assert all(found[x] == pytest.approx(wanted[x], rel=1e-9) for x in found)


def test_poisson_numbers():
    w = resample.poisson_weights([f"|{i}" for i in range(2000)], 10, 0)
    assert abs(w.mean() - 1) < 0.03 and abs(w.var() - 1) < 0.06
    assert np.array_equal(w[:, :3], resample.poisson_weights([f"|{i}" for i in range(2000)], 3, 0))


@pytest.mark.parametrize("rows", [1, 1024, 1025, 5000])
def test_draws_add_to_the_rows(rows):
    buckets = -(-rows // resample.BUCKET)
    w = np.concatenate([resample.bucket_weights(b, rows, 50, 3) for b in range(buckets)])
    assert w.shape == (rows, 50) and (w.sum(axis=0) == rows).all() and (w >= 0).all()
    if rows >= 1024:
        assert abs(w.var() - (1 - 1 / rows)) < 0.05
        assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.15


def test_draws_of_several_buckets_are_as_multinomial_ones():
    """A bucket's total over resamples has the mean and variance of a binomial."""
    draws = resample.bucket_draws(2, 4000, 4000, 1)
    p = 1024 / 4000
    assert abs(draws.mean() - 1024) < 2 and abs(draws.var() / (4000 * p * (1 - p)) - 1) < 0.1


def test_multinomial_scores(spark):
    preds = frame(spark, "values")
    scores = lambda df: {(r["rep"], r["model"]): r["value"] for r in resample.multinomial_scores(df, "rmse", ["id"], 30, width=64).collect()}
    a, b = scores(preds), scores(preds.repartition(7, "score"))
    assert a.keys() == b.keys() and len(a) == 60 and all(a[k] == pytest.approx(b[k]) for k in a)
    own = [v for (_, m), v in a.items() if m == "a"]
    whole = metrics.score(preds, "rmse").where("model = 'a'").first()["value"]
    assert abs(np.mean(own) - whole) < 0.05 and 0.02 < np.std(own) < 0.08


def test_one_class_has_no_auc(spark):
    preds = frame(spark, "binary").withColumn("label", F.lit(1))
    assert {r["value"] for r in resample.poisson_scores(preds, "roc_auc", ["id"], 3).collect()} == {None}


def test_digests_equal_hashlib():
    keys = [b"|", "|é".encode(), *[b"|" + b"x" * n + str(n).encode() for n in (1, 5, 6, 44, 48, 49, 51, 60, 200)]]
    heads = [f"3|{b}".encode() for b in range(120)]
    wanted = np.array([[np.frombuffer(hashlib.md5(h + k).digest(), ">u4") for h in heads] for k in keys])
    assert np.array_equal(resample.digests(heads, keys), wanted)


def test_weights_are_drawn_once_for_a_key(monkeypatch):
    asked, drawn = [], resample.poisson_weights
    monkeypatch.setattr(resample, "poisson_weights", lambda keys, *more: asked.extend(keys) or drawn(keys, *more))
    w = resample.key_weights(10, 4)(pa.RecordBatch.from_pydict({"key": ["|b", "|a", "|b", "|b"]}))
    assert asked == ["|b", "|a"] and np.array_equal(w, drawn(["|b", "|a", "|b", "|b"], 10, 4))


def test_models_of_a_key_share_a_task(spark, monkeypatch):
    monkeypatch.setattr(resample, "TASK_ROWS", 100)
    found = []
    monkeypatch.setattr(resample, "_scored", lambda rows, *_: found.append(rows))
    rows = [(m, i, float(i % 2), (i * 7 % 100) / 100) for m in ("a", "b") for i in range(200)]
    resample.poisson_scores(spark.createDataFrame(rows, "model string, id long, label double, score double").repartition(4), "rmse", ["id"], 5)
    parts = [[r["key"] for r in part] for part in found[0].rdd.glom().collect()]
    assert sum(map(len, parts)) == 400 and sum(len(set(p)) for p in parts) == 200 and len([p for p in parts if p]) > 1
