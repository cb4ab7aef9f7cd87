"""Ridge for all folds and penalties from two passes over the rows.

The features of any training set, with its own fills, means, deviations and leading categories, are
linear in one base that all sets share: numbers less a constant, indicators of missing values and of
categories. So one aggregate gives the base's sums of products by fold, a training set's are sums of
those, and each set and penalty is solved from a small system on the driver. The second pass scores
all of them at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.operators.features import INFREQUENT

_SCORED = "fold int, model int, test boolean, n long, e2 double, ae double, y double, y2 double"


@dataclass
class Base:
    """The shared base: number columns with the constant taken off, and text columns with their categories."""

    numbers: dict[str, float]
    texts: dict[str, list[str]]

    def columns(self) -> list[Column]:
        out = []
        for c, shift in self.numbers.items():
            x = F.col(f"`{c}`").cast("double")
            out += [F.coalesce(x - F.lit(shift), F.lit(0.0)), x.isNull().cast("double")]
        for c, values in self.texts.items():
            v = F.col(f"`{c}`")
            out += [*[F.coalesce((v == F.lit(k)).cast("double"), F.lit(0.0)) for k in values], v.isNull().cast("double")]
        return out

    def maps(self, made) -> np.ndarray:
        """Weights (features x base) of a training set's features; their constants go with the means."""
        at, width = {}, 0
        for c in self.numbers:
            at[c], width = width, width + 2
        for c, values in self.texts.items():
            at[c], width = width, width + len(values) + 1
        rows = []
        for c, s in made.numbers.items():
            row, fill = np.zeros(width), float(s[made.spec.prep.numeric_impute])
            row[at[c]], row[at[c] + 1] = 1.0, fill - self.numbers[c]
            rows.append(row / (float(s["std"]) or 1.0) if made.spec.scaled else row)
        for c, mode in made.modes.items():
            values, own = self.texts[c], {}
            for k in made.outputs[c]:
                if k != INFREQUENT:
                    own[k] = np.zeros(width)
                    own[k][at[c] + values.index(k)] = 1.0
                    own[k][at[c] + len(values)] = float(k == mode)
            for k in made.outputs[c]:
                rows.append(own[k] if k != INFREQUENT else -sum(own.values()))
        return np.array(rows).reshape(len(rows), width)


def base_of(made: dict[int, object]) -> Base:
    """The base of several training sets' features."""
    numbers, texts = {}, {}
    for m in made.values():
        for c, s in m.numbers.items():
            numbers.setdefault(c, float(s["mean"]))
        for c in m.modes:
            texts[c] = list(dict.fromkeys([*texts.get(c, []), *[k for k in m.outputs[c] if k != INFREQUENT]]))
    return Base(numbers, texts)


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    y = batch.column("y").to_numpy()
    return batch.column("own").to_numpy(), batch.column("b").flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1), y


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of products of (1, base, label) by fold: a row for each fold and task."""
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        own, b, y = _arrays(batch)
        v = np.c_[np.ones(len(y)), b, y]
        for k in np.unique(own):
            part = v[own == k]
            found[int(k)] = found.get(int(k), 0) + part.T @ part
    yield from _packed(found)


def _packed(found: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([np.asarray(v).tobytes() for v in found.values()], pa.binary())], ["own", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, s in zip(*[batch.column(c).to_pylist() for c in ("own", "sums")]):
            found[k] = found.get(k, 0) + np.frombuffer(s)
    yield from _packed(found)


def solve(m: np.ndarray, weights: np.ndarray, alphas: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients over the base (base x alphas) and intercepts, from a training set's sums of products.

    They minimize squared error plus alpha times the squares of the features' coefficients.
    """
    n, mean = m[0, 0], m[0, 1:] / m[0, 0]
    spread = m[1:, 1:] - n * np.outer(mean, mean)
    gram, cross = weights @ spread[:-1, :-1] @ weights.T, weights @ spread[:-1, -1]
    out = np.stack([np.linalg.lstsq(gram + a * np.eye(len(gram)), cross, rcond=None)[0] if len(gram) else np.zeros(0) for a in alphas], 1)
    over = weights.T @ out
    return over, mean[-1] - mean[:-1] @ over


def ridge_scores(ready: DataFrame, made: dict[int, object], trains: dict[int, list[int]], alphas: list[float]) -> dict[tuple[int, int, str, str], float | None]:
    """rmse, mae and r2 by (fold, place of the alpha, side, metric) of ready, with label and `_own`.

    made and trains: each fold's features, and the values of `_own` that train for it.
    """
    base = base_of(made)
    shift = ready.agg(F.avg("label")).first()[0] or 0.0
    columns = base.columns()
    rows = ready.select(F.col("_own").cast("int").alias("own"), (F.array(*columns) if columns else F.array().cast("array<double>")).alias("b"), (F.col("label") - F.lit(shift)).alias("y"))
    sums = rows.mapInArrow(_products, "own int, sums binary").repartition("own").mapInArrow(_added, "own int, sums binary")
    width = len(columns) + 2
    parts = {r["own"]: np.frombuffer(r["sums"]).reshape(width, width) for r in sums.collect()}  # a square of the columns for each fold
    models = {}
    for f, own in trains.items():
        models[f] = solve(sum(parts[p] for p in own if p in parts), base.maps(made[f]), alphas)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {}
        for batch in batches:
            own, b, y = _arrays(batch)
            for f, (coef, intercept) in models.items():
                for test, side in ((True, own == f), (False, np.isin(own, trains[f]))):
                    if side.any():
                        e = y[side][:, None] - b[side] @ coef - intercept
                        t = y[side]
                        for k in range(e.shape[1]):
                            found[f, k, test] = found.get((f, k, test), 0) + np.array([len(t), (e[:, k] ** 2).sum(), np.abs(e[:, k]).sum(), t.sum(), (t * t).sum()])
        if found:
            keys, values = list(zip(*found)), np.stack(list(found.values()))
            columns = [pa.array(keys[0], pa.int32()), pa.array(keys[1], pa.int32()), pa.array(keys[2], pa.bool_()), pa.array(values[:, 0].astype(np.int64)), *[pa.array(values[:, j]) for j in range(1, 5)]]
            yield pa.RecordBatch.from_arrays(columns, ["fold", "model", "test", "n", "e2", "ae", "y", "y2"])

    out = {}
    total = rows.mapInArrow(scored, _SCORED).groupBy("fold", "model", "test").agg(*[F.sum(c).alias(c) for c in ("n", "e2", "ae", "y", "y2")])
    for r in total.collect():  # a row for each fold, penalty and side
        spread, key = r["y2"] - r["y"] ** 2 / r["n"], (r["fold"], r["model"], "test" if r["test"] else "train")
        r2 = 1 - r["e2"] / spread if spread > 1e-12 * r["y2"] else None
        out |= {(*key, "rmse"): (r["e2"] / r["n"]) ** 0.5, (*key, "mae"): r["ae"] / r["n"], (*key, "r2"): r2}
    return out
