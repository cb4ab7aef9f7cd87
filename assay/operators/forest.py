"""Random forests: trees of bootstrapped rows and random features at each node, on Gini impurity or variance.

Features are cut into at most 255 bins. Nodes of more than LOCAL rows are split by passes over the
table, as in boosting: tasks sum rows by node, feature and bin, and the driver gets the best split of
each node. The rows of a smaller node go to one task, which grows all that is below it. Bootstrap
weights and features are drawn by hashes of rows and nodes, so that a forest does not depend on how the
table is partitioned. All trees of all training sets share each pass. A forest stays in Spark, a row
for each tree or part of one; some tens of MB of it are applied at a time.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from assay.operators import blocks
from assay.operators.boosting import MAX_BINS, Boosting, binned, with_outputs
from assay.operators.boosting import Params as Boosted
from assay.session import cut, drop

#: Drawn rows of a node that one task grows; rows dealt to a task; bytes of a step's sums, and of trees applied at a time.
LOCAL, DEALT, STEP_BYTES, WAVE_BYTES = 1 << 18, 1 << 20, 1 << 26, 1 << 26
#: Gains that differ by less than this share are equal; the first feature and bin is taken.
_EQUAL = 1e-9
#: Regression targets are multiples of this share of their deviation, so that sums are exact in any order.
_UNIT = 2.0**-24
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])
_PART = "set int, tree int, node int, bytes long, grown binary, gains binary"


@dataclass
class Params:
    n_estimators: int = 300
    max_depth: int = 30
    min_rows: int = 1
    max_features: str | float | None = "sqrt"
    seed: int = 42

    def features_of(self, d: int, task: str) -> int:
        """How many of d features a node may use."""
        given = {"auto": "sqrt" if task == "classification" else "onethird"}.get(self.max_features, self.max_features)
        share = {None: d, "all": d, "sqrt": math.sqrt(d), "log2": math.log2(max(d, 2)), "onethird": d / 3}
        if given not in share and not (isinstance(given, (int, float)) and 0 < given <= 1):
            raise ValueError(f"max_features {self.max_features!r}")
        return max(1, min(d, math.ceil(share[given] if given in share else given * d)))


@dataclass
class Nodes:
    """A tree as arrays. A leaf has feature -1; rows whose bin is at most the node's go left, the right child is next to the left."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while True:
            own = node[rows]
            f = self.feature[own]
            inner = f >= 0
            if not inner.all():
                rows, own, f = rows[inner], own[inner], f[inner]
            if not len(rows):
                return node
            node[rows] = self.left[own] + (x[rows, f] > self.bin[own])

    def to_bytes(self) -> bytes:
        return b"".join(a.tobytes() for a in (self.feature.astype(np.int32), self.left.astype(np.int32), self.bin.astype(np.uint8), self.value.astype(float)))

    @classmethod
    def from_bytes(cls, data: bytes, width: int) -> Nodes:
        n = len(data) // (9 + 8 * width)
        value = np.frombuffer(data[9 * n :]).reshape(n, width)
        return cls(np.frombuffer(data, np.int32, n), np.frombuffer(data, np.uint8, n, 8 * n), np.frombuffer(data, np.int32, n, 4 * n), value)

    def with_parts(self, parts: dict[int, Nodes]) -> Nodes:
        """This tree with parts grown at its leaves."""
        if list(parts) == [0]:
            return parts[0]
        f, b, left, v, size = [self.feature.copy()], [self.bin.copy()], [self.left.copy()], [self.value.copy()], len(self.feature)
        for at, p in sorted(parts.items()):
            f[0][at], b[0][at], left[0][at], v[0][at] = p.feature[0], p.bin[0], p.left[0] + size, p.value[0]
            f.append(p.feature), b.append(p.bin), left.append(p.left + size), v.append(p.value)
            size += len(p.feature)
        return Nodes(np.concatenate(f), np.concatenate(b), np.concatenate(left), np.concatenate(v))


def mixed(x: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits, mixed."""
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def root_of(tree: int, seed: int) -> np.ndarray:
    """A tree's own number, by which its draws are made."""
    return mixed(np.array([seed * 1_000_003 + tree + 1], np.uint64))


def weights(h: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is drawn for a tree, by Poisson's law with mean 1."""
    return np.searchsorted(_POISSON, (mixed(h ^ root_of(tree, seed)) >> np.uint64(11)).astype(float) / 2.0**53, "right").astype(np.uint8)


def told_apart(h: np.ndarray) -> np.ndarray:
    """Hashes with equal ones made different by their number among the equal."""
    order = np.argsort(h, kind="stable")
    own = h[order]
    new = np.r_[True, own[1:] != own[:-1]] if len(h) else np.zeros(0, bool)
    place = np.arange(len(h)) - np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    out = np.empty_like(h)
    out[order] = own + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return out


def children_of(ids: np.ndarray) -> np.ndarray:
    """Numbers of the left and right children of nodes, in pairs."""
    return mixed(np.repeat(ids, 2) * np.uint64(2) + np.tile(np.array([1, 2], np.uint64), len(ids)))


def chosen(ids: np.ndarray, d: int, m: int, turn: int = 0) -> np.ndarray:
    """m of d features for each node; in a later turn, the next m or those that are left."""
    if m >= d:
        return np.broadcast_to(np.arange(d), (len(ids), d))[:, turn * d :]
    salt, out = mixed(np.arange(1, d + 1, dtype=np.uint64)), []
    for at in range(0, len(ids), step := max(1, (1 << 20) // d)):
        out.append(np.sort(np.argsort(mixed(ids[at : at + step, None] ^ salt), axis=1)[:, turn * m : (turn + 1) * m], axis=1))
    return np.concatenate(out)


def rows_in(s: np.ndarray, task: str) -> np.ndarray:
    """Drawn rows of sums by class, or of sums of rows and targets."""
    return s @ np.ones(s.shape[-1]) if task == "classification" else s[..., 0]


def score(s: np.ndarray, task: str) -> np.ndarray:
    """Rows times purity: what a split gains is its sides' less the node's."""
    n = rows_in(s, task)
    q = np.einsum("...i,...i->...", s, s) if task == "classification" else s[..., 1] ** 2
    return np.divide(q, n, out=np.zeros_like(q), where=n > 0)


def value_of(s: np.ndarray, task: str) -> np.ndarray:
    """Shares of classes, or the mean target, of sums of one or more rows."""
    n = np.maximum(rows_in(s, task), 1e-300)[..., None]
    return s / n if task == "classification" else s[..., 1:] / n


def _cumulated(key: np.ndarray, y: np.ndarray, w: np.ndarray, task: str, width: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The different keys (below size) in order, and the sums of rows up to each of them."""
    if size <= len(key):  # counting is faster than sorting
        if task == "classification":
            s = np.bincount(key * width + y, w, size * width).reshape(size, width)
        else:
            s = np.stack([np.bincount(key, w, size), np.bincount(key, w * y, size)], axis=1)
        k = np.flatnonzero(rows_in(s, task))
        return k, np.cumsum(s[k], axis=0)
    if task == "classification":
        packed = np.sort((key << 16) | (y.astype(np.int64) << 8) | w)
        k, c, w = packed >> 16, (packed >> 8) & 255, (packed & 255).astype(float)
        columns = [np.where(c == i, w, 0.0) for i in range(width)]
    else:
        order = np.argsort(key)
        k, w = key[order], w[order].astype(float)
        columns = [w, w * y[order]]
    ends = np.flatnonzero(np.r_[k[1:] != k[:-1], True])
    return k[ends], np.stack([np.cumsum(c)[ends] for c in columns], axis=1)


def best_splits(x: np.ndarray, at: np.ndarray, y: np.ndarray, w: np.ndarray, sums: np.ndarray, use: np.ndarray, p: Params, task: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """gain, feature (-1 if none gains) and bin of each node's best split by its features; at: each row's node, all of which have rows."""
    n, before = len(sums), np.vstack([np.zeros(sums.shape[1]), np.cumsum(sums, axis=0)[:-1]])
    whole = score(sums, task)
    least = 1e-10 * np.maximum(1.0, np.abs(whole))
    gain, feature, bin_ = np.zeros(n), np.full(n, -1), np.zeros(n, np.int64)
    rows = np.arange(len(at))
    for j in range(use.shape[1]):
        f = use[:, j]
        key, left = _cumulated(at * 256 + x[rows, f[at]], y, w, task, sums.shape[1], n * 256)
        node, value = key >> 8, key & 255
        left = left - before[node]
        right = sums[node] - left
        ok = (rows_in(left, task) >= max(1, p.min_rows)) & (rows_in(right, task) >= max(1, p.min_rows))
        own = np.where(ok, score(left, task) + score(right, task) - whole[node], 0.0)
        most = np.maximum.reduceat(own, np.flatnonzero(np.r_[True, node[1:] != node[:-1]]))
        cells = np.flatnonzero(own >= (most * (1 - _EQUAL))[node])
        first = cells[np.unique(node[cells], return_index=True)[1]]
        middle = (value[first] + value[np.minimum(first + 1, len(value) - 1)]) // 2
        better = most > np.maximum(gain * (1 + _EQUAL), least)
        gain, feature, bin_ = np.where(better, most, gain), np.where(better, f, feature), np.where(better, middle, bin_)
    return gain, feature, bin_


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, ident: np.ndarray, depth: int, p: Params, task: str, classes: int) -> tuple[Nodes, np.ndarray]:
    """The tree below a node of the given rows, level by level, and each feature's gains."""
    d, width = x.shape[1], classes if task == "classification" else 2
    m, gains, at, levels, size = p.features_of(d, task), np.zeros(d), np.zeros(len(x), np.int64), [], 0
    ids = ident
    while len(ids):
        columns = [np.where(y == c, w, 0.0) for c in range(width)] if task == "classification" else [w, w * y]
        sums = np.stack([np.bincount(at, c, len(ids)) for c in columns], axis=1)
        n, feature, bin_, left = len(ids), np.full(len(ids), -1), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        size += n
        able = (rows_in(sums, task) >= 2 * max(1, p.min_rows)) & (depth < p.max_depth)
        if task == "classification":
            able &= sums.max(axis=1) < rows_in(sums, task)
        nodes = np.flatnonzero(able)
        if len(nodes):
            rows = able[at]
            x, y, w, at = x[rows], y[rows], w[rows], (np.cumsum(able) - 1)[at[rows]]
            gain, f, b = best_splits(x, at, y, w, sums[nodes], chosen(ids[nodes], d, m), p, task)
            for turn in range(1, math.ceil(d / m)):  # nodes that these features don't split use others
                if not (none := f < 0).any():
                    break
                rows, own = none[at], np.flatnonzero(none)
                gain[own], f[own], b[own] = best_splits(x[rows], (np.cumsum(none) - 1)[at[rows]], y[rows], w[rows], sums[nodes[own]], chosen(ids[nodes[own]], d, m, turn), p, task)
            cut_ = f >= 0
            split = nodes[cut_]
            feature[split], bin_[split], left[split] = f[cut_], b[cut_], size + 2 * np.arange(len(split))
            np.add.at(gains, f[cut_], gain[cut_])
            if not cut_.all():
                rows = cut_[at]
                x, y, w, at = x[rows], y[rows], w[rows], at[rows]
            at = 2 * (np.cumsum(cut_) - 1)[at] + (x[np.arange(len(at)), f[at]] > b[at])
            ids = children_of(ids[split])
        else:
            ids = ids[:0]
        levels.append((feature, bin_, left, value_of(sums, task)))
        depth += 1
    return Nodes(*(np.concatenate(v) for v in zip(*levels))), gains


@dataclass
class Top:
    """The upper nodes of one tree, as they are split by passes over the table."""

    ids: list[np.ndarray]
    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    depth: list[int] = field(default_factory=lambda: [0])
    rows: list[float] = field(default_factory=lambda: [math.inf])
    turn: dict[int, int] = field(default_factory=dict)  # how often a node's features did not split it
    over: dict[int, list[float]] = field(default_factory=dict)  # leaves for good: their values
    gains: dict[int, float] = field(default_factory=dict)

    def nodes(self, width: int) -> Nodes:
        value = np.array([self.over.get(i, [0.0] * width)[:width] for i in range(len(self.feature))], float)
        return Nodes(np.array(self.feature), np.array(self.bin), np.array(self.left), value)

    def open(self, most: int) -> list[int]:
        return [i for i, f in enumerate(self.feature) if f < 0 and i not in self.over and self.rows[i] > most]

    def divide(self, node: int, feature: int, bin_: int, gain: float, n_left: float, n: float) -> None:
        self.feature[node], self.bin[node], self.left[node] = feature, bin_, len(self.feature)
        self.gains[feature] = self.gains.get(feature, 0.0) + gain
        for child, rows in zip(children_of(self.ids[node]), (n_left, n - n_left)):
            self.ids.append(np.array([child], np.uint64)), self.feature.append(-1), self.bin.append(0), self.left.append(0)
            self.depth.append(self.depth[node] + 1), self.rows.append(rows)


class Grown:
    """A fitted model: its parts are rows of a table, the upper nodes of its trees are here."""

    def __init__(self, task: str, classes: int, bounds: list[np.ndarray], mean: float, scale: float, prior: list[float], trees: int, parts: DataFrame, tops: dict[int, Nodes], gains: dict[int, dict[int, float]]):
        self.task, self.classes, self.bounds, self.mean, self.scale, self.prior, self.trees, self.parts, self.tops, self.gains = task, classes, bounds, mean, scale, prior, trees, parts, tops, gains
        self.width = classes if task == "classification" else 1

    def _waves(self) -> list[list[int]]:
        """Trees to apply at a time."""
        out, used = [[]], 0
        for r in sorted(self.parts.groupBy("tree").agg(F.sum("bytes").alias("bytes")).collect()):
            if out[-1] and used + r["bytes"] > WAVE_BYTES:
                out, used = [*out, []], 0
            out[-1].append(r["tree"])
            used += r["bytes"]
        held = {t for wave in out for t in wave}
        return [*out[:-1], out[-1] + [t for t in range(self.trees) if t not in held]]

    def _of(self, trees: list[int]) -> list[Nodes]:
        found: dict[int, dict[int, Nodes]] = {t: {} for t in trees}
        for r in self.parts.where(F.col("tree").isin(trees)).select("tree", "node", "grown").collect():  # WAVE_BYTES, or one tree
            found[r["tree"]][r["node"]] = Nodes.from_bytes(bytes(r["grown"]), self.width)
        drawn_none = Nodes(np.array([-1]), np.array([0]), np.array([0]), np.array([self.prior]))
        return [self.tops[t].with_parts(parts) if t in self.tops else parts.get(0, drawn_none) for t, parts in sorted(found.items())]

    def transform(self, df: DataFrame) -> DataFrame:
        waves = self._waves()
        if len(waves) == 1:
            return with_outputs(df, _summed(self._of(waves[0]), self.bounds, self.width, self._end()), self.task)
        out = cut(df.withColumn("probs", F.array_repeat(F.lit(0.0), self.width)))
        for i, wave in enumerate(waves):
            last = i == len(waves) - 1
            added = _added(_summed(self._of(wave), self.bounds, self.width, self._end() if last else (0.0, 1.0)))
            out, done = cut(out.withColumn("probs", added(vector_to_array("features"), "probs"))), out
            drop(done)
        return out.withColumn("prediction", F.col("probs")[0]).drop("probs") if self.task == "regression" else out

    def _end(self) -> tuple[float, float]:
        return (self.mean, self.scale / self.trees) if self.task == "regression" else (0.0, 1.0 / self.trees)

    @property
    def importances(self) -> np.ndarray:
        """Each feature's share of a tree's gains, on average."""
        each = np.zeros((self.trees, len(self.bounds)))
        for t, found in self.gains.items():
            for f, gain in found.items():
                each[t, f] += gain
        for r in self.parts.select("tree", "gains").toLocalIterator():
            each[r["tree"]] += np.frombuffer(bytes(r["gains"]))
        all_ = each.sum(axis=1, keepdims=True)
        out = np.divide(each, all_, out=np.zeros_like(each), where=all_ > 0).sum(axis=0)
        return out / (out.sum() or 1.0)

    def save(self, path: str) -> None:
        """The parts at path/parts, the rest as JSON."""
        self.parts.write.mode("overwrite").parquet(f"{path}/parts")
        tops = {t: [v.tolist() for v in (n.feature, n.bin, n.left, n.value)] for t, n in self.tops.items()}
        record = {"task": self.task, "classes": self.classes, "bounds": [b.tolist() for b in self.bounds], "mean": self.mean, "scale": self.scale, "prior": self.prior, "trees": self.trees, "tops": tops, "gains": self.gains}
        self.parts.sparkSession.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/forest")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Grown:
        d = json.loads(spark.read.text(f"{path}/forest").first()[0])
        tops = {int(t): Nodes(*(np.array(v) for v in n)) for t, n in d["tops"].items()}
        gains = {int(t): {int(f): g for f, g in own.items()} for t, own in d["gains"].items()}
        return cls(d["task"], d["classes"], [np.array(b) for b in d["bounds"]], d["mean"], d["scale"], d["prior"], d["trees"], spark.read.parquet(f"{path}/parts"), tops, gains)


def _summed(trees: list[Nodes], bounds: list[np.ndarray], width: int, end: tuple[float, float]):
    def outputs(x: np.ndarray, earlier: np.ndarray | None = None) -> np.ndarray:
        b, out = binned(x, bounds), np.zeros((len(x), width)) if earlier is None else earlier
        for t in trees:
            out = out + t.value[t.leaves(b)]
        return out * end[1] + end[0]

    return outputs


def _added(outputs):
    @pandas_udf("array<double>")
    def scored(a: pd.Series, earlier: pd.Series) -> pd.Series:
        return pd.Series(list(outputs(np.stack(a.to_numpy()), np.stack(earlier.to_numpy())))) if len(a) else pd.Series([], dtype=object)

    return scored


class Forest:
    """An estimator of one or several training sets. scale: of a regression target."""

    def __init__(self, task: str, n_classes: int, params: Params, scale: float = 1.0):
        self.task, self.p, self.classes, self.scale = task, params, max(2, n_classes), scale or 1.0
        if task == "classification" and self.classes > 255:
            raise ValueError("a forest knows at most 255 classes")
        params.features_of(1, task)  # a ValueError if there is no such share

    def hasParam(self, name: str) -> bool:  # as Spark's estimators
        return False

    def fit(self, train: DataFrame) -> Grown:
        return self.fit_sets({0: train})[0]

    def fit_sets(self, trains: dict[int, DataFrame]) -> dict[int, Grown]:
        """A model of each training set (features and label), grown side by side."""
        task, p, scale = self.task, self.p, self.scale
        rows = cut(blocks.united({s: blocks.arrays(df) for s, df in trains.items()}))  # features are made once for the passes that read them
        facts = Boosting(task, self.classes, Boosted())._facts(rows)
        bounds, mean = {s: f[1] for s, f in facts.items()}, {s: f[2][0] if task == "regression" else 0.0 for s, f in facts.items()}
        width = self.classes if task == "classification" else 1

        def encode(s, x, y, h):
            own = y.astype(np.uint8) if task == "classification" else np.round((y - mean[s]) / scale / _UNIT) * _UNIT
            yield s, len(x), binned(x, bounds[s]).tobytes(), own.tobytes(), told_apart(h).tobytes()

        n = sum(f[0] for f in facts.values())
        table = cut(blocks.made_of(rows, n, encode, "set int, n int, x binary, y binary, h binary"))
        drop(rows)
        tops = {(s, t): Top([root_of(t, p.seed)], rows=[facts[s][0]]) for s in facts for t in range(p.n_estimators)}
        self._split(table, tops, {s: len(b) for s, b in bounds.items()})
        upper = {key: top.nodes(width) for key, top in tops.items()}
        tasks = max(table.sparkSession.sparkContext.defaultParallelism, n * p.n_estimators // DEALT)
        pieces = table.mapInArrow(_dealt(task, p, tops, upper), "set int, tree int, node int, n int, x binary, y binary, w binary")
        grown = pieces.repartition(min(tasks, len(tops)), "set", "tree", "node").groupBy("set", "tree", "node").applyInArrow(_below(task, p, tops, {s: len(b) for s, b in bounds.items()}, self.classes), _PART)
        parts = cut(grown)
        drop(table)
        out = {}
        for s, f in facts.items():
            mine = {t: key for key in tops for t in [key[1]] if key[0] == s}
            large = {t: upper[key] for t, key in mine.items() if len(tops[key].feature) > 1 or tops[key].over}
            out[s] = Grown(task, self.classes, bounds[s], mean[s], scale, self._prior(f[2]), p.n_estimators, parts.where(F.col("set") == s), large, {t: tops[key].gains for t, key in mine.items() if tops[key].gains})
        return out

    def _prior(self, start: list[float]) -> list[float]:
        """What a tree without a drawn row says."""
        if self.task == "regression":
            return [0.0]
        return [1 / (1 + math.exp(start[0])), 1 / (1 + math.exp(-start[0]))] if len(start) == 1 else [math.exp(v) for v in start]

    def _split(self, table: DataFrame, tops: dict[tuple[int, int], Top], wide: dict[int, int]) -> None:
        """Splits nodes of more than LOCAL rows, as many in one pass as sums are held for."""
        task, p, classes = self.task, self.p, self.classes
        columns = classes if task == "classification" else 2
        tasks = blocks.tasks_of(table)
        while True:
            todo: dict[tuple[int, int], list[int]] = {}
            size = 0
            for key, top in tops.items():
                each = p.features_of(wide[key[0]], task) * MAX_BINS * columns * 8
                for node in top.open(LOCAL):
                    if size and size + each > STEP_BYTES:
                        break
                    todo.setdefault(key, []).append(node)
                    size += each
            if not todo:
                return
            upper = {key: tops[key].nodes(0) for key in todo}
            most = {s: p.features_of(d, task) for s, d in wide.items()}
            use = {(*key, node): chosen(tops[key].ids[node], wide[key[0]], most[key[0]], tops[key].turn.get(node, 0))[0] for key, nodes in todo.items() for node in nodes}
            find = _histograms(task, p, upper, todo, use, columns)
            schema = "set int, tree int, node int, feature int, bin int, gain double, n_left double, n double, value binary"
            for r in blocks.merged(table, tasks, ["set", "tree", "node"], size, find, "set int, tree int, node int, hist binary", _best(task, p, use, columns), schema).collect():  # a row for each node
                top = tops[r["set"], r["tree"]]
                turn = top.turn.get(r["node"], 0) + 1
                if top.depth[r["node"]] >= p.max_depth or (r["feature"] < 0 and turn * most[r["set"]] >= wide[r["set"]]):
                    top.over[r["node"]] = np.frombuffer(bytes(r["value"])).tolist()
                elif r["feature"] < 0:
                    top.turn[r["node"]] = turn
                else:
                    top.divide(r["node"], r["feature"], r["bin"], r["gain"], r["n_left"], r["n"])


def _opened(batch: pa.RecordBatch, task: str) -> Iterator[tuple]:
    """set, binned features, labels and hashes of each block."""
    for s, n, x, y, h in zip(*[batch.column(c).to_pylist() for c in ("set", "n", "x", "y", "h")]):
        yield s, np.frombuffer(x, np.uint8).reshape(n, -1), np.frombuffer(y, np.uint8 if task == "classification" else float), np.frombuffer(h, np.uint64)


def _histograms(task: str, p: Params, upper: dict, todo: dict, use: dict, columns: int):
    """Sums of drawn rows by feature and bin for each node to split, a row for each node and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            for s, x, y, h in _opened(batch, task):
                for (own, t), nodes in todo.items():
                    if own != s:
                        continue
                    w, leaf = weights(h, t, p.seed), upper[s, t].leaves(x)
                    for node in nodes:
                        rows, f = np.flatnonzero((leaf == node) & (w > 0)), use[s, t, node]
                        cell = (x[np.ix_(rows, f)].astype(np.int64) + np.arange(len(f)) * MAX_BINS).ravel()
                        v = w[rows].astype(float)
                        each = [np.where(y[rows] == c, v, 0.0) for c in range(columns)] if task == "classification" else [v, v * y[rows]]
                        hist = np.stack([np.bincount(cell, np.repeat(q, len(f)), len(f) * MAX_BINS) for q in each])
                        sums[s, t, node] = hist + sums[s, t, node] if (s, t, node) in sums else hist
        if sums:
            s, t, node = zip(*sums)
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(t, pa.int32()), pa.array(node, pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["set", "tree", "node", "hist"])

    return run


def _best(task: str, p: Params, use: dict, columns: int):
    """The best split of each node, from the sums of all tasks."""

    def split(key: tuple, hist: np.ndarray) -> dict:
        hist = np.moveaxis(hist.reshape(columns, -1, MAX_BINS), 0, 2)  # by feature and bin
        total = hist[0].sum(axis=0)
        left = np.cumsum(hist, axis=1)
        right = total - left
        whole = float(score(total, task))
        ok = (rows_in(left, task) >= max(1, p.min_rows)) & (rows_in(right, task) >= max(1, p.min_rows))
        gain = np.where(ok, score(left, task) + score(right, task) - whole, 0.0)
        most, n = gain.max(initial=0.0), float(rows_in(total, task))
        out = {"feature": -1, "bin": 0, "gain": 0.0, "n_left": 0.0, "n": n, "value": value_of(total, task).tobytes()}
        if most > 1e-10 * max(1.0, abs(whole)):
            f, b = np.unravel_index(int(np.argmax(gain >= most * (1 - _EQUAL))), gain.shape)
            rest = np.flatnonzero(rows_in(hist[f, b + 1 :], task) > 0)  # the next bin that has rows
            out |= {"feature": int(use[key][f]), "bin": int(2 * b + 1 + rest[0]) // 2, "gain": float(most), "n_left": float(rows_in(left[f, b], task))}
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            for s, t, node, hist in zip(*[batch.column(c).to_pylist() for c in ("set", "tree", "node", "hist")]):
                own = np.frombuffer(hist)
                sums[s, t, node] = own + sums[s, t, node] if (s, t, node) in sums else own
        rows = [dict(zip(("set", "tree", "node"), key)) | split(key, hist) for key, hist in sums.items()]
        if rows:
            names = {"set": pa.int32(), "tree": pa.int32(), "node": pa.int32(), "feature": pa.int32(), "bin": pa.int32(), "gain": pa.float64(), "n_left": pa.float64(), "n": pa.float64(), "value": pa.binary()}
            yield pa.RecordBatch.from_pylist(rows, pa.schema(list(names.items())))

    return run


def _dealt(task: str, p: Params, tops: dict, upper: dict):
    """The drawn rows of each node that is left, by block."""
    names = {"set": pa.int32(), "tree": pa.int32(), "node": pa.int32(), "n": pa.int32(), "x": pa.binary(), "y": pa.binary(), "w": pa.binary()}
    keys, over = list(tops), {key: set(top.over) for key, top in tops.items()}
    nodes = {key: n for key, n in upper.items() if len(n.feature) > 1}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, x, y, h in _opened(batch, task):
                for own, t in keys:
                    if own != s:
                        continue
                    w = weights(h, t, p.seed)
                    rows = np.flatnonzero(w)
                    leaf = nodes[s, t].leaves(x[rows]) if (s, t) in nodes else np.zeros(len(rows), np.int64)
                    found = []
                    for node in np.unique(leaf).tolist():
                        if node not in over[s, t]:
                            r = rows[leaf == node]
                            found.append((s, t, node, len(r), x[r].tobytes(), y[r].tobytes(), w[r].tobytes()))
                    if found:
                        yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*found))), schema=pa.schema(list(names.items())))

    return run


def _below(task: str, p: Params, tops: dict, wide: dict[int, int], classes: int):
    """What grows below a node, from its rows."""
    begin = {(*key, i): (ids, top.depth[i]) for key, top in tops.items() for i, ids in enumerate(top.ids) if top.feature[i] < 0}

    def run(key: tuple, piece: pa.Table) -> pa.Table:
        s, t, node = (k.as_py() for k in key)
        x, y, w = (np.frombuffer(b"".join(piece.column(c).to_pylist()), kind) for c, kind in (("x", np.uint8), ("y", np.uint8 if task == "classification" else float), ("w", np.uint8)))
        tree, gains = grow(x.reshape(len(w), wide[s]), y, w, *begin[s, t, node], p, task, classes)
        data = tree.to_bytes()
        return pa.table({"set": pa.array([s], pa.int32()), "tree": pa.array([t], pa.int32()), "node": pa.array([node], pa.int32()), "bytes": pa.array([len(data)], pa.int64()), "grown": pa.array([data], pa.binary()), "gains": pa.array([gains.tobytes()], pa.binary())})

    return run
