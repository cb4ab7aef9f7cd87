"""Gradient boosting with second-order leaf values, leaf-wise or by levels, softmax for several classes.

Features are cut into at most 255 bins. A step is one pass over the table: tasks sum gradients and
hessians by node, feature and bin, sums meet by node, and the driver gets the best split of each
node, a few numbers. Leaf-wise trees take the split of largest gain first; the children of all
leaves that may still be split are examined in one step, so that a tree takes about as many steps
as it has levels. The K trees of a round and all training sets share each step.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from assay.operators import blocks
from assay.session import cut, drop

MAX_BINS = 255
#: Gains that differ by less than this share are equal; the first feature and bin is taken.
_EQUAL = 1e-9
#: Rounds after which rows' scores are written, so that no pass applies more trees than these.
_REFRESH = 2
_SPLIT = "set int, k int, node int, feature int, bin int, gain double, gl double, hl double, nl double, g double, h double, n double"


@dataclass
class Tree:
    """Nodes as lists; a leaf has feature -1. Rows whose bin is at most the node's go left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def add(self) -> int:
        for own, empty in ((self.feature, -1), (self.bin, 0), (self.left, 0), (self.right, 0), (self.value, 0.0), (self.gain, 0.0)):
            own.append(empty)
        return len(self.feature) - 1

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of binned features."""
        feature, at, left, right = (np.array(v) for v in (self.feature, self.bin, self.left, self.right))
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while True:
            own = node[rows]
            inner = feature[own] >= 0
            rows, own = rows[inner], own[inner]
            if not len(rows):
                return node
            node[rows] = np.where(x[rows, feature[own]] <= at[own], left[own], right[own])

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(x)]


def binned(x: np.ndarray, bounds: list[np.ndarray]) -> np.ndarray:
    """The bin of each value: the first whose bound is not below it, the last beyond all."""
    out = np.empty(x.shape, np.uint8)
    for j, b in enumerate(bounds):
        out[:, j] = np.searchsorted(b, x[:, j], "left")
    return out


def gradients(task: str, scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and hessians of squared error, log loss or softmax; scores and results have a row for each tree of a round."""
    if task == "regression":
        return scores - y, np.ones_like(scores)
    if len(scores) == 1:
        p = 1 / (1 + np.exp(-scores))
        return p - y, p * (1 - p)
    p = softmax(scores)
    return p - (y == np.arange(len(p))[:, None]), len(p) / (len(p) - 1) * p * (1 - p)


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=0))
    return e / e.sum(axis=0)


def _mixed(h: np.ndarray, seed: int) -> np.ndarray:
    """Uniform numbers in [0, 1) from rows' hashes."""
    x = h ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return (x >> np.uint64(11)).astype(np.float64) / 2.0**53


@dataclass
class Growth:
    """One tree of one training set as it grows."""

    tree: Tree = field(default_factory=Tree)
    splits: dict[int, dict | None] = field(default_factory=dict)  # examined nodes: their best split, if any
    sums: dict[int, tuple[float, float, float]] = field(default_factory=dict)  # g, h and rows of each node
    depth: dict[int, int] = field(default_factory=lambda: {0: 0})


@dataclass
class Params:
    """num_leaves bounds leaf-wise trees; max_depth alone makes trees by levels."""

    n_estimators: int = 100
    learning_rate: float = 0.1
    num_leaves: int | None = None
    max_depth: int | None = None
    min_rows: int = 1
    min_hessian: float = 0.0
    reg_lambda: float = 0.0
    subsample: float = 1.0
    every: int = 1  # rounds that share a sample of rows; 0: no sample
    columns: float = 1.0
    seed: int = 42


def best_split(hist: np.ndarray, features: np.ndarray, p: Params) -> dict:
    """The split of largest gain of sums of g, h and rows by feature and bin; feature -1 if none gains."""
    total = hist[:, 0, :].sum(axis=1)  # every feature has all rows
    left = np.cumsum(hist, axis=2)[:, :, :-1]
    right = total[:, None, None] - left
    score = lambda s: np.divide(s[0] ** 2, s[1] + p.reg_lambda, out=np.zeros_like(s[0]), where=s[1] + p.reg_lambda > 0)
    gain = score(left) + score(right) - score(total)
    low = max(p.min_hessian, 1e-12)
    ok = (left[2] >= max(1, p.min_rows)) & (right[2] >= max(1, p.min_rows)) & (left[1] >= low) & (right[1] >= low)
    gain = np.where(ok, gain, 0.0)
    out = {"feature": -1, "bin": 0, "gain": 0.0, "gl": 0.0, "hl": 0.0, "nl": 0.0, "g": float(total[0]), "h": float(total[1]), "n": float(total[2])}
    most = gain.max(initial=0.0)
    if most > 1e-10 * max(1.0, abs(float(score(total)))):
        f, b = np.unravel_index(int(np.argmax(gain >= most * (1 - _EQUAL))), gain.shape)
        out |= {"feature": int(features[f]), "bin": int(b), "gain": float(gain[f, b]), "gl": float(left[0, f, b]), "hl": float(left[1, f, b]), "nl": float(left[2, f, b])}
    return out


class Booster:
    """A fitted model: bounds of bins, start scores and rounds of trees."""

    def __init__(self, task: str, bounds: list[np.ndarray], start: list[float], rounds: list[list[Tree]], n_features: int):
        self.task, self.bounds, self.start, self.rounds, self.n_features = task, bounds, start, rounds, n_features

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Scores, a row for each tree of a round."""
        b, out = binned(x, self.bounds), np.repeat(np.array(self.start)[:, None], len(x), axis=1)
        for trees in self.rounds:
            for k, t in enumerate(trees):
                out[k] += t.predict(b)
        return out

    def outputs(self, x: np.ndarray) -> np.ndarray:
        """Values, or probabilities of each class in columns."""
        raw = self.raw(x)
        if self.task == "regression":
            return raw.T
        return softmax(np.concatenate([np.zeros_like(raw), raw]) if len(raw) == 1 else raw).T

    @property
    def importances(self) -> np.ndarray:
        """Each feature's share of all gains."""
        out = np.zeros(self.n_features)
        for trees in self.rounds:
            for t in trees:
                np.add.at(out, [f for f in t.feature if f >= 0], [g for f, g in zip(t.feature, t.gain) if f >= 0])
        return out / (out.sum() or 1.0)

    def transform(self, df: DataFrame) -> DataFrame:
        return with_outputs(df, self.outputs, self.task)

    def to_json(self) -> str:
        return json.dumps({"task": self.task, "bounds": [b.tolist() for b in self.bounds], "start": self.start, "n_features": self.n_features, "rounds": [[vars(t) for t in trees] for trees in self.rounds]})

    @classmethod
    def from_json(cls, text: str) -> Booster:
        d = json.loads(text)
        return cls(d["task"], [np.array(b) for b in d["bounds"]], d["start"], [[Tree(**t) for t in trees] for trees in d["rounds"]], d["n_features"])


def with_outputs(df: DataFrame, outputs, task: str) -> DataFrame:
    """df with prediction, or probs, of its features, by Arrow batches."""
    @pandas_udf("array<double>")
    def scored(a: pd.Series) -> pd.Series:
        return pd.Series(list(outputs(np.stack(a.to_numpy())))) if len(a) else pd.Series([], dtype=object)

    out = df.withColumn("probs", scored(vector_to_array("features")))
    return out.withColumn("prediction", F.col("probs")[0]).drop("probs") if task == "regression" else out


class Boosting:
    """An estimator of one or several training sets."""

    def __init__(self, task: str, n_classes: int, params: Params):
        self.task, self.p = task, params
        self.k = n_classes if task == "classification" and n_classes > 2 else 1

    def hasParam(self, name: str) -> bool:  # as Spark's estimators
        return False

    def fit(self, train: DataFrame) -> Booster:
        return self.fit_sets({0: train})[0]

    def _facts(self, rows: DataFrame) -> dict[int, tuple[int, list[np.ndarray], list[float]]]:
        """Rows, bounds of bins (at most 254 values of each feature) and start scores of each set, from two aggregates."""
        classes = range(max(2, self.k))
        labels = [F.count_if(F.col("y") == k).alias(f"n{k}") for k in classes]
        found = {r["set"]: r for r in rows.groupBy("set").agg(F.count("*").alias("n"), F.avg("y").alias("mean"), F.max(F.size("a")).alias("width"), *labels).collect()}
        grid = ", ".join(f"{i / MAX_BINS!r}D" for i in range(1, MAX_BINS + 1))
        values = [F.expr(f"percentile_approx(get(a, {j}), array({grid}), 10000)").alias(f"g{j}") for j in range(max(r["width"] for r in found.values()))]
        out = {}
        for r in rows.groupBy("set").agg(*values).collect():  # 255 numbers for each feature
            own = found[r["set"]]
            bounds = [np.unique(np.array(r[f"g{j}"], float))[:-1][: MAX_BINS - 1] for j in range(own["width"])]
            share = [(own[f"n{k}"] + 1e-9) / own["n"] for k in classes]
            start = [float(own["mean"])] if self.task == "regression" else [math.log(x) for x in share] if self.k > 1 else [math.log(share[1] / share[0])]
            out[r["set"]] = own["n"], bounds, start
        return out

    def fit_sets(self, trains: dict[int, DataFrame]) -> dict[int, Booster]:
        """A model of each training set (features and label), grown side by side."""
        sets = {s: blocks.arrays(df) for s, df in trains.items()}
        rows = cut(blocks.united(sets))  # features are made once for the three passes that read them
        facts = self._facts(rows)
        bounds, start = {s: f[1] for s, f in facts.items()}, {s: np.array(f[2]) for s, f in facts.items()}

        def encode(s, x, y, h):
            scores = np.repeat(start[s][:, None], len(x), axis=1)
            yield s, len(x), binned(x, bounds[s]).tobytes(), y.tobytes(), h.tobytes(), scores.tobytes()

        table = blocks.kept(blocks.made_of(rows, sum(f[0] for f in facts.values()), encode, "set int, n int, x binary, y binary, h binary, f binary"))
        drop(rows)
        tasks = blocks.tasks_of(table)
        models = {s: Booster(self.task, bounds[s], facts[s][2], [], len(bounds[s])) for s in sets}
        since: dict[int, list[list[Tree]]] = {s: [] for s in sets}
        for number in range(self.p.n_estimators):
            grown = self._round(table, tasks, number, since, models)
            if not any(len(t.feature) > 1 for trees in grown.values() for t in trees):
                break
            for s, trees in grown.items():
                models[s].rounds.append(trees)
                since[s].append(trees)
            if len(next(iter(since.values()))) == _REFRESH and number + 1 < self.p.n_estimators:
                table, last = blocks.kept(table.mapInArrow(_rescored(since), table.schema)), table
                table.count()
                tasks = blocks.tasks_of(table)
                since = {s: [] for s in sets}
                drop(last)
        drop(table)
        return models

    def _round(self, table: DataFrame, tasks: int, number: int, since: dict, models: dict[int, Booster]) -> dict[int, list[Tree]]:
        """The trees of one round for each set: steps until nothing is left to examine."""
        p, rng = self.p, np.random.default_rng([self.p.seed, number])
        columns = {s: [np.sort(rng.permutation(m.n_features)[: max(1, round(p.columns * m.n_features))]) for _ in range(self.k)] for s, m in models.items()}
        growing = {(s, k): Growth() for s in models for k in range(self.k)}
        todo = {key: [0] for key in growing}
        bag = None if p.every == 0 or p.subsample >= 1 else number // p.every + 1
        while todo:
            trees = {key: growing[key].tree for key in todo}
            find = _histograms(self.task, p, since, trees, todo, columns, bag)
            size = sum(len(nodes) * len(columns[s][k]) * MAX_BINS * 24 for (s, k), nodes in todo.items())
            rows = table.where(F.col("set").isin(sorted({s for s, _ in todo})))
            best = blocks.merged(rows, tasks, ["set", "k", "node"], size, find, "set int, k int, node int, hist binary", _best(p, columns), _SPLIT)
            for r in best.collect():  # a row for each node examined
                own = growing[r["set"], r["k"]]
                own.splits[r["node"]] = r.asDict() if r["feature"] >= 0 else None
                own.sums[r["node"]] = (r["g"], r["h"], r["n"])
            for key, nodes in todo.items():
                for node in nodes:  # without rows
                    growing[key].splits.setdefault(node, None)
                    growing[key].sums.setdefault(node, (0.0, 0.0, 0.0))
            todo = {key: nodes for key in todo if (nodes := self._next(growing[key]))}
        return {s: [self._final(growing[s, k]) for k in range(self.k)] for s in models}

    def _chosen(self, own: Growth) -> tuple[list[int], list[int]]:
        """Nodes to split in order; and those whose children must be examined before the order is known."""
        split, heap = [], [(-own.splits[0]["gain"], 0)] if own.splits.get(0) else []
        most = math.inf if self.p.num_leaves is None else self.p.num_leaves - 1
        while heap and len(split) < most:
            _, node = heapq.heappop(heap)
            split.append(node)
            if len(split) >= most:
                break
            children = own.tree.left[node], own.tree.right[node]
            if not children[0]:  # not yet examined: neither may be those of the other leaves
                left = int(min(most - len(split), len(heap)))
                return split, [node, *[n for _, n in heapq.nsmallest(left, heap) if not own.tree.left[n]]]
            for c in children:
                if own.splits.get(c):
                    heapq.heappush(heap, (-own.splits[c]["gain"], c))
        return split, []

    def _next(self, own: Growth) -> list[int]:
        """Splits what may be split, and gives the nodes to examine next."""
        if self.p.num_leaves is not None:
            todo = self._chosen(own)[1]
        else:
            todo = [n for n, s in own.splits.items() if s and not own.tree.left[n]]
        new = []
        for node in todo:
            new += self._divide(own, node)
        return new

    def _divide(self, own: Growth, node: int) -> list[int]:
        """Gives a node children; those of them that could be split."""
        s, t = own.splits[node], own.tree
        t.feature[node], t.bin[node], t.gain[node], new = s["feature"], s["bin"], s["gain"], []
        t.left[node], t.right[node] = t.add(), t.add()
        for child, sums in ((t.left[node], (s["gl"], s["hl"], s["nl"])), (t.right[node], (s["g"] - s["gl"], s["h"] - s["hl"], s["n"] - s["nl"]))):
            own.sums[child], own.depth[child], own.splits[child] = sums, own.depth[node] + 1, None
            if sums[2] >= 2 * max(1, self.p.min_rows) and (self.p.max_depth is None or own.depth[child] < self.p.max_depth):
                new.append(child)
        return new

    def _final(self, own: Growth) -> Tree:
        """The tree of the chosen splits, with values of its leaves."""
        split = set(self._chosen(own)[0]) if self.p.num_leaves is not None else {n for n, s in own.splits.items() if s}
        for node in list(split):
            if not own.tree.left[node]:  # the last one chosen
                self._divide(own, node)
        out, left = Tree(), [(0, 0)]
        while left:
            old, new = left.pop()
            g, h, _ = own.sums[old]
            out.value[new] = -g / (h + self.p.reg_lambda) * self.p.learning_rate if h + self.p.reg_lambda > 0 else 0.0
            if old in split:
                out.feature[new], out.bin[new], out.gain[new] = own.tree.feature[old], own.tree.bin[old], own.tree.gain[old]
                out.left[new], out.right[new] = out.add(), out.add()
                left += [(own.tree.left[old], out.left[new]), (own.tree.right[old], out.right[new])]
        return out


def _opened(batch: pa.RecordBatch) -> Iterator[tuple]:
    """set, binned features, labels, hashes and scores of each block."""
    for s, n, x, y, h, f in zip(*[batch.column(c).to_pylist() for c in ("set", "n", "x", "y", "h", "f")]):
        yield s, np.frombuffer(x, np.uint8).reshape(n, -1), np.frombuffer(y), np.frombuffer(h, np.uint64), np.frombuffer(f).reshape(-1, n)


def _with_trees(f: np.ndarray, x: np.ndarray, rounds: list[list[Tree]]) -> np.ndarray:
    out = f.copy()
    for trees in rounds:
        for k, t in enumerate(trees):
            out[k] += t.predict(x)
    return out


def _rescored(since: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = [_with_trees(f, x, since[s]).tobytes() for s, x, _, _, f in _opened(batch)]
            yield batch.set_column(batch.schema.get_field_index("f"), "f", pa.array(f, pa.binary()))

    return run


def _histograms(task: str, p: Params, since: dict, trees: dict, todo: dict, columns: dict, bag: int | None):
    """Sums of gradients, hessians and rows by feature and bin for each node to examine, a row for each node and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            for s, x, y, h, f in _opened(batch):
                g, hess = gradients(task, _with_trees(f, x, since[s]), y)
                drawn = None if bag is None else _mixed(h, p.seed + bag) < p.subsample
                for (own, k), nodes in todo.items():
                    if own != s:
                        continue
                    leaf, use = trees[s, k].leaves(x), columns[s][k]
                    for node in nodes:
                        rows = np.flatnonzero(leaf == node if drawn is None else (leaf == node) & drawn)
                        cell = (x[np.ix_(rows, use)].astype(np.int64) + np.arange(len(use)) * MAX_BINS).ravel()
                        each = [np.bincount(cell, np.repeat(w, len(use)), len(use) * MAX_BINS) for w in (g[k][rows], hess[k][rows])]
                        hist = np.stack([*each, np.bincount(cell, minlength=len(use) * MAX_BINS)]).astype(float)
                        sums[s, k, node] = hist + sums[s, k, node] if (s, k, node) in sums else hist
        if sums:
            s, k, node = zip(*sums)
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(k, pa.int32()), pa.array(node, pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["set", "k", "node", "hist"])

    return run


def _best(p: Params, columns: dict):
    """The best split of each node, from the sums of all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            for s, k, node, hist in zip(*[batch.column(c).to_pylist() for c in ("set", "k", "node", "hist")]):
                own = np.frombuffer(hist).reshape(3, -1, MAX_BINS)
                sums[s, k, node] = own + sums[s, k, node] if (s, k, node) in sums else own
        rows = [{"set": s, "k": k, "node": node} | best_split(hist, columns[s][k], p) for (s, k, node), hist in sums.items()]
        if rows:
            kinds = {"int": pa.int32(), "double": pa.float64()}
            yield pa.RecordBatch.from_pylist(rows, pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _SPLIT.split(", ")]))

    return run
