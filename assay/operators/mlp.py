"""Multilayer perceptrons by data-parallel mini-batch Adam, with an L2 penalty and early stopping.

A step is one pass over the rows of its mini-batch and no others: they lie in partitions of their own,
whose tasks sum gradients, a few numbers for some thousand rows, and the driver moves the weights. Rows belong to a mini-batch, or to the validation
part, by a hash of their content, so that a fit does not depend on how the table is partitioned. An
epoch has as many mini-batches as 200 rows each make, but 16 at most, so that its passes do not
grow with the table. All training sets share each step.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.operators import blocks
from assay.operators.boosting import softmax, with_outputs
from assay.session import cut, drop

BATCH_ROWS, MOST_BATCHES, VALIDATION = 200, 16, 0.1
#: Rows of a mini-batch, of all sets together, that a task has about.
PIECE_ROWS = 1 << 14
#: Rows that are multiplied together, and tasks whose sums the driver holds together.
_TOGETHER, _WAVE = 1 << 12, 256
PATIENCE, TOLERANCE = 10, 1e-4
_B1, _B2, _EPS = 0.9, 0.999, 1e-8


@dataclass
class Params:
    hidden: tuple[int, ...] = (100,)
    max_iter: int = 500
    alpha: float = 0.0001
    learning_rate: float = 0.001
    early_stopping: bool = True
    seed: int = 42


def unpack(w: np.ndarray, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weights and biases of each layer, as views of one vector."""
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        out.append((w[at : at + a * b].reshape(a, b), w[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def start(sizes: list[int], seed: int) -> np.ndarray:
    """Uniform within sqrt(6 / (inputs + outputs)) of each layer."""
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.uniform(-1, 1, a * b + b) * math.sqrt(6 / (a + b)) for a, b in zip(sizes, sizes[1:])])


def forward(layers: list, x: np.ndarray) -> list[np.ndarray]:
    """What each layer gives; rectified but for the last."""
    out = [x]
    for k, (w, b) in enumerate(layers):
        z = out[-1] @ w + b
        out.append(z if k == len(layers) - 1 else np.maximum(z, 0))
    return out


def outputs_of(z: np.ndarray, task: str) -> np.ndarray:
    """Values, or probabilities of each class; one output is the log odds of class 1."""
    if task == "regression":
        return z
    return softmax(np.concatenate([np.zeros_like(z), z], 1).T if z.shape[1] == 1 else z.T).T


def loss_sum(z: np.ndarray, y: np.ndarray, task: str) -> float:
    """Half squared error or log loss, summed over rows."""
    if task == "regression":
        return float(((z[:, 0] - y) ** 2).sum() / 2)
    return float(-np.log(np.maximum(outputs_of(z, task)[np.arange(len(y)), y.astype(int)], 1e-300)).sum())


def gradient_sum(w: np.ndarray, sizes: list[int], x: np.ndarray, y: np.ndarray, task: str) -> np.ndarray:
    """Gradient of loss_sum by the weights; the penalty is not in it."""
    layers, grad = unpack(w, sizes), np.empty_like(w)
    acts = forward(layers, x)
    if task == "regression":
        delta = acts[-1] - y[:, None]
    else:
        p = outputs_of(acts[-1], task)
        p[np.arange(len(y)), y.astype(int)] -= 1
        delta = p[:, 1:] if acts[-1].shape[1] == 1 else p
    for (gw, gb), (lw, _), a in reversed(list(zip(unpack(grad, sizes), layers, acts))):
        gw[:], gb[:] = a.T @ delta, delta.sum(axis=0)
        delta = (delta @ lw.T) * (a > 0)
    return grad


def penalty(w: np.ndarray, sizes: list[int]) -> np.ndarray:
    """The weights without the biases."""
    out = w.copy()
    for _, b in unpack(out, sizes):
        b[:] = 0
    return out


@dataclass
class State:
    """One training set's weights as they move."""

    w: np.ndarray
    batches: int
    m: np.ndarray = field(init=False)
    v: np.ndarray = field(init=False)
    t: int = 0
    epoch: int = 0
    best: float = -math.inf
    kept: np.ndarray | None = None
    waited: int = 0
    loss: list[tuple[float, int]] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    over: bool = False

    def __post_init__(self):
        self.m, self.v = np.zeros_like(self.w), np.zeros_like(self.w)

    def move(self, g: np.ndarray, rate: float) -> None:
        self.t += 1
        self.m = _B1 * self.m + (1 - _B1) * g
        self.v = _B2 * self.v + (1 - _B2) * g * g
        self.w = self.w - rate * math.sqrt(1 - _B2**self.t) / (1 - _B1**self.t) * self.m / (np.sqrt(self.v) + _EPS)

    def judge(self, score: float) -> None:
        """After an epoch: keeps the best weights; over if none of the last PATIENCE epochs was better by TOLERANCE."""
        self.scores.append(score)
        self.waited = self.waited + 1 if score <= self.best + TOLERANCE else 0
        if score > self.best:
            self.best, self.kept = score, self.w.copy()
        self.over = self.waited >= PATIENCE


class Network:
    """A fitted model."""

    def __init__(self, task: str, sizes: list[int], w: np.ndarray, shift: float = 0.0, scale: float = 1.0, scores: list[float] | None = None):
        self.task, self.sizes, self.w, self.shift, self.scale, self.scores = task, sizes, w, shift, scale, scores or []

    def outputs(self, x: np.ndarray) -> np.ndarray:
        out = outputs_of(forward(unpack(self.w, self.sizes), x)[-1], self.task)
        return out * self.scale + self.shift if self.task == "regression" else out

    def transform(self, df: DataFrame) -> DataFrame:
        return with_outputs(df, self.outputs, self.task)

    def to_json(self) -> str:
        return json.dumps({"task": self.task, "sizes": self.sizes, "w": self.w.tolist(), "shift": self.shift, "scale": self.scale, "scores": self.scores})

    @classmethod
    def from_json(cls, text: str) -> Network:
        d = json.loads(text)
        return cls(d["task"], d["sizes"], np.array(d["w"]), d["shift"], d["scale"], d["scores"])


class Perceptron:
    """An estimator of one or several training sets. A regression target is standardized inside."""

    def __init__(self, task: str, n_classes: int, params: Params):
        self.task, self.p = task, params
        self.out = n_classes if task == "classification" and n_classes > 2 else 1

    def hasParam(self, name: str) -> bool:  # as Spark's estimators
        return False

    def fit(self, train: DataFrame) -> Network:
        return self.fit_sets({0: train})[0]

    def fit_sets(self, trains: dict[int, DataFrame]) -> dict[int, Network]:
        """A model of each training set (features and label), trained side by side."""
        p, sets = self.p, {s: blocks.arrays(df) for s, df in trains.items()}
        facts = {r["set"]: r for r in blocks.united(sets).groupBy("set").agg(F.count("*").alias("n"), F.avg("y").alias("mean"), F.stddev_pop("y").alias("std"), F.max(F.size("a")).alias("width")).collect()}
        share = VALIDATION if p.early_stopping else 0.0
        states = {s: State(start([r["width"], *p.hidden, self.out], p.seed), max(1, min(MOST_BATCHES, round(r["n"] * (1 - share) / BATCH_ROWS)))) for s, r in facts.items()}
        sizes = {s: [r["width"], *p.hidden, self.out] for s, r in facts.items()}
        scale = {s: (r["mean"], r["std"] or 1.0) if self.task == "regression" else (0.0, 1.0) for s, r in facts.items()}
        table, rows, pieces = self._table(sets, states, scale, share, sum(r["n"] for r in facts.values()))
        rng = np.random.default_rng(p.seed)
        for epoch in range(p.max_iter + 1):
            order = rng.permutation(MOST_BATCHES)
            for step in range(max(s.batches for s in states.values())):
                own = {k: [b for b in order if b < s.batches][step] for k, s in states.items() if not s.over and step < s.batches}
                if not own:
                    continue
                found = self._step(rows, pieces, states, sizes, own, step == 0)
                for s, (g, loss, n, good, m) in found.items():
                    state = states[s]
                    if step == 0 and epoch:  # the weights are those after the last epoch
                        train_loss = sum(x for x, _ in state.loss) / max(1, sum(c for _, c in state.loss))
                        state.judge(good / m if p.early_stopping and m else -train_loss)
                        state.loss = []
                    if not state.over and epoch < p.max_iter and n:
                        state.loss.append((loss, n))
                        state.move((g + p.alpha * penalty(state.w, sizes[s])) / n, p.learning_rate)
            if all(s.over for s in states.values()):
                break
        rows.unpersist()
        drop(table)
        return {s: Network(self.task, sizes[s], st.kept if p.early_stopping and st.kept is not None else st.w, *scale[s], st.scores) for s, st in states.items()}

    def _table(self, sets: dict, states: dict, scale: dict, share: float, rows: int) -> tuple[DataFrame, RDD, int]:
        """Blocks of rows by mini-batch, as written and in memory; part -1 is for validation.

        Partitions are numbered by part, from the validation's on, and piece; the number of pieces is the last result.
        """
        pieces = max(1, math.ceil(rows / max(s.batches for s in states.values()) / PIECE_ROWS))

        def encode(s, x, y, h):
            mean, std = scale[s]
            u = (h >> np.uint64(11)).astype(float) / 2.0**53
            part = np.where(u < share, -1, ((u - share) / (1 - share) * states[s].batches).astype(int))
            for k in np.unique(part):
                own = part == k
                at = (int(k) + 1) * pieces + int(h[own][0] % np.uint64(pieces))
                yield s, int(k), at, int(own.sum()), np.ascontiguousarray(x[own]).tobytes(), ((y[own] - mean) / std).tobytes()

        table = cut(blocks.made_of(blocks.united(sets), rows, encode, "set int, part int, at int, n int, x binary, y binary"))
        placed = table.repartitionById((MOST_BATCHES + 1) * pieces, "at").drop("at")
        return table, placed.rdd.mapPartitions(_opened).persist(StorageLevel.MEMORY_AND_DISK), pieces

    def _step(self, rows: RDD, pieces: int, states: dict, sizes: dict, own: dict[int, int], first: bool) -> dict[int, list]:
        """Of each set: gradient, loss and rows of its mini-batch; and, in an epoch's first step, the validation score's sum and rows."""
        task, weights = self.task, {s: states[s].w for s in own}
        wanted = {(s, int(b)) for s, b in own.items()} | ({(s, -1) for s in own} if first else set())

        def sums(blocks_: Iterator[tuple]) -> Iterator[tuple]:
            found: dict[int, list] = {}
            for s, part, x, y in blocks_:
                if (s, part) not in wanted:
                    continue
                w = weights[s]
                r = found.setdefault(s, [np.zeros_like(w), 0.0, 0, 0.0, 0])
                z = forward(unpack(w, sizes[s]), x)[-1]
                if part < 0:
                    # share of variance explained, or of labels met; the target has variance 1
                    r[3] += float((1 - (z[:, 0] - y) ** 2).sum()) if task == "regression" else float((outputs_of(z, task).argmax(1) == y).sum())
                    r[4] += len(y)
                else:
                    r[0] = r[0] + gradient_sum(w, sizes[s], x, y, task)
                    r[1], r[2] = r[1] + loss_sum(z, y, task), r[2] + len(y)
            yield from found.items()

        places = [(part + 1) * pieces + i for part in sorted({part for _, part in wanted}) for i in range(pieces)]
        out: dict[int, list] = {}
        for at in range(0, len(places), _WAVE):
            for s, new in rows.context.runJob(rows, sums, places[at : at + _WAVE]):  # a gradient for each set and task
                out[s] = [a + b for a, b in zip(out[s], new)] if s in out else new
        return out


def _opened(rows: Iterator) -> Iterator[tuple]:
    """set, part, features and labels of blocks, some put together."""
    held: dict[tuple, list] = {}
    joined = lambda key: (*key, *(np.concatenate(v) for v in zip(*held[key])))
    for s, part, n, x, y in rows:
        own = held.setdefault((s, part), [])
        own.append((np.frombuffer(x).reshape(n, -1), np.frombuffer(y)))
        if sum(len(v) for _, v in own) >= _TOGETHER:
            yield joined((s, part))
            held[s, part] = []
    yield from (joined(key) for key, own in held.items() if own)
