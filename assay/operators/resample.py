"""Bootstrap scores of predictions without a row for each resample.

A task draws the weights of all resamples for some rows at a time, as a matrix, and keeps only sums
of its products with what a metric needs: a few numbers for each resample and model, or for AUC
counts by ranges of scores. What is shuffled are these sums, whose size does not depend on the rows.

Two kinds of weights: Poisson(1) numbers hashed from each row's key, and exact draws of n of n rows,
which are split down a tree of buckets by conditional binomials, so that each bucket draws its own
and a resample's weights add to n.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions.portable import text_hash
from assay.operators.rank import cuts_of, rank_by_hash

#: Resamples that share one digest of a row, 8 hexadecimal digits each.
SHARED = 4
#: Rows whose weights are in memory together.
_ROWS = 512
#: Rows that a task has at least, where there are as many.
TASK_ROWS = 1 << 15
#: Resamples that travel together.
_CHUNK = 250
BUCKET = 1024
_SUMS = "model string, chunk int, sums binary"


def poisson_bounds(most: int = 12) -> np.ndarray:
    """32-bit numbers from which on a Poisson(1) number is 1, 2, ... at least."""
    total, term, out = 0.0, 0.36787944117144233, []
    for k in range(most):
        total += term
        term /= k + 1
        if (bound := math.ceil(total * 2**32)) < 2**32:
            out.append(bound)
    return np.array(out, np.uint32)


def md5_words(m: np.ndarray) -> np.ndarray:
    """The four words of MD5 of many messages of one padded block each, by columns; m: 16 words x messages, all 32 bits, little-endian."""
    start = [np.uint32(v) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(m.shape[1], v) for v in start)
    for i in range(64):
        k = i // 16
        f = [lambda: d ^ (b & (c ^ d)), lambda: c ^ (d & (b ^ c)), lambda: b ^ c ^ d, lambda: c ^ (b | ~d)][k]()
        f += a
        f += np.uint32(int(abs(math.sin(i + 1)) * 2**32))
        f += m[(i, 5 * i + 1, 3 * i + 5, 7 * i)[k] % 16]
        turn = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))[k][i % 4]
        a, b, c, d = d, b + ((f << np.uint32(turn)) | (f >> np.uint32(32 - turn))), b, c
    return np.stack([x + v for x, v in zip((a, b, c, d), start)])


def digests(heads: list[bytes], keys: list[bytes]) -> np.ndarray:
    """MD5 of each key behind each head: keys x heads x 4 words, read as big-endian. What fits one block goes by arrays."""
    out = np.empty((len(keys), len(heads), 4), np.uint32)
    alike = lambda texts: {n: [i for i, t in enumerate(texts) if len(t) == n] for n in {len(t) for t in texts}}.items()
    by_head, each = alike(heads), max(1, (1 << 15) // max(1, len(heads)))
    for k, own in alike(keys):
        for at in range(0, len(own), each):
            mine = own[at : at + each]
            m, text = np.zeros((len(mine), len(heads), 64), np.uint8), np.frombuffer(b"".join(keys[i] for i in mine), np.uint8).reshape(-1, 1, k)
            for h, first in by_head:
                if h + k <= 55:
                    m[:, first, :h] = np.frombuffer(b"".join(heads[j] for j in first), np.uint8).reshape(1, -1, h)
                    m[:, first, h : h + k], m[:, first, h + k], m[:, first, 56], m[:, first, 57] = text, 0x80, 8 * (h + k) % 256, 8 * (h + k) // 256
            out[mine] = md5_words(np.ascontiguousarray(m.reshape(-1, 64).view("<u4").T)).T.byteswap().reshape(len(mine), len(heads), 4)
            for h, first in by_head:
                if h + k > 55:
                    found = b"".join(hashlib.md5(heads[j] + keys[i]).digest() for i in mine for j in first)
                    out[np.ix_(mine, first)] = np.frombuffer(found, ">u4").reshape(len(mine), len(first), 4)
    return out


def poisson_weights(keys: list[str], n_boot: int, seed: int) -> np.ndarray:
    """A row of Poisson(1) numbers for each key: of MD5 of (seed, four resamples, key)."""
    heads = [f"{seed}|{b}".encode() for b in range(-(-n_boot // SHARED))]
    found = digests(heads, [k.encode() for k in keys])
    return np.searchsorted(poisson_bounds(), found.reshape(len(keys), -1)[:, :n_boot], "right")


def key_weights(n_boot: int, seed: int) -> Callable:
    """Of a batch with column key, each row's weights, drawn once for each key."""

    def weights(part: pa.RecordBatch) -> np.ndarray:
        coded = part.column("key").dictionary_encode()
        return poisson_weights(coded.dictionary.to_pylist(), n_boot, seed).astype(np.uint8)[coded.indices.to_numpy()]

    return weights


def bucket_draws(bucket: int, rows: int, n_boot: int, seed: int, width: int = BUCKET) -> np.ndarray:
    """How many of each resample's `rows` draws fall to a bucket, of `width` rows but for the last.

    From the root, a node's draws are split by a binomial between the halves of its buckets; all
    buckets below a node see the same split, for it depends on seed and node only.
    """
    low, high, draws = 0, -(-rows // width), np.full(n_boot, rows, np.int64)
    size = lambda a, b: min(b * width, rows) - a * width
    while high - low > 1:
        mid = (low + high) // 2
        left = np.random.default_rng([seed, low, high]).binomial(draws, size(low, mid) / size(low, high))
        low, high, draws = (low, mid, left) if bucket < mid else (mid, high, draws - left)
    return draws


def bucket_weights(bucket: int, rows: int, n_boot: int, seed: int, width: int = BUCKET) -> np.ndarray:
    """A row of weights for each row of the bucket; columns add to the bucket's draws."""
    mine = min(width, rows - bucket * width)
    draws = bucket_draws(bucket, rows, n_boot, seed, width)
    return np.random.default_rng([seed, bucket]).multinomial(draws, np.full(mine, 1 / mine)).T


class Needs:
    """What a metric sums over rows, and what it makes of the sums."""

    def __init__(self, metric: str, classes: int = 2, cuts: list[list[float]] | None = None):
        self.metric, self.classes, self.cuts = metric, classes, [np.array(c[1:-1]) for c in cuts or []]
        self.bins = max((len(c) + 1 for c in self.cuts), default=0)

    @property
    def width(self) -> int:
        """Numbers for each resample."""
        if self.metric == "roc_auc":
            return len(self.cuts) * 2 * self.bins
        return {"accuracy": 2, "f1_macro": 3 * self.classes}.get(self.metric, 5)

    def add(self, sums: np.ndarray, w: np.ndarray, y: np.ndarray, score: np.ndarray) -> None:
        """Adds rows to sums (width x resamples); w: rows x resamples; score: a number or probabilities by class."""
        if self.metric == "roc_auc":
            for k, cuts in enumerate(self.cuts):
                own, pos = (score[:, k], y == k) if len(self.cuts) > 1 else (score, y == 1)
                cell = (k * 2 + pos) * self.bins + np.searchsorted(cuts, own, "right")
                for c, row in zip(cell.tolist(), w):
                    sums[c] += row
            return
        if self.metric in ("accuracy", "f1_macro"):
            p = score.argmax(axis=1) if score.ndim == 2 else (score >= 0.5).astype(int)
            y = y.astype(int)
            if self.metric == "accuracy":
                v = [np.ones(len(y)), p == y]
            else:
                v = [x for k in range(self.classes) for x in ((y == k) & (p == k), y == k, p == k)]
        else:
            e = y - score
            v = [np.ones(len(y)), e * e, np.abs(e), y, y * y]
        sums += np.stack(v).astype(float) @ w.astype(float)

    def values(self, sums: np.ndarray) -> np.ndarray:
        """The metric of each resample; NaN where it has none."""
        with np.errstate(all="ignore"):
            if self.metric == "roc_auc":
                each = []
                for k in range(len(self.cuts)):
                    neg, pos = (sums[(2 * k + s) * self.bins : (2 * k + s + 1) * self.bins] for s in (0, 1))
                    all_pos, all_neg = pos.sum(axis=0), neg.sum(axis=0)
                    auc = (pos * (np.cumsum(neg, axis=0) - neg / 2)).sum(axis=0) / (all_pos * all_neg)
                    each.append(np.where((all_pos > 0) & (all_neg > 0), auc, np.nan))
                return np.mean(each, axis=0)
            if self.metric == "f1_macro":
                both, label, met = sums[0::3], sums[1::3], sums[2::3]
                return np.where(label + met > 0, 2 * both / (label + met), 0).mean(axis=0)
            n = sums[0]
            if self.metric == "accuracy":
                return sums[1] / n
            if self.metric == "mae":
                return sums[2] / n
            if self.metric == "rmse":
                return np.sqrt(sums[1] / n)
            spread = sums[4] - sums[3] ** 2 / n
            return np.where(spread > 1e-12 * np.abs(sums[4]), 1 - sums[1] / spread, np.nan)


def _sums(needs: Needs, n_boot: int, weights: Callable) -> Callable:
    """Of batches with model, label and score: a row for each model and chunk of resamples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                w = weights(part)
                models = np.array(part.column("model").to_pylist(), object)
                y = part.column("label").to_numpy(zero_copy_only=False).astype(float)
                score = part.column("score")
                score = score.flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1) if pa.types.is_list(score.type) else score.to_numpy(zero_copy_only=False)
                for m in dict.fromkeys(models.tolist()):
                    own = models == m
                    needs.add(sums.setdefault(m, np.zeros((needs.width, n_boot))), w[own], y[own], score[own])
        rows = [(m, c, np.ascontiguousarray(s[:, c * _CHUNK : (c + 1) * _CHUNK]).tobytes()) for m, s in sums.items() for c in range(-(-n_boot // _CHUNK))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.binary()))], ["model", "chunk", "sums"])

    return run


def _valued(needs: Needs) -> Callable:
    """Sums of all tasks, by model and chunk, to rep, model and value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for m, c, s in zip(*[batch.column(x).to_pylist() for x in ("model", "chunk", "sums")]):
                own = np.frombuffer(s).reshape(needs.width, -1)
                found[m, c] = found[m, c] + own if (m, c) in found else own
        for (m, c), s in found.items():
            v = needs.values(s)
            yield pa.RecordBatch.from_arrays([pa.array(c * _CHUNK + np.arange(len(v)), pa.int32()), pa.array([m] * len(v)), pa.array(v, pa.float64(), from_pandas=True)], ["rep", "model", "value"])

    return run


def _scored(rows: DataFrame, needs: Needs, n_boot: int, weights: Callable) -> DataFrame:
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    partial = rows.coalesce(tasks).mapInArrow(_sums(needs, n_boot, weights), _SUMS)
    return partial.repartition("model", "chunk").mapInArrow(_valued(needs), "rep int, model string, value double")


def _prepared(preds: DataFrame, metric: str, classes: int, bins: int) -> tuple[DataFrame, Needs]:
    """preds with label and score alone of what a metric reads, and what it needs; AUC takes `bins` ranges of scores, over all classes together."""
    several = "probs" in preds.columns
    rows = preds.withColumns({"label": F.col("label").cast("double"), "score": F.col("probs").cast("array<double>") if several else F.col("score").cast("double")})
    if metric != "roc_auc":
        return rows, Needs(metric, classes)
    each = max(100, bins // classes) if several else bins
    sources = [preds.select(F.col("probs")[k].alias("score")) for k in range(classes)] if several else [preds]
    return rows, Needs(metric, classes, [cuts_of(s, "score", each, 100 * each) for s in sources])


def poisson_scores(preds: DataFrame, metric: str, keys: list[str], n_boot: int, seed: int = 0, classes: int = 2, bins: int = 1000) -> DataFrame:
    """rep, model and value: the metric under Poisson(1) weights, alike for all models of a key; null where it has no value."""
    rows, needs = _prepared(preds, metric, classes, bins)
    rows = rows.select("model", "label", "score", F.concat_ws("|", F.lit(""), *[F.col(k).cast("string") for k in keys]).alias("key"))
    # all models' rows of a key meet, so that its weights are drawn once; no more tasks than run at a time, for each has sums of all models
    session = rows.sparkSession
    tasks = min(int(session.conf.get("spark.sql.shuffle.partitions")), max(2, session.sparkContext.defaultParallelism), math.ceil((preds.count() + 1) / TASK_ROWS))
    return _scored(rows.repartition(tasks, "key").sortWithinPartitions("key"), needs, n_boot, key_weights(n_boot, seed))


def multinomial_scores(preds: DataFrame, metric: str, keys: list[str], n_boot: int, seed: int = 0, classes: int = 2, bins: int = 1000, width: int = BUCKET) -> DataFrame:
    """The same under exact draws: each resample's weights, alike for all models of a key, add to the number of keys."""
    rows, needs = _prepared(preds, metric, classes, bins)
    ranked = rank_by_hash(preds.select(*keys).distinct(), text_hash(seed, *keys), keys, name="_row")
    n = ranked.count()
    # nulls in keys are keys
    met = rows.alias("l").join(ranked.alias("r"), [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])
    placed = met.select("model", "label", "score", (F.col("_row") - 1).cast("long").alias("row"))
    placed = placed.withColumn("bucket", F.floor(F.col("row") / width)).repartition("bucket").sortWithinPartitions("bucket")
    last: list = [None, None]

    def weights(part: pa.RecordBatch) -> np.ndarray:
        row = part.column("row").to_numpy()
        out = np.empty((len(row), n_boot), np.int64)
        for b in np.unique(row // width):
            if last[0] != b:
                last[:] = [b, bucket_weights(int(b), n, n_boot, seed, width)]
            own = row // width == b
            out[own] = last[1][row[own] % width]
        return out

    return _scored(placed, needs, n_boot, weights)
