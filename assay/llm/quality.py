"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

Terms are hashed trigrams of a text's shape (letters, capitals, digits and white space by class,
marks as they are), hashed words, and repetition of words. Their weights in a bounded, documented
sample of labelled texts give a truncated singular value decomposition; each text's vector is
compared with all labelled vectors, block by block, and the labels of the nearest are averaged by
similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm import text
from assay.llm.language_id import held_out

SHAPES, WORDS, REPEATS = 2048, 512, 8
TERMS = SHAPES + WORDS + REPEATS
_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[65:91], _CLASS[97:123], _CLASS[128:], _CLASS[48:58] = 1, 2, 2, 3
_CLASS[list(text.SPACES)] = 4


def terms(texts: list[bytes]) -> np.ndarray:
    """A row for each text: square roots of its terms' shares, each kind of term by itself."""
    n = len(texts)
    data, at = text.joined(texts)
    doc = np.repeat(np.arange(n), np.diff(at))
    shape = _CLASS[data]
    code = (shape[:-2] << np.uint64(16) | shape[1:-1] << np.uint64(8) | shape[2:]) if len(shape) > 2 else np.zeros(0, np.uint64)
    inside = doc[: len(code)] == doc[2:] if len(code) else np.zeros(0, bool)
    slot = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(53)).astype(np.int64)
    parts = [np.bincount(doc[: len(code)][inside] * SHAPES + slot[inside], minlength=n * SHAPES).reshape(n, SHAPES)]
    folded = np.frombuffer(data.tobytes().lower(), np.uint8)
    starts, ends = text.spans(folded, text.SPACED)
    first = np.searchsorted(starts, at)
    words, owner = text.word_hashes(folded, starts, ends), np.repeat(np.arange(n), np.diff(first))
    parts.append(np.bincount(owner * WORDS + (words >> np.uint64(55)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS))
    repeats = np.zeros((n, REPEATS))
    count = np.maximum(np.diff(first), 1)
    for k in range(REPEATS // 2):  # words equal to the one k + 1 before
        step = k + 1
        if len(words) > step:
            same = (words[step:] == words[:-step]) & (owner[step:] == owner[:-step])
            repeats[:, k] = np.bincount(owner[step:][same], minlength=n) / count
            repeats[:, REPEATS // 2 + k] = 1 - repeats[:, k]
    shares = [p / np.maximum(p.sum(axis=1, keepdims=True), 1) for p in parts]
    return np.sqrt(np.concatenate([*shares, np.where(np.diff(first)[:, None] > 0, repeats, 0)], axis=1)).astype(np.float32)


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def main_axes(rows: np.ndarray, dimensions: int, rounds: int = 8) -> np.ndarray:
    """The right singular vectors of the largest singular values, by iteration on a random subspace of fixed seed."""
    found = np.random.default_rng(0).standard_normal((rows.shape[1], dimensions + 16)).astype(np.float32)
    for _ in range(rounds):
        found, _ = np.linalg.qr(rows.T @ (rows @ found))
    _, _, turn = np.linalg.svd(rows @ found, full_matrices=False)
    axes = found @ turn[:dimensions].T
    return np.pad(axes, ((0, 0), (0, dimensions - axes.shape[1])))


@dataclass
class Voters:
    weights: np.ndarray  # of the terms
    axes: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # unit rows of the labelled texts
    labels: np.ndarray
    prior: float
    neighbours: int
    power: float

    def project(self, rows: np.ndarray) -> np.ndarray:
        return unit((rows * self.weights) @ self.axes)

    def score(self, texts: list[bytes], block: int = 128) -> np.ndarray:
        """Share of label 1 among the nearest labelled texts, weighted by similarity."""
        out = np.full(len(texts), self.prior)
        if not len(self.labels):
            return out
        k = min(self.neighbours, len(self.labels))
        for lo in range(0, len(texts), block):
            cosine = self.project(terms(texts[lo : lo + block])) @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.clip(np.take_along_axis(cosine, near, axis=1), 0, 1).astype(np.float64) ** self.power
            total = weight.sum(axis=1)
            vote = (weight * self.labels[near]).sum(axis=1)
            out[lo : lo + block] = np.where(total > 0, vote / np.maximum(total, 1e-300), self.prior)
        return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4096, dimensions: int = 64, neighbours: int = 25, power: float = 8.0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Voters:
    """Voters from at most `sample` labelled rows: those whose hashed doc_id is smallest.

    A doc_id with several labels has their mean; rows without label or doc_id don't teach.
    """
    chosen = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("label")).where("doc_id is not null and label is not null")
    chosen = chosen.groupBy("doc_id").agg(F.avg("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most `sample` rows of 16 bytes
    taught = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.pieces(batch, "text", 1 << 20):
                rows = terms(text.as_bytes(part.column("text")))
                yield pa.record_batch([part.column("doc_id"), part.column("label"), pa.array([r.astype(np.float16).tobytes() for r in rows], pa.binary())], names=["doc_id", "label", "terms"])

    # rows that repeat a doc_id don't make the sample larger
    found = taught.mapInArrow(run, "doc_id long, label double, terms binary").groupBy("doc_id").agg(F.min("label").alias("label"), F.min("terms").alias("terms")).collect()
    found.sort(key=lambda r: r["doc_id"])
    rows = np.frombuffer(b"".join(r["terms"] for r in found), np.float16).astype(np.float32).reshape(len(found), TERMS)
    label = np.array([r["label"] for r in found])
    weights = np.log((1 + len(rows)) / (1 + (rows > 0).sum(axis=0))).astype(np.float32) + np.float32(0.5)
    rows *= weights
    axes = main_axes(rows, dimensions)
    voters = Voters(weights, axes, np.zeros((0, dimensions), np.float32), label, float(label.mean()) if len(label) else 0.5, neighbours, power)
    voters.vectors = unit(rows @ axes)
    return voters


def fit_apart(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2, id_col: str = "doc_id", **fitting) -> Voters:
    """Voters that never saw a doc_id whose CRC-32 as text is `remainder` modulo `modulus`."""
    learns = ~held_out(F.col(id_col), modulus, remainder)
    return fit(docs.where(learns), labels.where(learns), id_col=id_col, **fitting)


def column(docs: DataFrame, voters: Voters, text_col: str = "text") -> Column:
    """The score of each row's text, to filter docs by."""
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        voters = shared.value
        for batch in batches:
            yield pd.Series(np.concatenate([voters.score(text.as_bytes(p.column("text"))) for p in text.pieces(pa.table({"text": pa.array(batch, pa.large_string())}), "text", 1 << 20)] or [np.zeros(0)]))

    return scored(F.col(text_col))


def score(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2, threshold: float = 0.7, voters: Voters | None = None, id_col: str = "doc_id", text_col: str = "text", **fitting) -> DataFrame:
    """doc_id, held_out, score and predicted (score at least `threshold`); a row for each row of docs.

    Labels are learned only from doc_ids whose CRC-32 as text isn't `remainder` modulo `modulus`.
    Null counts as empty; an empty text, and any text if nothing was learned, gets what its vector
    is nearest to, or the mean label (0.5 without labels). Repeated rows stay as they are; columns
    other than doc_id and text are not read; an empty table gives an empty table.
    """
    if voters is None:
        voters = fit_apart(docs, labels, modulus, remainder, id_col=id_col, text_col=text_col, **fitting)
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = shared.value
        for batch in batches:
            for part in text.pieces(batch, "text", 1 << 20):
                s = voters.score(text.as_bytes(part.column("text")))
                yield pa.record_batch([part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), held_out(F.col(id_col), modulus, remainder).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
