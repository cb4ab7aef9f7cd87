"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1, made from its code point. A trigram's vector is the
product of its letters' vectors, those of the first and second letter permuted (rotated) twice and
once; a text's is the sum over its trigrams, a language's the sum over its texts, each by its
trigrams' shares. A text gets the language whose vector has the largest cosine with its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm import text

#: Fixed-point digits of what tasks add up, so that sums don't depend on their order.
_SCALE = 1 << 24
_letters = np.full(0x110000, -1, np.int32)
_vectors: dict[tuple[int, int], np.ndarray] = {}


def letters(points: np.ndarray) -> np.ndarray:
    """Lower-cased letters of code points; 0 for what is no letter."""
    out = _letters[points]
    for c in np.unique(points[out < 0]).tolist():
        _letters[c] = ord(chr(c).lower()[0]) if chr(c).isalpha() else 0
    return _letters[points]


def letter_vector(letter: int, size: int) -> np.ndarray:
    """Of +1 and -1, by the letter alone; 0 is the end of a word."""
    key = (letter, size)
    if key not in _vectors:
        if len(_vectors) > 1 << 15:
            _vectors.clear()
        _vectors[key] = np.random.default_rng([0x1D, letter]).integers(0, 2, size, dtype=np.int8) * 2 - 1
    return _vectors[key]


def trigram_vectors(codes: np.ndarray, size: int) -> np.ndarray:
    each = [(codes >> np.uint64(s)) & np.uint64(0x1FFFFF) for s in (42, 21, 0)]
    known, of = np.unique(np.concatenate(each), return_inverse=True)
    table = np.array([letter_vector(int(c), size) for c in known]).reshape(len(known), size)
    a, b, c = np.split(of, 3)
    return np.roll(table, 2, axis=1)[a] * np.roll(table, 1, axis=1)[b] * table[c]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct trigrams of some texts; for each trigram that occurs, which it is and its text.

    Words are runs of letters, with their two ends; a trigram has a letter in the middle.
    """
    joined = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    found = np.concatenate([[0], letters(joined), [0]]).astype(np.uint64)
    middle = np.flatnonzero(found[1:-1])
    code = found[middle] << np.uint64(42) | found[middle + 1] << np.uint64(21) | found[middle + 2]
    known, of = text.distinct(code, 18)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return known, of, np.searchsorted(ends, middle, "right")


def bundles(known: np.ndarray, of: np.ndarray, owner: np.ndarray, weight: np.ndarray, n: int, size: int, block: int = 2048, owners: int = 256) -> np.ndarray:
    """Sum of the vectors of each owner's trigrams, each `weight` times; a block of trigrams and of owners at a time, however many there are."""
    out = np.zeros((n, size))
    order = np.argsort(of, kind="stable")
    edge = np.searchsorted(of[order], np.arange(0, len(known) + block, block))
    for k, (a, b) in enumerate(zip(edge[:-1], edge[1:])):
        codes, mine = known[k * block : (k + 1) * block], order[a:b]
        if not len(mine):
            continue
        vectors = trigram_vectors(codes, size).astype(np.float64)
        at = np.argsort(owner[mine], kind="stable")
        mine = mine[at]
        for lo in range(int(owner[mine[0]]) // owners * owners, int(owner[mine[-1]]) + 1, owners):
            x, y = np.searchsorted(owner[mine], [lo, lo + owners])
            part = mine[x:y]
            if len(part):
                m = min(owners, n - lo)
                out[lo : lo + m] += np.bincount((owner[part] - lo) * len(codes) + of[part] - k * block, weight[part], m * len(codes)).reshape(m, -1) @ vectors
    return out


@dataclass
class Profiles:
    languages: list[str]
    vectors: np.ndarray  # a unit row for each language

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each text's language (-1: it has no letter, or none is known) and cosine."""
        best, score = np.full(len(texts), -1), np.zeros(len(texts))
        known, of, doc = trigrams(texts)
        if not len(known) or not self.languages:
            return best, score
        own = bundles(known, of, doc, np.ones(len(of)), len(texts), self.vectors.shape[1])
        some = np.unique(doc)
        length = np.linalg.norm(own[some], axis=1)
        cosine = (own[some] @ self.vectors.T) / np.maximum(length, 1e-30)[:, None]
        best[some], score[some] = cosine.argmax(axis=1), cosine.max(axis=1)
        return best, np.clip(score, 0, 1)


def _strings(column) -> list[str]:
    return [x.decode() for x in text.as_bytes(column)]


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """By the CRC-32 of doc_id as text; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def fit(docs: DataFrame, size: int = 1024, lang_col: str = "lang", text_col: str = "text") -> Profiles:
    """Profiles of the languages of all rows that have both. Tasks send one vector for each language they meet."""

    def bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in text.pieces(batch, "text", 2 << 20):
                known, of, doc = trigrams(_strings(part.column("text")))
                if not len(known):
                    continue
                langs = part.column("lang").to_pylist()
                names = sorted(set(langs))
                number = np.array([names.index(x) for x in langs])
                share = 1.0 / np.bincount(doc, minlength=len(langs))[doc]
                for name, v in zip(names, bundles(known, of, number[doc], share, len(names), size)):
                    total[name] = total.get(name, 0) + np.rint(v * _SCALE).astype(np.int64)
        yield pa.record_batch([pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.int64()))], names=["lang", "v"])

    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    sums = rows.mapInArrow(bundled, "lang string, v array<long>").select("lang", F.posexplode("v").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    found: dict[str, np.ndarray] = {}
    for r in sums.toLocalIterator():
        found.setdefault(r["lang"], np.zeros(size))[r["k"]] = r["x"]
    names = sorted(found)
    v = np.array([found[n] for n in names]).reshape(len(names), size)
    return Profiles(names, v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30))


def identify(docs: DataFrame, modulus: int = 3, remainder: int = 1, profiles: Profiles | None = None, size: int = 1024, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score (the cosine, 0 to 1); a row for each row of docs.

    Learning is from rows with text and language whose CRC-32 of doc_id as text isn't `remainder`
    modulo `modulus` (a null doc_id counts as empty text). A text that is null or has no letter is
    `und` with score 0, and so are all if no language is known. Of equal cosines the first language
    in order of name wins. Repeated rows count and stay as they are; other columns are not read; an
    empty table gives an empty table.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), held_out(F.col(id_col), modulus, remainder).alias("held_out"))
    if profiles is None:
        profiles = fit(docs.where(~held_out(F.col(id_col), modulus, remainder)), size, lang_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = shared.value
        names = np.array([*profiles.languages, "und"], object)
        for batch in batches:
            for part in text.pieces(batch, "text", 2 << 20):
                best, score = profiles.predict(_strings(part.column("text")))
                yield pa.record_batch([part.column("doc_id"), part.column("held_out"), pa.array(names[best].tolist(), pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
