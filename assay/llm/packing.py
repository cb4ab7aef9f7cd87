"""Harmonic packing of tokenized documents into sequences.

A piece of length L is of class k if L fits a k-th of the capacity and no (k+1)-th, and each bin of
class k takes k pieces. Documents are cut so that pieces nearly fill their share: while L leaves
more than a tolerance, a head of exactly capacity // (k+1) goes to class k+1 and the rest is
classed again. Each task fills its own bins, class by class, in one pass over its documents and
without a shuffle; what is in bins unfilled at its end is laid end to end into shared bins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from assay.llm import text

#: What a byte is: 0 white space, 1 part of a letter, 2 a mark, 3 a digit; and those that need the whole tokenizer.
_KIND = np.full(256, 2, np.uint8)
_KIND[list(text.SPACES)], _KIND[48:58] = 0, 3
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_ODD = np.zeros(256, bool)
_ODD[:32] = _ODD[39] = _ODD[127] = _ODD[192:] = True
_ODD[[*text.SPACES, 0xC3]] = False


class Encoder:
    """Ids as the tokenizer gives them, for texts of which most words repeat.

    This holds for tokenizers that drop white space, lower-case, and split letters, single digits
    and marks from each other. Such parts of plain words (ASCII but apostrophes and control bytes,
    letters from U+00C0 to U+00FF) are encoded once by the model; a word with anything else, a
    special token included, once by the whole tokenizer. Both are remembered by hash, up to a bound.
    """

    def __init__(self, path: str, remembered: int = 400_000):
        self.tokenizer, self.remembered = Tokenizer.from_file(path), remembered
        self.level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._forget()

    def _forget(self) -> None:
        self.known, self.from_, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _plain(self, raw: bytes) -> list[int]:
        part = raw.decode().lower()
        shown = part if part.isascii() else self.level.pre_tokenize_str(part)[0][0]
        return [t.id for t in self.tokenizer.model.tokenize(shown)]

    def _whole(self, raw: bytes) -> list[int]:
        return self.tokenizer.encode(raw.decode(), add_special_tokens=False).ids

    @staticmethod
    def parts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the parts of plain words and of other words as a whole; which are the latter."""
        odd = _ODD[data]
        odd[:-1] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
        odd[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)
        kind = _KIND[data]
        place = np.flatnonzero(odd)
        if len(place):
            starts, ends = text.spans(data, text.SPACED)
            word = np.unique(np.searchsorted(starts, place, "right") - 1)
            step = np.zeros(len(data) + 1, np.int8)
            step[starts[word]] = 1
            step[ends[word]] = -1
            kind[np.cumsum(step[:-1], dtype=np.int8) > 0] = 4
        edge = np.concatenate([[True], (kind[1:] != kind[:-1]) | (kind[1:] == 3)])
        starts = np.flatnonzero(edge)
        ends = np.concatenate([starts[1:], [len(data)]])
        inside = kind[starts] > 0
        return starts[inside], ends[inside], kind[starts[inside]] == 4

    def encode(self, texts: list[bytes], end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by `end`; where each text's ids start (and the end)."""
        data, at = text.joined(texts)
        starts, ends, odd = self.parts(data)
        first = np.searchsorted(starts, at)
        raw = data.tobytes()
        folded = data if b"<|" in raw else np.frombuffer(raw.lower(), np.uint8)
        keys, head, of = np.unique(text.word_hashes(folded, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) + len(keys) > self.remembered:
            self._forget()
        there = np.searchsorted(self.known, keys)
        new = np.ones(len(keys), bool)
        inside = there < len(self.known)
        new[inside] = self.known[there[inside]] != keys[inside]
        h = head[new]
        each = [self._whole(raw[a:b]) if o else self._plain(raw[a:b]) for a, b, o in zip(starts[h].tolist(), ends[h].tolist(), odd[h].tolist())]
        size = np.array([len(x) for x in each], np.int64)
        self.from_ = np.insert(self.from_, there[new], len(self.ids) + np.cumsum(size) - size)
        self.size, self.known = np.insert(self.size, there[new], size), np.insert(self.known, there[new], keys[new])
        self.ids = np.concatenate([self.ids, np.fromiter((i for x in each for i in x), np.uint32, int(size.sum()))])
        # the end is one more part after each text's last
        of = np.insert(np.searchsorted(self.known, keys)[of], first[1:], len(self.known))
        first = first + np.arange(len(first))
        flat = self.ids if end is None else np.append(self.ids, np.uint32(end))
        n = np.append(self.size, int(end is not None))[of]
        after = np.cumsum(n)
        found = flat[np.arange(int(after[-1]) if len(after) else 0) - np.repeat(after - n - np.append(self.from_, len(self.ids))[of], n)]
        return found, np.concatenate([[0], after])[first]


def classes(capacity: int) -> np.ndarray:
    """Pieces in a bin, of each class: all numbers up to 32, then ever larger steps."""
    k, out = 1, []
    while k <= capacity:
        out.append(k)
        k = k + 1 if k < 32 else k + max(1, k // 4)
    return np.array([*out, capacity] if out[-1] != capacity else out)


def cut(lengths: np.ndarray, capacity: int, tolerance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, class) of the pieces, in order of document and start."""
    k_of, out = classes(capacity), []
    share = capacity // k_of  # falls as the class grows
    doc, start = np.arange(len(lengths)), np.zeros(len(lengths), np.int64)
    whole = lengths // capacity
    if whole.any():
        d = np.repeat(doc, whole)
        s = (np.arange(len(d)) - np.repeat(np.cumsum(whole) - whole, whole)) * capacity
        out.append((d, s, np.full(len(d), capacity), np.zeros(len(d), np.int64)))
    start, left = whole * capacity, lengths - whole * capacity
    doc, start, left = doc[left > 0], start[left > 0], left[left > 0]
    while len(doc):
        c = np.searchsorted(-share, -left, "right") - 1  # the last class whose share holds it
        slack = capacity - k_of[c] * left
        fits = (slack <= tolerance) | (k_of[c] >= 32)
        out.append((doc[fits], start[fits], left[fits], c[fits]))
        doc, start, left, c = doc[~fits], start[~fits], left[~fits], c[~fits] + 1
        head = share[c]
        out.append((doc, start, head, c))
        start, left = start + head, left - head
    doc, start, length, c = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 4
    order = np.lexsort((start, doc))
    return doc[order], start[order], length[order], c[order]


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


class Packer:
    """A task's bins. Rows come back as soon as their bin's number and offset are known."""

    def __init__(self, task: int, capacity: int, tolerance: int):
        self.capacity, self.tolerance, self.base, self.bins = capacity, tolerance, task << 40, 0
        self.open: dict[int, list[tuple]] = {}

    def _bin(self) -> int:
        self.bins += 1
        return self.base + self.bins - 1

    def add(self, doc_ids: list, ids: np.ndarray, at: np.ndarray) -> list[tuple]:
        rows, total = [], np.diff(at)
        doc, start, length, c = cut(total, self.capacity, self.tolerance)
        raw, size = np.ascontiguousarray(ids, "<u4").tobytes(), classes(self.capacity)
        for d, s, n, k, a, t in zip(doc.tolist(), start.tolist(), length.tolist(), size[c].tolist(), (at[doc] + start).tolist(), total[doc].tolist()):
            waiting = self.open.setdefault(k, [])
            waiting.append((doc_ids[d], s, n, t, raw[4 * a : 4 * (a + n)]))
            if len(waiting) == k:
                number, offset = self._bin(), 0
                for i, s, n, t, x in waiting:
                    rows.append((i, s, n, t, number, offset, x))
                    offset += n
                self.open[k] = []
        return rows

    def close(self) -> list[tuple]:
        """Pieces of unfilled bins end to end, cut where a bin is full."""
        rows, number, offset = [], None, 0
        for i, s, n, t, x in (p for k in sorted(self.open) for p in self.open[k]):
            while n:
                if number is None or offset == self.capacity:
                    number, offset = self._bin(), 0
                m = min(n, self.capacity - offset)
                rows.append((i, s, m, t, number, offset, x[: 4 * m]))
                s, n, x, offset = s + m, n - m, x[4 * m :], offset + m
        return rows


def pack(docs: DataFrame, tokenizer: str, end: int | None = 1, capacity: int = 2048, tolerance: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset and ids (little-endian unsigned 32-bit); a row for each piece.

    tokenizer: a file readable on every executor. A document's tokens are its text's ids and `end`;
    each is in one piece. A sequence has `capacity` tokens at most, its pieces gapless from offset
    0. A null text counts as empty and has only the end. Rows with null or repeated doc_id are
    packed like any other; other columns are not read; an empty table gives no pieces. A task holds
    one text at least, so that the longest text bounds memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        packer = Packer(TaskContext.get().partitionId(), capacity, tolerance)
        for batch in batches:
            for part in text.pieces(batch, "text", 3 << 20):
                ids, at = encoder.encode(text.as_bytes(part.column("text")), end)
                yield _batch(packer.add(part.column("doc_id").to_pylist(), ids, at))
        yield _batch(packer.close())

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * len(_SCHEMA), _SCHEMA)], schema=_SCHEMA)


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One for each Python worker, which runs many tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
