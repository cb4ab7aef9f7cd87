"""Whole texts as numpy arrays, for use inside Spark tasks.

A batch of texts is one byte buffer in which a line feed follows each text, so that no word
spans two texts; words, their hashes and windows of words are then array operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that end a word `[^\x20\x09-\x0D]+`.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
SPACED = np.ones(256, bool)
SPACED[list(SPACES)] = False
#: Bytes of a word `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of a lower-cased text.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_SEGMENT = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_BYTES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [x or b"" for x in pc.cast(column, pa.large_binary()).to_pylist()]


def pieces(batch: pa.RecordBatch | pa.Table, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch | pa.Table]:
    """Slices whose texts have about `limit` bytes together; a longer text is a slice of its own."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size, dtype=np.int64) // limit
    cut = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
        yield batch.slice(a, b - a)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The buffer, and where each text starts in it (one entry more than texts)."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    return np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)[: at[-1]], at


def spans(data: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words: maximal runs of bytes for which `word` is true."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = word[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    return edge[0::2], edge[1::2]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which each bit depends on all."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of polynomial hashes, and of its inverse, n of them at least."""
    if len(_powers[0]) < n:
        n = max(n, _SEGMENT + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for k, base in enumerate((_BASE, inverse)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes. Memory is that of a segment, or of the longest word."""
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        base = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, base + _SEGMENT, "right")))
        n = int(ends[hi - 1] - base)
        power, inverse = powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[data[base : base + n]] * power[:n], out=total[1:])
        s, e = starts[lo:hi] - base, ends[lo:hi] - base
        h = (total[e] - total[s]) * inverse[s]
        out[lo:hi] = mix(h + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        lo = hi
    return out


def window_hashes(h: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of `width` words, texts' ends ignored (see `full`)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.full(n, np.uint64(0x243F6A8885A308D3) ^ np.uint64(seed), np.uint64)
    for k in range(width):
        acc ^= h[k : k + n]
        acc *= np.uint64(0xFF51AFD7ED558CCD)
        acc ^= acc >> np.uint64(32)
    return mix(acc)


def full(first: np.ndarray, width: int) -> np.ndarray:
    """Words at which a whole window of their own text starts; first: each text's first word, and the end."""
    n = int(first[-1])
    ends = np.repeat(first[1:], np.diff(first))
    return np.flatnonzero(np.arange(n) + width <= ends)


def covered(at: np.ndarray, width: np.ndarray | int, n: int) -> np.ndarray:
    """Which of n words lie in a window that starts in `at`."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + width, -1)
    return np.cumsum(step[:-1]) > 0


def distinct(codes: np.ndarray, bits: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, and which of them each is: through a hash table, and by sorting what collides there."""
    slot = (codes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)
    table = np.zeros(1 << bits, np.uint64)
    table[slot] = codes
    first = table[slot] == codes
    used = np.zeros(1 << bits, bool)
    used[slot] = True
    number = np.cumsum(used) - 1
    rest, back = np.unique(codes[~first], return_inverse=True)
    of = number[slot]
    of[~first] = back + int(used.sum())
    return np.concatenate([table[used], rest]), of


def grouped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, a place where each is, and which of them each value is; by one sort."""
    order = np.argsort(values)
    there = values[order]
    new = np.ones(len(values), bool)
    new[1:] = there[1:] != there[:-1]
    of = np.empty(len(values), np.int64)
    of[order] = np.cumsum(new) - 1
    return there[new], order[new], of


def prefix_hashes(data: np.ndarray, word: np.ndarray) -> np.ndarray:
    """For each byte, a 64-bit hash of the bytes of its word before it; a byte that ends a word has that of the whole word."""
    out = np.empty(len(data), np.uint64)
    start = np.where(word[data], 0, np.arange(1, len(data) + 1))
    start = np.concatenate([[0], np.maximum.accumulate(start)[:-1]]) if len(data) else start
    lo = 0
    while lo < len(data):
        # a segment begins at a word
        hi = len(data) if len(data) - lo <= _SEGMENT else max(int(start[lo + _SEGMENT]), lo)
        if hi <= lo:  # a word longer than a segment
            later = np.flatnonzero(start[lo + _SEGMENT :] > lo)
            hi = lo + _SEGMENT + int(later[0]) if len(later) else len(data)
        power, inverse = powers(hi - lo + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTES[data[lo:hi]] * power[: hi - lo], out=total[1:])
        s = start[lo:hi] - lo
        out[lo:hi] = mix((total[:-1] - total[s]) * inverse[s])
        lo = hi
    return out
