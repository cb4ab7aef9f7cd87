"""Questions from chunks of documents to slices of a hash space, and the answers back.

Hashes of the whole corpus are never in one place and never broadcast. Documents are dealt into
chunks of bounded size; each chunk sends each slice of the hash space one packed, sorted list of
its distinct keys; a slice sees all chunks' lists, answers each, and the answers return to the
chunks. A key that occurs everywhere is one entry per chunk, so that no slice is hot.
"""

from __future__ import annotations

import math

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts."""
    return int(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0)


def chunked(docs: DataFrame, total: int, chunk_bytes: int = 6 << 20, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text and chunk, a hash of both; rows alike in both share a chunk, other copies don't."""
    n = max(1, math.ceil(total / chunk_bytes))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text).alias("text"),
        F.pmod(F.xxhash64(F.col(id_col), F.col(text)), F.lit(n)).cast("int").alias("chunk"),
    )


def slice_of(h: np.ndarray, n: int) -> np.ndarray:
    """The slice of each hash: in order of the hashes, of about equal share."""
    return ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def cuts(slices: np.ndarray) -> list[tuple[int, int, int]]:
    """(slice, from, to) for each run in sorted slices."""
    if not len(slices):
        return []
    edge = np.flatnonzero(slices[1:] != slices[:-1]) + 1
    return [(int(slices[a]), int(a), int(b)) for a, b in zip(np.concatenate([[0], edge]), np.concatenate([edge, [len(slices)]]))]


def pack(values: np.ndarray) -> bytes:
    """Integers byte plane by byte plane, compressed."""
    a = np.ascontiguousarray(values)
    return zstandard.compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes(), 1)


def unpack(data: bytes, dtype=np.uint64) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted 64-bit integers, as their gaps."""
    gaps = values.copy()
    gaps[1:] -= values[:-1]
    return pack(gaps)


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def pack_bits(bits: np.ndarray) -> bytes:
    return zstandard.compress(np.packbits(bits).tobytes(), 1)


def unpack_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zstandard.decompress(data), np.uint8), count=n).astype(bool)
