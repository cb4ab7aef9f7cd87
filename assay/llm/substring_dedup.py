"""Removal of passages that a document with a smaller doc_id has too.

A window is `width` consecutive words. First pass: each chunk of documents makes count-min
sketches of its windows, sparse and cut by slice of the sketch; a slice merges those of all chunks
and answers which cells hold two or more. The smallest count over the sketch's rows never
underestimates, so that no repeated window is lost. Second pass: only windows estimated repeated
go, with 96 bits of hash and the chunk's smallest doc_id, to an exact grouping, whose answers name
those that a smaller doc_id has.

Sketch, groups and answers are dealt over slices whose number grows with the input; nothing is
broadcast or collected.
"""

from __future__ import annotations

import math
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from assay.llm import route, text

LAST = np.iinfo(np.int64).max
_ASK = "slice int, chunk int, keys binary, more binary, ids binary"
_SCHEMA = pa.schema([("slice", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("more", pa.binary()), ("ids", pa.binary())])
_SEEDS = np.random.default_rng(7).integers(1, 2**63, 16, dtype=np.uint64)


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table(list(map(list, zip(*rows))) if rows else [[] for _ in _SCHEMA], schema=_SCHEMA)


class _Chunk:
    """Windows of a chunk: their starts and texts, and the distinct ones in order of hash."""

    def __init__(self, table: pa.Table, width: int):
        self.width, hashes, counts = width, [], []
        for part in text.pieces(table, "text"):
            data, at = text.joined(text.as_bytes(part.column("text")))
            starts, ends = text.spans(data, text.SPACED)
            hashes.append(text.word_hashes(data, starts, ends))
            counts.append(np.diff(np.searchsorted(starts, at)))
        self.words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.first = np.concatenate([[0], np.cumsum(np.concatenate(counts) if counts else np.zeros(0, np.int64))])
        self.starts = text.full(self.first, width)
        h = text.window_hashes(self.words, width)[self.starts] if len(self.starts) else np.zeros(0, np.uint64)
        self.order = np.argsort(h, kind="stable")
        h = h[self.order]
        self.head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        self.unique = h[self.head]
        self.count = np.diff(np.concatenate([self.head, [len(h)]]))

    def cells(self, row: int, slices: int, cells: int) -> np.ndarray:
        """Slice and cell of each distinct window in a row of the sketch."""
        g = text.mix(self.unique ^ _SEEDS[row])
        return (route.slice_of(g, slices) << np.uint64(32)) | (g & np.uint64(cells - 1))

    def ids(self, table: pa.Table) -> np.ndarray:
        """doc_id of each text; null comes after all others."""
        return table.column("doc_id").fill_null(LAST).to_numpy().astype(np.int64)

    def owners(self, ids: np.ndarray) -> np.ndarray:
        """Text of each window, in order of hash."""
        return np.searchsorted(self.first, self.starts[self.order], "right") - 1


def _sketch(slices: int, depth: int, cells: int, width: int):
    def ask(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        c, rows = _Chunk(table, width), []
        for row in range(depth):
            k = c.cells(row, slices, cells)
            k = np.sort(np.concatenate([k, k[c.count > 1]]))
            rows += [(row * slices + s, key[0].as_py(), route.pack_sorted(k[a:b] & np.uint64(0xFFFFFFFF)), None, None) for s, a, b in route.cuts(k >> np.uint64(32))]
        return _table(rows)

    return ask


def _merge(cells: int):
    def answer(table: pa.Table) -> pa.Table:
        """Adds up the chunks' sketches (two is as good as more); then, for each, which of its cells hold two."""
        counts, asked, out = np.zeros(cells, np.uint8), table.column("keys"), []
        for x in asked:
            k, n = np.unique(route.unpack_sorted(x.as_py()), return_counts=True)
            counts[k] = np.minimum(counts[k] + np.minimum(n, 2).astype(np.uint8), 2)
        for x, c, s in zip(asked, table.column("chunk").to_pylist(), table.column("slice").to_pylist()):
            out.append((s, c, route.pack_bits(counts[np.unique(route.unpack_sorted(x.as_py()))] > 1), None, None))
        return _table(out)

    return answer


def _repeated(slices: int, depth: int, cells: int, width: int):
    def ask(key: tuple[pa.Scalar, ...], docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _table([])
        chunk, c = key[0].as_py(), _Chunk(docs, width)
        got = dict(zip(answers.column("slice").to_pylist(), answers.column("keys").to_pylist()))
        often = np.ones(len(c.unique), bool)
        for row in range(depth):
            k, back = np.unique(c.cells(row, slices, cells), return_inverse=True)
            bits = [route.unpack_bits(got[row * slices + s], b - a) for s, a, b in route.cuts(k >> np.uint64(32))]
            often &= np.concatenate(bits)[back] if bits else False
        if not often.any():
            return _table([])
        smallest = np.minimum.reduceat(c.ids(docs)[c.owners(docs)], c.head)[often]
        second = text.window_hashes(c.words, width, 1)[c.starts[c.order[c.head[often]]]].astype(np.uint32)
        h, rows = c.unique[often], [(-1 - chunk, chunk, route.pack_bits(often), None, None)]
        for s, a, b in route.cuts(route.slice_of(h, slices)):
            rows.append((s, chunk, route.pack_sorted(h[a:b]), route.pack(second[a:b]), route.pack(smallest[a:b])))
        return _table(rows)

    return ask


def _smaller(table: pa.Table) -> pa.Table:
    """For each chunk's windows: whether another chunk has the same with a smaller doc_id. A chunk's own mask passes."""
    if table.column("slice")[0].as_py() < 0:
        return table
    asked = [route.unpack_sorted(x.as_py()) for x in table.column("keys")]
    h = np.concatenate(asked)
    second = np.concatenate([route.unpack(x.as_py(), np.uint32) for x in table.column("more")])
    ids = np.concatenate([route.unpack(x.as_py(), np.int64) for x in table.column("ids")])
    order = np.lexsort((second, h))
    a, b = h[order], second[order]
    head = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    least = np.repeat(np.minimum.reduceat(ids[order], head), np.diff(np.concatenate([head, [len(h)]])))
    bits = np.empty(len(h), bool)
    bits[order] = least < ids[order]
    cut = np.cumsum([len(x) for x in asked])[:-1]
    return _table([(s, c, route.pack_bits(x), None, None) for s, c, x in zip(table.column("slice").to_pylist(), table.column("chunk").to_pylist(), np.split(bits, cut))])


_OUT = "doc_id long, n_words long, n_removed long, text string"
_OUT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])


def _cut(slices: int, width: int):
    def apply(key: tuple[pa.Scalar, ...], docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _OUT_SCHEMA.empty_table()
        c, chunk = _Chunk(docs, width), key[0].as_py()
        got = dict(zip(answers.column("slice").to_pylist(), answers.column("keys").to_pylist()))
        drop = np.zeros(int(c.first[-1]), bool)
        if got:
            often = route.unpack_bits(got[-1 - chunk], len(c.unique))
            h = c.unique[often]
            elsewhere = np.zeros(len(c.unique), bool)
            elsewhere[often] = np.concatenate([route.unpack_bits(got[s], b - a) for s, a, b in route.cuts(route.slice_of(h, slices))])
            own = c.ids(docs)[c.owners(docs)]
            least = np.minimum.reduceat(own, c.head)
            again = (own > np.repeat(least, c.count)) | np.repeat(elsewhere, c.count)
            drop = text.covered(c.starts[c.order[again]], width, len(drop))
        n = np.diff(c.first)
        gone = np.diff(np.concatenate([[0], np.cumsum(drop)])[c.first])
        kept = []
        for t, a, b, g in zip((t for p in text.pieces(docs, "text") for t in text.as_bytes(p.column("text"))), c.first[:-1].tolist(), c.first[1:].tolist(), gone.tolist()):
            kept.append(b" ".join(compress(t.split(), (~drop[a:b]).tolist()) if g else t.split()).decode())
        return pa.table([docs.column("doc_id"), n, gone, pa.array(kept, pa.string())], schema=_OUT_SCHEMA)

    return apply


def remove_repeated_passages(docs: DataFrame, width: int = 13, depth: int = 2, cells_log2: int = 25, slice_windows: int = 4_000_000, chunk_bytes: int = 6 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and the text that is left, its words joined by one space; a row for each row of docs.

    Words are `[^\\x20\\x09-\\x0D]+`. A word goes if it lies in a window of `width` words that also
    starts in a row with a smaller doc_id; windows are judged on the input. Null and empty texts
    have no words and give an empty text. A null doc_id counts as larger than all others; rows of
    equal doc_id take nothing from each other. Other columns, whatever their names, are not read;
    an empty table gives an empty table. A chunk holds one text at least, so that the longest text
    bounds memory.
    """
    total = route.text_bytes(docs, text_col)
    slices, cells = max(1, math.ceil(total / 6 / slice_windows)), 1 << cells_log2
    dealt = route.chunked(docs, total, chunk_bytes, id_col, text_col)
    counted = dealt.groupBy("chunk").applyInArrow(_sketch(slices, depth, cells, width), _ASK).groupBy("slice").applyInArrow(_merge(cells), _ASK)
    judged = dealt.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(_repeated(slices, depth, cells, width), _ASK).groupBy("slice").applyInArrow(_smaller, _ASK)
    return dealt.groupBy("chunk").cogroup(judged.groupBy("chunk")).applyInArrow(_cut(slices, width), _OUT)
