"""Benchmark decontamination by suffix arrays of the training texts.

A shard is a few megabytes of documents. Its suffix array orders every word position by the words
that follow, to a depth of a window at least and within its document. All windows of the benchmark
are binary-searched in each shard; the interval found lists the places where the window occurs
verbatim. Nothing is shuffled: the benchmark goes to the shards in groups of blocks, whose size is
bounded; a shard's array is built once for all blocks of a group, and a larger benchmark takes more
passes over the documents, never more memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm import text
from assay.llm.shared import cut


class SuffixArray:
    """Word positions of some documents in the order of their suffixes, compared over `depth` words at least."""

    def __init__(self, words: np.ndarray, first: np.ndarray, depth: int):
        n = len(words)
        self.vocabulary, rank = np.unique(words, return_inverse=True)
        self.words = rank.astype(np.int64) + 1
        self.ends = np.repeat(first[1:], np.diff(first))
        rank, length = self.words, 1
        bits = max(1, (n + 1).bit_length())
        fold = max(2, 63 // bits)  # as many ranks as one integer holds
        place = np.arange(n)
        self.order = np.argsort(rank, kind="stable") if depth == 1 else place
        while length < depth:
            key = rank.copy()
            for k in range(1, fold):
                key <<= bits
                shift = k * length
                if shift < n:
                    key[: n - shift] += np.where(place[: n - shift] + shift < self.ends[: n - shift], rank[shift:], 0)
            self.order = np.argsort(key, kind="stable")
            key = key[self.order]
            rank = np.empty(n, np.int64)
            rank[self.order] = np.cumsum(np.concatenate([[1], key[1:] != key[:-1]])) if n else 0
            length *= fold

    def ranks(self, words: np.ndarray) -> np.ndarray:
        """Words as the shard numbers them; 0: not in it."""
        if not len(self.vocabulary):
            return np.zeros(words.shape, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at + 1, 0)

    def search(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of the order in which each window is a prefix. windows: a row each, of ranks; lengths: words of each."""
        n, m, column = len(self.words), len(windows), np.arange(windows.shape[1])
        used = column < lengths[:, None]

        def bound(after: bool) -> np.ndarray:
            lo, hi = np.zeros(m, np.int64), np.full(m, n)
            for _ in range(max(1, n.bit_length() + 1)):
                going = lo < hi
                middle = (lo + hi) // 2
                place = self.order[np.minimum(middle, n - 1)]
                at = place[:, None] + column
                there = np.where(at < self.ends[place][:, None], self.words[np.minimum(at, n - 1)], 0)
                apart = np.where(used, np.sign(there - windows), 0)
                sign = apart[np.arange(m), np.argmax(apart != 0, axis=1)]
                right = going & ((sign <= 0) if after else (sign < 0))
                lo, hi = np.where(right, middle + 1, lo), np.where(going & ~right, middle, hi)
            return lo

        return bound(False), bound(True)


class Block:
    """Some of the benchmark: its distinct windows, and where each occurs."""

    def __init__(self, ids: list[str], texts: list[bytes], width: int):
        self.width = width
        data, at = text.joined([t.lower() for t in texts])
        starts, ends = text.spans(data, text.ALNUM)
        self.words = text.word_hashes(data, starts, ends)
        first = np.searchsorted(starts, at)
        count = np.diff(first)
        short = np.flatnonzero((count > 0) & (count < width))
        place = np.concatenate([text.full(first, width), first[short]])
        lengths = np.concatenate([np.full(len(place) - len(short), width), count[short]])
        keys = np.zeros(len(place), np.uint64)
        for n in np.unique(lengths):
            own = lengths == n
            keys[own] = text.window_hashes(self.words, int(n), int(n))[place[own]]
        _, head, self.window = np.unique(keys, return_index=True, return_inverse=True)
        self.starts, self.lengths = place[head], lengths[head]
        item = np.searchsorted(first, place, "right") - 1
        order = np.lexsort((place, self.window))
        #: for each distinct window, the items it is in, each once
        pairs = np.unique(np.stack([self.window[order], item[order]], axis=1), axis=0) if len(order) else np.zeros((0, 2), np.int64)
        self.window, self.item = pairs[:, 0], pairs[:, 1]
        self.from_ = np.searchsorted(self.window, np.arange(len(head) + 1))
        self.ids, self.first = ids, first


def _spread(from_: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers in some intervals, and which interval each is of."""
    n = to - from_
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + from_[of], of


def _runs(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of `length` words."""
    n = len(words)
    power, inverse = text.powers(n + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power[:n])])
    return text.mix((total[length:] - total[: n - length + 1]) * inverse[: n - length + 1])


def longest(doc: np.ndarray, item: np.ndarray, least: int) -> tuple[int, int, int] | None:
    """(word of the item, word of the document, words) of the longest run that both have, `least` words or more; the first of equals."""
    lo, hi, best = least, min(len(doc), len(item)), None
    while lo <= hi:  # two texts that share a run share all shorter ones
        length = (lo + hi) // 2
        a, b = _runs(doc, length), _runs(item, length)
        order = np.argsort(b, kind="stable")
        at = np.minimum(np.searchsorted(b[order], a), len(b) - 1)
        there = np.flatnonzero(b[order][at] == a)
        place = (int(order[at[there[0]]]), int(there[0])) if len(there) else None
        if place and np.array_equal(item[place[0] : place[0] + length], doc[place[1] : place[1] + length]):
            best, lo = (*place, length), length + 1
        else:
            hi = length - 1
    return best


def find(texts: list[bytes], blocks: list[Block]) -> tuple[np.ndarray, np.ndarray, list[list[str]], list[list[tuple]]]:
    """For some documents: first word of each (and the end), words hit, items with a hit, longest verbatim matches.

    A match is (item_id, word in the item, word in the document, words), one for each item with a hit.
    """
    data, at = text.joined([t.lower() for t in texts])
    starts, ends = text.spans(data, text.ALNUM)
    words, first = text.word_hashes(data, starts, ends), np.searchsorted(starts, at)
    hit, items, matches = np.zeros(len(words), bool), [[] for _ in texts], [[] for _ in texts]
    blocks = [b for b in blocks if len(b.starts)]
    if not len(words) or not blocks:
        return first, hit, items, matches
    shard = SuffixArray(words, first, blocks[0].width)
    for block in blocks:
        known, column = shard.ranks(block.words), np.arange(block.width)
        rows = known[np.minimum(block.starts[:, None] + column, len(known) - 1)]
        whole = np.flatnonzero(((rows > 0) | (column >= block.lengths[:, None])).all(axis=1))
        if not len(whole):
            continue
        lo, hi = shard.search(rows[whole], block.lengths[whole])
        # a word starts one occurrence at most for each length of windows
        place, of = _spread(lo, hi)
        place, window = shard.order[place], whole[of]
        here = text.covered(place, block.lengths[window], len(words))
        hit |= here
        doc = np.searchsorted(first, place, "right") - 1
        met = np.unique(doc * len(block.starts) + window)
        doc, window = met // len(block.starts), met % len(block.starts)
        entry, of = _spread(block.from_[window], block.from_[window + 1])
        pairs = np.unique(doc[of] * len(block.ids) + block.item[entry])
        for d, i in zip((pairs // len(block.ids)).tolist(), (pairs % len(block.ids)).tolist()):
            item = block.words[block.first[i] : block.first[i + 1]]
            own = np.flatnonzero(here[first[d] : first[d + 1]])
            a, b = int(own[0]), int(own[-1]) + 1
            items[d].append(block.ids[i])
            found = longest(words[first[d] + a : first[d] + b], item, min(block.width, len(item)))
            if found:
                matches[d].append((block.ids[i], found[0], found[1] + a, found[2]))
    return first, hit, items, matches


def blocks(benchmark: DataFrame, width: int, block_bytes: int, id_col: str, text_col: str) -> Iterator[Block]:
    """The benchmark in blocks of bounded size; a longer item is a block of its own."""
    ids: list[str] = []
    texts: list[bytes] = []
    size = 0
    for row in benchmark.select(F.col(id_col).cast("string"), F.col(text_col)).toLocalIterator():
        if row[1]:
            raw = row[1].encode()
            if texts and size + len(raw) > block_bytes:
                yield Block(ids, texts, width)
                ids, texts, size = [], [], 0
            ids.append(row[0] or "")
            texts.append(raw)
            size += len(raw)
    if texts:
        yield Block(ids, texts, width)


_MATCH = pa.struct([("item_id", pa.string()), ("item_word", pa.int64()), ("word", pa.int64()), ("n_words", pa.int64())])
_FIELDS = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("hits", pa.binary()), ("items", pa.list_(pa.string())), ("matches", pa.list_(_MATCH))]
_DDL = "doc_id long, n_words long, n_hit long, hits binary, items array<string>, matches array<struct<item_id string, item_word long, word long, n_words long>>"


def _searched(shared, keep: bool, again: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = shared.value if shared is not None else []
        schema = pa.schema(_FIELDS + [("text", pa.large_string())] * keep)
        for batch in batches:
            for part in text.pieces(batch, "text"):
                texts = text.as_bytes(part.column("text"))
                first, hit, items, matches = find(texts, group)
                bits = [np.packbits(hit[a:b]).tobytes() if hit[a:b].any() else b"" for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                if again:
                    old = part.select(["hits", "items", "matches"]).to_pydict()
                    bits = [_either(a, b) for a, b in zip(bits, old["hits"])]
                    items = [sorted({*a, *b}) for a, b in zip(items, old["items"])]
                    matches = [[tuple(x.values()) for x in b] + a for a, b in zip(matches, old["matches"])]
                names = [f.name for f in _MATCH]
                columns = [part.column("doc_id"), pa.array(np.diff(first)), pa.array([int.from_bytes(x).bit_count() for x in bits], pa.int64()), pa.array(bits, pa.binary()), pa.array(items, schema.field("items").type), pa.array([[dict(zip(names, m)) for m in x] for x in matches], schema.field("matches").type)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns + [part.column("text")] * keep, schema)], schema=schema)

    return run


def _either(a: bytes, b: bytes) -> bytes:
    return (np.frombuffer(a, np.uint8) | np.frombuffer(b, np.uint8)).tobytes() if a and b else a or b


def overlaps(docs: DataFrame, benchmark: DataFrame, width: int = 13, one_in: int = 20, block_bytes: int = 1 << 20, group_blocks: int = 8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, items, matches and contaminated; a row for each row of docs.

    Texts are lower-cased (A-Z) and split into words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. A window
    is `width` consecutive words of an item, or all of a shorter one; a word inside an occurrence
    of a window is hit. items: those with occurring windows; matches: for each the longest run of
    words that it has verbatim, the first of equals. contaminated: one word in `one_in` is hit, and one at least.
    Null and empty texts have no words, and items without words no windows; repeated rows and null
    ids stay as they are; other columns are not read; empty tables give no hits or no rows.
    """
    spark = docs.sparkSession
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    listed, again = blocks(benchmark, width, block_bytes, item_col, item_text_col), False
    group = list(islice(listed, group_blocks))
    while True:
        later = list(islice(listed, group_blocks))
        shared = spark.sparkContext.broadcast(group)  # group_blocks * block_bytes of text, or the longest item
        found = found.mapInArrow(_searched(shared, bool(later), again), _DDL + ", text string" * bool(later))
        if not later:
            break
        found, group, again = cut(found), later, True
        shared.unpersist()
    found = found.select("doc_id", "n_words", "n_hit", F.array_sort(F.array_distinct("items")).alias("items"), "matches")
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words")))

