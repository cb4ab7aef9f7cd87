"""How filters interact: what each removes alone and after others, in every order of them.

Each document gets a mask of the filters that it fails. Filters on its own text are array
operations on batches of whole texts. Whether a text repeats one of a smaller id is asked of radix
tries: texts are range-partitioned by prefixes that are as long as it takes to keep a range small,
and each range's texts go into one compressed trie, whose terminals hold the smallest id. Before
that, of equal texts in one batch only those of smallest id go on, so that no group of copies is
large. The report is made from counts of masks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm import text as T
from assay.session import cut

FILTERS = "ABCDE"
FEW, COPY = 200, 16
_MARKS = np.zeros(256, bool)
_MARKS[list(b"#$%&*|")] = True
_JUDGED = "doc_id long, part string, mask int, text binary, prefix binary"
_SEED = 42
#: Lengths of prefixes that are counted in one pass.
_AT_ONCE = 4


def heavy_prefixes(docs: DataFrame, range_bytes: int = 16 << 20, first: int = 4, text: str = "text") -> tuple[dict[int, list[int]], int, int]:
    """Hashes of prefixes, by length, whose texts have over an eighth of a range's bytes; bytes of a range; and of all texts.

    Lengths double as long as a prefix of the last one is heavy and has different texts. A range has
    `range_bytes`, or more so that 2^18 prefixes of a length are heavy at most.
    """
    data = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("t"))
    total = int(data.agg(F.sum(F.length("t"))).first()[0] or 0)
    most, size, heavy = max(range_bytes, total >> 15), first, {}
    at = lambda n: F.xxhash64(F.substring("t", 1, n))
    while True:
        own = data
        if size > first:
            last = data.sparkSession.createDataFrame([(h,) for h in heavy[size // 2]], "_h long").coalesce(1)
            own = data.where(F.length("t") >= size).join(F.broadcast(last), at(size // 2) == F.col("_h"), "left_semi")
        sizes = [size << k for k in range(_AT_ONCE)]
        each = F.array(*[F.when((F.length("t") >= n) | F.lit(n == first), F.struct(F.lit(n).alias("size"), at(n).alias("h"))) for n in sizes])
        cells = own.select(F.length("t").alias("n"), F.xxhash64("t").alias("x"), F.explode(F.array_compact(each)).alias("p"))
        found = cells.groupBy("p").agg(F.sum("n").alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).where((F.col("n") > most // 8) & (F.col("a") != F.col("b"))).select("p.*").collect()
        for n in sizes:
            heavy[n] = [r["h"] for r in found if r["size"] == n]
            if not heavy[n]:
                return heavy, most, total
        size <<= _AT_ONCE


def _prefix(text: bytes, heavy: dict[int, set[int]]) -> bytes:
    """The shortest prefix that isn't heavy, or all of the text."""
    for n, hashes in heavy.items():
        own = text[:n]
        if len(own) < n or xxhash.xxh64_intdigest(own, _SEED) not in hashes:
            return own
    return own


def _masks(texts: list[bytes]) -> np.ndarray:
    """Failures of A (under 200 words), B (under half of the words distinct), C (over 2 % capitals) and D (holds a mark)."""
    data, at = T.joined(texts)
    starts, ends = T.spans(data, T.SPACED)
    n = len(texts)
    of = np.searchsorted(at, starts, "right") - 1
    words = np.bincount(of, minlength=n)
    pairs = T.mix(T.word_hashes(data, starts, ends) + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    different = np.bincount(of[T.grouped(pairs)[1]], minlength=n) if len(pairs) else words
    each = lambda flags: np.add.reduceat(flags.astype(np.int64), at[:-1]) if n else np.zeros(0, np.int64)
    capitals, marks = each((data >= 65) & (data <= 90)), each(_MARKS[data])
    points = each((data & 0xC0) != 0x80) - 1  # without the line feed
    return (words < FEW) + 2 * (100 * different < 50 * words) + 4 * (100 * capitals > 2 * points) + 8 * (marks > 0)


def _judged(heavy: dict[int, list[int]]):
    hashes = {n: {h & (2**64 - 1) for h in hs} for n, hs in heavy.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in T.pieces(batch, "text", 2 << 20):
                texts, ids = T.as_bytes(piece.column("text")), piece.column("doc_id").to_pylist()
                masks, least = _masks(texts), {}
                for t, i in zip(texts, ids):
                    if i is not None and i <= least.get(t, i):
                        least[t] = i
                open_ = [i is not None and i == least[t] for t, i in zip(texts, ids)]
                masks = masks + [COPY * (i is not None and not o) for i, o in zip(ids, open_)]
                columns = [piece.column("doc_id"), piece.column("part"), pa.array(masks, pa.int32()), pa.array([t if o else None for t, o in zip(texts, open_)], pa.binary()), pa.array([_prefix(t, hashes) if o else None for t, o in zip(texts, open_)], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "mask", "text", "prefix"])

    return run


class Radix:
    """A compressed trie of byte strings; a terminal holds its smallest id and the rows that ended there."""

    __slots__ = ("label", "next", "least", "rows")

    def __init__(self, label: bytes = b""):
        self.label, self.next, self.least, self.rows = label, {}, None, None

    def insert(self, text: bytes, doc_id: int, row: int) -> None:
        node, at = self, 0
        while at < len(text):
            child = node.next.get(text[at])
            if child is None:
                child = node.next[text[at]] = Radix(text[at:])
            elif not text.startswith(child.label, at):  # the edge is split where they part
                k = _common(child.label, text, at)
                upper = Radix(child.label[:k])
                child.label = child.label[k:]
                upper.next[child.label[0]] = child
                node.next[text[at]] = child = upper
            node, at = child, at + len(child.label)
        if node.rows is None:
            node.least, node.rows = doc_id, []
        node.least = min(node.least, doc_id)
        node.rows.append(row)

    def terminals(self) -> Iterator[Radix]:
        left = [self]
        while left:
            node = left.pop()
            if node.rows is not None:
                yield node
            left.extend(node.next.values())


def _common(label: bytes, text: bytes, at: int) -> int:
    """How many bytes of the label the text has at a place: not all, by bisection."""
    lo, hi = 0, len(label) - 1
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if text.startswith(label[:mid], at) else (lo, mid - 1)
    return lo


def _tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range, with the flag of copies."""
    trie, ids, parts, masks = Radix(), [], [], []
    for batch in batches:
        for i, part, mask, t in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "part", "mask", "text")]):
            trie.insert(t, i, len(ids))
            ids.append(i)
            parts.append(part)
            masks.append(mask)
    for node in trie.terminals():
        for row in node.rows:
            masks[row] |= COPY * (ids[row] > node.least)
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.string()), pa.array(masks, pa.int32())], ["doc_id", "part", "mask"])


def masks(docs: DataFrame, range_bytes: int = 16 << 20, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, part (the source; null: empty) and mask (bit k: fails filter k of ABCDE) of each document.

    Null texts are empty. A text of a null doc_id has no smaller id and is none's smaller one; rows
    alike in text and doc_id aren't each other's copies.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("part"), F.col(text).cast("string").alias("text"))
    heavy, most, total = heavy_prefixes(docs, range_bytes)
    judged = cut(docs.mapInArrow(_judged(heavy), _JUDGED))
    ranges = judged.where("prefix is not null").repartitionByRange(max(1, -(-2 * total // most)), "prefix").drop("prefix")
    return judged.where("prefix is null").select("doc_id", "part", "mask").unionByName(ranges.mapInArrow(_tried, "doc_id long, part string, mask int"))


def audit(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and counts of documents, for each part, order of the filters and step.

    Of the step's filter: kept (after it), removed (by it), redundant (those that fail it but went
    before), unique_fails (those that fail no other), good_lost and toxic_lost (of those removed). A
    document counts as good or toxic if any row of labels with its doc_id says so. shapley is the
    sum over all orders of what the filter removes: a document counts once for each order in which
    the filter is the first that it fails.
    """
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    cells = masked.join(marks, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    # 32 masks at most
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    rows = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.array(*[F.lit(k) for k in range(1, len(FILTERS) + 1)])))
    place = {x: F.instr("filter_order", x) for x in FILTERS}
    bits = lambda test: sum((F.when(test(place[x]), 1 << k).otherwise(0) for k, x in enumerate(FILTERS)), F.lit(0))
    rows = rows.withColumns({"_own": bits(lambda p: p == F.col("step")), "_before": bits(lambda p: p < F.col("step"))})
    fails, earlier = lambda c: c["mask"].bitwiseAND(F.col("_own")) != 0, lambda c: c["mask"].bitwiseAND(F.col("_before")) != 0
    first = lambda c: fails(c) & ~earlier(c)
    total = lambda test, of=lambda c: c["n"]: F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + F.when(test(c), of(c)).otherwise(0).cast("long"))
    return rows.select(
        "part", "filter_order", "step",
        total(lambda c: ~fails(c) & ~earlier(c)).alias("kept"),
        total(first).alias("removed"),
        total(lambda c: fails(c) & earlier(c)).alias("redundant"),
        total(lambda c: c["mask"] == F.col("_own")).alias("unique_fails"),
        total(first, lambda c: c["good"]).alias("good_lost"),
        total(first, lambda c: c["toxic"]).alias("toxic_lost"),
        total(fails, lambda c: c["n"] * F.floor(F.lit(120) / F.bit_count(c["mask"]))).alias("shapley"),
    )
