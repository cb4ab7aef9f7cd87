"""Near duplicates by SimHash, linked through vantage-point trees.

Fingerprints within `radius` of each other are within `radius // segments` on one of `segments`
bit ranges at least. For each range a vantage-point tree, grown on a bounded sample, deals all
fingerprints to shards: a fingerprint lives in one shard, and is also a query to each shard that
the triangle inequality can't rule out. A shard compares its queries with its own, whole
fingerprints, and returns a spanning forest of the links found, not the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm import text
from assay.llm.components import components
from assay.llm.shared import cut, looked_up


def fingerprints_of(texts: list[bytes], shingle: int, seed: int = 42) -> np.ndarray:
    """64-bit SimHash of each text (see `fingerprint`)."""
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    for d, raw in enumerate(texts):
        flat = b" ".join(raw.lower().split())
        if not flat:
            continue
        gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
        n = max(1, len(gaps) + 2 - shingle)
        starts = np.concatenate([[0], gaps[: n - 1] + 1])
        ends = np.concatenate([gaps[shingle - 1 :], [len(flat)]]) if len(gaps) >= shingle - 1 else np.array([len(flat)])
        ones = np.zeros(64, np.int64)
        for lo in range(0, n, 1 << 16):  # a long text in parts
            h = np.fromiter((digest(flat[a:b], seed) for a, b in zip(starts[lo : lo + (1 << 16)].tolist(), ends[lo : lo + (1 << 16)].tolist())), np.uint64)
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            for k in range(0, len(bits), 255):  # no more ones than a byte holds
                ones += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
        out[d] = np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0]
    return out


def fingerprint(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint (long); a row for each row of docs.

    A-Z are lower-cased; words are `[^\\x20\\x09-\\x0D]+`; shingles are `shingle` words joined by
    one space, repeats included, or all words of a shorter text. A bit is set if it is in more than
    half of the shingles' XXH64 (seed 42). Null texts and those without words have fingerprint 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.pieces(batch, "text"):
                yield pa.record_batch([part.column("doc_id"), pa.array(fingerprints_of(text.as_bytes(part.column("text")), shingle).view(np.int64))], names=["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fingerprint long")


class Tree:
    """A vantage-point tree over some bits of the fingerprints. Only its inner nodes are kept: a shard is a leaf's number."""

    def __init__(self, sample: np.ndarray, mask: int, radius: int, leaf: float, rng: np.random.Generator):
        self.mask, self.radius, self.nodes, self.leaves = np.uint64(mask), radius, [], 0
        self.root = self._grow(sample & self.mask, leaf, rng)

    def _grow(self, points: np.ndarray, leaf: float, rng: np.random.Generator) -> int:
        if len(points) > max(leaf, 2):
            vantage = points[rng.integers(len(points))]
            distance = np.bitwise_count(points ^ vantage)
            middle = int(np.median(distance))
            near = distance <= middle
            if near.all():  # the upper half is one distance
                middle -= 1
                near = distance <= middle
            if near.any():
                self.nodes.append(None)
                me = len(self.nodes) - 1
                self.nodes[me] = (vantage, middle, self._grow(points[near], leaf, rng), self._grow(points[~near], leaf, rng))
                return me
        self.leaves += 1
        return -self.leaves

    def shards(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of a point, shard, whether it lives there), once for each shard that may hold a neighbour."""
        points, out = points & self.mask, []
        stack = [(self.root, np.arange(len(points)), np.ones(len(points), bool))]
        while stack:
            at, index, home = stack.pop()
            if not len(index):
                continue
            if at < 0:
                out.append((index, np.full(len(index), -at - 1, np.int64), home))
                continue
            vantage, middle, near, far = self.nodes[at]
            d = np.bitwise_count(points[index] ^ vantage).astype(np.int64)
            # a neighbour is at most `radius` nearer to the vantage point or farther from it
            for child, may, own in ((near, d - self.radius <= middle, d <= middle), (far, d + self.radius > middle, d > middle)):
                stack.append((child, index[may], home[may] & own[may]))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def linked(own: np.ndarray, queries: np.ndarray, radius: int, cells: int = 1 << 22) -> np.ndarray:
    """For own fingerprints and then queries, the first of each one's group of links between the two."""
    points = np.concatenate([own, queries])
    parent = np.arange(len(points))
    step = max(1, cells // max(1, len(own)))
    for lo in range(0, len(points), step):
        q, o = np.nonzero(np.bitwise_count(points[lo : lo + step, None] ^ own[None, :]) <= radius)
        q = q + lo
        apart = q != o
        q, o = q[apart], o[apart]
        while len(q):
            a, b = parent[q], parent[o]
            apart = a != b
            if not apart.any():
                break
            q, o, a, b = q[apart], o[apart], a[apart], b[apart]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            parent = _roots(parent)
    return parent


def links(prints: DataFrame, radius: int = 4, segments: int = 3, shard_size: int = 1024, sample_size: int = 16384, tile: int = 8192, seed: int = 1) -> DataFrame:
    """a, b: fingerprints (long), such that those within `radius` bits are connected; prints: distinct fingerprints.

    The trees grow on the `sample_size` fingerprints of smallest hash; all fingerprints are dealt
    and compared. Shards of more than `tile` fingerprints of their own are cut into pairs of tiles,
    each a task's work, so that neither memory nor time of a task follows a hot group.
    """
    spark, total = prints.sparkSession, prints.count()
    chosen = prints.select("fingerprint").orderBy(F.xxhash64("fingerprint", F.lit(seed))).limit(sample_size).collect()
    sample = np.array([r[0] for r in chosen], np.int64).view(np.uint64)
    rng = np.random.default_rng(seed)
    edges = [64 * k // segments for k in range(segments + 1)]
    trees = [Tree(sample, (1 << b) - (1 << a), radius // segments, shard_size * len(sample) / max(1, total), rng) for a, b in zip(edges, edges[1:])]
    offset = np.cumsum([0, *[t.leaves for t in trees]])
    shared = spark.sparkContext.broadcast((trees, offset))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, offset = shared.value
        for batch in batches:
            signed = batch.column("fingerprint").to_numpy(zero_copy_only=False).astype(np.int64)
            for t, tree in enumerate(trees):
                for lo in range(0, len(signed), 1 << 14):
                    part = signed[lo : lo + (1 << 14)]
                    at, shard, home = tree.shards(part.view(np.uint64))
                    lives = np.zeros(len(part), np.int64)
                    lives[at[home]] = shard[home]
                    ask = shard >= lives[at]  # of two shards that would find a pair, the later one does
                    yield pa.record_batch([pa.array(part[at[ask]]), pa.array((shard[ask] + offset[t]).astype(np.int64)), pa.array(home[ask])], names=["fingerprint", "shard", "home"])

    dealt = prints.select("fingerprint").mapInArrow(deal, "fingerprint long, shard long, home boolean")
    sizes = dealt.groupBy("shard").agg(F.sum(F.col("home").cast("long")).alias("n_own"), F.count("*").alias("n_all")).where((F.col("n_own") > tile) | (F.col("n_all") > 16 * tile))
    sizes = sizes.select("shard", F.ceil(F.col("n_own") / tile).cast("int").alias("own_tiles"), F.ceil(F.col("n_all") / (8 * tile)).cast("int").alias("all_tiles"))
    cutup = dealt.join(sizes, "shard", "left").fillna(1, ["own_tiles", "all_tiles"])
    place = F.xxhash64("fingerprint")
    every = lambda n: F.sequence(F.lit(0), F.greatest(F.col(n), F.lit(1)) - 1)
    mine = F.pmod(place, F.greatest("own_tiles", F.lit(1))).cast("int")
    asked = F.pmod(F.xxhash64("fingerprint", F.lit(9)), F.greatest("all_tiles", F.lit(1))).cast("int")
    own = cutup.where("home").select("fingerprint", "shard", F.lit(True).alias("own"), mine.alias("i"), F.explode(every("all_tiles")).alias("j"))
    queries = cutup.select("fingerprint", "shard", F.lit(False).alias("own"), F.explode(every("own_tiles")).alias("i"), asked.alias("j"))
    names = ["a", "b"]

    def compare(table: pa.Table) -> pa.Table:
        values = table.column("fingerprint").to_numpy().astype(np.int64)
        is_own = table.column("own").to_numpy()
        own, ask = np.sort(values[is_own]), np.sort(values[~is_own])
        ask = ask[~np.isin(ask, own, assume_unique=True)]
        parent = linked(own.view(np.uint64), ask.view(np.uint64), radius)
        both = np.concatenate([own, ask])
        apart = parent != np.arange(len(both))
        return pa.table([both[parent[apart]], both[apart]], names=names)

    return own.unionByName(queries).groupBy("shard", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text", **tree) -> DataFrame:
    """doc_id, fingerprint (long), component_id; a row for each row of docs.

    Fingerprints (see `fingerprint`) link at `radius` differing bits or fewer; component_id is the
    smallest doc_id that links reach, the row's own included. Texts without words have fingerprint
    0 and link like any other. A null doc_id is never smallest; a component of only such rows has a
    null component_id. Repeated rows stay as they are; other columns are not read; an empty table
    gives an empty table.
    """
    marked = cut(fingerprint(docs, shingle, id_col, text_col))
    prints = cut(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    groups = components(links(prints, radius, **tree)).withColumnRenamed("node", "fingerprint")
    named = prints.join(groups, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = looked_up(named.select("fingerprint", "component"), least, "component", "fingerprint").select("fingerprint", "component_id")
    # rows of one fingerprint are told apart by their doc_id, or by a number that only deals them out
    numbered = marked.withColumn("_row", F.coalesce("doc_id", F.monotonically_increasing_id()))
    return looked_up(numbered, named, "fingerprint", "_row").select("doc_id", "fingerprint", "component_id")


def as_hex(c: Column) -> Column:
    """16 lowercase hexadecimal digits of a long."""
    return F.lpad(F.lower(F.hex(c)), 16, "0")
