"""Near copies by the Jaccard similarity of their sets of word shingles.

Candidates share a band of MinHash values; each pair is held against the exact sets. Texts of one
set are one node. In each bucket the node of most company is
compared with the others first, so that a group near to it costs rows in proportion, however large.
In buckets that are not one component then, the nodes outside the largest component are compared
with all others, in cells of bounded size that return links only. Groups from elsewhere, in which
less similarity is asked, are buckets too; those that are one component by then are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm import text
from assay.llm.components import components
from assay.llm.shared import cut, looked_up, packed, small_side

_MULTIPLY, _FLIP = np.random.default_rng(5).integers(1, 2**63, (2, 4096), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sets_of(texts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles, sorted, one text after the other; where each text's start (and the end).

    A-Z are lower-cased; words are `[^\\x20\\x09-\\x0D]+`; a shorter text is one shingle of all its words.
    """
    data, at = text.joined([t.lower() for t in texts])
    starts, ends = text.spans(data, text.SPACED)
    h, first = text.word_hashes(data, starts, ends), np.searchsorted(starts, at)
    n = np.diff(first)
    whole = text.full(first, shingle)
    hashes, owner = text.window_hashes(h, shingle)[whole], np.repeat(np.arange(len(n)), np.maximum(n - shingle + 1, 0))
    for k in range(1, shingle):
        short = np.flatnonzero(n == k)
        if len(short):
            hashes, owner = np.concatenate([hashes, text.window_hashes(h, k)[first[short]]]), np.concatenate([owner, short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(n) + 1))


def _bands(hashes: np.ndarray, first: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each set that isn't empty, and of each of its bands."""
    node = text.mix(np.add.reduceat(text.mix(hashes ^ np.uint64(11)), first) + np.uint64(1))
    keys = np.empty((len(first), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(first), b + 1, np.uint64)
        for k in range(b * rows, (b + 1) * rows):
            key = text.mix(key ^ np.minimum.reduceat((hashes ^ _FLIP[k]) * _MULTIPLY[k], first))
        keys[:, b] = key
    return node, keys


def _marked(shingle: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.pieces(batch, "text", 1 << 20):
                hashes, first = sets_of(text.as_bytes(part.column("text")), shingle)
                some = np.flatnonzero(np.diff(first))
                node, keys = np.zeros(part.num_rows, np.uint64), np.zeros((0, bands), np.uint64)
                if len(some):
                    node[some], keys = _bands(hashes, first[some], bands, rows)
                size = np.zeros(part.num_rows + 1, np.int32)  # a text without words is in no band
                size[some + 1] = bands
                listed = pa.ListArray.from_arrays(np.cumsum(size, dtype=np.int32), pa.array(keys.ravel().view(np.int64)))
                yield pa.record_batch([part.column("row"), part.column("doc_id"), pa.array(node.view(np.int64)), listed, pa.array(np.diff(first).astype(np.int64))], names=["row", "doc_id", "node", "bands", "size"])

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.pieces(batch, "text", 1 << 20):
                hashes, first = sets_of(text.as_bytes(part.column("text")), shingle)
                yield pa.record_batch([part.column("node"), pa.ListArray.from_arrays(first.astype(np.int32), pa.array(hashes.view(np.int64)))], names=["node", "shingles"])

    return run


def _near(pairs: DataFrame, sets: DataFrame, tenths: int) -> DataFrame:
    """Those pairs whose sets have `tenths` tenths of their union in common, or more."""
    of = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"{c}_set")).hint("merge")
    common, both = F.size(F.array_intersect("a_set", "b_set")), F.size("a_set") + F.size("b_set")
    # a hot node is one row on the right; Spark splits its pairs on the left
    return pairs.join(of("b"), "b").join(of("a"), "a").where(10 * common >= tenths * (both - common)).select("a", "b")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _cell(tenths: int):
    """Compares a cell's own sets with those asked; gives pairs of components, one for each own set and component near to it."""

    def run(table: pa.Table) -> pa.Table:
        own, asked = (np.flatnonzero(table.column(c).to_numpy()) for c in ("own", "asked"))
        component = table.column("component").to_numpy()
        listed = pa.concat_arrays(table.column("shingles").chunks)
        size = pc.list_value_length(listed).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(size)])
        ids = np.unique(listed.flatten().to_numpy(), return_inverse=True)[1]
        theirs = ids if len(asked) == len(size) else np.concatenate([ids[at[k] : at[k + 1]] for k in asked] or [ids[:0]])
        first, n, of = np.cumsum(size[asked]) - size[asked], size[asked], component[asked]
        has, a, b = np.zeros(ids.max() + 1, np.int32), [], []
        for k in own if len(asked) else ():
            mine = ids[at[k] : at[k + 1]]
            has[mine] = 1
            common = np.add.reduceat(has[theirs], first)
            has[mine] = 0
            met = np.unique(of[(10 * common >= tenths * (size[k] + n - common)) & (of != component[k])])
            a.append(np.full(len(met), component[k]))
            b.append(met)
        none = [np.zeros(0, np.int64)]
        return pa.table([np.concatenate(a or none), np.concatenate(b or none)], names=["a", "b"])

    return run


def _across(met: DataFrame, sets: DataFrame, tenths: int, tile: int) -> DataFrame:
    """Pairs of components (a, b) that have near nodes in a bucket; met: bucket, node, size, component.

    Every node outside a bucket's largest component is held against all nodes of the bucket. Both
    sides are dealt to tiles of about `tile` shingles; a pair of tiles is one task's work.
    """
    parts = met.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    whole = parts.groupBy("bucket").agg(F.max(F.struct("n", "component", "size")).alias("most"), F.sum("size").alias("all"), F.count("*").alias("parts")).where("parts > 1")
    tiles = lambda c: F.ceil(c / F.lit(tile)).cast("int")
    whole = whole.select("bucket", F.col("most.component").alias("largest"), tiles(F.col("all") - F.col("most.size")).alias("n_own"), tiles(F.col("all")).alias("n_asked"))
    place = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    dealt = met.join(whole.hint("merge"), "bucket").withColumn("out", F.col("component") != F.col("largest")).withColumn("i", place("n_own", 3)).withColumn("j", place("n_asked", 4))
    asked = F.transform(every("n_own"), lambda i: F.struct(i.alias("i"), F.col("j").alias("j")))
    own = F.transform(F.when(F.col("out"), every("n_asked")).otherwise(F.array().cast("array<int>")), lambda j: F.struct(F.col("i").alias("i"), j.alias("j")))
    cells = dealt.select("bucket", "node", "component", "out", F.col("i").alias("my_i"), F.col("j").alias("my_j"), F.inline(F.array_union(asked, own)))
    cells = cells.select("bucket", "node", "component", "i", "j", (F.col("out") & (F.col("i") == F.col("my_i"))).alias("own"), (F.col("j") == F.col("my_j")).alias("asked"))
    return cells.join(sets.hint("merge"), "node").groupBy("bucket", "i", "j").applyInArrow(_cell(tenths), "a long, b long")


def _joined(named: DataFrame, edges: DataFrame) -> DataFrame:
    """node and component after the components of edges (a, b) are one."""
    joined = small_side(components(edges).select(F.col("node").alias("component"), F.col("component").alias("joined")))
    return named.join(joined, "component", "left").select("node", F.coalesce("joined", "component").alias("component"))


def _within(groups: DataFrame, marked: DataFrame, nodes: DataFrame, named: DataFrame, own: DataFrame, shingle: int, tenths: int, tile: int) -> DataFrame:
    """named (node, component) with all pairs of nodes of a group linked that are near; groups: row, group."""
    members = cut(marked.where("size > 0").select("row", "node").join(groups, "row").select(F.col("group").alias("bucket"), "node").distinct().join(named, "node"))
    apart = members.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("bucket")
    met = cut(looked_up(members, apart, "bucket", "node").join(nodes.select("node", "row", "size"), "node"))
    n = met.count()
    if not n:
        return named
    met = packed(met, n)
    sets = cut(own.join(small_side(met.select("node", "row").distinct()), "row").select("node", "text").mapInArrow(_sets(shingle), "node long, shingles array<long>"))
    first = met.groupBy("bucket").agg(F.min(F.struct("node", "component")).alias("first"))
    pairs = looked_up(met, first, "bucket", "node").where("component <> first.component").select(F.col("first.node").alias("a"), F.col("node").alias("b"))
    of = lambda c: named.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in"))
    near = _near(cut(_ordered(pairs)), sets, tenths).join(of("a"), "a").join(of("b"), "b")
    named = cut(_joined(named, near.select(F.col("a_in").alias("a"), F.col("b_in").alias("b"))))
    return _joined(named, _across(met.select("bucket", "node", "size").join(named, "node").select("bucket", "node", "size", "component"), sets, tenths, tile))


def kept(docs: DataFrame, row_col: str, groups: DataFrame | None = None, shingle: int = 5, tenths: int = 8, group_tenths: int = 5, bands: int = 26, rows: int = 6, tile: int = 1 << 19, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row: of each group of near copies the row of smallest doc_id (null is larger than all); a row near to no other is a group.

    Rows are linked if the distinct shingles that they share are `tenths` tenths of those of both,
    or more, and a group is what links reach; texts without words are one group. row_col holds
    unique longs, the same at each reading. Of pairs of similarity s, the share (1 - s ** rows) **
    bands never meets (0.0004 at 0.8) and is linked through others only. groups (row, group), if
    given, say what else is near: rows of one group that have words are linked from `group_tenths`
    tenths on.
    """
    own = docs.select(F.col(row_col).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marked = cut(own.mapInArrow(_marked(shingle, bands, rows), "row long, doc_id long, node long, bands array<long>, size long"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row", "bands", "size"))
    nodes = cut(marked.groupBy("node").agg(least.alias("least")).select("node", "least.*"))
    met = nodes.select("node", "size", F.explode("bands").alias("bucket"))
    # bands in which the same nodes meet are one bucket
    sizes = met.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(20)")).alias("who")).where("n > 1")
    sizes = sizes.groupBy("n", "who").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    met = met.join(sizes.hint("merge"), "bucket")
    met = cut(met.join(met.groupBy("node").agg(F.sum("n").alias("company")), "node").select("bucket", "node", "size", "n", "company"))
    top = met.groupBy("bucket").agg(F.max(F.struct("company", "node")).alias("top")).select("bucket", F.col("top.node").alias("a"))
    pairs = met.join(top.hint("merge"), "bucket").select("a", F.col("node").alias("b")).where("a <> b")
    pairs = cut(_ordered(pairs))
    chosen = nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi").select("node", "row")
    sets = cut(own.join(small_side(chosen), "row").select("node", "text").mapInArrow(_sets(shingle), "node long, shingles array<long>"))
    linked = small_side(components(_near(pairs, sets, tenths)))
    named = cut(nodes.select("node").join(linked, "node", "left").select("node", F.coalesce("component", "node").alias("component")))
    # a bucket of two nodes was compared whole
    named = _joined(named, _across(met.where("n > 2").join(named, "node").select("bucket", "node", "size", "component"), sets, tenths, tile))
    if groups is not None:
        named = _within(groups, marked, nodes, cut(named), own, shingle, group_tenths, tile)
    first = F.min(F.struct("unknown", "doc_id", "row")).alias("first")
    return nodes.join(named, "node").groupBy("component").agg(first).select("first.row")
