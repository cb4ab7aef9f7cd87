"""Prefix tries of conversations by time-forward processing.

A node is a distinct sequence of first turns, told by two 64-bit hashes of the turns with their
places, xored along the conversation; texts are never shuffled. Nodes that more than a certain
number of conversations share are few; below them hang the shards. In a shard's partition Spark
sorts the nodes externally, deepest first; each node then waits in a queue, which spills, for its
parent, takes its name from it and hands its subtree's totals to it. What the shards' roots hand on
goes, summed, through one more such pass over the few nodes above them.

A conversation's turns are one task's sequence, in a window that spills; nothing else is ever
gathered by conversation, node or prefix but counts, minima and lists of 4,096 ids at most.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.session import cut

#: A path, as two hashes of it.
PATH = ["depth", "p1", "p2"]
_NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends binary, q1 long, q2 long"
_ROW = np.dtype([("key", "S16"), ("conv_id", "i8"), ("n_convs", "i8"), ("n_children", "i8"), ("n_leaves", "i8"), ("saved_tokens", "i8"), ("ends", "V32")])
_CHUNK = 1 << 14


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, rank from 1, a, b (hashes of role and text) and bytes (of the text) of each turn.

    Turns come in order of `turn`, null first; those of equal turn in order of their hashes. Null
    role or text counts as empty; rows without conv_id belong to no conversation and go.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    hashes = [F.xxhash64(F.lit(seed), role, text).alias(name) for seed, name in ((1, "a"), (2, "b"))]
    turns = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *hashes, F.octet_length(text).cast("long").alias("bytes"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "a", "b")
    return turns.select("conv_id", F.row_number().over(order).alias("rank"), "a", "b", "bytes")


def rebranched(turns: DataFrame, family: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """Numbered turns of conversations that begin as the first of their family, and all conv_ids.

    Conversation c begins with the first h turns of c - c % family, h being crc32(c) mod (most + 1),
    and goes on with its own turns after its first h. A family's first conversation stays as it is;
    where it is absent there is nothing to begin with.
    """
    turns = cut(turns)
    conv, head = F.col("conv_id"), F.crc32(F.col("conv_id").cast("string")) % (most + 1)
    own = turns.where((conv % family == 0) | (F.col("rank") > head)).select("conv_id", F.lit(1).alias("part"), "rank", "a", "b", "bytes")
    # the few conversations that may begin as this one
    near = F.transform(F.array(*[F.lit(k) for k in range(1 - family, family) if k]), lambda k: F.try_add(F.col("conv_id"), k))
    lent = turns.where((conv % family == 0) & (F.col("rank") <= most)).select(conv.alias("base"), F.explode(near).alias("conv_id"), F.lit(0).alias("part"), "rank", "a", "b", "bytes")
    lent = lent.where((conv - conv % family == F.col("base")) & (F.col("rank") <= head)).drop("base")
    there = turns.select("conv_id").distinct()
    return own.unionByName(lent.join(there, "conv_id", "left_semi")), there


def paths(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, depth, p1, p2 (its path), q1, q2 (its parent's), bytes and last, for each turn and for the root (depth 0).

    turns: conv_id, part, rank, a, b and bytes, in order of part and rank.
    """
    root = convs.select("conv_id", F.lit(-1).alias("part"), F.lit(0).alias("rank"), *[F.lit(0).cast("long").alias(c) for c in ("a", "b", "bytes")])
    order = Window.partitionBy("conv_id").orderBy("part", "rank")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = turns.unionByName(root).withColumn("depth", F.row_number().over(order).cast("long") - 1)
    own: dict[str, Column] = {c: F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(k), "depth", "a", "b")) for k, c in ((3, "x1"), (4, "x2"))}
    rows = rows.withColumns(own)
    path = {f"p{k}": F.bit_xor(f"x{k}").over(so_far) for k in (1, 2)}
    rows = rows.withColumns(path | {"last": F.lead("part").over(order).isNull()})
    return rows.select("conv_id", *PATH, F.col("p1").bitwiseXOR(F.col("x1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("x2")).alias("q2"), "bytes", "last")


def _scratch() -> str | None:
    """Where Spark lets a task spill."""
    return os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None


class _Run:
    """Rows in order of their key, in memory or read back piece by piece."""

    def __init__(self, rows: np.ndarray, file=None):
        self.head, self.file = rows, file

    def upto(self, key: bytes) -> Iterator[np.ndarray]:
        while True:
            k = int(np.searchsorted(self.head["key"], key, "right"))
            yield self.head[:k]
            self.head = self.head[k:]
            if len(self.head) or self.file is None:
                return
            self.head = np.frombuffer(self.file.read(_CHUNK * _ROW.itemsize), _ROW)
            if not len(self.head):
                self.file.close()
                self.file = None
                return


class Waiting:
    """A queue of rows that wait for their parent, in order of its key; beyond `limit` rows it spills sorted runs."""

    def __init__(self, limit: int = 1 << 18):
        self.limit, self.fresh, self.n, self.runs = limit, [], 0, []

    def _sorted(self) -> np.ndarray:
        rows = np.concatenate(self.fresh) if self.fresh else np.zeros(0, _ROW)
        self.fresh, self.n = [], 0
        return rows[np.argsort(rows["key"], kind="stable")]

    def add(self, rows: np.ndarray) -> None:
        self.fresh.append(rows)
        self.n += len(rows)
        if self.n >= self.limit:
            file = tempfile.TemporaryFile(dir=_scratch())  # without a name: it goes with the task
            file.write(self._sorted().tobytes())
            file.seek(0)
            self.runs.append(_Run(np.zeros(0, _ROW), file))

    def full(self) -> Waiting:
        """Nothing more is added from here on."""
        self.runs.append(_Run(self._sorted()))
        return self

    def pop(self, key: bytes) -> np.ndarray:
        """All rows up to a parent's key."""
        return np.concatenate([x for run in self.runs for x in run.upto(key)] or [np.zeros(0, _ROW)])

    @property
    def empty(self) -> bool:
        return not self.n and all(not len(r.head) and r.file is None for r in self.runs)


def _keys(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Pairs of signed numbers as 16 bytes in the same order."""
    both = np.stack([hi, lo], 1).view(np.uint64) ^ np.uint64(1 << 63)
    return np.frombuffer(both.astype(">u8").tobytes(), "S16")


def _batch(rows: np.ndarray, depth: int, parent: np.ndarray | None, q: tuple | None) -> pa.RecordBatch:
    ends = pa.Array.from_buffers(pa.binary(32), len(rows), [None, pa.py_buffer(rows["ends"].tobytes())]).cast(pa.binary())
    none = pa.nulls(len(rows), pa.int64())
    counts = [pa.array(rows[c]) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    columns = [pa.array(rows["conv_id"]), pa.array(np.full(len(rows), depth, np.int64)), none if parent is None else pa.array(parent), *counts, ends, *([none, none] if q is None else map(pa.array, q))]
    return pa.RecordBatch.from_arrays(columns, ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends", "q1", "q2"])


def time_forward(batches: Iterator[pa.RecordBatch], limit: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Nodes with the totals of their subtrees, of nodes deepest first and then in order of their path.

    A node comes out when its parent has come in, with the parent's conv_id; those marked `edge`,
    whose parent is elsewhere, at once, with the parent's path. What children elsewhere have handed
    on is in n_children, n_leaves and saved_tokens.
    """
    waiting, coming, level = Waiting(limit).full(), Waiting(limit), None
    for batch in batches:
        if not batch.num_rows:
            continue
        at = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
        depths, p, q, edges = at("depth"), _keys(at("p1"), at("p2")), (at("q1"), at("q2")), at("edge").astype(bool)
        rows = np.zeros(batch.num_rows, _ROW)
        for c in ("conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"):
            rows[c] = at(c)
        rows["key"], rows["ends"] = _keys(*q), np.frombuffer(b"".join(batch.column("ends").to_pylist()), "V32")
        rows["saved_tokens"] += (rows["n_convs"] - 1) * at("bytes")
        step = np.flatnonzero(np.diff(depths)) + 1
        for a, b in zip([0, *step.tolist()], [*step.tolist(), len(rows)]):
            if depths[a] != level:
                if not waiting.empty:
                    raise RuntimeError("a node's parent is not in its shard")
                waiting, coming, level = coming.full(), Waiting(limit), depths[a]
            mine, children = rows[a:b], waiting.pop(p[b - 1])
            if len(children):
                of = np.searchsorted(p[a:b], children["key"])
                if not (p[a:b][of] == children["key"]).all():
                    raise RuntimeError("a node's parent is not in its shard")
                np.add.at(mine["n_children"], of, 1)
                np.add.at(mine["n_leaves"], of, children["n_leaves"])
                np.add.at(mine["saved_tokens"], of, children["saved_tokens"])
                yield _batch(children, int(level) + 1, mine["conv_id"][of], None)
            mine["n_leaves"][mine["n_children"] == 0] = 1
            edge = edges[a:b]
            if edge.any():
                yield _batch(mine[edge], int(level), None, tuple(x[a:b][edge] for x in q))
            if not edge.all():
                coming.add(mine[~edge])
    if not (waiting.empty and coming.empty):
        raise RuntimeError("a node's parent is not in its shard")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each path, whose pieces come in order; only a hash's state is held."""
    path, state = None, None
    out = lambda: pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in path], pa.array([state.digest()], pa.binary())], [*PATH, "ends"])
    for batch in batches:
        done = []
        for *own, ids in zip(*[batch.column(c).to_pylist() for c in (*PATH, "ids")]):
            if own == path:
                state.update(b"," + ids.encode())
                continue
            if path is not None:
                done.append((*path, state.digest()))
            path, state = own, hashlib.sha256(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in list(zip(*done))[:3]], pa.array([d[3] for d in done], pa.binary())], [*PATH, "ends"])
    if path is not None:
        yield out()


def _ends(rows: DataFrame) -> DataFrame:
    """Each path with the digest of the conversations that end there: ids in lists of 4,096 values at most, then streamed in order."""
    last = rows.where("last").groupBy(*PATH, F.shiftright("conv_id", 12).alias("piece")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    return last.repartition(*PATH).sortWithinPartitions(*PATH, "piece").mapInArrow(_digested, "depth long, p1 long, p2 long, ends binary")


def _shared_by_many(rows: DataFrame, least: int, most: int) -> DataFrame:
    """Paths that more conversations share than a shard shall have at most: `most` paths at most, and the root.

    A shard has `least` conversations at most, or more by powers of two if there were too many such paths.
    """
    counts = rows.groupBy(*PATH).agg(F.count("*").alias("n")).where((F.col("n") > least) | (F.col("depth") == 0))
    counts = cut(counts)
    powers = {r["k"]: r["n"] for r in counts.groupBy(F.ceil(F.log2("n")).alias("k")).agg(F.count("*").alias("n")).collect()}  # 64 at most
    bound = least
    while sum(n for k, n in powers.items() if 1 << k > bound) > most:
        bound *= 2
    return counts.where((F.col("n") > bound) | (F.col("depth") == 0)).select(*PATH, F.lit(True).alias("top"))


def prefix_trie(turns: DataFrame, convs: DataFrame, least: int = 1 << 6, most: int = 1 << 17, limit: int = 1 << 18) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of each node.

    turns as for `paths`, of the conversations convs. A node is named by its smallest member and its
    depth; the root has no parent. A conversation without turns is a member of the root alone, and
    ends there; no conversations give no nodes. least: conversations that a shard may have in any
    case; most: nodes above the shards; limit: rows that a queue keeps in memory.
    """
    rows = cut(paths(turns, convs))
    above = cut(_shared_by_many(rows, least, most))
    # `most` rows and one at most
    rows = rows.join(F.broadcast(above), PATH, "left").withColumn("top", F.coalesce("top", F.lit(False)))
    ends = cut(_ends(rows))
    order = Window.partitionBy("conv_id").orderBy("depth")
    below = rows.withColumns({"shard": F.first(F.when(~F.col("top"), F.col("p1")), True).over(order.rowsBetween(Window.unboundedPreceding, 0)), "edge": F.lag("top").over(order)}).where("not top")
    passed = lambda df: df.mapInArrow(lambda batches: time_forward(batches, limit), _NODES)

    def nodes(df: DataFrame, *more: Column) -> DataFrame:
        found = df.groupBy(*PATH).agg(F.count("*").alias("n_convs"), *[F.min(c).alias(c) for c in ("conv_id", "q1", "q2", "bytes")], *more)
        return found.join(ends, PATH, "left").withColumn("ends", F.coalesce("ends", F.unhex(F.sha2(F.lit(""), 256))))

    none = {c: F.lit(0).cast("long") for c in ("n_children", "n_leaves", "saved_tokens")}
    in_shards = nodes(below, F.min("shard").alias("shard"), F.bool_or("edge").alias("edge")).withColumns(none)
    in_shards = cut(passed(in_shards.repartition("shard").sortWithinPartitions(F.desc("depth"), "p1", "p2").drop("shard")))
    handed = in_shards.where("q1 is not null").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"))
    handed = handed.agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    top = cut(nodes(rows.where("top")).join(handed, PATH, "left").withColumns({c: F.coalesce(c, z) for c, z in none.items()}).withColumn("edge", F.col("depth") == 0))
    named = top.select((F.col("depth") + 1).alias("_depth"), F.col("p1").alias("_p1"), F.col("p2").alias("_p2"), F.col("conv_id").alias("_parent"))
    at_edge = (F.col("depth") == F.col("_depth")) & (F.col("q1") == F.col("_p1")) & (F.col("q2") == F.col("_p2"))
    in_shards = in_shards.join(F.broadcast(named), at_edge, "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_parent"))
    out = in_shards.drop("_depth", "_p1", "_p2", "_parent").unionByName(passed(top.repartition(1).sortWithinPartitions(F.desc("depth"), "p1", "p2")))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.lower(F.hex("ends")).alias("ends_sha256"))
