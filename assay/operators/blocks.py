"""Rows as blocks of numbers, for models whose passes over the data are array operations.

A block is a row of a table: some thousand rows of one training set. Training sets that are fitted
side by side share one table, so that a pass over it serves all of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.session import cut

#: Rows that a task has at least, where there are as many.
TASK_ROWS = 1 << 16


def arrays(train: DataFrame) -> DataFrame:
    """a (the features), y (the label) and h, a hash of both: rows are told apart by content, however they are partitioned."""
    rows = train.select(vector_to_array("features").alias("a"), F.col("label").cast("double").alias("y"))
    return rows.withColumn("h", F.xxhash64("a", "y"))


def united(sets: dict[int, DataFrame]) -> DataFrame:
    """set, a, y and h of the rows of all sets."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(s).alias("set"), "a", "y", "h") for s, df in sets.items()])


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    """Column a as rows of an array."""
    return batch.column("a").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def made_of(table: DataFrame, rows: int, encode: Callable[[int, np.ndarray, np.ndarray, np.ndarray], Iterator[tuple]], schema: str) -> DataFrame:
    """The blocks of all sets of a table (see `united`).

    encode: from set, features, labels and hashes of some rows to rows of the schema. rows: of all
    sets together, about, by which small tables get few tasks.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which = batch.column("set").to_numpy()
            step = np.flatnonzero(np.diff(which)) + 1
            for a, b in zip([0, *step.tolist()], [*step.tolist(), len(which)] if len(which) else []):
                part = batch.slice(a, b - a)
                found = list(encode(int(which[a]), matrix(part), part.column("y").to_numpy(), part.column("h").to_numpy().view(np.uint64)))
                if found:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*found))), schema=pa_schema)

    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    pa_schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])
    tasks = max(1, math.ceil(rows / TASK_ROWS))
    return table.mapInArrow(made, schema).coalesce(tasks)


def kept(df: DataFrame) -> DataFrame:
    """df, written to the shared folder, and in memory or on disk as long as its executors live."""
    return cut(df).persist(StorageLevel.MEMORY_AND_DISK)


def merged(table: DataFrame, tasks: int, keys: list[str], bytes_all: int, find: Callable, between: str, merge: Callable, schema: str) -> DataFrame:
    """What each task finds in blocks, put together by key in a few tasks; nothing is shuffled if the table is one task's (see `tasks_of`)."""
    if tasks == 1:
        return table.mapInArrow(lambda batches: merge(find(batches)), schema)
    return table.mapInArrow(find, between).repartition(max(1, bytes_all >> 24), *keys).mapInArrow(merge, schema)


def tasks_of(table: DataFrame) -> int:
    return table.rdd.getNumPartitions()
