"""The folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts into which the rows of one key are dealt.
SALTS = 32
#: Rows of a few longs that make one part of a counted table.
PART = 1 << 12


def cut(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder and read from there.

    The folder is the session's spark.checkpoint.dir; only a local session without one gets a
    temporary folder of its own.
    """
    context = df.sparkSession.sparkContext
    if not context.getConf().get("spark.checkpoint.dir") and context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def packed(df: DataFrame, rows: int) -> DataFrame:
    """df, which has `rows` rows of a few longs at most, in one part for each PART rows, or as it is if it has fewer parts.

    However few the rows, each part is a task and several files, and a shuffle has as many as the session says.
    """
    return df.coalesce(max(1, -(-rows // PART)))


def small_side(keys: DataFrame, most: int = 1 << 22) -> DataFrame:
    """keys (a few longs a row), written and counted: broadcast to a join if there are `most` rows or fewer, else shuffled."""
    keys = cut(keys)
    rows = keys.count()
    return F.broadcast(packed(keys, rows)) if rows <= most else keys


def looked_up(rows: DataFrame, lookup: DataFrame, key: str, by: str) -> DataFrame:
    """rows with what lookup, which has one row for each key, says of their key; rows without it go.

    The rows of a key are dealt over parts by a hash of column `by`, so that a key that many rows
    share is not one task's work; lookup's row is there once for each part that has rows.
    """
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    parts = dealt.select(key, "_part").distinct().join(lookup, key)
    return dealt.join(parts, [key, "_part"]).drop("_part")
