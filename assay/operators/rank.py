"""Exact global ranks without a global sort in one task."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.session import cut


def _ranked(df: DataFrame, by: list[str], bucket: list[str], order: list[Column], name: str) -> DataFrame:
    """Row numbers inside buckets, plus the rows in earlier buckets of the same group."""
    sizes = df.groupBy(*by, *bucket).agg(F.count("*").alias("_n"))
    # as many rows as there are buckets (and groups), not as data
    before = Window.partitionBy(*by).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, *bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = df.alias("l").join(F.broadcast(offsets).alias("r"), [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*by, *bucket]]).select("l.*", "r._before")
    inside = Window.partitionBy(*by, *bucket).orderBy(*order)
    return joined.withColumn(name, F.row_number().over(inside) + F.col("_before")).drop("_before", *bucket)


def rank_by_hash(df: DataFrame, h: Column, keys: list[str], by: list[str] | None = None, name: str = "rank", rows: int | None = None) -> DataFrame:
    """Adds the 1-based rank of each row in the order of a hexadecimal hash, then keys; within groups `by` if given.

    Buckets are the hash's first digits, so that work is split evenly whatever the groups; there are
    more of them the more rows there are (counted if not given), and so a bucket is one task's work.
    """
    by, rows = by or [], df.count() if rows is None else rows
    digits = min(6, 2 + max(0, math.ceil(math.log(max(rows, 1) / 1e8, 16))))
    df = df.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, digits))
    return _ranked(df, by, ["_b"], [F.col("_h"), *map(F.col, keys)], name).drop("_h")


def in_text_ranges(df: DataFrame, value: str, by: list[str], name: str, each: int = 1 << 18) -> DataFrame:
    """df with the number of the range that each text falls in, in order of `by` and the texts; equal ones share a range.

    Ranges hold about equally many rows, `each` or fewer: Spark draws their ends from a sample of
    the texts as they are, so that texts with a common beginning are told apart. The table is
    written, for another run of the sample could draw other ends.
    """
    session = df.sparkSession
    ranges = max(int(session.conf.get("spark.sql.shuffle.partitions")), math.ceil(df.count() / each))
    return cut(df.repartitionByRange(ranges, *by, value).withColumn(name, F.spark_partition_id()))


def rank_by_text(df: DataFrame, value: str, by: list[str], name: str = "rank") -> DataFrame:
    """Adds the 1-based rank of each text within groups `by`; buckets are ranges of texts (see `in_text_ranges`)."""
    return _ranked(in_text_ranges(df, value, by, "_b"), by, ["_b"], [F.col(value)], name)


def _as_number(df: DataFrame, column: str) -> Column:
    """A double that never falls where the column rises: of a text its first six bytes, of what has no such order a constant."""
    kind = dict(df.dtypes)[column]
    x = F.col(f"`{column}`")
    if kind.startswith(("timestamp", "date")):
        return F.unix_micros(x.cast("timestamp")).cast("double")
    if kind == "string":
        return F.conv(F.rpad(F.hex(F.substring(F.encode(x, "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
    return F.lit(0.0) if kind.startswith(("boolean", "binary", "array", "struct", "map")) else x.cast("double")


def cuts_of(df: DataFrame, value: str, buckets: int = 256, accuracy: int = 10000) -> list[float]:
    """Ends of intervals, `buckets` at most, that hold about equally many values each; from -inf to inf."""
    grid = df.agg(F.percentile_approx(_as_number(df, value), [k / buckets for k in range(buckets)], accuracy)).first()[0] or []
    return [-math.inf, *sorted({v for v in grid if math.isfinite(v)} or {0.0}), math.inf]


def in_cuts(df: DataFrame, value: str, cuts: list[float], name: str) -> DataFrame:
    """Adds the number of the value's interval; nulls come first."""
    df = df.withColumn("_x", F.coalesce(_as_number(df, value), F.lit(-math.inf)))
    return Bucketizer(splits=cuts, inputCol="_x", outputCol=name, handleInvalid="keep").transform(df).drop("_x")


def rank_by_value(df: DataFrame, value: str, keys: list[str], name: str = "rank", buckets: int = 256) -> DataFrame:
    """Adds the 1-based rank of each row in the order of a number, text, date or timestamp, then keys; nulls come last.

    Buckets are the intervals of a grid of approximate percentiles; rows on a grid point, as a value
    that many rows share is, are split again by a grid of the first key. The grids are a few hundred
    numbers on the driver; ranks don't depend on how exact they are.
    """
    points = [k / buckets for k in range(buckets)]
    df = df.withColumns({"_x": _as_number(df, value), "_k": _as_number(df, keys[0])})
    grids = df.agg(F.percentile_approx("_x", points, 10000), F.percentile_approx("_k", points, 10000)).first()
    cuts = [[-math.inf, *sorted({v for v in g or [0.0] if math.isfinite(v)} or {0.0}), math.inf] for g in grids]
    missing = F.col(f"`{value}`").isNull()
    df = df.withColumns({"_x": F.coalesce("_x", F.lit(math.inf)), "_k": F.coalesce("_k", F.lit(-math.inf))})
    df = Bucketizer(splitsArray=cuts, inputCols=["_x", "_k"], outputCols=["_b", "_s"], handleInvalid="keep").transform(df)
    # rows on an interval's lower end come first, in order of the key; a number or text that a double doesn't tell apart isn't split
    lower = F.element_at(F.array(*[F.lit(v) for v in cuts[0]]), F.col("_b").cast("int") + 1)
    tied = missing | ((F.col("_x") == lower) & (F.abs("_x") < 2**53) & F.lit(dict(df.dtypes)[value] != "string"))
    df = df.withColumns({"_s": F.when(tied, F.col("_s")).otherwise(math.inf), "_b": F.when(missing, math.inf).otherwise(F.col("_b"))})
    return _ranked(df.drop("_x", "_k"), [], ["_b", "_s"], [F.col(f"`{value}`").asc_nulls_last(), *map(F.col, keys)], name)
