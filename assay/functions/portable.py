"""Hashes and roundings that give the same values in any SQL engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text_hash(seed: int | str | Column, *cols: Column | str) -> Column:
    """MD5 of the seed and the columns as text, joined by `|`; nulls are left out."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws("|", seed.cast("string"), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]).cast("binary"))


def uniform(seed: int | str | Column, *cols: Column | str) -> Column:
    """A number in [0, 1) from the first 32 bits of text_hash."""
    return F.conv(F.substring(text_hash(seed, *cols), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes null in every float and double column, so that missing is one thing."""
    floats = {f.name: F.when(~F.isnan(F.col(f"`{f.name}`")), F.col(f"`{f.name}`")) for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.withColumns(floats) if floats else df


def skew(c: Column) -> Column:
    """Bias-adjusted skewness: null under three values, 0 for a constant."""
    n = F.count(c).cast("double")
    constant = F.min(c) == F.max(c)
    return F.when(n < 3, F.lit(None).cast("double")).when(constant, F.lit(0.0)).otherwise(F.skewness(c) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def pearson(x: Column, y: Column) -> Column:
    """Correlation over rows that have both; null if either is constant there."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x).cast("double"), F.when(both, y).cast("double")
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
