"""Student's t distribution as a Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def t_sf(t: Column, df: Column) -> Column:
    """P(T > t) for whole degrees of freedom, by the finite series in the angle atan(t / sqrt(df)).

    An infinite t gives 0 or 1; null stays null.
    """
    n = df.cast("int")
    angle = F.atan(t / F.sqrt(n.cast("double")))
    cosine2 = F.cos(angle) * F.cos(angle)

    def series(first: Column, terms: Column, ratio) -> Column:
        """first * (1 + r1 cos2 (1 + r2 cos2 ...)), terms of it."""
        steps = F.when(terms >= 1, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>"))
        start = F.struct(first.alias("term"), first.alias("sum"))
        step = lambda acc, k: F.struct((acc["term"] * cosine2 * ratio(k.cast("double"))).alias("term"), (acc["sum"] + acc["term"] * cosine2 * ratio(k.cast("double"))).alias("sum"))
        return F.aggregate(steps, start, step, lambda acc: acc["sum"])

    odd_sum = series(F.cos(angle), F.floor((n - 3) / 2).cast("int"), lambda k: 2 * k / (2 * k + 1))
    odd = 2 / F.pi() * (angle + F.when(n == 1, F.lit(0.0)).otherwise(F.sin(angle) * odd_sum))
    even = F.sin(angle) * series(F.lit(1.0), F.floor((n - 2) / 2).cast("int"), lambda k: (2 * k - 1) / (2 * k))
    inside = F.when(n % 2 == 1, odd).otherwise(even)
    return F.when(t == F.lit(float("inf")), F.lit(0.0)).when(t == F.lit(float("-inf")), F.lit(1.0)).otherwise((1 - inside) / 2)
