"""Exact medians of many training sets in bounded memory, by successive narrowing.

A pass counts values between the points of a grid, for all training sets at once, and finds the
interval that holds each wanted rank; the next pass looks at those intervals only, on a finer grid.
Few passes do: an interval holds about a thousandth of the values, or one value that is often met,
which is then the answer. No task keeps distinct values but of an interval of bounded size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class _Range:
    """Values of one column from low up to below high (to inf: all)."""

    column: int
    low: float
    high: float


def _cells(numbers: DataFrame, own: str, ranges: list[_Range], coded: bool) -> DataFrame:
    """own, range, x and, if coded, the bucket of each value in each of the ranges."""
    extra = [F.col(f"_b{i}").alias("bucket") for i in range(len(ranges))] if coded else [F.lit(0.0).alias("bucket")] * len(ranges)
    each = [F.when(F.col(f"_x{i}").isNotNull(), F.struct(F.lit(i).alias("range"), F.col(f"_x{i}").alias("x"), extra[i])) for i in range(len(ranges))]
    return numbers.select(own, F.explode(F.array_compact(F.array(*each)))).select(own, "col.*")


def _in_ranges(numbers: DataFrame, own: str, ranges: list[_Range]) -> DataFrame:
    cols = []
    for i, r in enumerate(ranges):
        x = F.col(f"_{r.column}")
        cols.append(F.when((x >= r.low) & ((x < r.high) | F.lit(r.high == math.inf)), x).alias(f"_x{i}"))
    return numbers.select(own, *cols)


def _by_train(cells: DataFrame, own: str, trains: dict[int, list[int]]) -> DataFrame:
    """Rows of cells once for each training set that their part is in."""
    taught = F.array_compact(F.array(*[F.when(F.col(own).isin(parts), F.lit(f)) for f, parts in trains.items()]))
    return cells.withColumn("train", F.explode(taught))


def medians(df: DataFrame, columns: list[str], own: str, trains: dict[int, list[int]], buckets: int = 1000, most: int = 1 << 14) -> dict[tuple[int, str], float]:
    """The median of each training set and column, by (set, column); half between the middle two; none without values.

    trains: the values of column `own` whose rows are in each set. most: values of an interval that
    are sorted in one task; the driver gets grids and two ranks for each set and column.
    """
    numbers = df.select(own, *[F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")).alias(f"_{i}") for i, c in enumerate(columns)])
    ranges = [_Range(i, -math.inf, math.inf) for i in range(len(columns))]
    # of each set and column the two middle ranks: where they are sought, and their place there; None until counted
    wanted: dict[tuple[int, int, int], tuple[_Range, int | None]] = {(t, i, k): (ranges[i], None) for t in trains for i in range(len(columns)) for k in (0, 1)}
    found: dict[tuple[int, int, int], float] = {}
    points = ", ".join(f"{k / buckets!r}D" for k in range(buckets + 1))
    while wanted:
        ranges = sorted({r for r, _ in wanted.values()}, key=lambda r: (r.column, r.low, r.high))
        held = _in_ranges(numbers, own, ranges)
        grid = held.agg(*[F.expr(f"percentile_approx(_x{i}, array({points}), {10 * buckets})").alias(f"g{i}") for i in range(len(ranges))]).first()
        cuts = [[-math.inf, *sorted({v for v in grid[f"g{i}"] or [0.0] if math.isfinite(v)} or {0.0}), math.inf] for i in range(len(ranges))]
        coded = Bucketizer(splitsArray=cuts, inputCols=[f"_x{i}" for i in range(len(ranges))], outputCols=[f"_b{i}" for i in range(len(ranges))], handleInvalid="keep").transform(held)
        counts = _cells(coded, own, ranges, True).groupBy(own, "range", "bucket").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        counts = _by_train(counts, own, trains).groupBy("train", "range", "bucket").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        # as many rows as there are buckets
        order = Window.partitionBy("train", "range").orderBy("bucket")
        counts = counts.withColumns({"before": F.sum("n").over(order) - F.col("n"), "all": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
        known = {(t, ranges.index(r), k): place for (t, _, k), (r, place) in wanted.items() if place is not None}
        ask = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(i).alias("r"), F.lit(k).alias("k"), F.lit(p).cast("long").alias("place")) for (t, i, k), p in known.items()]) if known else None
        middle = F.array(*[F.struct(F.col("train").alias("t"), F.col("range").alias("r"), F.lit(k).alias("k"), F.floor((F.col("all") - 1 + k) / 2).alias("place")) for k in (0, 1)])
        rows = counts.withColumn("q", F.explode(F.filter(middle if ask is None else ask, lambda q: (q["t"] == F.col("train")) & (q["r"] == F.col("range")) & (q["place"] >= F.col("before")) & (q["place"] < F.col("before") + F.col("n")))))
        small: dict[tuple[int, int, int], tuple[_Range, int]] = {}
        wanted = {}
        for r in rows.select("train", "range", "bucket", "n", "lo", "hi", (F.col("q.place") - F.col("before")).alias("place"), "q.k").collect():  # two for each set and column
            own_range, key = ranges[r["range"]], (r["train"], ranges[r["range"]].column, r["k"])
            if r["lo"] == r["hi"] or r["place"] in (0, r["n"] - 1):
                found[key] = r["lo"] if r["place"] == 0 else r["hi"]
                continue
            at = int(r["bucket"])
            inner = _Range(own_range.column, max(own_range.low, cuts[r["range"]][at]), min(own_range.high, cuts[r["range"]][at + 1]))
            (small if r["n"] <= most or inner == own_range else wanted)[key] = inner, r["place"]
        found |= _sorted_out(numbers, own, trains, small)
    out = {}
    for (t, i, k), v in found.items():
        if k == 0:
            out[t, columns[i]] = 0.5 * v + 0.5 * found[t, i, 1]
    return out


def _sorted_out(numbers: DataFrame, own: str, trains: dict[int, list[int]], small: dict) -> dict[tuple[int, int, int], float]:
    """Values at places of small intervals, which are sorted as they are."""
    if not small:
        return {}
    ranges = sorted({r for r, _ in small.values()}, key=lambda r: (r.column, r.low, r.high))
    places = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(ranges.index(r)).alias("r"), F.lit(k).alias("k"), F.lit(p).cast("int").alias("place")) for (t, _, k), (r, p) in small.items()])
    asked = lambda q: (q["t"] == F.col("train")) & (q["r"] == F.col("range"))
    cells = _by_train(_cells(_in_ranges(numbers, own, ranges), own, ranges, False), own, trains).where(F.exists(places, asked))
    lists = cells.groupBy("train", "range").agg(F.array_sort(F.collect_list("x")).alias("x"))
    rows = lists.select("train", "range", F.explode(F.transform(F.filter(places, asked), lambda q: F.struct(q["k"].alias("k"), F.get("x", q["place"]).alias("v")))).alias("a"))
    return {(r["train"], ranges[r["range"]].column, r["k"]): r["v"] for r in rows.select("train", "range", "a.*").collect()}
