"""The most frequent values of many columns, exact, without shuffling the values of columns that have many."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.session import cut

#: Values that a task keeps of a column; it may hold twice as many for a while.
SIZE = 4096
_SCHEMA = pa.schema([("name", pa.int32()), ("key", pa.string()), ("n", pa.int64())])


def _key(value: Column) -> Column:
    """A short text in place of a value: itself, or the SHA-256 of a long one."""
    return F.when(F.length(value) <= 64, F.concat(F.lit("="), value)).otherwise(F.concat(F.lit("#"), F.sha2(value.cast("binary"), 256)))


def _shrink(kept: Counter, size: int) -> int:
    """Leave `size` values at most: the next largest count is taken off all, and returned."""
    off = sorted(kept.values(), reverse=True)[size]
    for v in [v for v, n in kept.items() if n <= off]:
        del kept[v]
    for v in kept:
        kept[v] -= off
    return off


def summaries(df: DataFrame, columns: list[str], size: int = SIZE) -> DataFrame:
    """(position in columns, key, n): counts of values, each at most too low by the n of the row without a key.

    Each task keeps 2 x size values of a column and takes the same number off all when there are more,
    so that what a count lacks is at most rows / size. Summaries merge by sums. Nulls don't count.
    """
    cells = df.select(*[_key(F.col(f"`{c}`").cast("string")).alias(f"v{i}") for i, c in enumerate(columns)])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, lacking = [Counter() for _ in columns], [0] * len(columns)
        for batch in batches:
            for i, counts in enumerate(kept):
                found = pc.value_counts(batch.column(i).drop_null())
                counts.update(dict(zip(found.field("values").to_pylist(), found.field("counts").to_pylist())))
                if len(counts) > 2 * size:
                    lacking[i] += _shrink(counts, size)
        for i, counts in enumerate(kept):
            yield pa.record_batch([pa.array([i] * (len(counts) + 1), pa.int32()), pa.array([None, *counts], pa.string()), pa.array([lacking[i], *counts.values()], pa.int64())], schema=_SCHEMA)

    return cells.mapInArrow(summed, "name int, key string, n long").groupBy("name", "key").agg(F.sum("n").alias("n"))


def _first(counts: DataFrame, top: int, *ties: str) -> DataFrame:
    """Adds place among the counts of a name, from 1 to top."""
    order = Window.partitionBy("name").orderBy(F.desc("n"), *ties)
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def _long(df: DataFrame, columns: dict[int, str]) -> DataFrame:
    """(name, value): a row for each value, missing ones left out."""
    cells = [F.struct(F.lit(i).alias("name"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in columns.items()]
    return df.select(F.inline(F.array(*cells))).where("value is not null")


def _once(df: DataFrame, columns: dict[int, str], top: int) -> tuple[list[DataFrame], list[int]]:
    """Top values of columns whose values hardly repeat, and the columns that are not such.

    Only hashes are counted. If fewer than `top` hashes of a column repeat, their values are counted, and the
    others, all single, come in order of the value, which takes `top` of each task.
    """
    hashed = _long(df, columns).select("name", F.xxhash64("value").alias("h")).groupBy("name", "h").agg(F.count("*").alias("n")).where("n > 1")
    repeated: dict[int, list[int]] = {}
    for r in _first(hashed, top).collect():
        repeated.setdefault(r["name"], []).append(r["h"])
    flat = {i: c for i, c in columns.items() if len(repeated.get(i, [])) < top}
    found = []
    for i, c in flat.items():
        cells = _long(df, {i: c})
        again = F.xxhash64("value").isin(repeated.get(i, []))
        found.append(cells.where(again).groupBy("name", "value").agg(F.count("*").alias("n")))
        found.append(cells.where(~again).orderBy("value").limit(top).withColumn("n", F.lit(1).cast("long")))
    return found, [i for i in columns if i not in flat]


class Frequent:
    """Merged summaries of some columns of a table; see `top` and `few`."""

    def __init__(self, df: DataFrame, columns: list[str], size: int = SIZE):
        self.df, self.columns, self.size = df, columns, size
        self.merged = cut(summaries(df, columns, size)) if columns else None
        n_values = F.count("key").alias("n_values")
        # a row for each column
        stats = self.merged.groupBy("name").agg(n_values, F.sum(F.when(F.col("key").isNull(), F.col("n"))).alias("lacking"), F.max(F.col("key").startswith("#")).alias("long")).collect() if columns else []
        self.stats = {r["name"]: r for r in stats}

    def few(self, most: int) -> list[str]:
        """The columns of `most` values or fewer."""
        return [c for i, c in enumerate(self.columns) if i not in self.stats or (not self.stats[i]["lacking"] and self.stats[i]["n_values"] <= most)]

    def top(self, top: int) -> DataFrame:
        """name, value, n and place of the most frequent values of each column; ties by value.

        A value outside the summaries occurs no more often than they lack. Where that is less than
        the last place's count, only values that may reach it are counted again; where nothing is
        lacking, nothing is counted again. Columns without frequent values go by `_once`, and if
        their values do repeat, are grouped whole.
        """
        session = self.df.sparkSession
        names = session.createDataFrame(list(enumerate(self.columns)), "name int, column string")
        if not self.columns:
            return session.createDataFrame([], "name string, value string, n long, place int")
        counts = self.merged.where("key is not null")
        places = _first(counts, top).groupBy("name").agg(F.max("place").alias("place"), F.min("n").alias("n")).collect()
        last = {r["name"]: (r["place"], r["n"]) for r in places}
        exact = [i for i, s in self.stats.items() if not s["lacking"] and not s["long"]]
        found = [counts.where(F.col("name").isin(exact)).select("name", F.expr("substring(key, 2)").alias("value"), "n")] if exact else []
        open_ = {i: self.columns[i] for i in self.stats if i not in exact}
        # with the least count that a value in the summaries has if it reaches the last place
        likely = [(i, last[i][1] - self.stats[i]["lacking"]) for i in open_ if i in last and (last[i][0] >= top or not self.stats[i]["lacking"])]
        likely = [(i, n) for i, n in likely if n > 0]
        if likely:
            bounds = session.createDataFrame(likely, "name int, least long")
            candidates = cut(counts.join(F.broadcast(bounds), "name").where("n >= least").select("name", "key"))
            sizes = {r["name"]: r["size"] for r in candidates.groupBy("name").agg(F.count("*").alias("size")).collect()}
            decided = {i: self.columns[i] for i, size in sizes.items() if size <= self.size}
            if decided:
                # `size` keys of a column at most
                cells = _long(self.df, decided).withColumn("key", _key(F.col("value")))
                again = cells.join(F.broadcast(candidates.where(F.col("name").isin([*decided]))), ["name", "key"], "left_semi")
                found.append(again.groupBy("name", "value").agg(F.count("*").alias("n")))
                open_ = {i: c for i, c in open_.items() if i not in decided}
        if open_:
            singles, rest = _once(self.df, open_, top)
            found += singles
            if rest:
                found.append(_long(self.df, {i: open_[i] for i in rest}).groupBy("name", "value").agg(F.count("*").alias("n")))
        if not found:
            return session.createDataFrame([], "name string, value string, n long, place int")
        ranked = _first(reduce(DataFrame.unionByName, found), top, "value")
        return ranked.join(F.broadcast(names), "name").select(F.col("column").alias("name"), "value", "n", "place")
