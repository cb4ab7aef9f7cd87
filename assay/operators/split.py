"""Holdouts and folds, assigned by hash or by time, alike however the data is partitioned."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.functions.portable import text_hash
from assay.operators.rank import cuts_of, in_cuts, rank_by_hash, rank_by_value
from assay.session import cut

SEED = 42


def guess_task(df: DataFrame, target: str) -> DataFrame:
    """One row: task, and what decided it.

    Classification if the target is no number or boolean, or a null-free whole number of at most 20
    values; else regression.
    """
    kind = df.schema[target].dataType
    row = df.agg(F.countDistinct(target).alias("n_distinct"), F.count(F.when(F.col(target).isNull(), 1)).alias("n_missing"))
    if not isinstance(kind, T.NumericType):
        task = F.lit("classification")
    elif isinstance(kind, T.IntegralType):
        task = F.when((F.col("n_missing") == 0) & (F.col("n_distinct") <= 20), "classification").otherwise("regression")
    else:
        task = F.lit("regression")
    return row.select(F.lit(target).alias("target"), task.alias("task"), "n_distinct", "n_missing")


def sorted_time_columns(df: DataFrame, target: str, order_col: str) -> DataFrame:
    """For each datetime column but the target: name, n_values, in_order (never falls in row order)."""
    times = [f.name for f in df.schema if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)) and f.name != target]
    if not times:
        return df.sparkSession.createDataFrame([], "name string, n_values long, in_order boolean")
    # a row's predecessor is the one before in its bucket, or the last of the bucket before
    rows = in_cuts(df.select(F.col(order_col).alias("_o"), *times), "_o", cuts_of(df, order_col), "_b")
    out = None
    for c in times:
        inside = Window.partitionBy("_b").orderBy("_o")
        steps = rows.select("_b", c, F.lag(c).over(inside).alias("_p"), F.row_number().over(inside).alias("_r"))
        per = steps.groupBy("_b").agg(F.coalesce(F.bool_and(F.when(F.col("_r") > 1, F.coalesce(F.col("_p") <= F.col(c), F.lit(False)))), F.lit(True)).alias("ok"), F.min(c).alias("lo"), F.max(c).alias("hi"), F.count(F.when(F.col(c).isNull(), 1)).alias("nulls"))
        # one row for each bucket
        joints = per.withColumn("_ok", F.col("ok") & (F.col("nulls") == 0) & F.coalesce(F.lag("hi").over(Window.orderBy("_b")) <= F.col("lo"), F.lit(True)))
        in_order = joints.agg(F.coalesce(F.bool_and("_ok"), F.lit(False)).alias("in_order"))
        values = df.agg(F.countDistinct(c).alias("n_values"))
        row = values.select(F.lit(c).alias("name"), "n_values", in_order.select("in_order").scalar().alias("in_order"))
        out = row if out is None else out.unionByName(row)
    return out


def sorted_time_column(df: DataFrame, target: str, order_col: str) -> str | None:
    """The first datetime column that never falls in row order and has more than one value."""
    for r in sorted_time_columns(df, target, order_col).collect():  # a row for each datetime column
        if r["in_order"] and r["n_values"] > 1:
            return r["name"]
    return None


def _quotas(df: DataFrame, label: str, total: Column) -> DataFrame:
    """Rows of each class that go to the hidden side: proportional, rounded by largest remainder, `total` together."""
    sizes = df.groupBy(label).agg(F.count("*").alias("_size"))
    everyone = Window.partitionBy()
    exact = F.col("_size") * F.col("_total") / F.col("_all")
    rows = sizes.withColumn("_all", F.sum("_size").over(everyone)).withColumn("_total", total).withColumn("_floor", F.floor(exact)).withColumn("_rest", exact - F.floor(exact))
    order = Window.orderBy(F.col("_rest").desc(), F.col(label))
    short = F.col("_total") - F.sum("_floor").over(everyone)
    return rows.select(label, "_size", (F.col("_floor") + F.when(F.row_number().over(order) <= short, 1).otherwise(0)).alias("_quota"))


def holdout_time(df: DataFrame, time_col: str, keys: list[str], hidden: float = 0.2) -> DataFrame:
    """Adds split: the first round((1 - hidden) n) rows by time are `dev`, the rest `hidden`; missing times are last."""
    n = df.count()
    dev = round((1 - hidden) * n)
    return rank_by_value(df, time_col, keys, "_rank").withColumn("split", F.when(F.col("_rank") <= dev, "dev").otherwise("hidden")).drop("_rank")


def holdout_random(df: DataFrame, keys: list[str], hidden: float = 0.2, seed: int = SEED) -> DataFrame:
    """Adds split: the ceil(hidden n) rows of smallest hashed key are `hidden`."""
    n = df.count()
    n_hidden = math.ceil(round(hidden * n, 9))
    return rank_by_hash(df, text_hash(seed, *keys), keys, name="_rank", rows=n).withColumn("split", F.when(F.col("_rank") <= n_hidden, "hidden").otherwise("dev")).drop("_rank")


def holdout_stratified(df: DataFrame, label: str, keys: list[str], hidden: float = 0.2, seed: int = SEED) -> DataFrame:
    """Adds split, with each class's share on both sides; unstratified if some class has one row only."""
    smallest, n = df.groupBy(label).count().agg(F.min("count"), F.sum("count")).first()
    if smallest is None or smallest < 2:
        return holdout_random(df, keys, hidden, seed)
    quotas = _quotas(df, label, F.ceil(F.round(F.col("_all") * hidden, 9)))
    ranked = rank_by_hash(df, text_hash(seed, *keys), keys, [label], "_rank", n)
    # a row for each class
    joined = ranked.alias("l").join(F.broadcast(quotas).alias("r"), F.col(f"l.{label}").eqNullSafe(F.col(f"r.{label}"))).select("l.*", "r._quota")
    return joined.withColumn("split", F.when(F.col("_rank") <= F.col("_quota"), "hidden").otherwise("dev")).drop("_rank", "_quota")


def split_holdout(df: DataFrame, target: str, task: str, keys: list[str], time_col: str | None = None, hidden: float = 0.2, seed: int = SEED) -> DataFrame:
    """Adds split by time, by class or at random."""
    if time_col:
        return holdout_time(df, time_col, keys, hidden)
    return holdout_stratified(df, target, keys, hidden, seed) if task == "classification" else holdout_random(df, keys, hidden, seed)


def fold_kfold(df: DataFrame, k: int, keys: list[str], seed: int = SEED, repeat: int = 0, rows: int | None = None) -> DataFrame:
    """Adds fold, 0 to k-1, shuffled by hash; sizes differ by one at most."""
    return rank_by_hash(df, text_hash(f"{seed}.{repeat}", *keys), keys, name="_rank", rows=rows).withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def fold_stratified(df: DataFrame, k: int, label: str, keys: list[str], seed: int = SEED, repeat: int = 0, rows: int | None = None) -> DataFrame:
    """Adds fold, so that in each class and in all sizes differ by one at most: classes follow each other round-robin."""
    sizes = df.groupBy(label).agg(F.count("*").alias("_size"))
    offsets = sizes.select(label, F.coalesce(F.sum("_size").over(Window.orderBy(label).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    ranked = rank_by_hash(df, text_hash(f"{seed}.{repeat}", *keys), keys, [label], "_rank", rows)
    joined = ranked.alias("l").join(F.broadcast(offsets).alias("r"), F.col(f"l.{label}").eqNullSafe(F.col(f"r.{label}"))).select("l.*", "r._offset")
    return joined.withColumn("fold", ((F.col("_offset") + F.col("_rank") - 1) % k).cast("int")).drop("_rank", "_offset")


def repeated(df: DataFrame, repeats: int, assign) -> DataFrame:
    """All repeats of assign(df, repeat), with a column repeat."""
    out = None
    for r in range(repeats):
        one = assign(df, r).withColumn("repeat", F.lit(r))
        out = one if out is None else out.unionByName(one)
    return out


def fold_timeseries(df: DataFrame, k: int, time_col: str, keys: list[str]) -> DataFrame:
    """Adds pos (0-based place in time) and fold: the last k blocks of n div (k+1) rows are tests; null before them."""
    n = df.count()
    m = n // (k + 1)
    ranked = rank_by_value(df, time_col, keys, "_rank").withColumn("pos", (F.col("_rank") - 1).cast("long")).drop("_rank")
    start = n - k * m
    return ranked.withColumn("fold", F.when((F.col("pos") >= start) & F.lit(m > 0), F.floor((F.col("pos") - start) / max(m, 1)).cast("int")))


def timeseries_train(df: DataFrame, k: int, n: int) -> DataFrame:
    """Rows of fold_timeseries once for each fold that they train: those before the fold's first test row."""
    m = n // (k + 1)
    starts = df.sparkSession.createDataFrame([(i, n - k * m + i * m) for i in range(k)], "train_fold int, start long")
    return df.join(F.broadcast(starts), F.col("pos") < F.col("start")).drop("start")


def assign_folds(df: DataFrame, k: int, keys: list[str], repeats: int = 1, stratify: str | None = None, time_col: str | None = None, seed: int = SEED) -> DataFrame:
    """Adds repeat and fold. Folds in time have one repeat."""
    if time_col:
        return fold_timeseries(df, k, time_col, keys).drop("pos").withColumn("repeat", F.lit(0))
    n = df.count()
    if stratify:
        return repeated(df, repeats, lambda d, r: fold_stratified(d, k, stratify, keys, seed, r, n))
    return repeated(df, repeats, lambda d, r: fold_kfold(d, k, keys, seed, r, n))


#: Words of 64 bits in a bitmap of hashes, so that it has 16 MB at most whatever the rows.
WORDS = 1 << 21


def possible_matches(df: DataFrame, other: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of df whose columns may equal those of some row of other: all that do, and few more.

    The bitmap of other's hashes is a grouped OR, broadcast by words that have a bit. Of rows without a
    match a share of (distinct rows of other / 2^27) passes, so that beyond 2^27 rows it holds little back.
    """
    place = F.xxhash64(*[F.col(f"`{c}`") for c in columns]) if columns else F.lit(0).cast("long")
    word, bit = (F.shiftrightunsigned(place, 6) % WORDS).alias("_word"), F.expr("shiftleft(1L, cast(_place & 63 as int))")
    bitmap = other.select(place.alias("_place"), word).groupBy("_word").agg(F.bit_or(bit).alias("_bits"))
    # WORDS rows at most
    tested = df.withColumns({"_place": place, "_word": word}).join(F.broadcast(bitmap), "_word")
    return tested.where(F.col("_bits").bitwiseAND(bit) != 0).select(*[F.col(f"`{c}`") for c in df.columns])


def cross_split_duplicates(dev: DataFrame, hidden: DataFrame, target: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Rows of hidden whose features all equal those of some dev row; missing equals missing.

    Only rows that may have a match are shuffled: dev is held against a bitmap of hidden's hashes,
    and hidden against one of what is left of dev. The join that follows compares the features.
    """
    features = [c for c in dev.columns if c != target and c not in exclude]
    columns = [F.col(f"`{c}`") for c in features]
    known = cut(possible_matches(dev.select(*columns), hidden, features).distinct())
    hidden = possible_matches(hidden, known, features)
    known = known.alias("d")
    return hidden.alias("h").join(known, [F.col(f"h.`{c}`").eqNullSafe(F.col(f"d.`{c}`")) for c in features], "left_semi")


def split_summary(df: DataFrame, method: str, target: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """One row: rows on each side, how they were split, and cross-split duplicates."""
    side = lambda s: df.where(F.col("split") == s).drop("split")
    duplicates = cross_split_duplicates(side("dev"), side("hidden"), target, exclude).agg(F.count("*").alias("n"))
    return df.agg(F.count(F.when(F.col("split") == "dev", 1)).alias("n_dev"), F.count(F.when(F.col("split") == "hidden", 1)).alias("n_hidden")).select("n_dev", "n_hidden", F.lit(method).alias("method"), duplicates.select("n").scalar().alias("n_duplicates"))
