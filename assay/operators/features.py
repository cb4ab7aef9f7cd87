"""Features with statistics learned on training folds only.

Statistics of the training rows of all folds come in one aggregate of numbers and one of categories.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.functions.portable import nan_to_null
from assay.operators.median import medians
from assay.operators.profile import kinds
from assay.operators.rank import rank_by_text

INFREQUENT = "__infrequent__"


@dataclass(frozen=True)
class Prep:
    """How features are made: numeric_impute median or mean, scale, categorical onehot or ordinal, most outputs of one-hot."""

    numeric_impute: str = "median"
    scale: bool | None = None
    categorical: str = "onehot"
    max_categories: int = 20

    def __post_init__(self):
        if self.numeric_impute not in ("median", "mean") or self.categorical not in ("onehot", "ordinal") or self.max_categories < 2:
            raise ValueError(f"bad preprocessing {self}")


def bool_to_int(df: DataFrame) -> DataFrame:
    """Booleans as 0 and 1."""
    return df.withColumns({f.name: F.col(f"`{f.name}`").cast("int") for f in df.schema if isinstance(f.dataType, T.BooleanType)} or {df.columns[0]: F.col(f"`{df.columns[0]}`")})


def date_parts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Dates and timestamps as <name>_year, _month and _dow (Monday 0); the column itself goes."""
    columns = [c for c, k in kinds(df).items() if k == "datetime"] if columns is None else columns
    for c in columns:
        x = F.col(f"`{c}`")
        df = df.withColumns({f"{c}_year": F.year(x), f"{c}_month": F.month(x), f"{c}_dow": F.weekday(x)}).drop(c)
    return df


def to_string_null_safe(df: DataFrame) -> DataFrame:
    """What is neither number, boolean, date nor nested as text; missing stays missing."""
    return df.withColumns({c: F.col(f"`{c}`").cast("string") for c, k in kinds(df).items() if k == "categorical"} or {df.columns[0]: F.col(f"`{df.columns[0]}`")})


def clean(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """All columns but `keep` as numbers or text; nested ones go."""
    mine = [c for c in df.columns if c not in keep]
    rest = df.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"`{c}`") for c in mine if kinds(df)[c] != "nested"])
    cast = {}
    for c, k in kinds(rest).items():
        if c not in keep and k in ("boolean", "categorical"):
            cast[c] = F.col(f"`{c}`").cast("int" if k == "boolean" else "string")
    rest = nan_to_null(rest.withColumns(cast) if cast else rest)
    return date_parts(rest, [c for c, k in kinds(rest).items() if k == "datetime" and c not in keep])


def label_encode(df: DataFrame, target: str, classes: DataFrame | None = None, name: str = "label") -> DataFrame:
    """Adds the class's place, from 0, in the order of class names; rows of other classes go if classes are given."""
    found = (df if classes is None else classes).where(F.col(target).isNotNull()).select(F.col(target).cast("string").alias("_class")).distinct()
    codes = found.select("_class", (F.row_number().over(Window.orderBy("_class")) - 1).cast("double").alias(name))
    # a row for each class
    return df.join(F.broadcast(codes), F.col(target).cast("string") == F.col("_class"), "left" if classes is None else "inner").drop("_class")


def fold_values(df: DataFrame, fold_col: str) -> list[int]:
    return sorted(r[0] for r in df.where(F.col(fold_col).isNotNull()).select(fold_col).distinct().collect())


def all_but_own(folds: list[int]) -> dict[int, list[int]]:
    """Each fold's training rows are those of all other folds."""
    return {f: [g for g in folds if g != f] for f in folds}


def numeric_stats(df: DataFrame, columns: list[str], fold_col: str, trains: dict[int, list[int]] | None = None) -> DataFrame:
    """fold, name, median, mean and std (population) of each fold's training rows.

    trains: the values of fold_col that train for each fold; all but its own if not given. Means
    come from one aggregate, medians from a few passes that all folds share (see `median.medians`).
    """
    trains = all_but_own(fold_values(df, fold_col)) if trains is None else trains
    found, row, cells = medians(df, columns, fold_col, trains), [], []
    for f, own in trains.items():
        train = F.col(fold_col).isin(own)
        for i, c in enumerate(columns):
            x = F.when(train, F.col(f"`{c}`").cast("double"))
            row += [F.avg(x).alias(f"mean_{f}_{i}"), F.stddev_pop(x).alias(f"std_{f}_{i}")]
            cells.append(F.struct(F.lit(f).alias("fold"), F.lit(c).alias("name"), F.lit(found.get((f, c))).cast("double").alias("median"), *[F.col(f"{s}_{f}_{i}").alias(s) for s in ("mean", "std")]))
    return df.agg(*row).select(F.inline(F.array(*cells)))


def category_counts(df: DataFrame, columns: list[str], fold_col: str, trains: dict[int, list[int]] | None = None) -> DataFrame:
    """fold, name, value and n of each fold's training rows: sums of the counts of those that train for it (see `numeric_stats`)."""
    trains = all_but_own(fold_values(df, fold_col)) if trains is None else trains
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    own = df.select(F.col(fold_col).alias("_own"), F.inline(cells)).where("value is not null").groupBy("_own", "name", "value").agg(F.count("*").alias("n"))
    # a few numbers for each of the folds
    taught = F.array(*[F.when(F.col("_own").isin(o), F.lit(f)) for f, o in trains.items()])
    each = own.select(F.explode(F.filter(taught, lambda f: f.isNotNull())).alias("fold"), "name", "value", "n")
    return each.groupBy("fold", "name", "value").agg(F.sum("n").alias("n"))


def impute_mode(counts: DataFrame) -> DataFrame:
    """fold, name and the most frequent value; of equals the smallest."""
    return counts.groupBy("fold", "name").agg(F.min(F.struct((-F.col("n")).alias("n"), "value"))["value"].alias("mode"))


def leading(counts: DataFrame, most: int) -> DataFrame:
    """fold, name, value and place (from 1) of the `most` most frequent values and one more; ties by value."""
    place = F.row_number().over(Window.partitionBy("fold", "name").orderBy(F.desc("n"), "value"))
    return counts.select("fold", "name", "value", place.alias("place")).where(F.col("place") <= most + 1)


def outputs_of(values: list[str], max_categories: int) -> list[str]:
    """One-hot outputs of leading values in order: their own, or the first ones' and one for all others."""
    return values if len(values) <= max_categories else [*values[: max_categories - 1], INFREQUENT]


def onehot_categories(counts: DataFrame, max_categories: int = 20) -> DataFrame:
    """fold, name, value and output: own ones for the most frequent values; one for all others if they are too many."""
    listed = leading(counts, max_categories).groupBy("fold", "name").agg(F.count("*").alias("_n"), F.map_from_entries(F.collect_list(F.struct("value", "place"))).alias("_places"))
    # a row of a few values for each fold and column
    joined = counts.join(F.broadcast(listed), ["fold", "name"])
    own = (F.col("_n") <= max_categories) | (F.col("_places")[F.col("value")] < max_categories)
    return joined.select("fold", "name", "value", F.when(F.coalesce(own, F.lit(False)), F.col("value")).otherwise(INFREQUENT).alias("output"))


def ordinal_codes(counts: DataFrame) -> DataFrame:
    """fold, name, value and its place, from 0, among the training values in order."""
    return rank_by_text(counts.select("fold", "name", "value"), "value", ["fold", "name"], "code").withColumn("code", F.col("code") - 1)


def impute(df: DataFrame, columns: list[str], stats: DataFrame, fold: int, how: str = "median", scale: bool = False) -> DataFrame:
    """Numbers of all rows as one fold sees them: missing ones filled, and standardized if asked.

    A column that has no value in the fold's training rows goes.
    """
    found = {r["name"]: r for r in stats.where(F.col("fold") == fold).collect()}  # a row for each column
    out = {}
    for c in columns:
        s = found[c]
        if s[how] is None:
            df = df.drop(c)
            continue
        x = F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float(s[how])))
        out[c] = (x - F.lit(s["mean"])) / F.lit(s["std"] or 1.0) if scale else x
    return df.withColumns(out) if out else df


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean over their population deviation; a constant becomes 0."""
    stats = df.agg(*[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in columns]).first()
    return df.withColumns({c: F.when(F.col(c).isNotNull(), (F.col(c).cast("double") - F.lit(stats[c]["mean"])) / F.lit(stats[c]["std"] or 1.0)) for c in columns if stats[c]["mean"] is not None})


def balanced_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Adds n / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    all_rows = counts.agg(F.sum("_n").alias("n"), F.count("*").alias("k"))
    weights = counts.select(F.col(label).alias("_label"), (all_rows.select("n").scalar() / (all_rows.select("k").scalar() * F.col("_n"))).alias(name))
    return df.join(F.broadcast(weights), F.col(label).eqNullSafe(F.col("_label"))).drop("_label")
