"""What a table's columns hold: counts, balance, correlation with the target, and flags.

All columns are profiled in a few jobs whatever their number: one wide aggregate, summaries of
frequent values, one grouping of (column, value, class) of columns with few values and one of whole rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.functions.portable import nan_to_null, pearson, skew
from assay.operators.filters import require_columns
from assay.operators.frequent import Frequent

LEAK_CORRELATION, LEAK_PURITY, LEAK_GAIN = 0.95, 0.98, 0.05
MOST_LEVELS, ID_SHARE, MOSTLY = 50, 0.95, 40.0
DROPPED_FLAGS = ("id_like", "possible_leakage", "constant")


def kind(field: T.StructField) -> str:
    """boolean, datetime, numeric, categorical, or nested."""
    t = field.dataType
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(t, T.NumericType):
        return "numeric"
    return "nested" if isinstance(t, (T.ArrayType, T.MapType, T.StructType, T.VariantType)) else "categorical"


def kinds(df: DataFrame, target: str | None = None) -> dict[str, str]:
    """Kind of each column but the target."""
    return {f.name: kind(f) for f in df.schema if f.name != target}


def _long(df: DataFrame, row: dict[str, Column], columns: list[str], **types: str) -> DataFrame:
    """A row for each of some columns, out of one row of aggregates named <value>_<position>."""
    if not columns:
        return df.sparkSession.createDataFrame([], ", ".join(["name string", *[f"{v} {t}" for v, t in types.items()]]))
    found = df.agg(*row.values())
    each = F.array(*[F.struct(F.lit(c).alias("name"), *[F.col(f"{v}_{i}").cast(t).alias(v) for v, t in types.items()]) for i, c in enumerate(columns)])
    return found.select(F.inline(each))


def shape(df: DataFrame, target: str) -> DataFrame:
    """One row: n_rows, n_features."""
    return df.agg(F.count("*").alias("n_rows")).select("n_rows", F.lit(len(df.columns) - 1).alias("n_features"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: rows that repeat an earlier one in all columns; missing equals missing."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))


def class_balance(df: DataFrame, target: str, top: int = 10) -> DataFrame:
    """class and share (3 decimals) of the most frequent classes."""
    counts = df.where(F.col(target).isNotNull()).groupBy(F.col(target).cast("string").alias("class")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("n"))
    return counts.orderBy(F.desc("n"), "class").limit(top).select("class", F.round(F.col("n") / total.select("n").scalar(), 3).alias("share"))


def target_summary(df: DataFrame, target: str) -> DataFrame:
    """One row: n_classes, missing_pct (1 decimal), min, max, mean and skew (4 decimals) of a target; the latter only of a number."""
    y = F.col(target)
    numeric = isinstance(df.schema[target].dataType, T.NumericType)
    number = y.cast("double") if numeric else F.lit(None).cast("double")
    values = {"min": F.min(number), "max": F.max(number), "mean": F.avg(number), "skew": skew(number)}
    return df.agg(F.countDistinct(y).alias("n_classes"), F.round(100 * F.avg(y.isNull().cast("int")), 1).alias("missing_pct"), *[F.round(v, 4).alias(n) for n, v in values.items()])


def missing(df: DataFrame) -> DataFrame:
    """name and missing_pct (1 decimal) of each column."""
    row = {c: F.round(100 * F.avg(F.col(f"`{c}`").isNull().cast("int")), 1).alias(f"missing_pct_{i}") for i, c in enumerate(df.columns)}
    return _long(df, row, df.columns, missing_pct="double")


def distinct(df: DataFrame, approx: bool = False) -> DataFrame:
    """name and n_unique, the distinct values that aren't missing, of each column.

    approx: HyperLogLog first, then exact counts for columns of few values or near a number that
    decides a flag.
    """
    columns = [f.name for f in df.schema if kind(f) != "nested"]
    exact = set(columns)
    if approx and columns:
        guess = df.agg(F.count("*").alias("n"), *[F.approx_count_distinct(f"`{c}`").alias(f"u_{i}") for i, c in enumerate(columns)]).first()
        n = guess["n"]
        near = lambda u, limit: abs(u - limit) <= 0.15 * max(limit, 10)
        exact = {c for i, c in enumerate(columns) if guess[f"u_{i}"] <= 2 * MOST_LEVELS or any(near(guess[f"u_{i}"], x) for x in (ID_SHARE * n, n))}
    row = {c: (F.countDistinct(f"`{c}`") if c in exact else F.approx_count_distinct(f"`{c}`")).alias(f"n_unique_{i}") for i, c in enumerate(columns)}
    return _long(df, row, columns, n_unique="long")


def numeric(df: DataFrame) -> DataFrame:
    """name, min, max, mean and skew (4 decimals) of each numeric column."""
    columns = [f.name for f in df.schema if kind(f) == "numeric"]
    row = {}
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`").cast("double")
        for n, v in (("min", F.min(x)), ("max", F.max(x)), ("mean", F.avg(x)), ("skew", skew(x))):
            row[n, c] = F.round(v, 4).alias(f"{n}_{i}")
    return _long(df, row, columns, min="double", max="double", mean="double", skew="double")


def target_code(df: DataFrame, target: str, task: str) -> Column | None:
    """The target as a number: itself, or 0 and 1 for the smaller and larger of two classes; else None."""
    if task == "regression":
        return F.col(target).cast("double")
    two = df.where(F.col(target).isNotNull()).select(F.col(target).cast("string").alias("c")).distinct().orderBy("c").limit(3).collect()
    if len(two) != 2:
        return None
    return F.when(F.col(target).isNotNull(), (F.col(target).cast("string") == two[1]["c"]).cast("double"))


def correlation(df: DataFrame, target: str, task: str) -> DataFrame:
    """name and corr_with_target (4 decimals) of each numeric column; null where a constant or a third class forbids it."""
    columns = [c for c, k in kinds(df, target).items() if k == "numeric"]
    y = target_code(df, target, task)
    row = {c: F.round(pearson(F.col(f"`{c}`").cast("double"), y) if y is not None else F.lit(None).cast("double"), 4).alias(f"corr_with_target_{i}") for i, c in enumerate(columns)}
    return _long(df, row, columns, corr_with_target="double")


def _levels(df: DataFrame, target: str) -> DataFrame:
    """(name, value, class) and rows of each, for categorical and boolean columns."""
    columns = [c for c, k in kinds(df, target).items() if k in ("categorical", "boolean")]
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]) if columns else F.expr("cast(array() as array<struct<name string, value string>>)")
    return df.select(F.col(target).cast("string").alias("class"), F.inline(cells)).where("value is not null").groupBy("name", "value", "class").agg(F.count("*").alias("n"))


def frequent(df: DataFrame, target: str) -> Frequent:
    """Summaries of the values of categorical and boolean columns."""
    return Frequent(df, [c for c, k in kinds(df, target).items() if k in ("categorical", "boolean")])


def top_values(df: DataFrame, target: str, top: int = 3, found: Frequent | None = None) -> DataFrame:
    """name, value, n and place of the most frequent values of each categorical or boolean column; ties by value."""
    return (found or frequent(df, target)).top(top)


def target_purity(df: DataFrame, target: str, levels: tuple[int, int] = (2, MOST_LEVELS), found: Frequent | None = None) -> DataFrame:
    """name and target_purity: share of rows in the largest class of their value; columns with 2 to 50 values.

    Columns of more values are known from the summaries and not read again.
    """
    few = (found or frequent(df, target)).few(levels[1])
    cells = _levels(df.select(*[F.col(f"`{c}`") for c in (target, *few)]), target)
    known = cells.where("class is not null")
    all_levels = cells.select("name", "value").distinct().groupBy("name").agg(F.count("*").alias("n_levels"))
    each = known.groupBy("name", "value").agg(F.max("n").alias("best"), F.sum("n").alias("n"))
    return each.groupBy("name").agg((F.sum("best") / F.sum("n")).alias("target_purity")).join(all_levels, "name").where(F.col("n_levels").between(*levels)).select("name", F.round("target_purity", 6).alias("target_purity"))


def column_profile(df: DataFrame, target: str, task: str, approx: bool = False) -> DataFrame:
    """A row for each column but the target: kind, missing_pct, n_unique, numbers, correlation, purity, top_values, flags."""
    require_columns(df, target)
    df = nan_to_null(df)
    spark = df.sparkSession
    types = {f.name: f.dataType for f in df.schema}
    base = spark.createDataFrame([(i, c, k, isinstance(types[c], T.IntegralType)) for i, (c, k) in enumerate(kinds(df, target).items())], "position int, name string, kind string, integral boolean")
    features = df.drop(target)
    summed = frequent(df, target)
    tops = top_values(df, target, found=summed).groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value", "n"))), lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n"))).alias("top_values"))
    parts = [missing(features), distinct(features, approx), numeric(features), correlation(df, target, task), tops]
    if task == "classification":
        parts.append(target_purity(df, target, found=summed))
        majority = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count("*").alias("n")).agg((F.max("n") / F.sum("n")).alias("m"))
    # each part has a row for each column
    wide = reduce(lambda a, b: a.join(F.broadcast(b), "name", "left"), parts, base)
    if task != "classification":
        wide = wide.withColumn("target_purity", F.lit(None).cast("double")).withColumn("_m", F.lit(None).cast("double"))
    else:
        wide = wide.withColumn("_m", majority.select("m").scalar())
    wide = wide.withColumn("_n", df.agg(F.count("*").alias("n")).select("n").scalar())
    categorical = F.col("kind").isin("categorical", "boolean")
    rules = {
        "possible_leakage": ((F.col("kind") == "numeric") & (F.abs("corr_with_target") > LEAK_CORRELATION)) | (categorical & (F.col("target_purity") > LEAK_PURITY) & (F.col("target_purity") - F.col("_m") > LEAK_GAIN)),
        "id_like": (F.col("_n") > 50) & ((F.col("integral") & (F.col("missing_pct") == 0) & (F.col("n_unique") == F.col("_n"))) | ((F.col("kind") == "categorical") & (F.col("n_unique") >= ID_SHARE * F.col("_n")))),
        "high_cardinality": categorical & (F.col("n_unique") > MOST_LEVELS),
        "constant": F.col("n_unique") <= 1,
        "mostly_missing": F.col("missing_pct") > MOSTLY,
    }
    flags = F.filter(F.array(*[F.when(rule, F.lit(flag)) for flag, rule in rules.items()]), lambda f: f.isNotNull())
    return wide.withColumn("flags", flags).drop("_m", "_n", "integral").orderBy("position")


def auto_drop_columns(profile: DataFrame) -> DataFrame:
    """name of the columns that a run leaves out: ids, suspected leaks and constants."""
    return profile.where(F.arrays_overlap("flags", F.array(*map(F.lit, DROPPED_FLAGS)))).select("name")


def inspect_sample(df: DataFrame, column: str, keys: list[str], rows: int = 10) -> DataFrame:
    """The first values of a column, in order of the keys, as text; and its type."""
    require_columns(df, column)
    return df.where(F.col(column).isNotNull()).orderBy(*keys).limit(rows).select(F.col(column).cast("string").alias("value"), F.lit(df.schema[column].dataType.simpleString()).alias("type"))


def inspect_value_counts(df: DataFrame, column: str, top: int = 15) -> DataFrame:
    """value and n of the most frequent values, missing included; ties by value."""
    require_columns(df, column)
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(top)


def inspect_target_rate(df: DataFrame, column: str, target: str, levels: int = MOST_LEVELS, top: int = 15) -> DataFrame:
    """value, class and share (3 decimals) for the first values of a column in order; empty beyond `levels` values."""
    require_columns(df, column, target)
    cells = df.where(F.col(target).isNotNull()).groupBy(F.coalesce(F.col(column).cast("string"), F.lit("nan")).alias("value"), F.col(target).cast("string").alias("class")).agg(F.count("*").alias("n"))
    totals = cells.groupBy("value").agg(F.sum("n").alias("total"))
    few = totals.agg((F.count("*") <= levels).alias("few")).select("few").scalar()
    first = totals.where(few).orderBy("value").limit(top)
    return cells.join(F.broadcast(first), "value").select("value", "class", F.round(F.col("n") / F.col("total"), 3).alias("share"))
