"""Reading tables, and what a CSV's text becomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that mean missing.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "dd.MM.yyyy")


def read_table(spark: SparkSession, path: str, order_col: str | None = None) -> DataFrame:
    """A parquet table if the path ends in .parquet; else a CSV with a header."""
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else infer_datetimes(read_csv(spark, path), order_col)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Columns as long, double or boolean if all their texts are; missing texts as null."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    raw = raw.select(*[F.when(~F.trim(f"`{c}`").isin(*MISSING), F.col(f"`{c}`")).alias(c) for c in raw.columns])
    kinds = {"bigint": "bigint", "double": "double", "boolean": "boolean"}
    tests = [F.bool_and(F.col(f"`{c}`").isNull() | _parsed(c, k).isNotNull()).alias(f"{k}_{i}") for i, c in enumerate(raw.columns) for k in kinds]
    fits = raw.agg(*tests, *[F.count(f"`{c}`").alias(f"n_{i}") for i, c in enumerate(raw.columns)]).first()
    out = []
    for i, c in enumerate(raw.columns):
        kind = next((k for k in kinds if fits[f"{k}_{i}"] and fits[f"n_{i}"]), None)
        out.append((_parsed(c, kind) if kind else F.col(f"`{c}`")).alias(c))
    return raw.select(*out)


def _parsed(c: str, kind: str) -> Column:
    x = F.trim(f"`{c}`")
    if kind == "boolean":
        return F.when(F.lower(x).isin("true", "false"), F.lower(x) == "true")
    return x.try_cast(kind)


def parse_datetime(c: Column) -> Column:
    """A timestamp by the first format that fits; else null."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in FORMATS]).cast("timestamp_ntz")


def datetime_share(df: DataFrame, order_col: str | None = None, sample: int = 200, min_len: int = 6) -> DataFrame:
    """name, n, shortest and share parsed as a date of each text column's first `sample` values."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    out = None
    for c in texts:
        known = df.where(F.col(f"`{c}`").isNotNull())
        first = (known.orderBy(order_col) if order_col else known).limit(sample).select(F.col(f"`{c}`").alias("v"))
        row = first.agg(F.count("*").alias("n"), F.min(F.length("v")).alias("shortest"), F.avg(parse_datetime(F.col("v")).isNotNull().cast("int")).alias("parsed")).select(F.lit(c).alias("name"), "n", "shortest", "parsed")
        out = row if out is None else out.unionByName(row)
    return out if out is not None else df.sparkSession.createDataFrame([], "name string, n long, shortest int, parsed double")


def infer_datetimes(df: DataFrame, order_col: str | None = None, sample: int = 200, min_len: int = 6, threshold: float = 0.9) -> DataFrame:
    """Text columns whose first values look like dates as timestamps; what doesn't parse is missing."""
    found = [r["name"] for r in datetime_share(df, order_col, sample, min_len).collect() if r["n"] and r["shortest"] >= min_len and r["parsed"] > threshold]
    return df.withColumns({c: parse_datetime(F.col(f"`{c}`")) for c in found}) if found else df


def stage(df: DataFrame, path: str) -> DataFrame:
    """df written as parquet, and read from there."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def save_results(path: str, **frames: DataFrame) -> None:
    """Each result as a parquet table of its name."""
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
