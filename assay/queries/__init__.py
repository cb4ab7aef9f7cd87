"""Every operator as a query over the given tables, with SQL for its result where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function under its name."""

    def register(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def uniform_sql(seed: str, *columns: str) -> str:
    return f"(CAST('0x' || substr(md5(concat_ws('|', {', '.join([seed, *columns])})), 1, 8) AS BIGINT) / 4294967296.0)"


def hash_sql(seed: str, *columns: str) -> str:
    return f"md5(concat_ws('|', {', '.join([seed, *columns])}))"


from assay.queries import data, modelling, scoring, splitting  # noqa: E402, F401
