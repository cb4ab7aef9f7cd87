"""Rows and columns left out before a model sees them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, *names: str) -> None:
    """Raises ValueError if a column is unknown, and names those that exist."""
    unknown = [n for n in names if n and n not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns {unknown}; there are {df.columns}")


def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    """Rows whose target is neither null nor NaN."""
    require_columns(df, target)
    return df.na.drop(subset=[target])


def drop_columns(df: DataFrame, names: list[str], target: str | None = None) -> DataFrame:
    """df without some columns; unknown names are ignored, and the target stays."""
    return df.drop(*[n for n in names if n != target])


def filter_known_labels(df: DataFrame, label: str, classes: DataFrame) -> DataFrame:
    """Rows whose label is among the classes (one column of that name)."""
    return df.join(classes.select(label).distinct(), label, "left_semi").select(df.columns)
