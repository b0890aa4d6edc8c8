"""Violation queries and the one action that turns them into an error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"Missing columns: {missing}")


def require_none(violations: DataFrame, message: str) -> None:
    """Fail with a few examples when a violation query is not empty."""
    found = violations.limit(5).collect()
    if found:
        raise ValueError(f"{message}: {[r.asDict() for r in found]}")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")
