"""Per-ticker window helpers. Groups are bounded by the calendar length."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def by_ticker(order: str, *extra: str) -> WindowSpec:
    return Window.partitionBy("ticker", *extra).orderBy(order)


def ratio_minus_one(a: Column, b: Column) -> Column:
    return F.try_divide(a, b) - 1.0


def stop_at_gap(value: Column, source: Column, window: WindowSpec) -> Column:
    """Keep a running value only while no earlier or current source is missing."""
    running = window.rowsBetween(Window.unboundedPreceding, 0)
    missing = F.sum(F.when(source.isNull(), 1).otherwise(0)).over(running)
    return F.when(missing == 0, value)
