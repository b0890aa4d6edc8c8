"""How a cross-section is spread over tasks.

Time-series windows partition by ticker: (ticker, week) is unique, so such a
group never exceeds the length of the calendar. A *cross-section* (one week, or
one week and sector) has no such bound: it holds the whole universe. Every
cross-sectional operator therefore takes a Layout, which carries an upper bound
on the rows of any cross-section:

* bound <= task_rows: one window per cross-section, a single task can hold it;
* bound >  task_rows: the cross-section is cut into value ranges that are ranked
  in parallel and stitched with prefix counts, and group statistics are
  partially aggregated map-side and joined back.

Both give the same rows; nothing is dropped or capped.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layout:
    group_rows: int
    task_rows: int = 2_000_000

    @property
    def splits(self) -> int:
        return max(1, -(-self.group_rows // self.task_rows))

    @property
    def sample_every(self) -> int:
        """Hash-sampling period that leaves about 32 split candidates per range."""
        return max(1, self.group_rows // (self.splits * 32))


def measure(df: DataFrame, keys: Sequence[str]) -> Layout:
    """Find the largest cross-section with a map-side combined count."""
    row = df.groupBy(*keys).count().agg(F.max("count").alias("n")).first()
    return Layout(int(row["n"] or 0))


def resolve(layout: Layout | None, df: DataFrame, keys: Sequence[str]) -> Layout:
    return layout if layout is not None else measure(df, keys)
