"""Retention buffer (B7): the one portfolio rule with week-to-week state.

A held name is kept while it ranks inside the buffer (20-30% of the universe);
vacancies are filled from the current top 20% in rank order. How many names are
filled depends on how many were kept, so weeks are sequential by nature.

One execution serves every size: rows are sorted by (series, week, rank) and pass
through a task as a stream of Arrow batches. What a task keeps is the book of the
series at hand and the rows of one week, never a history; the sort spills. Series
and variants run in parallel.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.layout import Layout, resolve
from .portfolio import top_fraction, weigh

# Portfolio variants as (buffer, rank weighted); None = per-date choice.
VARIANTS = {
    "exact_q1": (0.20, False),
    "buffer_20_25": (0.25, False),
    "buffer_20_30": (0.30, False),
    "exact_q1_rank_weighted": (0.20, True),
    "selected_buffer_rank_weighted": (None, True),
}


def buffered_holdings(
    scores: DataFrame,
    series: Sequence[str] = ("model",),
    *,
    score: str = "score",
    buffer: float = 0.30,
    buffer_by_week: DataFrame | None = None,
    rank_weighted: bool = False,
    layout: Layout | None = None,
) -> DataFrame:
    """Held names with weights: (series..., week_date, ticker, slot, n_hold, weight).

    `buffer_by_week` (week_date, buffer) overrides the constant buffer; weeks that it
    lacks are left out. A week below five scored names holds nothing and ends every holding.
    """
    if buffer_by_week is None and not 0.20 <= buffer <= 0.30:
        raise ValueError("Retention threshold must be between 20% and 30%")
    layout = resolve(layout, scores, [*series, "week_date"])
    ranked = top_fraction(scores, series, score, layout=layout)
    if buffer_by_week is None:
        ranked = ranked.withColumn("__buffer", F.lit(buffer))
    else:
        ranked = ranked.join(buffer_by_week.select("week_date", F.col("buffer").alias("__buffer")), "week_date")
    inside = ranked.filter(F.col("rank") <= F.ceil(F.col("__buffer") * F.col("universe"))).select(
        *series, "week_date", "ticker", "rank", "n_hold"
    )
    return weigh(_walk(inside, series), rank_weighted)


def next_book(tickers: list, n_hold: int, prior: set) -> list[int]:
    """Places, in rank order, of the names held this week: `tickers` are those inside the buffer, best first."""
    keep = [i for i, t in enumerate(tickers) if t in prior][:n_hold]
    kept = set(keep)
    fill = [i for i in range(min(n_hold, len(tickers))) if i not in kept]
    return sorted(keep + fill[: n_hold - len(keep)])


def _walk(inside: DataFrame, series: Sequence[str]) -> DataFrame:
    series = list(series)
    schema = inside.select(*series, "week_date", "ticker", F.lit(1).alias("slot"), "n_hold").schema
    arrow = to_arrow_schema(schema)
    m = len(series)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prior: set = set()
        path = week = None
        rows: list[tuple] = []

        def close() -> pa.RecordBatch:
            nonlocal prior
            tickers = [r[m + 1] for r in rows]
            at = next_book(tickers, rows[0][m + 3], prior)
            prior = {tickers[i] for i in at}
            out = [(*rows[i][: m + 2], slot, rows[i][m + 3]) for slot, i in enumerate(at, 1)]
            return pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], arrow.field(c).type) for c in range(len(arrow))], schema=arrow)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and (row[:m] != path or row[m] != week):
                    yield close()
                    rows = []
                if row[:m] != path:
                    prior = set()
                path, week = row[:m], row[m]
                rows.append(row)
        if rows:
            yield close()

    ordered = inside.repartition(*series).sortWithinPartitions(*series, "week_date", "rank")
    return ordered.mapInArrow(run, schema)
