"""Trading calendar, as-of joins and time grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checks import require_none

WEEK = "interval 7 days"


def session_calendar(prices: DataFrame, holidays: DataFrame | None = None, lead_days: int = 10, cutoff=None) -> DataFrame:
    """Weekdays from (first date - lead) to the cutoff, minus a holiday table."""
    bounds = prices.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    hi = F.lit(cutoff).cast("date") if cutoff is not None else F.col("hi")
    days = bounds.select(F.explode(F.sequence(F.date_sub("lo", lead_days), hi)).alias("price_date")).filter(
        F.weekday("price_date") < 5
    )
    if holidays is None:
        return days
    return days.join(holidays.select(F.col("date").alias("price_date")), "price_date", "left_anti")


def off_calendar(prices: DataFrame, sessions: DataFrame) -> DataFrame:
    """Input dates that are not sessions (must be empty)."""
    days = prices.select(F.col("date").alias("price_date")).distinct()
    return days.join(sessions, "price_date", "left_anti")


def wednesday_anchors(prices: DataFrame, cutoff=None) -> DataFrame:
    """Every Wednesday inside the observed date range."""
    bounds = prices.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    hi = F.lit(cutoff).cast("date") if cutoff is not None else F.col("hi")
    first = F.next_day(F.date_sub("lo", 1), "WED")
    weeks = F.when(first <= hi, F.sequence(first, hi, F.expr(WEEK))).otherwise(F.array().cast("array<date>"))
    return bounds.select(F.explode(weeks).alias("week_date"))


def asof_sessions(anchors: DataFrame, sessions: DataFrame) -> DataFrame:
    """Last session on or before each anchor. Both sides are calendars
    (thousands of rows for a century), so one ordered pass over their union."""
    marks = sessions.select(F.col("price_date").alias("d"), F.col("price_date"), F.lit(None).cast("date").alias("week_date"))
    asks = anchors.select(F.col("week_date").alias("d"), F.lit(None).cast("date").alias("price_date"), "week_date")
    w = Window.orderBy(F.col("d"), F.col("week_date").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return (
        marks.unionByName(asks)
        .select("week_date", F.last("price_date", ignorenulls=True).over(w).alias("price_date"))
        .filter("week_date is not null")
    )


def with_labels(calendar: DataFrame) -> DataFrame:
    """C4: the label week and the label's session."""
    w = Window.orderBy("week_date")
    return calendar.select(
        "week_date",
        "price_date",
        F.date_add("week_date", 7).alias("label_end_week"),
        F.lead("price_date").over(w).alias("label_end_date"),
    )


def snapshot_calendar(prices: DataFrame, sessions: DataFrame, cutoff=None, check: bool = True) -> DataFrame:
    """C1-C4 combined; with check=True the same failures as a strict build."""
    anchors = wednesday_anchors(prices, cutoff)
    calendar = with_labels(asof_sessions(anchors, sessions))
    if check:
        require_none(off_calendar(prices, sessions), "Input dates outside the session calendar")
        span = calendar.agg(F.max("price_date").alias("need"), F.count(F.lit(1)).alias("n")).crossJoin(
            prices.agg(F.max("date").alias("have"))
        )
        require_none(span.filter("n = 0"), "No completed Wednesday anchors in this range")
        require_none(span.filter("need > have"), "Latest required snapshot is after the available data")
    return calendar


def session_grid(prices: DataFrame, sessions: DataFrame) -> DataFrame:
    """Each ticker's own session grid; absent quotes stay missing.

    A quote fills the sessions up to the ticker's next one with missing rows, so the grid
    costs one exchange by ticker, which the windows on it use again. The calendar is one row
    of dates (bounded by the number of sessions ever held). A quote between sessions has no
    row of its own.
    """
    calendar = sessions.agg(F.sort_array(F.collect_set("price_date")).alias("__days"))
    following = F.coalesce(F.date_sub(F.lead("__day").over(Window.orderBy("__day")), 1), F.col("__day"))
    spans = calendar.select(F.posexplode("__days").alias("__i", "__day")).withColumn("__until", following)
    # Every day of the calendar with the place of the first session from then on.
    numbered = spans.select("__i", "__day", F.explode(F.sequence("__day", "__until")).alias("date")).select(
        "date", (F.col("date") == F.col("__day")).alias("__own"), F.when(F.col("date") == F.col("__day"), F.col("__i")).otherwise(F.col("__i") + 1).alias("__i"))
    outside = F.when(F.col("date") < F.try_element_at("__days", F.lit(1)), 0).otherwise(F.size("__days"))
    known = prices.filter("date is not null").select("ticker", "date", "adj_close").join(F.broadcast(numbered), "date", "left")
    dated = known.crossJoin(F.broadcast(calendar)).select(
        "ticker", "date", "adj_close", F.coalesce("__own", F.lit(False)).alias("__own"), F.coalesce("__i", outside).alias("__i"))
    w = Window.partitionBy("ticker").orderBy("date")
    # Neighbours are read before the calendar is put beside the rows, so that no window holds it.
    near = dated.select("*", F.lead("__i").over(w).alias("__next"))
    reach = near.crossJoin(F.broadcast(calendar)).withColumn(
        "__rows", F.greatest(F.coalesce("__next", F.size("__days")) - F.col("__i"), F.col("__own").cast("int")))
    held = F.slice("__days", F.col("__i") + 1, F.col("__rows"))
    filled = reach.select("ticker", "date", "adj_close", F.explode(held).alias("price_date"))
    return filled.select("ticker", "price_date", F.when(F.col("price_date") == F.col("date"), F.col("adj_close")).alias("adj_close"))


def snapshot_rows(daily: DataFrame, calendar: DataFrame, tickers: DataFrame | None = None) -> DataFrame:
    """Every calendar week for every ticker, left-joined to its daily row. `tickers` (one
    row each) saves building the daily rows a second time for their names."""
    weeks = calendar.agg(F.collect_list(F.struct(*calendar.columns)).alias("weeks"))
    tickers = daily.select("ticker").distinct() if tickers is None else tickers
    grid = tickers.crossJoin(F.broadcast(weeks)).select("ticker", F.inline("weeks"))
    # Only the sessions of the calendar (one row per week) are exchanged.
    due = daily.join(F.broadcast(calendar.select("price_date").distinct()), "price_date", "left_semi")
    return grid.join(due, ["ticker", "price_date"], "left")


def weekly_grid(px: DataFrame) -> DataFrame:
    """Complete weekly grid between each ticker's first price and the last
    observed week of the table, gaps left missing (weekly form of C5/C6)."""
    last = px.agg(F.max("week_date").alias("last_week"))
    tickers = px.groupBy("ticker", "sector").agg(F.min("week_date").alias("first_week"))
    grid = tickers.crossJoin(F.broadcast(last)).select(
        "ticker", "sector", F.explode(F.sequence("first_week", "last_week", F.expr(WEEK))).alias("week_date")
    )
    return grid.join(px.select("ticker", "week_date", "adj_close"), ["ticker", "week_date"], "left")


def missing_wednesdays(weeks: DataFrame, start=None, end=None) -> DataFrame:
    """Wednesdays in the requested (or observed) range with no snapshot."""
    bounds = weeks.agg(F.min("week_date").alias("lo"), F.max("week_date").alias("hi"))
    lo = F.lit(start).cast("date") if start is not None else F.col("lo")
    hi = F.lit(end).cast("date") if end is not None else F.col("hi")
    first = F.next_day(F.date_sub(lo, 1), "WED")
    expected = bounds.select(F.explode(F.sequence(first, hi, F.expr(WEEK))).alias("week_date"))
    return expected.join(weeks.select("week_date").distinct(), "week_date", "left_anti")
