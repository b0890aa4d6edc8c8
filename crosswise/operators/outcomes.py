"""Realized outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checks import require_none
from ..functions.columns import close_to
from ..functions.layout import Layout, resolve
from ..functions.ranking import add_group_stats
from .panel import TARGET, cross_sectional_scores, observed_weeks, winsor_rank, zscore


def with_benchmark(returns: DataFrame, layout: Layout | None = None) -> DataFrame:
    """Sector mean over the whole universe of the week, and the active return."""
    layout = resolve(layout, returns, ["week_date", "sector"])
    stats = add_group_stats(returns, ["week_date", "sector"], {"sector_return": "avg(return_1w) @"}, layout)
    return stats.withColumn("raw_active_return", F.col("return_1w") - F.col("sector_return"))


def _lead_exact(names: dict[str, str]) -> list[str]:
    w = "over (partition by ticker order by week_date)"
    return [f"if(lead(week_date) {w} = next_week_date, lead({src}) {w}, null) as {dst}" for dst, src in names.items()]


AHEAD = {
    "stock_return_fwd": "return_1w",
    "sector_return_fwd": "sector_return",
    "raw_active_return_fwd": "raw_active_return",
}


def forward_returns(returns: DataFrame, layout: Layout | None = None, weeks: DataFrame | None = None) -> DataFrame:
    """O1/O2: stock, sector and active return at the next observed week.

    `returns`: (ticker, sector, week_date, return_1w), one row per ticker-week.
    The exact next week is required; a missing ticker-week is never skipped.
    """
    weeks = observed_weeks(returns) if weeks is None else weeks
    based = with_benchmark(returns, layout).join(F.broadcast(weeks.select("week_date", "next_week_date")), "week_date")
    out = based.selectExpr("ticker", "sector", "week_date", "next_week_date", *_lead_exact(AHEAD))
    source = "if(stock_return_fwd is not null, 'raw_feature_snapshot', 'unobserved')"
    return out.selectExpr("*", f"{source} as return_source", "cast(null as string) as return_source_url")


def realized_outcomes(
    returns: DataFrame, layout: Layout | None = None, lower: float = 0.01, upper: float = 0.99, weeks: DataFrame | None = None
) -> DataFrame:
    """O1 together with the normalized target, for rows that carry their own
    score inputs: every column of `returns` passes through, and the four
    next-week outcomes are read by one window per ticker. No join of the panel
    with itself is planned.
    """
    layout = resolve(layout, returns, ["week_date"])
    weeks = observed_weeks(returns) if weeks is None else weeks
    if layout.splits == 1:
        returns = returns.repartition("week_date")
    based = with_benchmark(returns, layout)
    ranked = winsor_rank(based, ["week_date", "sector"], "raw_active_return", "ticker", lower, upper, layout)
    scored = zscore(ranked, ["week_date"], "percentile", TARGET, layout).drop("winsorized", "percentile")
    joined = scored.join(F.broadcast(weeks.select("week_date", "next_week_date")), "week_date")
    return joined.selectExpr("*", *_lead_exact({**AHEAD, "active_return_fwd": TARGET}))


def sector_benchmarks(returns: DataFrame) -> DataFrame:
    return returns.groupBy("week_date", "sector").agg(F.avg("return_1w").alias("sector_return"))


def event_violations(forward: DataFrame, prices: DataFrame, events: DataFrame) -> DataFrame:
    """Events that may not be applied, with the reason (O3's refusals)."""
    held = events.join(
        forward.select("ticker", "week_date", "next_week_date", "stock_return_fwd"),
        ["ticker", "week_date", "next_week_date"],
    )
    start = prices.select("ticker", "week_date", F.col("adj_close").alias("__start"))
    joined = held.join(start, ["ticker", "week_date"], "left")
    problem = (
        F.when(F.col("stock_return_fwd").isNotNull(), "overwrites_observed_return")
        .when((F.col("event_date") <= F.col("week_date")) | (F.col("event_date") > F.col("next_week_date")), "outside_holding_period")
        .when(~close_to(F.col("__start"), F.col("start_close"), 1e-5, 1e-8) | F.col("__start").isNull(), "start_close_mismatch")
        .when((F.col("event_type") != "cash_acquisition") | (F.col("start_close") <= 0) | (F.col("cash_per_share") < 0), "unsupported_event")
    )
    return joined.select("ticker", "week_date", problem.alias("problem")).filter("problem is not null")


def apply_events(forward: DataFrame, returns: DataFrame, events: DataFrame) -> DataFrame:
    """O3: terminal value of a cash acquisition inside the holding week.

    Fills missing raw performance only; the benchmark is the outcome week's
    mean of the sector held at the score week.
    """
    terms = events.select(
        "ticker", "week_date", "next_week_date", "event_date", "event_type",
        (F.col("cash_per_share") / F.col("start_close") - 1.0).alias("__cash"),
        F.col("source_url").alias("__url"),
    )
    bench = sector_benchmarks(returns).select(
        F.col("week_date").alias("next_week_date"), "sector", F.col("sector_return").alias("__bench")
    )
    joined = forward.join(terms, ["ticker", "week_date", "next_week_date"], "left").join(bench, ["next_week_date", "sector"], "left")
    use = (
        F.col("stock_return_fwd").isNull() & F.col("__cash").isNotNull()
        & (F.col("event_date") > F.col("week_date")) & (F.col("event_date") <= F.col("next_week_date"))
    )
    return joined.select(
        "ticker", "sector", "week_date", "next_week_date",
        F.when(use, F.col("__cash")).otherwise(F.col("stock_return_fwd")).alias("stock_return_fwd"),
        F.when(use, F.col("__bench")).otherwise(F.col("sector_return_fwd")).alias("sector_return_fwd"),
        F.when(use, F.col("__cash") - F.col("__bench")).otherwise(F.col("raw_active_return_fwd")).alias("raw_active_return_fwd"),
        F.when(use, F.col("event_type")).otherwise(F.col("return_source")).alias("return_source"),
        F.when(use, F.col("__url")).otherwise(F.col("return_source_url")).alias("return_source_url"),
    )


def raw_outcome_violations(panel: DataFrame, returns: DataFrame, layout: Layout | None = None) -> DataFrame:
    """Panel rows whose raw return is missing, impossible, or does not
    rebuild the panel's normalized target."""
    joined = panel.select("ticker", "sector", "week_date", F.col(TARGET).alias("__have")).join(
        returns.select("ticker", "week_date", "return_1w"), ["ticker", "week_date"], "left"
    )
    bad = F.col("return_1w").isNull() | F.isnan("return_1w") | (F.abs("return_1w") == float("inf")) | (F.col("return_1w") < -1)
    rebuilt = cross_sectional_scores(
        joined.select("ticker", "sector", "week_date", "return_1w"), {"return_1w": 1}, layout=layout
    ).select("ticker", "week_date", F.col(TARGET).alias("__want"))
    compared = joined.join(rebuilt, ["ticker", "week_date"], "left")
    problem = F.when(bad, "invalid_return").when(~close_to(F.col("__have"), F.col("__want")), "not_reconstructed")
    return compared.select("ticker", "week_date", problem.alias("problem")).filter("problem is not null")


def raw_outcomes(panel: DataFrame, returns: DataFrame, layout: Layout | None = None, check: bool = True) -> DataFrame:
    """Validated raw active return per panel row. Rows that are their own panel are not joined with themselves."""
    if check:
        require_none(raw_outcome_violations(panel, returns, layout), "Raw returns do not match the panel")
    if panel is returns:
        joined = returns.select("ticker", "sector", "week_date", "return_1w").dropna(subset=["ticker", "week_date"])
    else:
        joined = panel.select("ticker", "sector", "week_date").join(
            returns.select("ticker", "week_date", "return_1w"), ["ticker", "week_date"]
        )
    return with_benchmark(joined, layout).select(
        "ticker", "week_date", "raw_active_return", F.col("return_1w").alias("raw_stock_return")
    )


def attach_outcomes(rows: DataFrame, outcomes: DataFrame, check: bool = False, required: str = "raw_active_return") -> DataFrame:
    """Many-to-one join after membership is fixed; membership columns
    pass through untouched."""
    joined = rows.join(outcomes, ["ticker", "week_date"], "left")
    if check:
        require_none(joined.filter(F.col(required).isNull()).select("ticker", "week_date"), "Rows without a validated raw return")
    return joined
