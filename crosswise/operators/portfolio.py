"""Portfolios and backtests.

Holdings, trades and returns are rows keyed by (series..., week_date, ticker);
`series` names the columns that identify one portfolio path, e.g. ["model"].
Weekly tables hold one row per series and week, so their windows are bounded by
the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checks import require_none
from ..functions.columns import finite_sql
from ..functions.layout import Layout, resolve
from ..functions.ranking import add_ranks
from ..functions.timeseries import stop_at_gap

# Cost assumptions in basis points.
COST_BPS = (0, 5, 10, 25)
LONG_ONLY_BPS = 5
SELECTION_BPS = 10
UNDEFINED_IR = -1e6


def information_ratio(value: str) -> Column:
    std = F.stddev_samp(value)
    return F.when(std > 0, F.sqrt(F.lit(52.0)) * F.avg(value) / std)


# --- B1 / B2 / B3: quintile performance --------------------------------------


def quintile_performance(members: DataFrame) -> DataFrame:
    """B1: equal-weight means; a model-week with any unobserved holding is
    withheld in every quintile."""
    outcomes = ["stock_return_fwd", "sector_return_fwd", "raw_active_return_fwd"]
    seen = F.lit(True)
    for c in outcomes:
        seen = seen & F.col(c).isNotNull()
    weekly = (
        members.filter("quintile is not null")
        .groupBy("model", "week_date", "quintile")
        .agg(
            F.first("next_week_date").alias("next_week_date"),
            F.count(F.lit(1)).alias("holdings"),
            F.sum(F.when(seen, 1).otherwise(0)).alias("observed_holdings"),
            F.avg("prediction").alias("mean_prediction"),
            F.avg("active_return_fwd").alias("mean_forward_zscore"),
            F.avg("stock_return_fwd").alias("portfolio_return"),
            F.avg("sector_return_fwd").alias("benchmark_return"),
            F.avg("raw_active_return_fwd").alias("active_return"),
        )
    )
    w = Window.partitionBy("model", "week_date")
    complete = F.every(F.col("holdings") == F.col("observed_holdings")).over(w)
    marked = weekly.withColumn("complete", complete)
    for c in ("mean_forward_zscore", "portfolio_return", "benchmark_return", "active_return"):
        marked = marked.withColumn(c, F.when(F.col("complete"), F.col(c)))
    return marked


def cumulative_series(weekly: DataFrame) -> DataFrame:
    """B2: six running series; an interior missing week stops them for good."""
    w = Window.partitionBy("model", "quintile").orderBy("week_date")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    p, b, a = F.col("portfolio_return"), F.col("benchmark_return"), F.col("active_return")
    base = weekly.select(
        "*",
        stop_at_gap(F.product(1 + p).over(run), p, w).alias("__pw"),
        stop_at_gap(F.product(1 + b).over(run), b, w).alias("__bw"),
        stop_at_gap(F.sum(a).over(run), a, w).alias("cumulative_active_return"),
        stop_at_gap(F.product(1 + a).over(run) - 1, a, w).alias("compounded_active_spread"),
    )
    return base.withColumns(
        {
            "cumulative_portfolio_return": F.col("__pw") - 1,
            "cumulative_benchmark_return": F.col("__bw") - 1,
            "cumulative_excess_return": F.col("__pw") - F.col("__bw"),
            "relative_wealth_return": F.try_divide(F.col("__pw"), F.col("__bw")) - 1,
        }
    ).drop("__pw", "__bw")


def endpoints(cumulative: DataFrame) -> DataFrame:
    """Last week with a live cumulative series, per model and quintile."""
    columns = [c for c in cumulative.columns if c not in ("model", "quintile")]
    live = cumulative.filter("cumulative_active_return is not null")
    newest = live.groupBy("model", "quintile").agg(F.max_by(F.struct(*columns), "week_date").alias("r"))
    return newest.select("model", "quintile", "r.*")


# --- trades -------------------------------------------------------------------


def weekly_book(
    rows: DataFrame, series: Sequence[str], aggregates: dict[str, str], carry: Sequence[str] = (), weeks: DataFrame | None = None
) -> DataFrame:
    """One row per series and week: caller's aggregates plus dollars traded.

    rows        (series..., week_date, ticker, weight, carry...); weight may be
                missing or zero for names that are scored but not held
    aggregates  name -> SQL aggregate over the carried columns
    weeks       (series..., week_date, prev_week, next_week) to trade against the
                previous week of the series across calendar gaps; by default a
                week trades against the one seven days before

    Trades are the full outer difference of two successive books. Instead of
    joining the book with itself, one window by (series, ticker) pays
    |weight - previous weight| in the current week and books a leaving name's
    weight in the following week; both legs and the caller's aggregates are then
    combined map-side in one shuffle.
    """
    series = list(series)
    by = ", ".join([*series, "ticker"])
    w = f"over (partition by {by} order by week_date)"
    if weeks is None:
        before, after = "date_sub(week_date, 7)", "date_add(week_date, 7)"
    else:
        rows = rows.join(weeks.select(*series, "week_date", "prev_week", "next_week"), [*series, "week_date"])
        before, after = "prev_week", "next_week"
    legs = rows.selectExpr(
        *series, "week_date", "coalesce(weight, 0D) as weight", *carry,
        f"{after} as __after",
        f"if(lag(week_date) {w} = {before}, coalesce(lag(weight) {w}, 0D), 0D) as __was",
        f"coalesce(lead(week_date) {w} = {after}, false) as __stays",
    )
    here = ", ".join(["week_date as week_date", "abs(weight - __was) as __move", "abs(weight) as __gross", "true as __row", *[f"{c} as {c}" for c in carry]])
    gone = ", ".join(["__after as week_date", "abs(weight) as __move", "0D as __gross", "false as __row", *[f"null as {c}" for c in carry]])
    legs = legs.selectExpr(
        *series,
        f"inline(if(weight <> 0 and not __stays and __after is not null, array(struct({here}), struct({gone})), array(struct({here}))))",
    )
    weekly = legs.groupBy(*series, "week_date").agg(
        F.expr("count_if(__row)").alias("__rows"),
        F.sum("__move").alias("traded"),
        F.sum("__gross").alias("gross_weight"),
        *[F.expr(sql).alias(name) for name, sql in aggregates.items()],
    )
    # Departures may point at weeks the series does not have; a week whose book
    # is empty neither trades nor anchors the next one.
    order = f"over (partition by {', '.join(series)} order by week_date)"
    return weekly.filter("__rows > 0").selectExpr(
        *series, "week_date", "traded", "gross_weight", *aggregates,
        f"coalesce(lag(week_date) {order} = date_sub(week_date, 7) and lag(gross_weight) {order} > 0 and gross_weight > 0, false) as consecutive",
    )


def series_weeks(frame: DataFrame, series: Sequence[str]) -> DataFrame:
    """Neighbouring weeks of each series (one row per series and week)."""
    order = f"over (partition by {', '.join(series)} order by week_date)"
    return frame.select(*series, "week_date").distinct().selectExpr(
        "*", f"lag(week_date) {order} as prev_week", f"lead(week_date) {order} as next_week"
    )


# --- B4 / B5: long/short ------------------------------------------------------


def long_short_weight(place: str = "place", n: str = "n") -> str:
    """+1/n on Q1 and -1/n on Q5 (high score first). Q1 holds ceil(n/5) names,
    Q5 floor(n/5); a cross-section below five names holds nothing."""
    bucket = f"floor(({place} - 1) * 5 / {n})"
    return f"case when {n} < 5 then null when {bucket} = 0 then 1D / ceil({n} / 5) when {bucket} = 4 then -1D / floor({n} / 5) end"


def long_short_weekly(
    frame: DataFrame, series: Sequence[str] = ("model",), *, score: str = "score", active: str = "raw_active_return",
    layout: Layout | None = None,
) -> DataFrame:
    """Gross spread, turnover (half the traded dollars, only across
    consecutive weeks) and the turnover charged (1.0 when entering from cash)."""
    keys = [*series, "week_date"]
    layout = resolve(layout, frame, keys)
    ranked = add_ranks(frame, keys, score, tie=["ticker"], descending=True, position="place", count="n", layout=layout)
    legs = ranked.selectExpr(*keys, "ticker", f"{active} as __a", f"{long_short_weight()} as weight")
    held = legs.filter("weight is not null").selectExpr("*", "weight as __w")
    spread = "avg(__a) filter (where __w > 0) - avg(__a) filter (where __w < 0)"
    weekly = weekly_book(held, series, {"gross_return": spread}, ["__a", "__w"])
    return weekly.selectExpr(
        *keys, "gross_return", "if(consecutive, traded / 2, null) as turnover", "if(consecutive, traded / 2, 1D) as cost_turnover"
    )


def cost_scenarios(weekly: DataFrame, series: Sequence[str] = ("model",), costs: Sequence[int] = COST_BPS) -> DataFrame:
    """Net performance under each cost; one row per series and cost."""
    levels = F.explode(F.array(*[F.lit(c) for c in costs]))
    net = F.col("gross_return") - 2.0 * F.col("cost_bps") / 10000.0 * F.col("cost_turnover")
    rows = weekly.select("*", levels.alias("cost_bps")).withColumn("__net", net)
    keys = [*series, "cost_bps"]
    run = Window.partitionBy(*keys).orderBy("week_date").rowsBetween(Window.unboundedPreceding, 0)
    wealth = rows.withColumn("__wealth", F.product(1 + F.col("__net")).over(run))
    peaks = wealth.withColumn("__peak", F.greatest(F.max("__wealth").over(run), F.lit(1.0)))
    return peaks.groupBy(*keys).agg(
        (52.0 * F.avg("__net")).alias("annualized_return"),
        information_ratio("__net").alias("information_ratio"),
        (F.max_by("__wealth", "week_date") - 1).alias("cumulative_return"),
        F.min(F.col("__wealth") / F.col("__peak") - 1).alias("max_drawdown"),
        F.avg("cost_turnover").alias("mean_weekly_turnover"),
        F.count(F.lit(1)).alias("return_weeks"),
    )


# --- B6 / B8 / B12: long-only targets ----------------------------------------

#: Scored names below which a week gives no book.
MIN_UNIVERSE = 5


def small_universes(scores: DataFrame, series: Sequence[str] = ("model",), score: str = "score") -> DataFrame:
    """Weeks with some but fewer than MIN_UNIVERSE finite scores: violations for a check."""
    counted = scores.groupBy(*series, "week_date").agg(F.count(F.expr(finite_sql(score))).alias("n"))
    return counted.filter((F.col("n") > 0) & (F.col("n") < MIN_UNIVERSE))


def top_fraction(scores: DataFrame, series: Sequence[str], score: str = "score", fraction: float = 0.2, layout: Layout | None = None) -> DataFrame:
    """Rank (1 = best) and the number of names to hold, for every scored row; a
    cross-section below five scored names holds nothing."""
    keys = [*series, "week_date"]
    ranked = add_ranks(scores, keys, score, tie=["ticker"], descending=True, position="rank", count="universe", layout=layout)
    hold = F.ceil(F.lit(fraction) * F.col("universe"))
    return ranked.withColumn("n_hold", F.when(F.col("universe") >= MIN_UNIVERSE, hold).otherwise(0).cast("int"))


def weigh(held: DataFrame, rank_weighted: bool) -> DataFrame:
    """`held` carries slot (1..m) and n_hold = m."""
    m = F.col("n_hold")
    if not rank_weighted:
        return held.withColumn("weight", 1.0 / m)
    slope = F.when(m > 1, 1.25 - 0.5 * (F.col("slot") - 1) / (m - 1)).otherwise(1.0)
    return held.withColumn("weight", slope / m)


def target_weights(
    scores: DataFrame, series: Sequence[str] = ("model",), *, score: str = "score", rank_weighted: bool = False,
    layout: Layout | None = None, check: bool = False,
) -> DataFrame:
    """B6 (exact top 20%) and B8 (1.25 -> 0.75 rank weights): no state needed. A week
    below MIN_UNIVERSE scored names is refused (check=True) or has no targets."""
    if check:
        require_none(small_universes(scores, series, score), "At least five finite scores are required per week")
    layout = resolve(layout, scores, [*series, "week_date"])
    top = top_fraction(scores, series, score, layout=layout).filter("rank <= n_hold").withColumn("slot", F.col("rank"))
    return weigh(top, rank_weighted).select(*series, "week_date", "ticker", "rank", "n_hold", "weight")


def sub_buckets(frame: DataFrame, series: Sequence[str] = ("model",), *, score: str = "score", active: str = "raw_active_return",
                stock: str | None = None, layout: Layout | None = None) -> DataFrame:
    """Five rank slices inside the top 20%; a slice with a missing return
    reports none. Empty slices are reported with zero holdings."""
    layout = resolve(layout, frame, [*series, "week_date"])
    top = top_fraction(frame, series, score, layout=layout).filter("rank <= n_hold")
    bucket = F.floor((F.col("rank") - 1) * 5 / F.col("n_hold")).cast("int") + 1
    def whole(c):
        return F.when(F.count(c) == F.count(F.lit(1)), F.avg(c))
    outputs = [F.count(F.lit(1)).alias("holdings"), whole(active).alias("active_return")]
    if stock:
        outputs.append(whole(stock).alias("stock_return"))
    filled = top.groupBy(*series, "week_date", bucket.alias("subbucket")).agg(*outputs)
    slots = frame.select(*series, "week_date").distinct().withColumn("subbucket", F.explode(F.sequence(F.lit(1), F.lit(5))))
    return slots.join(filled, [*series, "week_date", "subbucket"], "left").withColumn("holdings", F.coalesce("holdings", F.lit(0)))


# --- B9: weekly long-only evaluation -----------------------------------------


# Aggregates of a book's returns; a book with any unobserved return, or without any name, has none.
HELD = "__w > 0"


def _book_return(column: str) -> str:
    return f"if(count_if({HELD}) > 0 and count_if({HELD} and {column} is null) = 0, sum(__w * {column}), null)"


def long_only_weekly(
    rows: DataFrame,
    series: Sequence[str] = ("model",),
    *,
    active: str = "raw_active_return",
    stock: str | None = None,
    cost_bps: float = LONG_ONLY_BPS,
    extra: dict[str, str] | None = None,
    carry: Sequence[str] = (),
    entries: bool = False,
) -> DataFrame:
    """Returns, trades, costs and coverage of target weights.

    `rows` carries `weight` (missing or 0 for names not held, which may be
    present so that `extra` aggregates, e.g. ranking metrics, see the whole
    universe in the same pass). Entering after a gap buys the whole book. A week
    that holds nothing (a withheld one) has neither returns nor costs nor turnover.
    `entries` returns every week twice, told apart by `__entry`: as a successor, and as
    bought whole from cash, which differs in the dollars traded only.
    """
    keys = [*series, "week_date"]
    priced = rows.selectExpr(
        *keys, "ticker", "weight", "coalesce(weight, 0D) as __w", f"{finite_sql(active)} as __a",
        f"{finite_sql(stock) if stock else 'cast(null as double)'} as __s", *carry,
    )
    aggregates = {
        "holdings": f"count_if({HELD})",
        "gross_active_return": _book_return("__a"),
        "gross_stock_return": _book_return("__s"),
        **(extra or {}),
    }
    weekly = weekly_book(priced, series, aggregates, ["__w", "__a", "__s", *carry])
    if entries:
        weekly = weekly.withColumn("__entry", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("consecutive", F.col("consecutive") & ~F.col("__entry"))
    dollars = "if(holdings = 0, null, if(consecutive, traded, gross_weight))"
    cost = f"{cost_bps / 10000.0}D * {dollars}"
    return weekly.selectExpr(
        *keys, "holdings", "gross_stock_return", "gross_active_return",
        f"gross_stock_return - {cost} as net_stock_return",
        f"gross_active_return - {cost} as net_active_return",
        f"{cost} as transaction_cost", f"{dollars} / 2 as turnover",
        "gross_active_return is not null as complete", *(extra or {}), *(["__entry"] if entries else []),
    )


# --- B10 / B11: portfolio metrics --------------------------------------------


def _whole_mean(c: str, where: str = "true") -> Column:
    """Annualized mean, missing when any selected week lacks the value."""
    return F.expr(f"if(count({c}) filter (where {where}) = count_if({where}), 52 * avg({c}) filter (where {where}), null)")


def portfolio_metrics(weekly: DataFrame, series: Sequence[str] = ("model",)) -> DataFrame:
    """One row per series, in one pass. Mean turnover skips the first week
    but keeps incomplete ones; everything else uses complete weeks."""
    keys = list(series)
    w = Window.partitionBy(*keys).orderBy("week_date")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    growth = F.when(F.col("complete"), 1 + F.col("net_stock_return"))
    rows = weekly.select("*", F.row_number().over(w).alias("__i"), F.product(growth).over(run).alias("__wealth"))
    rows = rows.withColumn("__peak", F.greatest(F.max("__wealth").over(run), F.lit(1.0)))

    def done(sql: str, name: str) -> Column:
        return F.expr(f"{sql} filter (where complete)").alias(name)

    priced = "count(net_stock_return) filter (where complete) = count_if(complete)"
    final = "max_by(__wealth, week_date) filter (where complete)"
    std = "stddev_samp(net_active_return) filter (where complete)"
    mean = "avg(net_active_return) filter (where complete)"
    optional = [c for c in ("q1_capture", "rank_ic", "ndcg_at_50") if c in weekly.columns]
    return rows.groupBy(*keys).agg(
        F.count_if("complete").alias("return_weeks"),
        _whole_mean("gross_stock_return", "complete").alias("annualized_stock_return"),
        _whole_mean("net_stock_return", "complete").alias("annualized_net_stock_return"),
        F.expr("52 * avg(gross_active_return) filter (where complete)").alias("annualized_active_return"),
        F.expr(f"52 * {mean}").alias("net_active_return"),
        F.expr(f"if({std} > 0, sqrt(52) * {mean} / {std}, null)").alias("active_ir"),
        done("sum(net_active_return)", "net_cumulative_active_return"),
        *[done(f"avg({c})", c) for c in optional],
        F.expr("52 * avg(transaction_cost) filter (where complete)").alias("annualized_transaction_cost"),
        done("sum(transaction_cost)", "total_transaction_cost"),
        F.expr(f"if({priced}, min(__wealth / __peak - 1) filter (where complete), null)").alias("max_drawdown"),
        F.expr(f"if({priced}, pow({final}, 52D / count_if(complete)) - 1, null)").alias("net_stock_cagr"),
        F.expr("avg(turnover) filter (where __i > 1)").alias("turnover"),
    ).filter("return_weeks > 0")


def yearly_performance(weekly: DataFrame, series: Sequence[str] = ("model",)) -> DataFrame:
    """The same figures per calendar year of the score week."""
    return weekly.filter("complete").groupBy(*series, F.year("week_date").alias("year")).agg(
        F.count(F.lit(1)).alias("weeks"),
        _whole_mean("gross_stock_return").alias("annualized_stock_return"),
        _whole_mean("net_stock_return").alias("annualized_net_stock_return"),
        (52.0 * F.avg("gross_active_return")).alias("annualized_active_return"),
        (52.0 * F.avg("net_active_return")).alias("net_active_return"),
        information_ratio("net_active_return").alias("active_ir"),
    )


# --- B13 / B14 ----------------------------------------------------------------


def long_only_net_ir(frame: DataFrame, series: Sequence[str] = ("model",), *, score: str = "score",
                     active: str = "raw_active_return", bps: float = LONG_ONLY_BPS, layout: Layout | None = None) -> DataFrame:
    """Net IR of a score vector; trades are charged between successive
    weeks of the frame even across a calendar gap."""
    layout = resolve(layout, frame, [*series, "week_date"])
    top = top_fraction(frame, series, score, layout=layout).filter("rank <= n_hold")
    held = top.selectExpr(*series, "week_date", "ticker", "1D / n_hold as weight", f"{active} as __a")
    weekly = weekly_book(held, series, {"__g": "avg(__a)"}, ["__a"], series_weeks(frame, series))
    net = weekly.withColumn("__net", F.col("__g") - bps / 10000.0 * F.col("traded"))
    return net.groupBy(*series).agg(F.coalesce(information_ratio("__net"), F.lit(UNDEFINED_IR)).alias("net_ir"))


def long_short_net_ir(frame: DataFrame, series: Sequence[str] = ("model",), *, score: str = "score",
                      active: str = "raw_active_return", bps: float = SELECTION_BPS, layout: Layout | None = None) -> DataFrame:
    weekly = long_short_weekly(frame, series, score=score, active=active, layout=layout)
    net = weekly.withColumn("__net", F.col("gross_return") - 2.0 * bps / 10000.0 * F.col("cost_turnover"))
    return net.groupBy(*series).agg(F.coalesce(information_ratio("__net"), F.lit(UNDEFINED_IR)).alias("net_ir"))


def change_versus_baseline(metrics: DataFrame, baseline: str = "incumbent") -> DataFrame:
    """Per model, the change of each status against the baseline row."""
    base = metrics.filter(F.col("status") == baseline).select(
        "model", F.col("active_ir").alias("__ir"), F.col("net_active_return").alias("__net")
    )
    return metrics.join(base, "model").withColumns(
        {
            "ir_change_vs_incumbent": F.col("active_ir") - F.col("__ir"),
            "annual_net_active_change_vs_incumbent": F.col("net_active_return") - F.col("__net"),
        }
    ).drop("__ir", "__net")
