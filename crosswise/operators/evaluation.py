"""Ranking and regression metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checks import require_none
from ..functions.columns import finite, finite_sql
from ..functions.layout import Layout, resolve
from ..functions.ranking import add_group_stats, add_ranks, join_groups, rank_correlation
from ..sources.storage import cut_lineage
from .portfolio import MIN_UNIVERSE, cost_scenarios, information_ratio, long_only_weekly, long_short_weight, weekly_book

MODEL_WEEK = ("model", "week_date")


# --- E1 / E2: regression metrics ---------------------------------------------


def _correlation(a: str, b: str) -> Column:
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def regression_metrics(
    frame: DataFrame, keys: Sequence[str], *, actual: str = "active_return_fwd", predicted: str = "prediction",
    layout: Layout | None = None,
) -> DataFrame:
    """Errors and correlations per group; undefined figures are missing.

    Only the rank correlation needs ordering, which a group beyond the bound gets
    by ranges, so it may be a whole model history. The pairs are stored once where
    they are read more than once. Groups without a valid pair keep a row with n = 0.
    """
    keys = list(keys)
    a, p = finite(actual), finite(predicted)
    both = a.isNotNull() & p.isNotNull()
    rows = frame.select(*keys, F.when(both, a).alias("__a"), F.when(both, p).alias("__p"))
    if layout is None or layout.splits > 1:
        rows = cut_lineage(rows)
        layout = resolve(layout, rows, keys)
    split = layout.splits > 1
    if not split:
        rows = add_ranks(rows, keys, "__a", average="__ra", layout=layout)
        rows = add_ranks(rows, keys, "__p", average="__rp", layout=layout)
    err = F.col("__a") - F.col("__p")
    n = F.count("__a")
    varied, spread = F.var_pop("__a"), F.var_pop("__p")
    defined = (n > 1) & (varied > 0) & (spread > 0)
    mse = F.avg(err * err)
    out = rows.groupBy(*keys).agg(
        n.alias("n"),
        mse.alias("mse"),
        F.sqrt(mse).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        F.when((n > 1) & (varied > 0), 1 - mse / varied).alias("r2"),
        F.when(defined, _correlation("__a", "__p")).alias("pearson_ic"),
        defined.alias("spearman_ic") if split else F.when(defined, _correlation("__ra", "__rp")).alias("spearman_ic"),
        F.avg(F.col("__a") * F.col("__a")).alias("zero_baseline_mse"),
    )
    if not split:
        return out
    ranked = join_groups(out, rank_correlation(rows, keys, "__a", "__p", "__rank_ic", layout), keys, "left")
    return ranked.withColumn("spearman_ic", F.when(F.col("spearman_ic"), F.col("__rank_ic"))).drop("__rank_ic")


def ic_statistics(weekly: DataFrame, ic: str = "spearman_ic", keys: Sequence[str] = ("model",)) -> DataFrame:
    """Mean, sample deviation and positive share of the weekly IC."""
    return weekly.groupBy(*keys).agg(
        F.avg(ic).alias("mean_weekly_ic"),
        F.stddev_samp(ic).alias("weekly_ic_std"),
        F.avg(F.when(F.col(ic).isNotNull(), (F.col(ic) > 0).cast("int"))).alias("positive_weekly_ic_fraction"),
        F.count(ic).alias("ic_weeks"),
    )


# --- rank state shared by E3-E8 ----------------------------------------------


def relevance(first_rank: str, n: str) -> str:
    """Label 0-4 from the first-tie rank of the outcome (W6's scale)."""
    return f"cast(if({n} < 2, 0, least(greatest(ceil({first_rank} / {n} * 5) - 1, 0), 4)) as int)"


STATE = ("place", "n", "__t", "__first", "__rs", "__rt", "label")


def rank_state(
    frame: DataFrame, keys: Sequence[str], *, score: str, target: str, layout: Layout | None = None
) -> DataFrame:
    """Everything the ranking metrics read, per row: score place (1 = best),
    scored names in the group, outcome place (1 = worst), both average ranks and
    the label. Rows without a score stay, unranked, so that empty groups show."""
    layout = resolve(layout, frame, keys)
    clean = frame.selectExpr("*", f"{finite_sql(score)} as __s", f"if({finite_sql(score)} is null, null, {finite_sql(target)}) as __t")
    placed = add_ranks(clean, keys, "__s", tie=["ticker"], descending=True, position="place", average="__rs", count="n", layout=layout)
    placed = add_ranks(placed, keys, "__t", tie=["ticker"], position="__first", average="__rt", layout=layout)
    return placed.selectExpr("*", f"if(__first is null, null, {relevance('__first', 'n')}) as label").drop("__s")


def _ndcg_sql(k: str, side: str = "long", empty: str = "0D") -> str:
    """NDCG as one aggregate. Labels rise with the outcome place, so the ideal
    order is the outcome order itself: no extra sort. The short side reverses
    both orders and flips the labels."""
    gain, place, best = ("label", "place", "(n + 1 - __first)") if side == "long" else ("(4 - label)", "(n + 1 - place)", "__first")
    def total(at):
        return f"sum({gain} / log2({at} + 1)) filter (where {at} <= {k})"
    return f"if({total(best)} > 0, {total(place)} / {total(best)}, {empty})"


# A group is evaluated only when every scored name has an outcome.
WHOLE = "max(n) > 0 and max(n) = count(__t)"
# Score ranks run from the best score down, hence the sign.
# Built from moments: the corr aggregate divides by zero on constant input.
RANK_IC = "if(min(__rs) < max(__rs) and min(__rt) < max(__rt), -try_divide(covar_pop(__rt, __rs), stddev_pop(__rt) * stddev_pop(__rs)), null)"


def ndcg_at(
    frame: DataFrame, k: int, keys: Sequence[str] = MODEL_WEEK, *, score: str = "prediction", target: str = "active_return_fwd",
    empty: str = "0D", layout: Layout | None = None,
) -> DataFrame:
    """Long-side NDCG at min(k, n); weeks with a missing outcome are withheld."""
    state = rank_state(frame, keys, score=score, target=target, layout=layout)
    value = f"if({WHOLE}, {_ndcg_sql(f'least({k}, n)', empty=empty)}, null)"
    return state.groupBy(*keys).agg(F.expr("max(n)").alias("n_scored"), F.expr(value).alias("ndcg"))


def symmetric_ndcg(
    frame: DataFrame, keys: Sequence[str] = MODEL_WEEK, *, score: str = "prediction", target: str = "active_return_fwd",
    layout: Layout | None = None,
) -> DataFrame:
    """Mean of long and short NDCG at ceil(n / 5)."""
    state = rank_state(frame, keys, score=score, target=target, layout=layout)
    sides = {side: f"if({WHOLE}, {_ndcg_sql('ceil(n / 5)', side)}, null)" for side in ("long", "short")}
    both = state.groupBy(*keys).agg(
        F.expr("max(n)").alias("n_scored"), *[F.expr(sql).alias(f"{side}_ndcg") for side, sql in sides.items()]
    )
    return both.selectExpr("*", "(long_ndcg + short_ndcg) * 0.5D as ls_ndcg")


def evaluate_scores(
    frame: DataFrame, series: Sequence[str] = ("model",), *, score: str = "prediction", target: str = "active_return_fwd",
    layout: Layout | None = None,
) -> DataFrame:
    """E5: weekly ranking evaluation. Both sides hold ceil(20%) of the scored
    names; a missing outcome withholds the week's outcome metrics only."""
    keys = [*series, "week_date"]
    state = rank_state(frame, keys, score=score, target=target, layout=layout)
    k = "ceil(0.2D * n)"
    long_side, short_side = f"place <= {k}", f"place > n - {k}"
    rows = state.selectExpr(
        *keys, "ticker", *STATE, f"case when n < 2 then null when {long_side} then 1D / {k} when {short_side} then -1D / {k} end as weight"
    )
    ok = f"max(n) >= 2 and {WHOLE}"
    aggregates = {
        "n_scored": "max(n)",
        "n_observed": "count(__t)",
        "long_ndcg": f"if({ok}, {_ndcg_sql(k)}, null)",
        "short_ndcg": f"if({ok}, {_ndcg_sql(k, 'short')}, null)",
        "q1_q5_spread": f"if({ok}, avg(__t) filter (where {long_side}) - avg(__t) filter (where {short_side}), null)",
        "spearman": f"if({ok}, {RANK_IC}, null)",
    }
    weekly = weekly_book(rows, series, aggregates, STATE)
    return weekly.selectExpr(
        *keys, "n_scored", "n_observed", "long_ndcg", "short_ndcg", "(long_ndcg + short_ndcg) * 0.5D as ls_ndcg",
        "q1_q5_spread", "spearman", "if(consecutive, traded / 2, null) as turnover",
    )


SUMMARY = ("ls_ndcg", "long_ndcg", "short_ndcg", "q1_q5_spread", "turnover", "spearman")


def summarize_metrics(weekly: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Finite means, spread IR and the number of evaluated weeks."""
    cleaned = weekly.withColumns({c: finite(c) for c in SUMMARY})
    return cleaned.groupBy(*keys).agg(
        *[F.avg(c).alias(f"mean_{c}") for c in SUMMARY],
        information_ratio("q1_q5_spread").alias("q1_q5_information_ratio"),
        F.count("ls_ndcg").alias("n_groups"),
    )


def fold_summary(folds: DataFrame, keys: Sequence[str] = ("candidate",)) -> DataFrame:
    """Mean over folds of E6; group counts add up."""
    names = [*[f"mean_{c}" for c in SUMMARY], "q1_q5_information_ratio"]
    return folds.groupBy(*keys).agg(*[F.avg(finite(c)).alias(c) for c in names], F.sum("n_groups").alias("n_groups"))


# --- E7 and the weekly extras of B9 ------------------------------------------

# Capture of the actual top 20%, rank IC and NDCG@50, over rows that carry the
# rank state, the outcome place from the top (__best) and the held weight (__w).
WEEKLY_METRICS = {
    "q1_capture": f"if({WHOLE} and count_if(__w > 0) > 0, count_if(__best <= ceil(0.2D * n) and __w > 0) / count_if(__best <= ceil(0.2D * n)), null)",
    "rank_ic": f"if({WHOLE}, {RANK_IC}, null)",
    "ndcg_at_50": f"if({WHOLE}, {_ndcg_sql('least(50, n)', empty='null')}, null)",
}


def metric_state(
    frame: DataFrame, series: Sequence[str] = ("model",), *, score: str = "score", target: str = "active_return_train", layout: Layout | None = None
) -> DataFrame:
    """Rank state plus __best and the exact top-20% weight of each row."""
    keys = [*series, "week_date"]
    layout = resolve(layout, frame, keys)
    state = rank_state(frame, keys, score=score, target=target, layout=layout)
    # Place from the top without a third sort: inside a tie of s rows starting after p
    # places, __first runs through p + 1 .. p + s and __rt is p + (s + 1) / 2; from the
    # top the same rows keep their ticker order behind the m - p - s rows above.
    counted = add_group_stats(state, keys, {"__m": "count(__t) @"}, layout)
    best = counted.selectExpr("*", "cast(__m + 1 + __first - 2 * __rt as int) as __best").drop("__m")
    return best.selectExpr("*", f"if(n >= {MIN_UNIVERSE} and place <= ceil(0.2D * n), 1D / ceil(0.2D * n), null) as weight")


def weekly_rank_metrics(
    frame: DataFrame, series: Sequence[str] = ("model",), *, book: DataFrame | None = None, score: str = "score",
    target: str = "active_return_train", layout: Layout | None = None,
) -> DataFrame:
    """E7 and companions per week, all missing when an outcome is missing; capture also when nothing is held.
    `book` replaces the exact top 20% as the held set."""
    keys = [*series, "week_date"]
    state = metric_state(frame, series, score=score, target=target, layout=layout)
    if book is not None:
        state = state.drop("weight").join(book.select(*keys, "ticker", "weight"), [*keys, "ticker"], "left")
    return state.withColumn("__w", F.col("weight")).groupBy(*keys).agg(*[F.expr(sql).alias(k) for k, sql in WEEKLY_METRICS.items()])


def evaluate_exact_q1(
    frame: DataFrame, series: Sequence[str] = ("model",), *, score: str = "score", active: str = "raw_active_return",
    stock: str | None = None, target: str = "active_return_train", cost_bps: float = 5, layout: Layout | None = None,
    entries: bool = False,
) -> DataFrame:
    """B9 with E7 for the exact top 20%: ranks, returns, trades and metrics of
    every week in one pass over the scored rows."""
    state = metric_state(frame, series, score=score, target=target, layout=layout)
    return long_only_weekly(
        state, series, active=active, stock=stock, cost_bps=cost_bps, extra=WEEKLY_METRICS, carry=[*STATE, "__best"], entries=entries
    )


# --- E8: comparative evaluation ----------------------------------------------


def quintile_violations(members: DataFrame, layout: Layout | None = None) -> DataFrame:
    """Stored quintiles that are not Q1-high with ticker tie breaks."""
    layout = resolve(layout, members, MODEL_WEEK)
    scored = members.filter(finite("prediction").isNotNull())
    ranked = add_ranks(scored, MODEL_WEEK, "prediction", tie=["ticker"], descending=True, position="__p", count="__n", layout=layout)
    want = F.floor((F.col("__p") - 1) * 5 / F.col("__n")) + 1
    return ranked.filter((F.col("__n") >= 5) & ~F.col("quintile").eqNullSafe(want.cast("int"))).select("model", "week_date", "ticker")


def comparative_weekly(members: DataFrame, layout: Layout | None = None, check: bool = False) -> DataFrame:
    """E8, weekly part: rank metrics, Q1-Q5 spreads, turnover and the flags of
    weeks usable by every model, per metric family. `check` also verifies the
    stored quintiles."""
    layout = resolve(layout, members, MODEL_WEEK)
    if check:
        require_none(quintile_violations(members, layout), "Quintiles are not Q1-high with ticker tie breaks")
    state = rank_state(members, MODEL_WEEK, score="prediction", target="active_return_fwd", layout=layout)
    returns = ("stock_return_fwd", "sector_return_fwd", "raw_active_return_fwd")
    seen = " and ".join(f"{finite_sql(c)} is not null" for c in returns)
    rows = state.selectExpr(
        *MODEL_WEEK, "ticker", *STATE, f"if(place is null, null, {seen}) as __seen", "raw_active_return_fwd as __a", "stock_return_fwd as __r",
        f"{long_short_weight()} as weight", f"{long_short_weight()} as __w",
    )
    def spread(c):
        return f"avg({c}) filter (where __w > 0) - avg({c}) filter (where __w < 0)"
    ranked, returned = f"max(n) >= 5 and {WHOLE}", "max(n) >= 5 and max(n) = count_if(__seen)"
    aggregates = {
        "scored_stocks": "max(n)",
        "effective_ndcg_k": "least(50, max(n))",
        "rank_ic": f"if({ranked}, {RANK_IC}, null)",
        "ndcg_at_50": f"if({ranked}, {_ndcg_sql('least(50, n)')}, null)",
        "q1_q5_active_return": f"if({returned}, {spread('__a')}, null)",
        "q1_q5_stock_return": f"if({returned}, {spread('__r')}, null)",
    }
    weekly = weekly_book(rows, ["model"], aggregates, [*STATE, "__seen", "__a", "__r", "__w"])
    weekly = weekly.selectExpr(*MODEL_WEEK, *aggregates, "if(consecutive, traded / 2, null) as turnover")
    # (model, week) is unique here, so counting rows counts models. The table has
    # models x weeks rows, so one unpartitioned window may list the models.
    weekly = weekly.selectExpr("*", "size(collect_set(model) over ()) as __models")
    families = {
        "ranking": "rank_ic is not null and ndcg_at_50 is not null",
        "returns": "q1_q5_active_return is not null and q1_q5_stock_return is not null",
        "turnover": "turnover is not null",
    }
    flags = [f"count_if({sql}) over (partition by week_date) = __models as common_{name}_week" for name, sql in families.items()]
    return weekly.selectExpr(*[c for c in weekly.columns if c != "__models"], *flags)


def comparative_summary(weekly: DataFrame) -> DataFrame:
    """E8, one row per model over the common weeks of each metric family."""
    def over(flag, c):
        return F.when(F.col(flag), F.col(c))
    rows = weekly.select(
        "model",
        over("common_ranking_week", "rank_ic").alias("__ic"), over("common_ranking_week", "ndcg_at_50").alias("__ndcg"),
        over("common_returns_week", "q1_q5_active_return").alias("__active"),
        over("common_returns_week", "q1_q5_stock_return").alias("__stock"),
        over("common_turnover_week", "turnover").alias("__turnover"),
    )
    return rows.groupBy("model").agg(
        F.avg("__ic").alias("rank_ic"),
        F.avg("__ndcg").alias("ndcg_at_50"),
        (52.0 * F.avg("__active")).alias("q1_q5_annualized_return"),
        information_ratio("__active").alias("q1_q5_annualized_ir"),
        F.avg("__turnover").alias("mean_weekly_turnover"),
        (52.0 * F.avg("__stock")).alias("q1_q5_annualized_stock_return"),
        information_ratio("__stock").alias("q1_q5_annualized_stock_ir"),
        F.count("__ic").alias("ranking_weeks"),
        F.count("__active").alias("return_weeks"),
        F.count("__turnover").alias("turnover_observations"),
    )


def comparative_costs(weekly: DataFrame) -> DataFrame:
    """Cost sensitivity of the realized spreads: entry is charged as 1.0."""
    usable = weekly.filter("common_returns_week").select(
        "model", "week_date", F.col("q1_q5_active_return").alias("gross_return"),
        F.coalesce("turnover", F.lit(1.0)).alias("cost_turnover"),
    )
    return cost_scenarios(usable)
