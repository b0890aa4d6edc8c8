"""Sector-neutral weekly panel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checks import duplicate_keys, require_columns, require_none
from ..functions.columns import FEATURE_DIRECTIONS, clean_ticker, close_to, epoch_or_date, finite, finite_sql, ticker_key
from ..functions.layout import Layout, resolve
from ..functions.ranking import add_group_stats, add_ranks, join_groups
from ..functions.timeseries import by_ticker
from ..sources.storage import cut_lineage

TARGET, FORWARD = "active_return_train", "active_return_fwd"


# --- P1 / P2 / P3: inputs and sectors ----------------------------------------


def check_arguments(directions: Mapping[str, int], lower: float, upper: float) -> None:
    if not 0.0 <= lower < upper <= 1.0:
        raise ValueError("winsor bounds must satisfy 0 <= lower < upper <= 1")
    if not directions:
        raise ValueError("at least one feature is needed")
    wrong = {k: v for k, v in directions.items() if v not in (-1, 1)}
    if wrong:
        raise ValueError(f"feature directions must be +1 or -1: {wrong}")


def panel_violations(weekly: DataFrame) -> DataFrame:
    """Rows that may not enter the panel: (problem, ticker, week_date, n_rows)."""
    key = ticker_key("ticker")
    grouped = weekly.groupBy(key.alias("ticker"), F.col("week_date")).agg(F.count(F.lit(1)).alias("n_rows"))
    problem = (
        F.when(F.col("ticker").isNull() | (F.col("ticker") == ""), "blank_ticker")
        .when(F.col("week_date").isNull(), "missing_week")
        .when(F.col("n_rows") > 1, "duplicate_key")
    )
    return grouped.withColumn("problem", problem).filter("problem is not null").select(
        "problem", "ticker", "week_date", "n_rows"
    )


def attach_sectors(weekly: DataFrame, sectors: DataFrame) -> DataFrame:
    """Many-to-one join on the normalized ticker; existing sectors win."""
    mapping = sectors.select(ticker_key("ticker").alias("__key"), F.trim(F.col("sector").cast("string")).alias("__mapped"))
    joined = weekly.withColumn("__key", ticker_key("ticker")).join(mapping, "__key", "left")
    existing = F.trim(F.col("sector").cast("string")) if "sector" in weekly.columns else F.lit(None).cast("string")
    return joined.withColumn("__existing", existing)


def sector_conflicts(attached: DataFrame) -> DataFrame:
    return attached.filter("__existing <> __mapped").select(
        "ticker", F.col("__existing").alias("sector"), F.col("__mapped").alias("mapped_sector")
    ).distinct()


def settle_sectors(attached: DataFrame) -> DataFrame:
    return attached.withColumn("sector", F.coalesce("__existing", "__mapped")).drop("__key", "__existing", "__mapped")


def patch_sectors(df: DataFrame, patch: Mapping | DataFrame) -> DataFrame:
    """Fill missing sectors only (a literal map, or a table of any size)."""
    if isinstance(patch, DataFrame):
        fixes = patch.select("ticker", F.col("sector").alias("__fix"))
        return df.join(fixes, "ticker", "left").withColumn("sector", F.coalesce("sector", "__fix")).drop("__fix")
    literal = F.create_map(*[F.lit(x) for pair in patch.items() for x in pair])
    return df.withColumn("sector", F.coalesce("sector", F.try_element_at(literal, F.col("ticker"))))


def completed_sector_map(df: DataFrame) -> DataFrame:
    return df.select("ticker", "sector").distinct()


# --- P4 - P8: the cross-sectional transform ----------------------------------


def to_long(df: DataFrame, ids: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """One row per (ids, feature). All features then share one sort and one
    chain of windows, and spread over tasks, instead of one chain per column."""
    wide = df.selectExpr(*ids, *[f"cast({sql} as double) as `{name}`" for name, sql in columns.items()])
    return wide.unpivot(list(ids), list(columns), "feature", "x")


def winsor_rank(df: DataFrame, group: Sequence[str], value: str, tie: str, lower: float, upper: float, layout: Layout) -> DataFrame:
    """P5 + P6 in one pass over the sorted group: adds `winsorized` and
    `percentile`.

    The interpolated quantiles are read off the rank positions, so no
    percentile buffer is built; clipped rows tie at a bound, and their average
    rank follows from the places of the values next to it.
    """
    keep = df.columns
    if layout.splits == 1:
        spec = f"partition by {', '.join(group)} order by {value} nulls last"
        ranked = df.selectExpr(
            "*",
            f"rank() over ({spec}) as __from",
            f"count({value}) over ({spec} range between unbounded preceding and current row) as __to",
            f"count({value}) over ({spec} rows between unbounded preceding and unbounded following) as __n",
        )
    else:
        placed = cut_lineage(add_ranks(df, group, value, tie=[tie], position="__p", count="__n", layout=layout))
        # The group of the missing values holds null places.
        ends = placed.groupBy(*group, value).agg(F.min("__p").alias("__from"), F.max("__p").alias("__to"))
        ranked = join_groups(placed.drop("__p"), ends, [*group, value], "left")

    def at(q: float, shift: int, what: str) -> str:
        place = f"floor((__n - 1) * {q}D) + {1 + shift}"
        return f"max(if({place} between __from and __to, {what}, null)) @"

    picks = {
        "__la": at(lower, 0, value), "__lb": at(lower, 1, value), "__la_to": at(lower, 0, "__to"), "__lb_to": at(lower, 1, "__to"),
        "__ha": at(upper, 0, value), "__hb": at(upper, 1, value), "__ha_from": at(upper, 0, "__from"), "__hb_from": at(upper, 1, "__from"),
    }
    near = add_group_stats(ranked, group, picks, layout)

    def bound(a: str, b: str, q: float) -> str:
        place = f"(__n - 1) * {q}D"
        return f"{a} + (coalesce({b}, {a}) - {a}) * ({place} - floor({place}))"

    clipped = near.selectExpr("*", f"{bound('__la', '__lb', lower)} as __lo", f"{bound('__ha', '__hb', upper)} as __hi")
    low_rank = "(if(__lo >= __lb, __lb_to, __la_to) + 1) / 2.0D"
    high_rank = "(if(__hi <= __ha, __ha_from, __hb_from) + __n) / 2.0D"
    rank = f"case when {value} <= __lo then {low_rank} when {value} >= __hi then {high_rank} else (__from + __to) / 2.0D end"
    return clipped.selectExpr(
        *keep,
        f"if({value} is null, null, greatest(least({value}, __hi), __lo)) as winsorized",
        f"if({value} is null, null, ({rank} - 0.5D) / __n) as percentile",
    )


def zscore(df: DataFrame, group: Sequence[str], value: str, out: str, layout: Layout) -> DataFrame:
    """Population z-score; a constant cross-section scores 0."""
    keep = df.columns
    stats = add_group_stats(df, group, {"__mean": f"avg({value}) @", "__std": f"stddev_pop({value}) @"}, layout)
    z = f"case when __std > 1e-12D then ({value} - __mean) / __std when {value} is not null then 0.0D end"
    return stats.selectExpr(*keep, f"{z} as {out}")


def neutral_column(x: np.ndarray, groups: list[np.ndarray], what: str, lower: float, upper: float) -> np.ndarray:
    """P5-P7 of one column of a week (NaN: missing): `winsorized`, `percentile` or `z`."""
    out = np.full(len(x), np.nan)
    for group in groups:
        known = group[~np.isnan(x[group])]
        n = len(known)
        if not n:
            continue
        own = x[known]
        # Values are ordered once; ranks go back along the same order.
        order = None if what == "winsorized" else np.argsort(own)
        ordered = np.sort(own) if order is None else own[order]

        def bound(q: float) -> float:
            place = (n - 1) * q
            at = int(place)
            return ordered[at] + (ordered[min(at + 1, n - 1)] - ordered[at]) * (place - at)

        lo, hi = bound(lower), bound(upper)
        if order is None:
            out[known] = np.maximum(np.minimum(own, hi), lo)
            continue
        places = np.maximum(np.minimum(ordered, hi), lo)
        first = np.flatnonzero(np.append(True, places[1:] != places[:-1]))
        last = np.append(first[1:], n)
        rank = np.repeat((first + 1 + last) / 2.0, last - first)
        out[known[order]] = (rank - 0.5) / n
    if what != "z":
        return out
    known = ~np.isnan(out)
    if not known.any():
        return out
    away = out - out[known].mean()
    std = np.sqrt(np.mean(away[known] ** 2))
    return away / std if std > 1e-12 else np.where(known, 0.0, np.nan)


def neutral_weeks(weekly: DataFrame, cells: Mapping[str, str], what: str, lower: float, upper: float, benchmarked: str | None = None) -> DataFrame:
    """(ticker, sector, week_date, one `what` per cell), a week at a time.

    The cross-section stays wide: a week is one group of (ticker, cells) rows, and its columns
    are ordered one after the other, so nothing is multiplied by the number of cells.
    `benchmarked` names a cell that is taken relative to its sector's mean first."""
    ids = ["ticker", "sector", "week_date"]
    rows = weekly.selectExpr(*ids, *[f"cast({sql} as double) as `{name}`" for name, sql in cells.items()])

    def neutral(table: pa.Table) -> pa.Table:
        codes = table.column("sector").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(codes[order])) + 1)
        columns = []
        for name in cells:
            x = table.column(name).to_numpy().astype(float)
            if name == benchmarked:
                x = x.copy()
                for group in groups:
                    known = group[~np.isnan(x[group])]
                    x[known] -= x[known].mean() if len(known) else 0.0
            scored = neutral_column(x, groups, what, lower, upper)
            columns.append(pa.array(scored, mask=np.isnan(scored)))
        return pa.table([*[table.column(c) for c in ids], *columns], names=[*ids, *cells])

    kinds = dict(rows.dtypes)
    return rows.groupBy("week_date").applyInArrow(neutral, ", ".join(f"`{c}` {kinds[c]}" for c in [*ids, *cells]))


def cross_sectional_scores(
    weekly: DataFrame,
    directions: Mapping[str, int],
    *,
    return_column: str = "return_1w",
    lower: float = 0.01,
    upper: float = 0.99,
    layout: Layout | None = None,
) -> DataFrame:
    """(ticker, sector, week_date, one score per feature, target)."""
    layout = resolve(layout, weekly, ["week_date"])
    cells = {name: f"{sign} * {finite_sql(name)}" for name, sign in directions.items()}
    if layout.splits == 1:
        scored = neutral_weeks(weekly, {**cells, TARGET: finite_sql(return_column)}, "z", lower, upper, TARGET)
        return scored.select("week_date", "ticker", "sector", *cells, TARGET)
    cleaned = weekly.withColumn("__ret", finite(return_column))
    with_mean = add_group_stats(cleaned, ["week_date", "sector"], {"__bench": "avg(__ret) @"}, layout)
    cells[TARGET] = "__ret - __bench"
    long = to_long(with_mean, ["ticker", "sector", "week_date"], cells)
    # Key order: the (week, feature) windows then reuse the (week, feature,
    # sector) sort as a prefix.
    ranked = winsor_rank(long, ["week_date", "feature", "sector"], "x", "ticker", lower, upper, layout)
    scored = zscore(ranked, ["week_date", "feature"], "percentile", "z", layout)
    return scored.groupBy("week_date", "ticker", "sector").agg(
        *[F.expr(f"max(z) filter (where feature = '{name}')").alias(name) for name in cells]
    )


# --- P9 / P10: exact previous and next observed week -------------------------


def observed_weeks(df: DataFrame) -> DataFrame:
    """Distinct weeks with their observed neighbours (one row per week)."""
    w = Window.orderBy("week_date")
    return df.select("week_date").distinct().select(
        "week_date",
        F.lag("week_date").over(w).alias("prev_week_date"),
        F.lead("week_date").over(w).alias("next_week_date"),
    )


def exact_neighbours(
    scored: DataFrame, features: Sequence[str], target: str = TARGET, forward: str = FORWARD, weeks: DataFrame | None = None
) -> DataFrame:
    """lag/lead guarded by the observed-week map: a missing ticker-week is
    never bridged. One exchange on ticker instead of two self-joins."""
    weeks = observed_weeks(scored) if weeks is None else weeks
    with_weeks = scored.join(F.broadcast(weeks), "week_date")
    w = "over (partition by ticker order by week_date)"
    lags = [f"if(lag(week_date) {w} = prev_week_date, lag({f}) {w}, null) as {f}_train" for f in features]
    ahead = f"if(lead(week_date) {w} = next_week_date, lead({target}) {w}, null) as {forward}"
    return with_weeks.selectExpr("ticker", "sector", "week_date", "prev_week_date", *features, *lags, target, ahead)


def build_panel(
    weekly: DataFrame,
    sectors: DataFrame | None = None,
    *,
    directions: Mapping[str, int] = FEATURE_DIRECTIONS,
    return_column: str = "return_1w",
    lower: float = 0.01,
    upper: float = 0.99,
    layout: Layout | None = None,
    weeks: DataFrame | None = None,
    check: bool = True,
) -> DataFrame:
    """The whole panel. `weeks` (from observed_weeks) saves a pass over the
    input where the calendar is known, e.g. from the partitions of a table. `check=False` skips the eager violation queries (for
    inputs already validated upstream)."""
    check_arguments(directions, lower, upper)
    require_columns(weekly, ["ticker", "week_date", return_column, *directions])
    if sectors is None and "sector" not in weekly.columns:
        raise ValueError("Supply sectors or a sector column")
    if check:
        require_none(panel_violations(weekly), "Invalid ticker/week rows")
    if sectors is not None:
        attached = attach_sectors(weekly, sectors)
        if check:
            require_none(sector_conflicts(attached), "Conflicting sectors")
        weekly = settle_sectors(attached)
    if check:
        blank = weekly.filter(F.col("sector").isNull() | (F.trim(F.col("sector").cast("string")) == ""))
        require_none(blank.select("ticker").distinct(), "Missing sector assignments")
    scored = cross_sectional_scores(
        weekly, directions, return_column=return_column, lower=lower, upper=upper, layout=layout
    )
    return exact_neighbours(scored, list(directions), weeks=weeks)


def trim_lookback(panel: DataFrame, start, end=None) -> DataFrame:
    """Drop the warm-up weeks only after lagging."""
    kept = panel.filter(F.col("week_date") >= F.lit(start).cast("date"))
    return kept if end is None else kept.filter(F.col("week_date") <= F.lit(end).cast("date"))


# --- P11 / P13 / P14: validation and preparation -----------------------------


def panel_statistics(panel: DataFrame, features: Sequence[str]) -> DataFrame:
    """P11 as one row: coverage, missing values, neutrality and dispersion.

    Three aggregate passes at shrinking grain (week x sector, week, all), each
    combined map-side; nothing is collected.
    """
    cols = [*features, TARGET]
    n = F.count(F.lit(1)).alias("rows")
    any_missing = F.lit(False)
    for f in features:
        any_missing = any_missing | F.col(f"{f}_train").isNull()
    missing_train = F.sum(F.when(any_missing, 1).otherwise(0)).alias("rows_with_any_missing_train_feature")
    missing_fwd = F.sum(F.when(F.col(FORWARD).isNull(), 1).otherwise(0)).alias("rows_with_missing_active_return_fwd")
    sums = [e for c in cols for e in (F.sum(c).alias(f"s_{c}"), F.sum(F.col(c) * F.col(c)).alias(f"q_{c}"), F.count(c).alias(f"n_{c}"))]
    sector = panel.groupBy("week_date", "sector").agg(n, missing_train, missing_fwd, *sums)

    def largest(values):
        return F.greatest(F.lit(0.0), *values)

    def worst_mean(names):
        return largest([F.coalesce(F.abs(F.try_divide(F.col(f"s_{c}"), F.col(f"n_{c}"))), F.lit(0.0)) for c in names])

    carried = [e for c in cols for e in (F.sum(f"s_{c}").alias(f"s_{c}"), F.sum(f"q_{c}").alias(f"q_{c}"), F.sum(f"n_{c}").alias(f"n_{c}"))]
    week = (
        sector.withColumn("fs", worst_mean(features)).withColumn("ts", worst_mean([TARGET]))
        .groupBy("week_date")
        .agg(
            F.max("fs").alias("fs"), F.max("ts").alias("ts"), F.sum("rows").alias("rows"),
            F.sum("rows_with_any_missing_train_feature").alias("rows_with_any_missing_train_feature"),
            F.sum("rows_with_missing_active_return_fwd").alias("rows_with_missing_active_return_fwd"),
            *carried,
        )
    )

    def std_error(c):
        mean = F.try_divide(F.col(f"s_{c}"), F.col(f"n_{c}"))
        std = F.sqrt(F.greatest(F.try_divide(F.col(f"q_{c}"), F.col(f"n_{c}")) - mean * mean, F.lit(0.0)))
        return F.when(std > 1e-12, F.abs(std - 1.0)).otherwise(0.0)

    return (
        week.withColumn("fw", worst_mean(features)).withColumn("tw", worst_mean([TARGET]))
        .withColumn("fe", largest([std_error(c) for c in features]))
        .withColumn("te", std_error(TARGET))
        .agg(
            F.sum("rows").alias("rows"),
            F.count(F.lit(1)).alias("weeks"),
            F.min("week_date").alias("first_week"),
            F.max("week_date").alias("last_week"),
            F.sum("rows_with_any_missing_train_feature").alias("rows_with_any_missing_train_feature"),
            F.sum("rows_with_missing_active_return_fwd").alias("rows_with_missing_active_return_fwd"),
            F.max("fw").alias("max_abs_weekly_feature_mean"),
            F.max("fs").alias("max_abs_week_sector_feature_mean"),
            F.max("fe").alias("max_abs_population_std_minus_one"),
            F.max("tw").alias("max_abs_weekly_active_return_mean"),
            F.max("ts").alias("max_abs_week_sector_active_return_mean"),
            F.max("te").alias("max_abs_active_return_population_std_minus_one"),
        )
    )


def lag_violations(panel: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows whose *_train value is not the ticker's score one observed week ago,
    or whose forward target is not its next observed week's target."""
    w = by_ticker("week_date")
    weeks = observed_weeks(panel).select("week_date", F.col("prev_week_date").alias("__prev"), F.col("next_week_date").alias("__next"))
    joined = panel.join(F.broadcast(weeks), "week_date")
    prev_ok = F.lag("week_date").over(w) == F.col("__prev")
    next_ok = F.lead("week_date").over(w) == F.col("__next")
    checked = joined.select(
        "ticker", "week_date", "prev_week_date", "__prev",
        *[F.struct(F.col(f"{f}_train").alias("got"), F.when(prev_ok, F.lag(f).over(w)).alias("want")).alias(f"c_{f}") for f in features],
        F.struct(F.col(FORWARD).alias("got"), F.when(next_ok, F.lead(TARGET).over(w)).alias("want")).alias("c_fwd"),
    )
    same_lags = F.lit(True)
    for f in features:
        same_lags = same_lags & close_to(F.col(f"c_{f}.got"), F.col(f"c_{f}.want"))
    problem = (
        F.when(~F.col("prev_week_date").eqNullSafe(F.col("__prev")), "prev_week_date")
        .when(~same_lags, "lagged_feature")
        .when(~F.col("c_fwd.got").eqNullSafe(F.col("c_fwd.want")), "forward_target")
    )
    return checked.select("ticker", "week_date", problem.alias("problem")).filter("problem is not null")


def validate_panel(panel: DataFrame, features: Sequence[str], source_weeks: DataFrame, tol: float = 1e-10) -> dict:
    """P11 as a gate: raise on any violation, else return the statistics."""
    require_none(duplicate_keys(panel, ["ticker", "week_date"]), "Duplicate panel rows")
    cells = [*features, TARGET]
    missing = F.col("sector").isNull()
    infinite = F.lit(False)
    for c in cells:
        missing = missing | F.col(c).isNull()
    for c in [*cells, FORWARD, *[f"{f}_train" for f in features]]:
        infinite = infinite | F.coalesce(F.abs(c) == float("inf"), F.lit(False))
    require_none(panel.filter(missing | infinite).select("ticker", "week_date"), "Missing or infinite panel values")
    have = panel.select("week_date").distinct()
    want = source_weeks.select("week_date").distinct()
    require_none(have.exceptAll(want).unionByName(want.exceptAll(have)), "Week coverage differs from source")
    require_none(lag_violations(panel, features), "Lag contract broken")
    stats = panel_statistics(panel, features).first().asDict()
    off = {k: v for k, v in stats.items() if k.startswith("max_abs") and v > tol}
    if off:
        raise ValueError(f"Neutrality validation failed: {off}")
    return stats


def continuity_violations(panel: DataFrame) -> DataFrame:
    """Weeks that do not follow the previous observed week by seven days, or
    are not Wednesdays."""
    return observed_weeks(panel).filter(
        (F.weekday("week_date") != 2)
        | (F.col("prev_week_date").isNotNull() & (F.datediff("week_date", "prev_week_date") != 7))
    )


def follow_flags(df: DataFrame, features: Sequence[str], by: str) -> DataFrame:
    """For each row, the week of the one before it in its series (`by`) and whether its lags are that one's
    scores, or all missing: what the lag contract reads, whichever weeks turn out to be observed."""
    w = Window.partitionBy(by).orderBy("week_date")
    lags = df.select("*", F.lag("week_date").over(w).alias("__last"), *[F.lag(f).over(w).alias(f"__lag_{f}") for f in features])
    follows, bare = F.lit(True), F.lit(True)
    for f in features:
        follows = follows & close_to(F.col(f"{f}_train"), F.col(f"__lag_{f}"))
        bare = bare & F.col(f"{f}_train").isNull()
    return lags.select(*df.columns, "__last", follows.alias("__follows"), bare.alias("__bare"))


def checked_input(df: DataFrame, features: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """The rows stored once, beside flags that the checks read instead of the rows: a series is looked at while its
    rows are together, by its spelling in the input (`__key`), as a panel leaves them. Only where a ticker is
    spelled otherwise than cleaned do rows meet again, by the cleaned one."""
    # One array: a chain of conditions over all columns is too long to be compiled.
    infinite = F.coalesce(F.array_contains(F.array(*[F.abs(c) for c in numeric]), float("inf")), F.lit(False))
    blank = F.col("ticker").isNull() | (F.col("ticker") == "") | F.col("sector").isNull() | (F.col("sector") == "")
    kept = [c for c in df.columns if c != "__key"]
    flagged = follow_flags(df, features, "__key").withColumns({"__unfit": blank | infinite, "__spelled": ~F.col("__key").cast("string").eqNullSafe(F.col("ticker"))})
    stored = cut_lineage(flagged.drop("__key"))
    require_none(stored.filter("__unfit").select("ticker", "week_date"), "Blank keys or infinite values")
    rows = stored if stored.filter("__spelled").isEmpty() else follow_flags(stored.select(*kept), features, "ticker")
    require_none(rows.filter("__last = week_date").select("ticker", "week_date"), "Duplicate ticker/week observations")
    require_none(continuity_violations(stored), "Expected complete Wednesday snapshots")
    # The first kept week may point before the start; only later weeks are comparable.
    weeks = observed_weeks(stored).filter("prev_week_date is not null").select("week_date", F.col("prev_week_date").alias("__prev"))
    off = rows.join(F.broadcast(weeks), "week_date").filter("not prev_week_date <=> __prev or not if(__last = __prev, __follows, __bare)")
    require_none(off.select("ticker", "week_date"), "Lag contract broken")
    return stored.select(*kept)


def prepare_model_input(panel: DataFrame, features: Sequence[str], start="2017-01-01", check: bool = True) -> DataFrame:
    """Lower-case names, coerce dates, trim to the start, verify contracts."""
    lowered = [c.lower() for c in panel.columns]
    if len(set(lowered)) != len(lowered):
        raise ValueError("Duplicate case-insensitive column names")
    df = panel.toDF(*lowered)
    required = ["ticker", "sector", "week_date", "prev_week_date", *features, *[f"{f}_train" for f in features], TARGET, FORWARD]
    require_columns(df, required)
    numeric = [*features, *[f"{f}_train" for f in features], TARGET, FORWARD]
    # A date stays as it is, so that rows in the order of their weeks are known to be.
    weeks = [F.col(c) if kind == "date" else epoch_or_date(c).alias(c) for c, kind in df.select("week_date", "prev_week_date").dtypes]
    df = df.select(
        F.col("ticker").alias("__key"),
        clean_ticker("ticker").alias("ticker"),
        F.trim(F.col("sector").cast("string")).alias("sector"),
        *weeks,
        *[F.col(c).cast("double").alias(c) for c in numeric],
    ).filter(F.col("week_date") >= F.lit(start).cast("date"))
    return checked_input(df, features, numeric) if check else df.drop("__key")


def panel_summary(panel: DataFrame, directions: Mapping[str, int] = FEATURE_DIRECTIONS) -> DataFrame:
    """Two-level counts, so no distinct set is gathered in one task."""
    per_ticker = panel.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))
    per_week = panel.groupBy("week_date").agg(F.count(F.lit(1)).alias("n"))
    rows = per_ticker.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("tickers"))
    weeks = per_week.agg(F.count(F.lit(1)).alias("weeks"))
    worse = ",".join(sorted(k for k, v in directions.items() if v == -1))
    return rows.crossJoin(weeks).select("rows", "tickers", "weeks", F.lit(worse).alias("lower_is_better"))
