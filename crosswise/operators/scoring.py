"""Membership and score tables (Q1-Q8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checks import duplicate_keys, require_none
from ..functions.columns import close_to, finite
from ..functions.layout import Layout, resolve
from ..functions.ranking import add_group_stats, add_ranks

MODEL_WEEK = ("model", "week_date")


def linear_scores(snapshot: DataFrame, models: DataFrame, features: Sequence[str], model: str) -> DataFrame:
    """Q1: score current features with the model fitted as of the same week.

    `models` holds one row per week: (week_date, intercept, coefficients array).
    Rows with a missing feature keep a missing prediction.
    """
    complete = F.lit(True)
    dot: Column = F.col("intercept")
    for i, f in enumerate(features):
        complete = complete & F.col(f).isNotNull()
        dot = dot + F.col(f) * F.element_at("coefficients", i + 1)
    fitted = models.select("week_date", "intercept", "coefficients")
    return snapshot.join(fitted, "week_date").select(
        F.lit(model).alias("model"), "ticker", "sector", "week_date",
        F.col("week_date").alias("model_as_of"),
        F.when(complete, dot).alias("prediction"),
    )


def assign_quintiles(
    scores: DataFrame,
    *,
    scope: str = "universe",
    highest_first: bool = False,
    layout: Layout | None = None,
    check: bool = False,
) -> DataFrame:
    """Q2: five count-balanced groups by (prediction, ticker).

    Group sizes are floor/ceil of n/5 spread over the order, which ntile does
    not reproduce. Missing predictions stay unassigned; groups with fewer than
    five valid predictions are refused (check=True) or left unassigned.
    """
    if scope not in ("universe", "sector"):
        raise ValueError("scope must be universe or sector")
    keys = [*MODEL_WEEK, *(["sector"] if scope == "sector" else [])]
    layout = resolve(layout, scores, keys)
    clean = scores.withColumn("prediction", finite("prediction"))
    if check:
        require_none(duplicate_keys(scores, [*MODEL_WEEK, "ticker"]), "Duplicate model/date/ticker scores")
        small = clean.groupBy(*keys).agg(F.count("prediction").alias("n")).filter("n > 0 and n < 5")
        require_none(small, "At least five valid predictions are required per quintile group")
    ranked = add_ranks(
        clean, keys, "prediction", tie=["ticker"], descending=highest_first, position="__p", count="__n", layout=layout
    )
    quintile = F.floor((F.col("__p") - 1) * 5 / F.col("__n")).cast("int") + 1
    return ranked.withColumn("quintile", F.when(F.col("__n") >= 5, quintile)).drop("__p", "__n")


def predicted_ranks(scores: DataFrame, layout: Layout | None = None) -> DataFrame:
    """Q3: rank 1 = best (ticker order breaks ties) and average-tie percentile."""
    layout = resolve(layout, scores, MODEL_WEEK)
    best = add_ranks(scores, MODEL_WEEK, "prediction", tie=["ticker"], descending=True,
                     position="predicted_rank", average="__desc", count="__n", layout=layout)
    # The ascending average rank mirrors the descending one, so one sort is enough.
    ascending = F.col("__n") + 1 - F.col("__desc")
    return best.withColumn("predicted_percentile", ascending / F.col("__n")).drop("__desc", "__n")


def selection_flags(scores: DataFrame, fraction: float = 0.2, layout: Layout | None = None) -> DataFrame:
    """Q4: the ceil(fraction * n) best and worst names of each model-week."""
    layout = resolve(layout, scores, MODEL_WEEK)
    ranked = add_ranks(scores, MODEL_WEEK, "prediction", tie=["ticker"], descending=True, position="__p", count="__n", layout=layout)
    k = F.ceil(F.lit(fraction) * F.col("__n"))
    enough = F.col("__n") >= 2
    return ranked.withColumns(
        {
            "long_selected": F.coalesce(enough & (F.col("__p") <= k), F.lit(False)),
            "short_selected": F.coalesce(enough & (F.col("__p") > F.col("__n") - k), F.lit(False)),
        }
    ).drop("__p", "__n")


def ground_truth_ranks(members: DataFrame, target: str = "active_return_fwd", layout: Layout | None = None) -> DataFrame:
    """Q5: descending average rank of the outcome; missing for a whole
    model-week when any outcome is missing."""
    layout = resolve(layout, members, MODEL_WEEK)
    ranked = add_ranks(members, MODEL_WEEK, target, tie=["ticker"], descending=True, average="__r", layout=layout)
    whole = add_group_stats(ranked, MODEL_WEEK, {"ground_truth_complete_week": f"every({target} is not null) @"}, layout)
    return whole.withColumn("ground_truth_rank", F.when(F.col("ground_truth_complete_week"), F.col("__r"))).drop("__r")


def score_audit(audits: DataFrame, models: DataFrame) -> DataFrame:
    """Q6: per (model, as_of) the training window's bounds, size and content signature.
    `audits` comes from windows.window_audit, `models` lists (model, as_of)."""
    return models.select("model", "as_of").distinct().join(audits, "as_of").select(
        "model", "as_of", "first_training_week", "last_training_week", "training_rows", "signature"
    )


def universe_differences(scores: DataFrame, panel: DataFrame) -> DataFrame:
    """Q7: tickers scored but absent from the panel week, and the reverse."""
    scored = scores.select("model", "week_date", "ticker").distinct().withColumn("__scored", F.lit(True))
    models = scored.select("model", "week_date").distinct()
    expected = panel.select("week_date", "ticker").join(models, "week_date").withColumn("__expected", F.lit(True))
    both = scored.join(expected, ["model", "week_date", "ticker"], "full_outer")
    side = F.when(F.col("__scored").isNull(), "not_scored").when(F.col("__expected").isNull(), "not_in_panel")
    return both.select("model", "week_date", "ticker", side.alias("problem")).filter("problem is not null")


def replay_differences(a: DataFrame, b: DataFrame, value: str = "prediction", atol: float = 1e-11, rtol: float = 1e-10) -> DataFrame:
    """Q8: keys whose two scores differ beyond the tolerance, or exist once."""
    keys = ["model", "week_date", "ticker"]
    left = a.select(*keys, F.col(value).alias("first"), F.lit(True).alias("__l"))
    right = b.select(*keys, F.col(value).alias("second"), F.lit(True).alias("__r"))
    both = left.join(right, keys, "full_outer")
    same = F.col("__l").isNotNull() & F.col("__r").isNotNull() & close_to(F.col("first"), F.col("second"), rtol, atol)
    return both.filter(~same).select(*keys, "first", "second")
