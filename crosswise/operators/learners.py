"""Rolling learners."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .panel import TARGET
from .windows import WINDOW_WEEKS, complete_rows, window_weeks


def gram_columns(features: Sequence[str], target: str) -> dict[str, Column]:
    """Sufficient statistics of least squares: sums of x_i, x_i x_j, x_i y, y, y^2."""
    xs = [f"{f}_train" for f in features]
    out = {"n": F.count(F.lit(1)), "y": F.sum(target), "yy": F.sum(F.col(target) * F.col(target))}
    for i, a in enumerate(xs):
        out[f"x{i}"] = F.sum(a)
        out[f"x{i}_y"] = F.sum(F.col(a) * F.col(target))
        for j in range(i, len(xs)):
            out[f"x{i}_x{j}"] = F.sum(F.col(a) * F.col(xs[j]))
    return out


def weekly_gram(panel: DataFrame, features: Sequence[str], target: str = TARGET, data_start="2017-01-01") -> DataFrame:
    """One row of sums per week, combined map-side: the panel is read once and
    shuffles (number of weeks) rows, whatever its size or skew."""
    rows = complete_rows(panel, features, data_start)
    return rows.groupBy("week_date").agg(*[e.alias(k) for k, e in gram_columns(features, target).items()])


def rolling_least_squares(
    panel: DataFrame, features: Sequence[str], *, target: str = TARGET, n_weeks: int = WINDOW_WEEKS, min_rows: int = 1,
    data_start="2017-01-01",
) -> DataFrame:
    """Intercept and coefficients for every as-of date with a full window.

    Rows are never multiplied by the window: the 260-week sums are a sliding
    frame over the per-week sums (one row per week), and each small system is
    solved in an Arrow batch.
    """
    gram = weekly_gram(panel, features, target, data_start)
    names = list(gram_columns(features, target))
    w = Window.orderBy("week_date").rowsBetween(-(n_weeks - 1), 0)
    summed = gram.select(
        F.col("week_date").alias("as_of"),
        F.count(F.lit(1)).over(w).alias("held"),
        F.min("week_date").over(w).alias("first_training_week"),
        F.min("n").over(w).alias("smallest"),
        *[F.sum(c).over(w).alias(c) for c in names],
    ).filter(
        (F.col("held") == n_weeks)
        & (F.datediff("as_of", "first_training_week") == 7 * (n_weeks - 1))
        & (F.col("smallest") >= min_rows)
    )
    return solve_systems(summed, len(features), ["as_of", "first_training_week"])


def solve_systems(sums: DataFrame, m: int, keep: Sequence[str]) -> DataFrame:
    """Solve the normal equations of each row (minimum-norm when singular)."""

    def solve(rows: pd.DataFrame) -> pd.Series:
        k = len(rows)
        a, b = np.empty((k, m + 1, m + 1)), np.empty((k, m + 1))
        a[:, 0, 0], b[:, 0] = rows["n"], rows["y"]
        for i in range(m):
            a[:, 0, i + 1] = a[:, i + 1, 0] = rows[f"x{i}"]
            b[:, i + 1] = rows[f"x{i}_y"]
            for j in range(i, m):
                a[:, i + 1, j + 1] = a[:, j + 1, i + 1] = rows[f"x{i}_x{j}"]
        fitted = np.einsum("kij,kj->ki", np.linalg.pinv(a, hermitian=True), b)
        return pd.Series(list(fitted))

    solver = F.pandas_udf(solve, "array<double>")
    names = ["n", "y", *[f"x{i}" for i in range(m)], *[f"x{i}_y" for i in range(m)],
             *[f"x{i}_x{j}" for i in range(m) for j in range(i, m)]]
    packed = F.struct(*[F.col(c).cast("double").alias(c) for c in names])
    return sums.select(*keep, F.col("n").alias("training_rows"), solver(packed).alias("__beta")).select(
        *keep, "training_rows",
        F.element_at("__beta", 1).alias("intercept"),
        F.slice("__beta", 2, m).alias("coefficients"),
    )


def fold_baseline_mse(panel: DataFrame, folds: DataFrame, features: Sequence[str], *, target: str = TARGET, data_start="2017-01-01") -> DataFrame:
    """W7's cross-validation: mse of the linear fit on each fold's validation
    weeks, from weekly sums alone. folds: (as_of, fold, week_date, role)."""
    m = len(features)
    names = list(gram_columns(features, target))
    gram = weekly_gram(panel, features, target, data_start)
    sums = folds.join(gram, "week_date").groupBy("as_of", "fold", "role").agg(*[F.sum(c).alias(c) for c in names])
    fitted = solve_systems(sums.filter("role = 'train'"), m, ["as_of", "fold"])
    held = sums.filter("role = 'validation'").join(
        fitted.select("as_of", "fold", "intercept", "coefficients"), ["as_of", "fold"]
    )
    c = [F.element_at("coefficients", i + 1) for i in range(m)]
    b0 = F.col("intercept")
    # sum (y - b0 - c.x)^2 expanded over the sufficient statistics
    sse = F.col("yy") - 2 * b0 * F.col("y") + b0 * b0 * F.col("n")
    for i in range(m):
        sse = sse - 2 * c[i] * F.col(f"x{i}_y") + 2 * b0 * c[i] * F.col(f"x{i}")
        for j in range(i, m):
            sse = sse + (1 if i == j else 2) * c[i] * c[j] * F.col(f"x{i}_x{j}")
    return held.select("as_of", "fold", F.col("n").alias("validation_rows"), (sse / F.col("n")).alias("linear_mse"))


def feature_effects(models: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row per as-of date and feature."""
    names = F.array(*[F.lit(f) for f in features])
    pairs = F.arrays_zip(names.alias("feature"), F.col("coefficients").alias("linear_coefficient"))
    return models.select("as_of", F.inline(pairs).alias("feature", "linear_coefficient"))


# --- W8: one boosted tree regression on MLlib (many dated fits: boosting.py) ----------------------------------------------


def tree_parameters(params: Mapping) -> dict:
    """Grid parameters that MLlib has. L2 and hessian-weighted child weight have
    no counterpart; the child weight becomes a minimum number of rows."""
    return {
        "maxDepth": int(params["max_depth"]),
        "stepSize": float(params["learning_rate"]),
        "maxIter": int(params["n_estimators"]),
        "subsamplingRate": float(params.get("subsample", 1.0)),
        "featureSubsetStrategy": str(params.get("colsample_bytree", "all")),
        "minInstancesPerNode": int(params.get("min_child_weight", 1)),
    }


def assemble(rows: DataFrame, inputs: Sequence[str], target: str | None, keep: Sequence[str]) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    vector = array_to_vector(F.array(*[F.col(c).cast("double") for c in inputs])).alias("features")
    return rows.select(*keep, *([F.col(target).alias("label")] if target else []), vector)


def fit_trees(window: DataFrame, features: Sequence[str], params: Mapping, seed: int, *, target: str = TARGET, validation: str | None = None):
    """Fit one boosted-tree regression; `validation` names a boolean column
    that stops boosting early."""
    from pyspark.ml.regression import GBTRegressor

    keep = [validation] if validation else []
    data = assemble(window, [f"{f}_train" for f in features], target, keep)
    learner = GBTRegressor(featuresCol="features", labelCol="label", seed=seed, validationTol=0.0, **tree_parameters(params))
    if validation:
        # MLlib stops at the first rise of the loss; at its own tolerance of 1 % slow rates would stop at once.
        learner = learner.setValidationIndicatorCol(validation)
    return learner.fit(data)


def score_trees(model, snapshot: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Q1 for trees: rows with a missing feature keep a missing prediction."""
    full = snapshot.dropna(subset=list(features))
    scored = model.transform(assemble(full, features, None, keep)).select(*keep, "prediction")
    return snapshot.select(*keep).join(scored, list(keep), "left")


def tree_importance(spark, model, as_of, features: Sequence[str]) -> DataFrame:
    values = [float(v) for v in model.featureImportances.toArray()]
    return spark.createDataFrame([(as_of, f, v) for f, v in zip(features, values)], "as_of date, feature string, importance double")
