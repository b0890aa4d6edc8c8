"""Boosted regression trees on histograms for many dated fits at once.

The fits of an as-of date share its window, so one group of rows holds them all: grid points
times folds in the search, seeds in the refit. Trees grow level by level on gradient sums per
(fit, node, feature, bin), with L2, a least hessian weight per child (a row's hessian is 1),
row and column sampling, and patience on the validation loss. Windows are dealt over tasks by
as-of date and bounded by `window_rows`: a longer window is thinned by whole tickers (a hash
of the name, alike for every date), so that books stay comparable from week to week.

Fitted trees leave as rows of a table; scoring is a join on the date and a JVM expression
that walks them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.layout import Layout
from ..sources.storage import cut_lineage
from .panel import TARGET
from .portfolio import SELECTION_BPS, cost_scenarios, long_short_weekly
from .windows import ENSEMBLE_SEEDS, choose_candidate, complete_rows, seed_ensemble

BINS = 64
#: Labelled rows of a window, about: the bound on what one fit learns from.
WINDOW_ROWS = 4096
_SCALE = 1_000_000


def cut_points(values: np.ndarray) -> np.ndarray:
    """At most BINS - 1 distinct quantiles: a value belongs to the bin of the first cut not below it."""
    return np.unique(np.quantile(values, np.arange(1, BINS) / BINS, method="lower"))


def boost(bins: np.ndarray, y: np.ndarray, train: np.ndarray, points: Sequence[Mapping], seeds: Sequence[int], held: np.ndarray | None = None):
    """Fit one model per row of `train` (fits x rows, boolean), with one point and seed each.

    bins: features x rows. With `held` (fits x rows), a fit ends when its validation loss has not
    improved for min(30, n_estimators / 3) trees, and what it predicts is that of its best
    number of trees. Returns the numbers of trees, the predictions of all rows, and per fit
    (base, [(features, cuts, leaves)]) with nodes in heap order; rows of a bin above the
    cut go right, and a node that does not split sends all rows left."""
    fits, n = train.shape
    rate, depth, child, l2, rows_share, columns_share, rounds = (
        np.array([float(p[c]) for p in points]) for c in ("learning_rate", "max_depth", "min_child_weight", "reg_lambda", "subsample", "colsample_bytree", "n_estimators"))
    depth, rounds = depth.astype(int), rounds.astype(int)
    patience = np.minimum(30, np.maximum(2, rounds // 3))
    base = (train * y).sum(axis=1) / np.maximum(train.sum(axis=1), 1)
    now = np.repeat(base[:, None], n, axis=1)
    best, least, n_trees = now.copy(), np.full(fits, np.inf), np.zeros(fits, int)
    trees: list[list[tuple]] = [[] for _ in range(fits)]
    live = np.arange(fits)
    draws = {s: np.random.default_rng(s) for s in dict.fromkeys(seeds)}
    every = np.arange(n)
    for t in range(int(rounds.max(initial=0))):
        live = live[t < rounds[live]]
        if held is not None:
            live = live[t - n_trees[live] < patience[live]]
        if not len(live):
            break
        chance = {s: (g.random(n), g.permutation(len(bins))) for s, g in draws.items()}
        u = np.stack([chance[seeds[i]][0] for i in live])
        w = (train[live] & (u < rows_share[live, None])).astype(float)
        g = (now[live] - y) * w
        size, levels = len(live), int(depth[live].max())
        allowed = np.stack([np.isin(np.arange(len(bins)), chance[seeds[i]][1][: max(1, round(columns_share[i] * len(bins)))]) for i in live])
        own, node = np.arange(size)[:, None], np.zeros((size, n), int)
        feature, cut = np.zeros((size, 2**levels - 1), int), np.full((size, 2**levels - 1), BINS)
        for level in range(levels):
            k = 2**level
            gain, f_at, c_at = np.full((size, k), 1e-12), np.zeros((size, k), int), np.full((size, k), BINS)
            for j in np.flatnonzero(allowed.any(axis=0)):
                key = ((own * k + node) * BINS + bins[j]).ravel()
                left, heavy = (np.bincount(key, x.ravel(), size * k * BINS).reshape(size, k, BINS).cumsum(axis=2) for x in (g, w))
                whole, mass, lam = left[..., -1:], heavy[..., -1:], l2[live][:, None, None]
                won = left**2 / (heavy + lam) + (whole - left) ** 2 / (mass - heavy + lam) - whole**2 / (mass + lam)
                least_child = child[live][:, None, None]
                won[(heavy < least_child) | (mass - heavy < least_child)] = -np.inf
                won[~allowed[:, j] | (depth[live] <= level)] = -np.inf
                at = won.argmax(axis=2)
                top = np.take_along_axis(won, at[..., None], axis=2)[..., 0]
                better = top > gain
                gain, f_at, c_at = np.where(better, top, gain), np.where(better, j, f_at), np.where(better, at, c_at)
            feature[:, k - 1 : 2 * k - 1], cut[:, k - 1 : 2 * k - 1] = f_at, c_at
            node = 2 * node + (bins[f_at[own, node], every] > c_at[own, node])
        slot = (own * 2**levels + node).ravel()
        sums, mass = (np.bincount(slot, x.ravel(), size * 2**levels).reshape(size, -1) for x in (g, w))
        leaves = -rate[live][:, None] * sums / (mass + l2[live][:, None])
        now[live] += leaves[own, node]
        for i, fit in enumerate(live):
            trees[fit].append((feature[i], cut[i], leaves[i]))
        if held is None:
            n_trees[live] = t + 1
        else:
            loss = (held[live] * (now[live] - y) ** 2).sum(axis=1) / np.maximum(held[live].sum(axis=1), 1)
            good = live[loss < least[live]]
            least[good], n_trees[good], best[good] = loss[loss < least[live]], t + 1, now[good]
    return n_trees, best if held is not None else now, [(b, x[:k]) for b, x, k in zip(base, trees, n_trees)]


def _binned(rows: pd.DataFrame, inputs: Sequence[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    cuts = [cut_points(rows[c].to_numpy()) for c in inputs]
    return np.stack([np.searchsorted(c, rows[x].to_numpy()) for c, x in zip(cuts, inputs)]), cuts


SEARCHED = "as_of date, position int, fold int, n_trees int, ticker string, week_date date, raw_active_return double, label double, score double"
TREES = "as_of date, seed int, tree int, base double, depth int, features array<int>, cuts array<double>, leaves array<double>"


def search_fits(windows: DataFrame, inputs: Sequence[str], points: Sequence[Mapping], n_folds: int, seed: int) -> DataFrame:
    """Validation predictions of every point on every fold of every date (SEARCHED)."""
    inputs, points = list(inputs), [dict(p) for p in points]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["week_date", "ticker"], ignore_index=True)
        bins, _ = _binned(rows, inputs)
        train, held = (np.stack([rows[c].map(lambda x, f=f: f in x).to_numpy(bool) for f in range(1, n_folds + 1)]) for c in ("train_folds", "held_folds"))
        fits = [(p, f) for p in range(len(points)) for f in range(n_folds) if train[f].any() and held[f].any()]
        at = [f for _, f in fits]
        n_trees, predicted, _ = boost(bins, rows.label.to_numpy(), train[at], [points[p] for p, _ in fits], [seed] * len(fits), held[at])
        out = []
        for i, (p, f) in enumerate(fits):
            part = rows.loc[held[f], ["as_of", "ticker", "week_date", "raw_active_return", "label"]]
            out.append(part.assign(position=p, fold=f + 1, n_trees=n_trees[i], score=predicted[i][held[f]]))
        names = [c.split()[0] for c in SEARCHED.split(", ")]
        return pd.concat(out)[names] if out else pd.DataFrame(columns=names)

    return windows.groupBy("as_of").applyInPandas(run, SEARCHED)


def refit(windows: DataFrame, inputs: Sequence[str], points: Sequence[Mapping], seeds: Sequence[int]) -> DataFrame:
    """Trees (TREES) of each date's chosen point, fitted on the whole window for every seed.
    `windows` carries the chosen position and number of trees."""
    inputs, points, seeds = list(inputs), [dict(p) for p in points], list(seeds)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["week_date", "ticker"], ignore_index=True)
        bins, cuts = _binned(rows, inputs)
        point = points[int(rows.position[0])] | {"n_estimators": int(rows.n_trees[0])}
        _, _, models = boost(bins, rows.label.to_numpy(), np.ones((len(seeds), len(rows)), bool), [point] * len(seeds), seeds)
        out = []
        for seed, (base, trees) in zip(seeds, models):
            for i, (feature, cut, leaves) in enumerate(trees):
                edges = [float(cuts[f][c]) if c < len(cuts[f]) else float("inf") for f, c in zip(feature, cut)]
                out.append((rows.as_of[0], seed, i, float(base), int(point["max_depth"]), feature.tolist(), edges, leaves.tolist()))
        return pd.DataFrame(out, columns=[c.split()[0] for c in TREES.split(", ")])

    return windows.groupBy("as_of").applyInPandas(run, TREES)


def score_tree_table(snapshot: DataFrame, trees: DataFrame, features: Sequence[str]) -> DataFrame:
    """Q1 for trees kept as rows: (seed, ticker, week_date, prediction) of the complete rows of a snapshot,
    each under the models dated at its week."""
    models = trees.groupBy("as_of", "seed").agg(F.first("base").alias("base"), F.collect_list(F.struct("depth", "features", "cuts", "leaves")).alias("trees"))
    full = snapshot.dropna(subset=list(features)).select("ticker", "week_date", F.array(*[F.col(f).cast("double") for f in features]).alias("x"))
    walk = "aggregate(sequence(1, t.depth), 0, (i, _) -> 2 * i + 1 + if(x[t.features[i]] > t.cuts[i], 1, 0))"
    total = f"base + aggregate(trees, 0D, (s, t) -> s + t.leaves[{walk} - size(t.features)])"
    return full.join(models, full.week_date == models.as_of).select("seed", "ticker", "week_date", F.expr(total).alias("prediction"))


def tree_splits(trees: DataFrame, features: Sequence[str]) -> DataFrame:
    """How often each feature splits a node, per date, as a share of all splits."""
    used = trees.select("as_of", F.explode(F.arrays_zip("features", "cuts")).alias("s")).filter("s.cuts < double('infinity')")
    names = F.array(*[F.lit(f) for f in features])
    counted = used.groupBy("as_of", names[F.col("s.features")].alias("feature")).agg(F.count(F.lit(1)).alias("splits"))
    total = counted.groupBy("as_of").agg(F.sum("splits").alias("all_splits"))
    return counted.join(total, "as_of").select("as_of", "feature", "splits", (F.col("splits") / F.col("all_splits")).alias("importance"))


def bounded_windows(rows: DataFrame, folds: DataFrame, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Training rows of every as-of date with the folds they train and validate, thinned by ticker to
    about `window_rows` rows a date."""
    def at(role):
        return F.collect_list(F.when(F.col("role") == role, F.col("fold")))

    weeks = folds.groupBy("as_of", "week_date").agg(at("train").alias("train_folds"), at("validation").alias("held_folds"))
    counts = rows.groupBy("week_date").agg(F.count(F.lit(1)).alias("n"))
    sizes = weeks.join(counts, "week_date").groupBy("as_of").agg(F.sum("n").alias("n"))
    bound = sizes.select("as_of", F.least(F.lit(1.0), F.lit(window_rows) / F.col("n")).alias("share"))
    dated = weeks.join(bound, "as_of")
    widest = bound.agg(F.max("share").alias("widest"))
    place = F.pmod(F.xxhash64("ticker"), F.lit(_SCALE)) / F.lit(float(_SCALE))
    # Rows that no date keeps go before the others are multiplied by the windows.
    kept = rows.withColumn("place", place).crossJoin(F.broadcast(widest)).filter("place < widest").drop("widest")
    return kept.join(dated, "week_date").filter("place < share").drop("place", "share")


def rolling_trees(
    panel: DataFrame, outcomes: DataFrame, folds: DataFrame, features: Sequence[str], points: Sequence[Mapping], *,
    layout: Layout, data_start="2017-01-01", seeds: Sequence[int] = ENSEMBLE_SEEDS, window_rows: int = WINDOW_ROWS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """W8 for every as-of date of folds (as_of, fold, week_date, role): every grid point on every fold with
    early stop, the choice by net validation results, and a refit of the winner at its median
    number of trees for every seed.

    Returns the candidates (as_of, position, params, iterations per fold, cv_mse, zero_mse, results,
    selected), the scores (one row per snapshot row, the ensemble of the seeds, missing where
    a feature is missing) and the fitted trees as rows."""
    spark, inputs = panel.sparkSession, [f"{f}_train" for f in features]
    labelled = complete_rows(panel, features, data_start).join(outcomes.select("ticker", "week_date", "raw_active_return"), ["ticker", "week_date"], "left")
    rows = cut_lineage(labelled.select(F.col("ticker").cast("string").alias("ticker"), "week_date", "raw_active_return", F.col(TARGET).alias("label"), *inputs))
    folds = cut_lineage(folds)
    n_folds = folds.agg(F.max("fold")).first()[0]
    if n_folds is None:
        raise ValueError("No as-of date has a full window")
    windows = cut_lineage(bounded_windows(rows, folds, window_rows))
    stitched = cut_lineage(search_fits(windows, inputs, points, n_folds, seeds[0]))
    per_fold = stitched.groupBy("as_of", "position", "fold", "n_trees").agg(F.avg((F.col("label") - F.col("score")) ** 2).alias("mse"), F.avg(F.col("label") ** 2).alias("zero"))
    per_point = per_fold.groupBy("as_of", "position").agg(
        F.sort_array(F.collect_list(F.struct("fold", "n_trees"))).getField("n_trees").alias("iterations"),
        F.expr("cast(median(n_trees) as int)").alias("n_trees"), F.avg("mse").alias("cv_mse"), F.avg("zero").alias("zero_mse"))
    weekly = long_short_weekly(stitched, ["as_of", "position"], layout=layout).filter("gross_return is not null")
    net = cost_scenarios(weekly, ["as_of", "position"], [SELECTION_BPS]).select("as_of", "position", "information_ratio", "cumulative_return")
    listed = spark.createDataFrame(
        [(i, {k: str(v) for k, v in p.items()}, [float(p["max_depth"]), -float(p["min_child_weight"]), -float(p["reg_lambda"])]) for i, p in enumerate(points)],
        "position int, params map<string,string>, simple array<double>")
    searched = cut_lineage(per_point.join(F.broadcast(listed), "position").join(net, ["as_of", "position"], "left"))
    entry = searched.select("as_of", "position", F.col("position").alias("candidate"), "information_ratio", "cumulative_return",
                            F.concat("simple", F.array(F.col("n_trees").cast("double"))).alias("complexity"))
    won = choose_candidate(entry, ["as_of"]).select("as_of", F.col("candidate").alias("position"))
    chosen = cut_lineage(searched.join(won, ["as_of", "position"]).select("as_of", "position", F.greatest("n_trees", F.lit(1)).alias("n_trees")))
    trees = cut_lineage(refit(windows.join(F.broadcast(chosen), "as_of"), inputs, points, seeds))
    snapshot = panel.join(F.broadcast(chosen.select(F.col("as_of").alias("week_date"))), "week_date", "left_semi")
    ensemble = seed_ensemble(score_tree_table(snapshot, trees, features), layout=layout)
    scores = snapshot.select("ticker", "sector", "week_date").join(ensemble, ["ticker", "week_date"], "left")
    told = chosen.select(F.col("as_of").alias("week_date"), F.col("position").alias("candidate"), "n_trees")
    scores = scores.join(F.broadcast(told), "week_date").withColumn("n_seeds", F.lit(len(seeds)))
    selected = searched.join(chosen.select("as_of", F.col("position").alias("won")), "as_of").withColumn("selected", F.col("position") == F.col("won"))
    return selected.drop("simple", "won"), scores, trees
