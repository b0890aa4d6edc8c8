"""Staged search: every branch against hand-made results, and the path learner against brute force."""

import math

import numpy as np
import pandas as pd
import pytest
from helpers import pdf, week
from pyspark.sql import functions as F

from crosswise.functions.layout import Layout
from crosswise.operators import search

REFINEMENT = {"learning_rate": "0.03", "n_estimators": "1000"}
# group, candidate of stage 1, its truncation, net ratio by truncation, iterations of 100 by truncation.
CASES = [
    # The runner-up wins once both are tested under truncation 8; it ends early: no refinement.
    ("runner-up", "a", "5", {"5": 1.0, "8": 0.9}, 40), ("runner-up", "b", "5", {"5": 0.8, "8": 1.5}, 40), ("runner-up", "c", "5", {"5": 0.2, "8": 9.0}, 40),
    # The winner uses 90 % of its trees: refined, and better for it (2.0).
    ("refined", "a", "5", {"5": 1.0, "8": 0.5}, 90), ("refined", "b", "5", {"5": 0.3, "8": 0.2}, 10),
    # Just below 90 %; the first finalist has truncation 8 already and is not tested again.
    ("skipped", "a", "8", {"8": 1.0}, 89), ("skipped", "b", "5", {"5": 0.3, "8": 0.2}, 10),
    ("alone", "a", "5", {"5": 1.0, "8": 1.01}, 10),
]


def injected(table):
    """Results from CASES: the ratio of the candidate a row stems from, 2.0 with 1000 trees."""
    spark = table.sparkSession
    known = spark.createDataFrame([(g, origin, t, ir, n) for g, origin, _, by, n in CASES for t, ir in by.items()],
                                  "g string, origin string, truncation string, information_ratio double, n int")
    rows = table.withColumns({"origin": F.col("params")["origin"], "truncation": F.col("params")["truncation"]}).join(known, ["g", "origin", "truncation"])
    slow = F.col("params")["n_estimators"] == "1000"
    return rows.select("g", "candidate", F.when(slow, 2.0).otherwise(F.col("information_ratio")).alias("information_ratio"), F.lit(0.1).alias("cumulative_return"),
                       F.array(F.col("truncation").cast("double")).alias("complexity"), F.col("n").cast("double").alias("median_iterations"), F.col("n").alias("max_iterations"))


@pytest.fixture(scope="module")
def searched(spark):
    rows = [(g, i, c, {"origin": c, "truncation": t, "learning_rate": "0.05", "n_estimators": "100"}) for i, (g, c, t, _, _) in enumerate(CASES)]
    table = spark.createDataFrame(rows, "g string, position int, candidate string, params map<string,string>")
    return pdf(search.staged_search(table, injected, ["g"], truncation="8", refinement=REFINEMENT), "g", "position")


def names(searched, g, column="candidate"):
    return searched[searched.g == g][column].tolist()


def test_runner_up_can_win_the_second_stage(searched):
    assert names(searched, "runner-up") == ["a", "b", "c", "finalist 1", "finalist 2"]
    won = searched[(searched.g == "runner-up") & searched.selected]
    assert won.candidate.tolist() == ["finalist 2"] and won.params.iloc[0]["origin"] == "b" and won.params.iloc[0]["truncation"] == "8"
    assert not any(names(searched, "runner-up", "refined"))


def test_refinement_needs_nine_tenths_of_the_ceiling(searched):
    won = searched[(searched.g == "refined") & searched.selected].iloc[0]
    assert (won.candidate, won.stage, won.information_ratio) == ("refined", 3, 2.0)
    assert won.params["learning_rate"] == "0.03" and won.params["n_estimators"] == "1000" and won.params["truncation"] == "5"
    assert all(names(searched, "refined", "refined")) and not any(names(searched, "skipped", "refined"))


def test_finalists_are_not_tested_twice_alike(searched):
    assert names(searched, "skipped") == ["a", "b", "finalist 2"]
    assert names(searched, "alone") == ["a", "finalist 1"]
    # Within the tolerance of 0.05 the simpler one, of the smaller truncation, stays.
    assert names(searched, "alone", "selected") == [True, False]
    assert searched.groupby("g").selected.sum().eq(1).all()


def test_empty_table_gives_no_rows(spark):
    none = spark.createDataFrame([], "g string, position int, candidate string, params map<string,string>")
    assert search.staged_search(none, injected, ["g"], truncation="8", refinement=REFINEMENT).count() == 0


def test_path_stops_where_the_truncated_spread_is_largest(spark):
    rng = np.random.default_rng(3)
    data = [("x", 1 + w // 5, f"T{i:02d}", week(w), rng.normal(), rng.normal(), rng.normal() / 50) for w in range(10) for i in range(11)]
    frame = pd.DataFrame(data, columns=["g", "fold", "ticker", "week_date", "base", "added", "raw_active_return"])
    rate, k, steps = 0.15, 3, 6
    table = spark.createDataFrame([("x", "c", {"learning_rate": str(rate), "truncation": str(k), "n_estimators": str(steps)})], "g string, candidate string, params map<string,string>")
    rows = spark.createDataFrame(data, "g string, fold int, ticker string, week_date date, base double, added double, raw_active_return double")
    got = search.blend_path_results(rows, table, ["g"], Layout(1)).collect()[0]
    stops = []
    for _, part in frame.groupby("fold"):
        spreads = []
        for t in range(1, steps + 1):
            score = part.base * (1 - t * rate) + part.added * t * rate
            by_week = [w.assign(score=score[w.index]).sort_values("score", ascending=False).raw_active_return.to_numpy() for _, w in part.groupby("week_date")]
            spreads.append(np.mean([x[:k].mean() - x[-k:].mean() for x in by_week]))
        stops.append(1 + int(np.argmax(spreads)))
    assert got.median_iterations == np.median(stops) and got.max_iterations == max(stops)
    net, before = [], None
    for (fold, _), w in frame.groupby(["fold", "week_date"]):
        t = stops[fold - 1]
        ordered = w.assign(score=w.base * (1 - t * rate) + w.added * t * rate).sort_values("score", ascending=False)
        n = len(ordered)
        longs, shorts = ordered.iloc[: math.ceil(n / 5)], ordered.iloc[n - n // 5 :]
        book = {x: 1 / len(longs) for x in longs.ticker} | {x: -1 / len(shorts) for x in shorts.ticker}
        traded = 1.0 if before is None else sum(abs(book.get(x, 0) - before.get(x, 0)) for x in book.keys() | before.keys()) / 2
        net.append(longs.raw_active_return.mean() - shorts.raw_active_return.mean() - 0.002 * traded)
        before = book
    assert math.isclose(got.information_ratio, math.sqrt(52) * np.mean(net) / np.std(net, ddof=1), rel_tol=1e-9)


def test_paths_are_exchanged_as_edges_whatever_the_batches(spark):
    rng = np.random.default_rng(5)
    data = [("x", 1, f"T{i:03d}", week(w), float(rng.integers(-2, 3)), float(rng.integers(-2, 3)), rng.normal() / 50) for w in range(3) for i in range(60)]
    rows = spark.createDataFrame(data, "g string, fold int, ticker string, week_date date, base double, added double, raw_active_return double").coalesce(1)
    points = [("x", "c", 0.1, 2, 7)]
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    assert search.path_edges(rows, points, "raw_active_return").count() == 3 * 7 * 4
    table = spark.createDataFrame([("x", "c", {"learning_rate": "0.1", "truncation": "2", "n_estimators": "7"})], "g string, candidate string, params map<string,string>")
    whole = search.blend_path_results(rows, table, ["g"], Layout(60)).collect()
    kept = spark.conf.get(size)
    try:
        spark.conf.set(size, 7)
        found = pdf(search.path_edges(rows.sortWithinPartitions("g", "week_date", "fold", "ticker"), points, "raw_active_return"))
        assert search.blend_path_results(rows, table, ["g"], Layout(60)).collect() == whole
    finally:
        spark.conf.set(size, kept)
    frame = pd.DataFrame(data, columns=["g", "fold", "ticker", "week_date", "base", "added", "raw_active_return"])
    for (t, day), part in found.groupby(["t", "week_date"]):
        every = frame[frame.week_date == day].copy()
        every["score"] = every.base * (1 - t * 0.1) + every.added * (t * 0.1)
        order = ["score", "ticker"]
        assert part.n.sum() == 60
        got, want = (x.sort_values(order, ascending=[False, True]).ticker.tolist() for x in (part, every))
        assert got[:2] == want[:2] and got[-2:] == want[-2:]
