import datetime as dt
import hashlib

import numpy as np
import pandas as pd
import pytest
from helpers import pdf, week

from crosswise.functions.layout import Layout
from crosswise.operators import gate as gt
from crosswise.operators import boosting as bst
from crosswise.operators import learners as ln
from crosswise.operators import panel as pan
from crosswise.operators import scoring as sc
from crosswise.operators import windows as win

START = dt.date(2017, 1, 4)
SMALL = Layout(20)


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(17)
    rows = [(f"T{i}", f"S{i % 2}", week(w, START), rng.normal(), rng.normal()) for w in range(14) for i in range(8)]
    df = spark.createDataFrame(rows, "ticker string, sector string, week_date date, return_1w double, volatility_20d double")
    built = pan.build_panel(df, directions={"return_1w": 1, "volatility_20d": -1}, layout=SMALL)
    path = f"{spark.conf.get('spark.checkpoint.dir')}/panel"
    built.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


FEATURES = ["return_1w", "volatility_20d"]


def test_window_is_exact_and_ignores_the_future(panel):
    content = win.weekly_content(win.complete_rows(panel, FEATURES, "2017-01-01"))
    spans = {r["as_of"]: r for r in win.window_audit(win.window_weeks(panel, FEATURES, n_weeks=10), content).collect()}
    assert sorted(spans) == [week(w, START) for w in range(10, 14)]
    for as_of, r in spans.items():
        assert r["last_training_week"] == as_of and (as_of - r["first_training_week"]).days == 63 and r["training_rows"] == 80 and r["weeks"] == 10
    counted = win.rolling_window(panel, FEATURES, n_weeks=10).groupBy("as_of").count().collect()
    assert {r["as_of"]: r["count"] for r in counted} == {k: r["training_rows"] for k, r in spans.items()}
    moved = panel.withColumn("active_return_fwd", pan.F.lit(99.0))
    one = pdf(win.rolling_window(panel, FEATURES, n_weeks=10, as_of=week(12, START)).drop("active_return_fwd"), "week_date", "ticker")
    two = pdf(win.rolling_window(moved, FEATURES, n_weeks=10, as_of=week(12, START)).drop("active_return_fwd"), "week_date", "ticker")
    pd.testing.assert_frame_equal(one, two)
    assert len(one) == 80
    assert win.rolling_window(panel.filter(panel.week_date != week(5, START)), FEATURES, n_weeks=10, as_of=week(12, START)).count() == 0


def test_folds_keep_weeks_whole_with_a_gap(spark):
    weeks = spark.createDataFrame([(week(w, START),) for w in range(260) for _ in range(2)], "week_date date")
    bounds = pdf(win.fold_bounds(win.week_folds(weeks)), "fold")
    assert (bounds.validation_weeks == 52).all() and bounds.train_weeks.tolist() == [51, 103, 155, 207]
    assert all((b - a).days == 14 for a, b in zip(bounds.train_end, bounds.validation_start))
    known = weeks.select("week_date", pan.F.date_sub("week_date", 7).alias("prev_week_date"))
    assert win.label_leaks(win.week_folds(weeks), known).count() == 0
    assert win.label_leaks(win.week_folds(weeks, gap=0), weeks.select("week_date", pan.F.date_sub("week_date", 14).alias("prev_week_date"))).count() == 4


def test_least_squares_matches_numpy_and_fold_errors(panel):
    fits = {r["as_of"]: r for r in ln.rolling_least_squares(panel, FEATURES, n_weeks=10).collect()}
    frame = pdf(panel, "week_date", "ticker")
    for as_of, r in fits.items():
        part = frame[(frame.week_date <= as_of) & (frame.week_date > as_of - dt.timedelta(days=70))]
        x = np.column_stack([np.ones(len(part)), part[[f"{f}_train" for f in FEATURES]]])
        want = np.linalg.lstsq(x, part.active_return_train, rcond=None)[0]
        assert np.allclose([r["intercept"], *r["coefficients"]], want)
    folds = win.week_folds(win.window_weeks(panel, FEATURES, n_weeks=10), n_splits=2, keys=["as_of"])
    got = pdf(ln.fold_baseline_mse(panel, folds, FEATURES), "as_of", "fold")
    roles = pdf(folds)
    for r in got.itertuples():
        side = {role: frame[frame.week_date.isin(roles[(roles.as_of == r.as_of) & (roles.fold == r.fold) & (roles.role == role)].week_date)] for role in ("train", "validation")}
        def design(p):
            return np.column_stack([np.ones(len(p)), p[[f"{f}_train" for f in FEATURES]]])
        beta = np.linalg.lstsq(design(side["train"]), side["train"].active_return_train, rcond=None)[0]
        assert r.linear_mse == pytest.approx(((side["validation"].active_return_train - design(side["validation"]) @ beta) ** 2).mean())


def test_scoring_keeps_incomplete_rows_without_a_prediction(spark, panel):
    models = ln.rolling_least_squares(panel, FEATURES, n_weeks=10).withColumnRenamed("as_of", "week_date")
    holes = panel.withColumn("return_1w", pan.F.when(panel.ticker != "T0", panel.return_1w))
    got = pdf(sc.linear_scores(holes, models, FEATURES, "linear"), "week_date", "ticker")
    assert len(got) == 32 and got.prediction.isna().sum() == 4 and (got.model_as_of == got.week_date).all()


def test_trees_are_deterministic_and_learn_a_planted_signal(spark):
    rng = np.random.default_rng(1)
    rows = []
    for w in range(6):
        for i in range(60):
            x = rng.normal()
            rows.append((f"T{i}", week(w), x, rng.normal(), 2 * x + 0.1 * rng.normal()))
    df = spark.createDataFrame(rows, "ticker string, week_date date, a_train double, b_train double, active_return_train double")
    params = {**win.regression_grid("compact")[1], "n_estimators": 15, "min_child_weight": 5, "learning_rate": 0.3}
    first, second = (ln.fit_trees(df, ["a", "b"], params, seed=42) for _ in range(2))
    snapshot = df.selectExpr("ticker", "week_date", "a_train as a", "b_train as b", "active_return_train as y")
    one = pdf(ln.score_trees(first, snapshot, ["a", "b"], ["ticker", "week_date", "y"]), "week_date", "ticker")
    two = pdf(ln.score_trees(second, snapshot, ["a", "b"], ["ticker", "week_date", "y"]), "week_date", "ticker")
    assert np.allclose(one.prediction, two.prediction)
    assert ((one.prediction - one.y) ** 2).mean() < (one.y**2).mean() / 2
    effects = {r["feature"]: r["importance"] for r in ln.tree_importance(spark, first, week(5), ["a", "b"]).collect()}
    assert effects["a"] > effects["b"]


def test_seed_ensemble_values(spark):
    """Four names, two seeds: mean of rank / 4, ties at their average rank."""
    seen = {1: {"A": 10.0, "B": 30.0, "C": 30.0, "D": -5.0}, 2: {"A": 0.0, "B": 0.0, "C": 0.0, "D": 8.0}}
    rows = [(seed, week(w), t, v) for seed, row in seen.items() for w in range(2) for t, v in row.items()]
    got = pdf(win.seed_ensemble(spark.createDataFrame(rows, "seed int, week_date date, ticker string, prediction double"), layout=SMALL), "week_date", "ticker")
    assert np.allclose(got.score, [(2 + 2) / 8, (3.5 + 2) / 8, (3.5 + 2) / 8, (1 + 4) / 8] * 2)
    assert np.allclose(got.raw_prediction, [5, 15, 15, 1.5] * 2)


def test_ranking_labels_use_ticker_ties(spark):
    df = spark.createDataFrame([(week(0), t, 1.0) for t in "EDCBA"], "week_date date, ticker string, active_return_train double")
    got = pdf(win.ranking_inputs(df, layout=SMALL), "ticker")
    assert got.label.tolist() == [0, 1, 2, 3, 4] and (got.group_size == 5).all()


def test_candidates_change_one_parameter(spark):
    bases = [("xgboost", {"max_depth": "4", "min_child_weight": "30", "reg_lambda": "5", "n_estimators": "77"}),
             ("lightgbm", {"num_leaves": "9", "min_child_samples": "101", "reg_lambda": "0.5", "n_estimators": "77", "label_gain": "[0, 1]"})]
    table = spark.createDataFrame(bases, "learner string, params map<string,string>")
    got = {(r["learner"], r["candidate"]): r for r in win.neighbours(table).collect()}
    assert len(got) == 8
    for (learner, name), r in got.items():
        base = dict(bases)[learner]
        assert {k: v for k, v in r["params"].items() if base.get(k) != v} == r["changed"] and r["params"].keys() == base.keys()
        assert len(r["changed"]) == (name != "incumbent") and r["params"]["n_estimators"] == "77"
    changes = {name: r["changed"] for (learner, name), r in got.items() if learner == "lightgbm"}
    assert changes == {"incumbent": {}, "fewer_leaves": {"num_leaves": "5"}, "larger_leaf_min": {"min_child_samples": "151"}, "stronger_l2": {"reg_lambda": "2.5"}}
    assert got["xgboost", "shallower_depth"]["changed"] == {"max_depth": "3"}
    floor = spark.createDataFrame([("xgboost", {"max_depth": "1", "min_child_weight": "30", "reg_lambda": "2"})], table.schema)
    assert [r["candidate"] for r in win.neighbours(floor).orderBy("position").collect()] == ["incumbent", "larger_child"]
    with pytest.raises(ValueError, match="Unknown learner"):
        win.neighbours(spark.createDataFrame([("forest", {"a": "1"})], table.schema))
    assert win.candidate_tasks(win.neighbours(table), spark.createDataFrame([(week(0),)], "as_of date")).count() == 32


def test_candidate_choice_is_an_ordered_fold(spark):
    rows = [("x", 0, "simple", 0.50, 0.10, [2, -50]), ("x", 1, "complex", 0.52, 0.105, [3, -10]), ("x", 2, "strong", 0.60, 0.09, [3, -10]),
            ("y", 0, "undefined", None, 0.10, [1, 0]), ("y", 1, "defined", -3.0, -0.5, [9, 9]),
            ("z", 0, "a", 0.50, 0.1, [3, 0]), ("z", 1, "b", 0.47, 0.1, [2, 0]), ("z", 2, "c", 0.44, 0.1, [1, 0])]
    df = spark.createDataFrame(rows, "k string, position int, candidate string, information_ratio double, cumulative_return double, complexity array<int>")
    got = {r["k"]: r["candidate"] for r in win.choose_candidate(df, ["k"]).collect()}
    # z: each step is within tolerance of the previous winner, so simplicity walks down.
    assert got == {"x": "strong", "y": "defined", "z": "c"}


def test_resume_skips_finished_dates_and_refuses_changes(panel):
    columns = ["ticker", "week_date", "active_return_train"]

    def sign(df, config="config"):
        return win.training_fingerprints(df, FEATURES, columns, config, n_weeks=10)

    signed = sign(panel)
    assert signed.exceptAll(sign(panel.orderBy(pan.F.rand()))).count() == 0
    nudged = panel.withColumn("active_return_train", pan.F.when((panel.ticker == "T1") & (panel.week_date == week(3, START)), 0.5).otherwise(panel.active_return_train))
    other = {r["as_of"]: r["signature"] for r in sign(nudged).collect()}
    # week 3 lies in the ten-week windows that end before week 13
    assert [r["as_of"] for r in signed.orderBy("as_of").collect() if other[r["as_of"]] == r["signature"]] == [week(13, START)]
    done = signed.filter(signed.as_of < week(12, START))
    assert {r["as_of"] for r in win.pending_dates(signed, done).collect()} == {week(12, START), week(13, START)}
    with pytest.raises(ValueError, match="differ"):
        win.pending_dates(sign(panel, "other"), done)


def test_score_audit_has_a_row_per_model(spark, panel):
    audits = win.window_audit(win.window_weeks(panel, FEATURES, n_weeks=10), win.weekly_content(panel, ["ticker"]), ["ticker"], "c")
    models = spark.createDataFrame([(m, week(w, START)) for m in ("x", "y") for w in (9, 10, 12)], "model string, as_of date")
    got = sc.score_audit(audits, models).collect()
    assert sorted((r["model"], r["as_of"]) for r in got) == [(m, week(w, START)) for m in ("x", "y") for w in (10, 12)] and all(len(r["signature"]) == 64 for r in got)


def gate_weekly(spark, steps):
    """A level incumbent and a challenger whose gain walks through `steps`, four folds of 26 weeks."""
    rows = []
    for w in range(104):
        base = 0.004 * ((w * 7) % 5 - 2)
        rows += [(week(60, START), name, w // 26 + 1, week(w, START), base + gain) for name, gain in (("incumbent", 0.0), ("better", steps[w % len(steps)]))]
    df = spark.createDataFrame(rows, "as_of date, candidate string, fold int, week_date date, net_active_return double")
    zero = [pan.F.lit(0.0).alias(c) for c in ("gross_stock_return", "net_stock_return", "gross_active_return", "transaction_cost", "turnover")]
    return df.select("*", *zero, pan.F.lit(True).alias("complete"))


def test_bootstrap_is_drawn_by_name_and_the_gate_decides(spark):
    steps = (0.003, 0.0005, 0.002)
    weekly = gate_weekly(spark, steps)
    gains = {f: [steps[w % 3] for w in range(104) if w // 26 + 1 == f] for f in (1, 2, 3, 4)}
    sums = []
    for rep in range(1, 501):
        total = 0.0
        for fold, d in gains.items():
            for i in range(26):
                name = f"{week(60, START)}|{fold}|{rep}|{i // 4}"
                total += d[(int(hashlib.md5(name.encode()).hexdigest()[:12], 16) + i % 4) % 26]
        sums.append(52 * total / 104)
    boot = gt.block_bootstrap(weekly)
    assert boot.first()["lower_annual_gain"] == pytest.approx(float(pd.Series(sums).quantile(0.1)))
    assert boot.exceptAll(gt.block_bootstrap(weekly.orderBy(pan.F.rand(3)))).count() == 0
    good = gt.gate(weekly, boot).first()
    assert good["eligible"] and good["fold_ir_wins"] == 4
    mixed = gate_weekly(spark, (0.02,) * 6 + (-0.0199,) * 6)
    weak = gt.gate(mixed, gt.block_bootstrap(mixed)).first()
    assert not weak["bootstrap_lower_gain_positive"] and not weak["eligible"]
    order = spark.createDataFrame([("incumbent", 0), ("better", 1)], "candidate string, position int")
    for w, want in ((weekly, "better"), (mixed, "incumbent")):
        assert gt.choose_winner(gt.stitched_metrics(w), gt.gate(w, gt.block_bootstrap(w)), order).first()["selected"] == want
    with pytest.raises(ValueError, match="weeks differ"):
        gt.block_bootstrap(weekly.filter(f"candidate = 'incumbent' or week_date > '{week(3, START)}'"))
    hole = weekly.withColumn("net_active_return", pan.F.when((weekly.week_date != week(5, START)) | (weekly.candidate == "incumbent"), weekly.net_active_return))
    assert gt.block_bootstrap(hole).first()["lower_annual_gain"] is None


def test_tree_search_covers_every_date_point_fold_and_seed(panel):
    outcomes = panel.select("ticker", "week_date", pan.F.col("active_return_train").alias("raw_active_return"))
    folds = win.week_folds(win.window_weeks(panel, FEATURES, n_weeks=12), n_splits=2, keys=["as_of"])
    points = [{**p, "n_estimators": 4, "min_child_weight": 2, "learning_rate": 0.3} for p in win.regression_grid("compact")[:2]]
    found, scored, trees = bst.rolling_trees(panel, outcomes, folds, FEATURES, points, layout=SMALL)
    found, scored = pdf(found, "as_of", "position"), pdf(scored, "week_date", "ticker")
    assert found.as_of.tolist() == [week(12, START)] * 2 + [week(13, START)] * 2 and found.position.tolist() == [0, 1, 0, 1]
    assert all(len(x) == 2 and min(x) >= 1 and max(x) <= 4 for x in found.iterations)
    assert (found.groupby("as_of").selected.sum() == 1).all() and (found.cv_mse > 0).all()
    assert (found.n_trees == [int(np.median(x)) for x in found.iterations]).all()
    won = found[found.selected].set_index("as_of")
    assert len(scored) == 16 and (scored.n_seeds == 3).all() and scored.score.notna().all()
    assert all(won.position[r.week_date] == r.candidate and won.n_trees[r.week_date] == r.n_trees for r in scored.itertuples())
    assert trees.groupBy("as_of", "seed").count().count() == 6 and pdf(bst.tree_splits(trees, FEATURES)).importance.between(0, 1).all()


def boost_example(n=600, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = np.where(x[:, 0] > 0.2, 1.0, -1.0) + 0.5 * (x[:, 1] > 0) * (x[:, 0] > 0.2) + 0.1 * rng.normal(size=n)
    cuts = [bst.cut_points(c) for c in x.T]
    return x, y, cuts, np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T)])


POINT = {"learning_rate": 0.3, "max_depth": 2, "min_child_weight": 20, "reg_lambda": 1.0, "subsample": 1.0, "colsample_bytree": 1.0, "n_estimators": 40}


def test_first_split_is_the_best_by_exhaustive_search():
    x, y, cuts, bins = boost_example()
    stump = POINT | {"max_depth": 1, "n_estimators": 1, "reg_lambda": 5.0}
    _, got, [(base, [(feature, cut, leaves)])] = bst.boost(bins, y, np.ones((1, len(y)), bool), [stump], [1])
    g = y.mean() - y

    def gain(left):
        return sum(g[s].sum() ** 2 / (s.sum() + 5.0) for s in (left, ~left)) if min(left.sum(), (~left).sum()) >= 20 else -1

    best = max(((gain(bins[j] <= c), j, c) for j in range(3) for c in range(bst.BINS)), key=lambda t: t[0])
    assert (feature[0], cut[0]) == best[1:]
    left = bins[best[1]] <= best[2]
    assert np.allclose(got[0], base - 0.3 * np.where(left, g[left].sum() / (left.sum() + 5), g[~left].sum() / ((~left).sum() + 5)))


def test_fits_together_equal_fits_alone_and_stop_early():
    _, y, _, bins = boost_example()
    train = np.zeros((2, len(y)), bool)
    train[0, :300], train[1, 100:500] = True, True
    points = [POINT, POINT | {"max_depth": 3, "subsample": 0.7, "colsample_bytree": 0.67, "n_estimators": 60}]
    together = bst.boost(bins, y, train, points, [5, 5], ~train)
    for i in range(2):
        alone = bst.boost(bins, y, train[i : i + 1], points[i : i + 1], [5], ~train[i : i + 1])
        assert alone[0][0] == together[0][i] and np.allclose(alone[1][0], together[1][i])
        assert np.mean((together[1][i][~train[i]] - y[~train[i]]) ** 2) < 0.1 * np.mean(y[~train[i]] ** 2)
    noise = np.random.default_rng(1).normal(size=len(y))
    assert bst.boost(bins, noise, train[:1], [POINT | {"n_estimators": 300}], [5], ~train[:1])[0][0] < 60


def test_tree_table_scores_like_the_fit(spark):
    x, y, cuts, bins = boost_example(200)
    _, predicted, models = bst.boost(bins, y, np.ones((2, 200), bool), [POINT] * 2, [42, 73])
    rows = [(week(0), seed, i, float(base), 2, f.tolist(), [float(cuts[a][b]) if b < len(cuts[a]) else float("inf") for a, b in zip(f, c)], v.tolist())
            for seed, (base, trees) in zip([42, 73], models) for i, (f, c, v) in enumerate(trees)]
    snapshot = pd.DataFrame(x, columns=["a", "b", "c"]).assign(ticker=[f"T{i:03d}" for i in range(200)], week_date=week(0))
    scored = pdf(bst.score_tree_table(spark.createDataFrame(snapshot), spark.createDataFrame(rows, bst.TREES), ["a", "b", "c"]), "seed", "ticker")
    assert np.allclose(scored.prediction.to_numpy().reshape(2, -1), predicted)


def test_long_windows_are_thinned_by_ticker(spark):
    rows = spark.range(200).selectExpr("concat('T', id) as ticker", "explode(sequence(date'2022-01-05', date'2022-03-23', interval 7 days)) as week_date")
    folds = rows.select(pan.F.lit(week(11)).alias("as_of"), "week_date", pan.F.lit(1).alias("fold"), pan.F.lit("train").alias("role")).distinct()
    kept = bst.bounded_windows(rows, folds, window_rows=600).groupBy("ticker").count().collect()
    assert 25 <= len(kept) <= 80 and {r["count"] for r in kept} == {12}


def test_shared_weeks_equal_folds_from_cash(spark):
    from helpers import random_frame

    frame = random_frame(n_tickers=12, n_weeks=14, gap=6).rename(columns={"model": "candidate", "stock_return": "raw_stock_return"})
    scores = spark.createDataFrame(frame[frame.candidate.eq("a") | (frame.week_date > week(2))])
    days = sorted(set(frame.week_date))
    folds = spark.createDataFrame([(days[a + 7], f, d) for a in range(7) for f, part in ((1, days[a:a + 4]), (2, days[a + 4:a + 8])) for d in part], "as_of date, fold int, week_date date")
    keys = ["as_of", "candidate", "fold", "week_date"]
    want = pdf(gt.candidate_weekly(scores.join(folds, "week_date"), layout=SMALL), *keys)
    got = pdf(gt.shared_weekly(scores, folds, SMALL), *keys)
    pd.testing.assert_frame_equal(got[sorted(want.columns)], want[sorted(want.columns)])


def test_all_dates_follow_the_calendar(spark):
    from crosswise.plans import training, views

    sf = "/root/testdata/sf0.001"
    weeks = views.dense_weeks(spark, sf).count()
    assert training.gate_weekly_all_dates(spark, sf).select("as_of").distinct().count() == weeks - 259 > 2


def test_weeks_are_evaluated_once_for_both_charges(spark, monkeypatch):
    from helpers import random_frame

    from crosswise.operators.evaluation import evaluate_exact_q1

    scores = spark.createDataFrame(random_frame(n_tickers=9, n_weeks=5, gap=3).rename(columns={"model": "candidate", "stock_return": "raw_stock_return"}))
    args = {"stock": "raw_stock_return", "layout": SMALL}
    both = evaluate_exact_q1(scores, ["candidate"], **args, entries=True)
    after = evaluate_exact_q1(scores, ["candidate"], **args)
    alone = evaluate_exact_q1(scores.withColumn("entry", scores.week_date), ["candidate", "entry"], **args).drop("entry")
    for flag, want in ((False, after), (True, alone)):
        got = both.filter(both["__entry"] == flag).drop("__entry")
        pd.testing.assert_frame_equal(pdf(got.select(*want.columns), "candidate", "week_date"), pdf(want, "candidate", "week_date"))
    calls = []
    monkeypatch.setattr(gt, "evaluate_exact_q1", lambda *a, **k: calls.append(1) or evaluate_exact_q1(*a, **k))
    gt.shared_weekly(scores, scores.selectExpr("date'2022-03-02' as as_of", "1 as fold", "week_date").distinct(), SMALL)
    assert len(calls) == 1


def test_rows_that_are_their_own_panel_are_not_joined_with_themselves(spark):
    from crosswise.operators import outcomes as out

    rows = [(f"T{i}", f"S{i % 2}", week(w), None if (i, w) == (3, 1) else i / 50 - w / 40) for i in range(6) for w in range(3)]
    returns = spark.createDataFrame([*rows, (None, "S0", week(0), 0.5)], "ticker string, sector string, week_date date, return_1w double")
    own, joined = (out.raw_outcomes(panel, returns, check=False) for panel in (returns, returns.select("*")))
    assert "Join" not in own._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, own.collect())) == sorted(map(str, joined.collect())) and own.count() == 18
