"""Queries over training windows, learners and the selection gate (W, G, Q6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boosting as bst
from ..operators import evaluation as ev
from ..operators import gate as gt
from ..operators import learners as ln
from ..operators import outcomes as out
from ..operators import panel as pan
from ..operators import portfolio as pf
from ..operators import scoring as sc
from ..operators import search
from ..operators import windows as win
from ..sources import sinks
from ..sources.storage import cut_lineage
from . import views
from .backtests import B10_SQL, E8_SUMMARY_SQL, IR, long_short, outcomes, scored
from .registry import BLOCKS, query, r, rounded, trades_sql, with_blocks

START = "1995-01-01"
TWO = {"return_1w": 1, "return_4w": -1}

BLOCKS.update(
    {
        "tcell": ("act", "select ticker, sector, week_date, 'return_1w' as feature, return_1w as x from act union all select ticker, sector, week_date, 'return_4w', -return_4w from act"),
        "tcellq": ("tcell", "select week_date, sector, feature, quantile_cont(x, 0.01) as lo, quantile_cont(x, 0.99) as hi, count(x) as n from tcell group by all"),
        "tcellp": ("tcell tcellq", """select *, case when w is not null then (rank() over (partition by week_date, sector, feature order by w nulls last)
              + (count(*) over (partition by week_date, sector, feature, w) - 1) / 2.0 - 0.5) / n end as p
            from (select c.*, n, case when x is not null then greatest(least(x, hi), lo) end as w from tcell c join tcellq using (week_date, sector, feature))"""),
        "tcellz": ("tcellp", "select *, case when stddev_pop(p) over g > 1e-12 then (p - avg(p) over g) / stddev_pop(p) over g when p is not null then 0 end as z from tcellp window g as (partition by week_date, feature)"),
        "twide": ("tcellz", "select ticker, week_date, max(z) filter (feature = 'return_1w') as return_1w, max(z) filter (feature = 'return_4w') as return_4w from tcellz group by all"),
        # Complete training rows: both lagged features and the target present.
        "trows": ("twide target dweeks", """select t.ticker, t.week_date, k.prev_week_date, l.return_1w as a, l.return_4w as b, t.active_return_train as y
            from target t join dweeks k using (week_date) join twide l on l.ticker = t.ticker and l.week_date = k.prev_week_date
            where l.return_1w is not null and l.return_4w is not null and t.active_return_train is not null"""),
        "tgram": ("trows", """select week_date, count(*) as n, sum(a) as sa, sum(b) as sb, sum(y) as sy, sum(a * a) as saa, sum(a * b) as sab, sum(b * b) as sbb,
              sum(a * y) as say, sum(b * y) as sby, sum(y * y) as syy from trows group by 1"""),
        "twin": ("tgram", """select as_of, first, unnest(generate_series(first, as_of, interval 7 day))::date as week_date from (
              select week_date as as_of, min(week_date) over w as first, count(*) over w as held from tgram window w as (order by week_date rows 259 preceding))
            where held = 260 and as_of - first = 259 * 7"""),
        "tfold": ("twin", """select as_of, fold, week_date, case when i >= b and i < b + 52 then 'validation' when i < b - 1 then 'train' end as role from (
              select as_of, week_date, fold, row_number() over (partition by as_of, fold order by week_date) - 1 as i, 260 - (5 - fold) * 52 as b
              from twin cross join (select unnest([1, 2, 3, 4]) as fold)) where (i >= b and i < b + 52) or i < b - 1"""),
    }
)
SUMS = "sum(n) as n, sum(sa) as sa, sum(sb) as sb, sum(sy) as sy, sum(saa) as saa, sum(sab) as sab, sum(sbb) as sbb, sum(say) as say, sum(sby) as sby, sum(syy) as syy"
# Two-regressor least squares in closed form.
CAA, CAB, CBB, CAY, CBY = "(saa - sa * sa / n)", "(sab - sa * sb / n)", "(sbb - sb * sb / n)", "(say - sa * sy / n)", "(sby - sb * sy / n)"
DET = f"({CAA} * {CBB} - {CAB} * {CAB})"
BETA = f"({CAY} * {CBB} - {CBY} * {CAB}) / {DET} as ba, ({CBY} * {CAA} - {CAY} * {CAB}) / {DET} as bb"
BLOCKS["tfit"] = ("twin tgram", f"select *, (sy - ba * sa - bb * sb) / n as b0 from (select *, {BETA} from (select as_of, first, {SUMS} from twin join tgram using (week_date) group by 1, 2))")


def train_panel(spark, sf, returns=None):
    """Panel over the gap-free view (or its `returns`, where a plan has them stored) with two features,
    stored as training reads it: several window passes then scan columns instead of rebuilding it."""
    returns = views.dense_returns(spark, sf) if returns is None else returns
    return cut_lineage(pan.build_panel(returns.select("ticker", "sector", "week_date", *TWO), directions=TWO,
                                       layout=views.universe(spark, sf), weeks=views.dense_weeks(spark, sf), check=False))


def rolling_audit(spark, sf, columns=(), config=""):
    """Windows of the training panel from weekly sums; the panel is read for both."""
    panel = train_panel(spark, sf)
    rows = win.complete_rows(panel, list(TWO), START)
    return win.window_audit(win.window_weeks(panel, list(TWO), data_start=START), win.weekly_content(rows, columns), columns, config)


@query("w01_rolling_window", with_blocks("twin trows", "select as_of, count(*) as training_rows, min(week_date) as first_training_week, max(week_date) as last_training_week, count(distinct week_date) as weeks from twin join trows using (week_date) group by 1"))
def _(spark, sf):
    return rolling_audit(spark, sf).drop("signature")


@query("w02_calendar_window", with_blocks("trows dweeks", """select as_of, count(*) as training_rows, min(week_date) as first_training_week, max(week_date) as last_training_week
    from (select distinct week_date as as_of from trows where week_date >= date '2000-01-01') join trows on week_date > (as_of - interval 5 year)::date and week_date <= as_of
    where (select min(week_date) from dweeks) <= (as_of - interval 5 year)::date + 7 group by 1"""))
def _(spark, sf):
    panel = train_panel(spark, sf)
    dates = views.dense_weeks(spark, sf).filter("week_date >= '2000-01-01'").select(F.col("week_date").alias("as_of"))
    pairs = win.calendar_pairs(panel, list(TWO), dates, 5, START)
    return win.window_audit(pairs, win.weekly_content(win.complete_rows(panel, list(TWO), START))).drop("signature", "weeks")


def folds_of(spark, sf):
    weeks = win.window_weeks(train_panel(spark, sf), list(TWO), data_start=START)
    return win.week_folds(weeks, keys=["as_of"])


@query("w03_expanding_folds", with_blocks("tfold", """select as_of, fold, min(week_date) filter (role = 'train') as train_start, max(week_date) filter (role = 'train') as train_end,
    min(week_date) filter (role = 'validation') as validation_start, max(week_date) filter (role = 'validation') as validation_end,
    count(*) filter (role = 'train') as train_weeks, count(*) filter (role = 'validation') as validation_weeks from tfold group by 1, 2"""))
def _(spark, sf):
    return win.fold_bounds(folds_of(spark, sf), ["as_of"])


@query("w04_raw_outcomes", with_blocks("target", f"select ticker, week_date, {r('raw_active_return')} as raw_active_return, {r('return_1w')} as raw_stock_return from target"))
def _(spark, sf):
    rets = views.dense_returns(spark, sf)
    return rounded(out.raw_outcomes(rets, rets, views.universe(spark, sf), check=False))


@query("w04_outcome_violations", with_blocks("target", "select ticker, week_date, 'invalid_return' as problem from target where return_1w is null or week_date = date '1999-06-02'"))
def _(spark, sf):
    rets = views.dense_returns(spark, sf)
    layout = views.universe(spark, sf)
    panel = pan.cross_sectional_scores(rets, {"return_1w": 1}, layout=layout)
    broken = rets.withColumn("return_1w", F.when(F.col("week_date") != "1999-06-02", F.col("return_1w")))
    return out.raw_outcome_violations(panel, broken, layout)


@query("w05_attach_outcomes", with_blocks("trows target", f"""select t.ticker, t.week_date, {r('raw_active_return')} as raw_active_return from trows t join target using (ticker, week_date)
    where t.week_date > date '2001-06-06' - 7 * 260 and t.week_date <= date '2001-06-06'"""))
def _(spark, sf):
    window = win.rolling_window(train_panel(spark, sf), list(TWO), data_start=START, as_of="2001-06-06")
    rets = views.dense_returns(spark, sf)
    outcomes = out.raw_outcomes(rets, rets, views.universe(spark, sf), check=False)
    return rounded(out.attach_outcomes(window.select("ticker", "week_date"), outcomes).select("ticker", "week_date", "raw_active_return"))


@query("w06_ranking_inputs", with_blocks("trows", """select ticker, week_date, n as group_size, case when n < 2 then 0 else least(greatest(ceil(p / n * 5) - 1, 0), 4)::int end as label from (
    select ticker, week_date, row_number() over (partition by week_date order by y, ticker) as p, count(*) over (partition by week_date) as n from trows)"""))
def _(spark, sf):
    rows = win.complete_rows(train_panel(spark, sf), list(TWO), START)
    return win.ranking_inputs(rows, layout=views.universe(spark, sf)).select("ticker", "week_date", "group_size", "label")


@query("w07_rolling_least_squares", with_blocks("tfit", f"select as_of, first as first_training_week, n::bigint as training_rows, {r('b0')} as intercept, {r('ba')} as beta_return_1w, {r('bb')} as beta_return_4w from tfit"))
def _(spark, sf):
    fit = ln.rolling_least_squares(train_panel(spark, sf), list(TWO), data_start=START)
    return rounded(fit.select("as_of", "first_training_week", "training_rows", "intercept",
                              F.element_at("coefficients", 1).alias("beta_return_1w"), F.element_at("coefficients", 2).alias("beta_return_4w")))


@query("w07_fold_baseline_mse", with_blocks("tfold tgram", f"""select as_of, fold, v.n::bigint as validation_rows,
    {r('(v.syy - 2 * b0 * v.sy - 2 * ba * v.say - 2 * bb * v.sby + b0 * b0 * v.n + 2 * b0 * ba * v.sa + 2 * b0 * bb * v.sb + ba * ba * v.saa + 2 * ba * bb * v.sab + bb * bb * v.sbb) / v.n')} as linear_mse
    from (select as_of, fold, ba, bb, (sy - ba * sa - bb * sb) / n as b0 from (select *, {BETA} from s where role = 'train')) f join (select * from s where role = 'validation') v using (as_of, fold)""",
    {"s": f"select as_of, fold, role, {SUMS} from tfold join tgram using (week_date) group by 1, 2, 3"}))
def _(spark, sf):
    return rounded(ln.fold_baseline_mse(train_panel(spark, sf), folds_of(spark, sf), list(TWO), data_start=START))


# w05 keeps its SQL and its date; this one has the outcomes of every window.
@query("w05_window_outcomes", with_blocks("twin trows target", f"""select as_of, t.ticker, t.week_date, {r('raw_active_return')} as raw_active_return
    from twin join trows t using (week_date) join target o on o.ticker = t.ticker and o.week_date = t.week_date"""))
def _(spark, sf):
    """Outcomes are attached and rounded once per row; windows, pairs of weeks, are broadcast to them afterwards."""
    rets = cut_lineage(views.dense_returns(spark, sf).select("ticker", "sector", "week_date", *TWO))
    panel = train_panel(spark, sf, rets)
    rows = win.complete_rows(panel, list(TWO), START).select("ticker", "week_date")
    attached = out.attach_outcomes(rows, out.raw_outcomes(rets, rets, views.universe(spark, sf), check=False).select("ticker", "week_date", "raw_active_return"))
    windows = win.window_weeks(panel, list(TWO), data_start=START)
    return rounded(attached).join(F.broadcast(windows), "week_date").select("as_of", "ticker", "week_date", "raw_active_return")


def tree_search(spark, sf):
    """The compact grid on the folds of every as-of date, refitted for three seeds."""
    panel, rets, layout = train_panel(spark, sf), views.dense_returns(spark, sf), views.universe(spark, sf)
    folds = win.week_folds(win.window_weeks(panel, list(TWO), data_start=START), keys=["as_of"])
    outcomes = out.raw_outcomes(rets, rets, layout, check=False)
    return bst.rolling_trees(panel, outcomes, folds, list(TWO), win.regression_grid("compact"), layout=layout, data_start=START)


@query("w08_boosted_trees")
def _(spark, sf):
    return tree_search(spark, sf)[1]


# Every date with all six points, one of them chosen, and errors below those of predicting zero.
@query("w08_tree_candidates", with_blocks("tfold", """select as_of, 6::bigint as points, true as below_zero_baseline, 1::bigint as selected_points from tfold group by 1"""))
def _(spark, sf):
    found = tree_search(spark, sf)[0]
    return found.groupBy("as_of").agg(F.count(F.lit(1)).alias("points"), F.expr("bool_and(cv_mse < zero_mse)").alias("below_zero_baseline"), F.count_if("selected").alias("selected_points"))


# --- fit, score, choose, evaluate: one chain over dated models ------------------

# Scores of the rolling fit on the features of its own date, beside those of one plain signal.
CHAIN = {"frame": ("tfit twide fwd rets", """select s.*, f.next_week_date, f.stock_return_fwd, f.sector_return_fwd, f.raw_active_return_fwd, f.active_return_fwd from (
    select 'linear' as model, x.ticker, x.sector, week_date, b0 + ba * z.return_1w + bb * z.return_4w as prediction from rets x join twide z using (ticker, week_date) join tfit on as_of = week_date
    union all select 'momentum', ticker, sector, week_date, return_4w from rets join (select as_of as week_date from tfit) using (week_date)) s
    join fwd f using (ticker, week_date) where s.prediction is not null""")}


def chain_frame(spark, sf):
    """Coefficients as dated rows, joined with the features of their date; outcomes follow."""
    panel = train_panel(spark, sf)
    models = cut_lineage(ln.rolling_least_squares(panel, list(TWO), data_start=START).withColumnRenamed("as_of", "week_date"))
    linear = sc.linear_scores(panel, models.select("week_date", "intercept", "coefficients"), list(TWO), "linear").select("model", "ticker", "sector", "week_date", "prediction")
    plain = views.dense_returns(spark, sf).join(models.select("week_date"), "week_date", "left_semi").select(F.lit("momentum").alias("model"), "ticker", "sector", "week_date", F.col("return_4w").alias("prediction"))
    scores = linear.unionByName(plain).filter("prediction is not null")
    outcomes = out.realized_outcomes(views.dense_returns(spark, sf), views.universe(spark, sf), weeks=views.dense_weeks(spark, sf)).select(
        "ticker", "week_date", "next_week_date", "stock_return_fwd", "sector_return_fwd", "raw_active_return_fwd", "active_return_fwd")
    return cut_lineage(scores.join(outcomes, ["ticker", "week_date"]))


@query("chain_quintiles", with_blocks("quint", f"""select model, week_date, quintile, count(*) as holdings, {r('avg(prediction)')} as mean_prediction, {r('avg(raw_active_return_fwd)')} as active_return from quint group by 1, 2, 3""", swap=CHAIN))
def _(spark, sf):
    members = sc.assign_quintiles(chain_frame(spark, sf), highest_first=True, layout=views.universe(spark, sf))
    return rounded(members.groupBy("model", "week_date", "quintile").agg(
        F.count(F.lit(1)).alias("holdings"), F.avg("prediction").alias("mean_prediction"), F.avg("raw_active_return_fwd").alias("active_return")))


@query("chain_portfolio_metrics", with_blocks("lofull", B10_SQL, swap=CHAIN))
def _(spark, sf):
    weekly = ev.evaluate_exact_q1(chain_frame(spark, sf).withColumnRenamed("prediction", "score"), active="raw_active_return_fwd", stock="stock_return_fwd",
                                  target="active_return_fwd", layout=views.universe(spark, sf))
    return rounded(pf.portfolio_metrics(weekly))


@query("chain_comparison", with_blocks("cmpw", E8_SUMMARY_SQL, swap=CHAIN))
def _(spark, sf):
    return rounded(ev.comparative_summary(ev.comparative_weekly(chain_frame(spark, sf), views.universe(spark, sf))))


BASES = [
    ("xgboost", {"learning_rate": "0.025", "max_depth": "2", "min_child_weight": "50", "reg_lambda": "10", "n_estimators": "120"}),
    ("lightgbm", {"num_leaves": "15", "min_child_samples": "300", "reg_lambda": "1.0", "n_estimators": "90"}),
]


@query("w09_candidate_tasks", with_blocks("twin", """select learner, as_of, fold, candidate, parameter, new_value from (select distinct as_of from twin) cross join (select unnest([1, 2, 3, 4]) as fold)
    cross join (values ('xgboost', 'incumbent', null, null), ('xgboost', 'shallower_depth', 'max_depth', 1.0::double), ('xgboost', 'larger_child', 'min_child_weight', 100), ('xgboost', 'stronger_l2', 'reg_lambda', 2),
      ('lightgbm', 'incumbent', null, null), ('lightgbm', 'fewer_leaves', 'num_leaves', 7), ('lightgbm', 'larger_leaf_min', 'min_child_samples', 450), ('lightgbm', 'stronger_l2', 'reg_lambda', 3)) c(learner, candidate, parameter, new_value)"""))
def _(spark, sf):
    dates = win.window_weeks(train_panel(spark, sf), list(TWO), data_start=START).select("as_of").distinct()
    table = win.neighbours(spark.createDataFrame(BASES, "learner string, params map<string,string>"))
    tasks = win.candidate_tasks(table, dates)
    return tasks.select("learner", "as_of", "fold", "candidate", F.try_element_at(F.map_keys("changed"), F.lit(1)).alias("parameter"),
                        F.try_element_at(F.map_values("changed"), F.lit(1)).cast("double").alias("new_value"))


# The rates that the search tries first, with their numbers of iterations, and what
# its later stages change.
RATES, CEILINGS = ("0.1", "0.2", "0.3", "0.4"), ("10", "10", "10", "10")
FIRST_TRUNCATION, SECOND_TRUNCATION = "2", "5"
REFINEMENT = {"learning_rate": "0.05", "n_estimators": "20"}


def search_sql(stage):
    """Blocks that evaluate the candidates of c{stage} (year, position, candidate, rate, k, ceiling)."""
    x, who = f"s{stage}", "year, candidate"
    return {
        f"{x}path": f"""select {who}, fold, t, k, week_date, a, row_number() over (partition by {who}, t, week_date order by score desc, ticker) as place, count(*) over (partition by {who}, t, week_date) as n
            from (select b.*, c.candidate, c.k, t, m * (1 - t * rate) + v * (t * rate) as score from sboth b join (select *, unnest(generate_series(1, ceiling)) as t from c{stage}) c using (year))""",
        f"{x}loss": f"""select {who}, fold, t, round(avg(g), 9) as g from (select {who}, fold, t, week_date, avg(a) filter (place <= k) - avg(a) filter (place > n - k) as g
            from {x}path where n >= 5 group by all) group by all""",
        f"{x}stop": f"select {who}, fold, t::int as t from (select *, row_number() over (partition by {who}, fold order by g desc, t) as i from {x}loss) where i = 1",
        f"{x}r": f"""select *, row_number() over (partition by {who}, week_date order by score desc, ticker) as place, count(*) over (partition by {who}, week_date) as n from (
            select {who}, b.ticker, b.week_date, b.a, b.m * (1 - t * rate) + b.v * (t * rate) as score from {x}stop join c{stage} using ({who}) join sboth b using (year, fold))""",
        f"{x}pos": f"""select {who}, week_date, ticker, a, case when (place - 1) * 5 // n = 0 then 1.0::double / ceil(n / 5) else -1.0::double / floor(n / 5) end as w
            from {x}r where n >= 5 and ((place - 1) * 5 // n in (0, 4))""",
        f"{x}dates": f"select {who}, week_date, lag(week_date) over w as prev_week, lead(week_date) over w as next_week from (select distinct {who}, week_date from {x}pos) window w as (partition by {who} order by week_date)",
        f"{x}tr": trades_sql(f"{x}pos", f"{x}dates", who),
        f"{x}net": f"""select {who}, gross - 0.002::double * coalesce(case when k.week_date - k.prev_week = 7 then traded / 2 end, 1) as net
            from (select {who}, week_date, avg(a) filter (w > 0) - avg(a) filter (w < 0) as gross from {x}pos group by all) join {x}dates k using ({who}, week_date) join {x}tr using ({who}, week_date) where gross is not null""",
        f"e{stage}": f"""select {stage} as stage, c.*, ir, cum, med, top from c{stage} c join (select {who}, {IR.format(x='net')} as ir, product(1 + net) - 1 as cum from {x}net group by 1, 2) using ({who})
            join (select {who}, median(t) as med, max(t) as top from {x}stop group by 1, 2) using ({who})""",
    }


def leader_sql(table):
    """The ordered choice with tolerances within each year of an evaluated table."""
    return f"""select * exclude (i) from (select *, row_number() over (partition by year order by position) as i from {table}) where (year, i) in (
        with recursive listed as (select *, row_number() over (partition by year order by position) as i from {table}),
          walk as (select year, i, i as best, ir, cum, k, med from listed where i = 1 union all
            select year, i, if(better, i, best), if(better, ir, bir), if(better, cum, bcum), if(better, k, bk), if(better, med, bmed) from (
              select n.*, w.best, w.ir as bir, w.cum as bcum, w.k as bk, w.med as bmed,
                case when (n.ir is null) <> (w.ir is null) then w.ir is null when n.ir is not null and abs(n.ir - w.ir) > 0.05 then n.ir > w.ir
                  when abs(n.cum - w.cum) > 0.01 then n.cum > w.cum when n.k <> w.k then n.k < w.k else n.med < w.med end as better
              from walk w join listed n on n.year = w.year and n.i = w.i + 1))
        select year, arg_max(best, i) from walk group by year)"""


W10 = {
    "sboth": """select year(week_date)::int as year, quarter(week_date)::int as fold, ticker, week_date, any_value(raw_active_return_fwd) as a,
        max(prediction) filter (model = 'momentum') as m, max(prediction) filter (model = 'reversal') as v
        from frame group by ticker, week_date having m is not null and v is not null and a is not null""",
    "c1": "select distinct b.year, position, 'rate ' || s as candidate, s::double as rate, " + FIRST_TRUNCATION + " as k, ceiling from sboth b cross join (values "
          + ", ".join(f"({i}, '{s}', {n})" for i, (s, n) in enumerate(zip(RATES, CEILINGS), 1)) + ") t(position, s, ceiling)",
    **search_sql(1),
    "first": leader_sql("e1"),
    "others": "select * from e1 where (year, candidate) not in (select (year, candidate) from first)",
    "second": leader_sql("others"),
    "c2": f"select year, 4 + i as position, 'finalist ' || i as candidate, rate, {SECOND_TRUNCATION} as k, ceiling from (select *, 1 as i from first union all select *, 2 from second)",
    **search_sql(2),
    "e12": "select * from e1 union all select * from e2",
    "lead12": leader_sql("e12"),
    "c3": f"select year, 7 as position, 'refined' as candidate, {REFINEMENT['learning_rate']}::double as rate, k, {REFINEMENT['n_estimators']} as ceiling from lead12 where med >= ceil(0.9 * ceiling) or top >= ceiling",
    **search_sql(3),
    "e123": "select * from e12 union all select * from e3",
    "chosen": leader_sql("e123"),
}


@query("w10_staged_search", with_blocks("frame", f"""select e.year, e.stage, e.candidate, e.rate, e.k as truncation, e.ceiling as n_estimators, e.med as median_iterations, e.top as max_iterations,
    {r('e.ir')} as information_ratio, {r('e.cum')} as cumulative_return, e.year in (select year from e3) as refined, e.candidate = c.candidate as selected from e123 e join chosen c using (year)""", W10))
def _(spark, sf):
    """The search of every year at once, on a path from momentum to reversal with the quarters as folds."""
    active = "raw_active_return_fwd"
    rows = outcomes(spark, sf).select(F.year("week_date").alias("year"), F.quarter("week_date").alias("fold"), "ticker", "week_date",
                                      F.expr(views.MODELS["momentum"]).alias("base"), F.expr(views.MODELS["reversal"]).alias("added"), active)
    rows = cut_lineage(rows.filter(f"base is not null and added is not null and {active} is not null"))
    layout = views.universe(spark, sf)
    points = [(i, f"rate {s}", {"learning_rate": s, "truncation": FIRST_TRUNCATION, "n_estimators": n}) for i, (s, n) in enumerate(zip(RATES, CEILINGS), 1)]
    table = spark.createDataFrame(points, "position int, candidate string, params map<string,string>")
    found = search.staged_search(rows.select("year").distinct().crossJoin(F.broadcast(table)), lambda c: search.blend_path_results(rows, c, ["year"], layout, active),
                                 ["year"], truncation=SECOND_TRUNCATION, refinement=REFINEMENT)
    value = F.col("params")
    return rounded(found.select("year", "stage", "candidate", value["learning_rate"].cast("double").alias("rate"), value["truncation"].cast("int").alias("truncation"),
                                value["n_estimators"].cast("int").alias("n_estimators"), "median_iterations", "max_iterations", "information_ratio", "cumulative_return", "refined", "selected"))


SEEDS = {"42": "return_1w", "73": "0 - return_4w", "107": "return_13w"}


@query("w11_seed_rank_ensemble", with_blocks("rets", f"""select ticker, week_date, {r('avg(pct)')} as score, {r('avg(x)')} as raw_prediction from (
    select *, (rank() over (partition by seed, week_date order by x) + (count(*) over (partition by seed, week_date, x) - 1) / 2.0) / count(*) over (partition by seed, week_date) as pct
    from (select ticker, week_date, unnest([42, 73, 107]) as seed, unnest([return_1w, 0 - return_4w, return_13w]) as x from rets where return_13w is not null)) group by 1, 2"""))
def _(spark, sf):
    rows = views.dense_returns(spark, sf).filter("return_13w is not null")
    seeds = views.as_models(rows, SEEDS).select(F.col("model").cast("int").alias("seed"), "ticker", "week_date", "prediction")
    return rounded(win.seed_ensemble(seeds, layout=views.universe(spark, sf)))


CONTENT = ["ticker", "week_date", "return_1w_train", "return_4w_train", "active_return_train"]
# The same 48 bits of an MD5 per row, summed per window.
BLOCKS["tsign"] = ("twin trows", """select as_of, min(week_date) as first, max(week_date) as last, count(*) as n,
      sum(('0x' || substr(md5(concat_ws('|', ticker, week_date, round(a * 1e6)::bigint, round(b * 1e6)::bigint, round(y * 1e6)::bigint)), 1, 12))::bigint::hugeint) as d
    from twin join trows using (week_date) group by 1""")
SIGNATURE = f"sha256(d::varchar || '|' || n || '|v1|{','.join(CONTENT)}')"


@query("w13_training_fingerprint", with_blocks("tsign", f"select as_of, n as training_rows, {SIGNATURE} as signature from tsign"))
def _(spark, sf):
    return win.training_fingerprints(train_panel(spark, sf), list(TWO), CONTENT, "v1", data_start=START)


@query("w13_pending_dates", with_blocks("twin trows", "select as_of, count(*) as training_rows from twin join trows using (week_date) where as_of >= date '2001-03-01' group by 1"))
def _(spark, sf):
    wanted = win.training_fingerprints(train_panel(spark, sf), list(TWO), ["ticker", "week_date"], "v1", data_start=START)
    done = wanted.filter("as_of < '2001-03-01'")
    return win.pending_dates(wanted, done, check=False).select("as_of", "training_rows")


@query("w14_feature_effects", with_blocks("tfit", f"select as_of, 'return_1w' as feature, {r('ba')} as linear_coefficient from tfit union all select as_of, 'return_4w', {r('bb')} from tfit"))
def _(spark, sf):
    return rounded(ln.feature_effects(ln.rolling_least_squares(train_panel(spark, sf), list(TWO), data_start=START), list(TWO)))


NET10 = "gross_return - 0.002::double * cost_turnover"


W15_SQL = f"""select year, case when (case when abs(i1 - i0) > 0.05 then i1 > i0 when abs(c1 - c0) > 0.01 then c1 > c0 else false end) then 'reversal' else 'momentum' end as candidate from (
    select year, max(ir) filter (model = 'momentum') as i0, max(ir) filter (model = 'reversal') as i1, max(cum) filter (model = 'momentum') as c0, max(cum) filter (model = 'reversal') as c1
    from (select model, year(week_date)::int as year, {IR.format(x='(' + NET10 + ')')} as ir, product(1 + {NET10}) - 1 as cum from lsweek where gross_return is not null group by 1, 2) group by 1)"""


def yearly_choice(spark, sf):
    weekly = long_short(spark, sf).filter("gross_return is not null").withColumn("year", F.year("week_date"))
    costs = pf.cost_scenarios(weekly, ["model", "year"], [pf.SELECTION_BPS])
    table = costs.select("year", F.when(F.col("model") == "momentum", 0).otherwise(1).alias("position"), F.col("model").alias("candidate"),
                         "information_ratio", "cumulative_return", F.array(F.lit(1)).alias("complexity"))
    return win.choose_candidate(table, ["year"]).select("year", "candidate")


query("w15_candidate_choice", with_blocks("lsweek", W15_SQL))(yearly_choice)


# Both candidates of every year, with the chosen one marked, as a search leaves them.
@query("k06_configuration_counts", with_blocks("lsweek", f"select candidate, count(*) as n_weeks from ({W15_SQL}) group by 1"))
def _(spark, sf):
    names = F.explode(F.array(F.lit("momentum"), F.lit("reversal"))).alias("candidate")
    listed = yearly_choice(spark, sf).withColumnRenamed("candidate", "won").select(F.lit("trees").alias("model"), "year", "won", names)
    return sinks.configuration_counts(listed.withColumn("selected", F.col("candidate") == F.col("won")), "trees")


@query("q06_score_audit", with_blocks("tsign scores", f"""select model, as_of, first as first_training_week, last as last_training_week, n as training_rows, {SIGNATURE} as signature
    from tsign join (select distinct model, week_date as as_of from scores) using (as_of)"""))
def _(spark, sf):
    models = views.scores(spark, sf).select("model", F.col("week_date").alias("as_of"))
    return sc.score_audit(rolling_audit(spark, sf, CONTENT, "v1"), models)


# --- G: selection gate --------------------------------------------------------

CANDIDATES = {"incumbent": "return_4w", "reversal": "0 - return_1w", "slow": "0 - return_13w"}
BLOCKS.update(
    {
        # Every as-of date whose 260 weeks are in the calendar.
        "gdates": ("dweeks", """select as_of, week_date from (select week_date as as_of from dweeks where week_date - 7 * 259 >= (select min(week_date) from dweeks))
            cross join (select week_date from dweeks) where week_date > as_of - 7 * 260 and week_date <= as_of"""),
        "gfold": ("gdates", """select as_of, week_date, fold from (select as_of, week_date, row_number() over (partition by as_of order by week_date) - 1 as i from gdates)
            cross join (select unnest([1, 2, 3, 4]) as fold) where i >= 260 - (5 - fold) * 52 and i < 260 - (5 - fold) * 52 + 52"""),
        "gframe": ("rets fwd gfold", """select g.as_of, c.candidate, g.fold, f.week_date, f.ticker, c.score, f.raw_active_return_fwd as a, f.stock_return_fwd as s
            from rets x join fwd f using (ticker, week_date) cross join lateral (select unnest(['incumbent', 'reversal', 'slow']) as candidate, unnest([return_4w, 0 - return_1w, 0 - return_13w]) as score) c
            join gfold g on g.week_date = f.week_date where c.score is not null"""),
        "gbook": ("gframe", """select *, 1.0::double / ceil(0.2::double * n) as w from (select *, row_number() over (partition by as_of, candidate, fold, week_date order by score desc, ticker) as place,
              count(*) over (partition by as_of, candidate, fold, week_date) as n from gframe) where place <= ceil(0.2::double * n)"""),
        "gweeks": ("gframe", "select *, lag(week_date) over w as prev_week, lead(week_date) over w as next_week from (select distinct as_of, candidate, fold, week_date from gframe) window w as (partition by as_of, candidate, fold order by week_date)"),
        "gtr": ("gbook gweeks", trades_sql("gbook", "gweeks", "as_of, candidate, fold")),
        "glo": ("gbook gtr gweeks", """select as_of, candidate, fold, week_date, ga - 0.0005::double * d as net, d / 2 as turnover from (
              select as_of, candidate, fold, week_date, case when count(a) = count(*) then sum(w * a) end as ga, sum(w) as gross from gbook group by all)
            join gtr using (as_of, candidate, fold, week_date) join gweeks k using (as_of, candidate, fold, week_date)
            cross join lateral (select case when k.week_date - k.prev_week = 7 then traded else gross end as d)"""),
        "gm": ("glo", f"select as_of, candidate, 52 * avg(net) as net, {IR.format(x='net')} as ir from glo where net is not null group by 1, 2"),
        "gmf": ("glo", f"select as_of, candidate, fold, count(*) as n, 52 * avg(net) as net, {IR.format(x='net')} as ir from glo where net is not null group by 1, 2, 3"),
        "gmy": ("glo", "select as_of, candidate, year(week_date) as y, 52 * avg(net) as net from glo where net is not null group by 1, 2, 3"),
    }
)


def gated(name, sql):
    """A query over the weekly results of the candidates at every as-of date."""
    return lambda fn: query(name, sql)(lambda spark, sf: fn(spark, gate_weekly(spark, sf)))


def gate_folds(dates):
    windows = dates.select("as_of", F.explode(F.sequence(F.date_sub("as_of", 7 * 259), F.col("as_of"), F.expr("interval 7 days"))).alias("week_date"))
    return win.week_folds(windows, keys=["as_of"]).filter("role = 'validation'").select("as_of", "fold", "week_date")


def gate_rows(spark, sf):
    rows = out.realized_outcomes(views.dense_returns(spark, sf), views.universe(spark, sf), weeks=views.dense_weeks(spark, sf))
    return rows.selectExpr("ticker", "week_date", "return_1w", "return_4w", "return_13w", "raw_active_return_fwd as raw_active_return",
                           "stock_return_fwd as raw_stock_return", "active_return_fwd as active_return_train")


def gate_scores(rows):
    return views.as_models(rows, CANDIDATES).withColumnsRenamed({"model": "candidate", "prediction": "score"}).filter("score is not null")


def gate_weekly(spark, sf):
    """Three candidates on the validation folds of every as-of date with a full window."""
    weeks = views.dense_weeks(spark, sf)
    first = weeks.agg(F.min("week_date").alias("first"))
    dates = weeks.crossJoin(F.broadcast(first)).filter(F.date_sub("week_date", 7 * 259) >= F.col("first")).select(F.col("week_date").alias("as_of"))
    # The gate reads the weekly table several times: store it once.
    return cut_lineage(gt.shared_weekly(gate_scores(gate_rows(spark, sf)), gate_folds(dates), views.universe(spark, sf)))


# The gate has one set of dates, all of them; the longer name says so.
gate_weekly_all_dates = gate_weekly


@gated("g01_fold_validation", with_blocks("gmf glo", f"""select as_of, candidate, fold, n as return_weeks, {r('net')} as net_active_return, {r('ir')} as active_ir, {r('t')} as turnover from gmf
    join (select as_of, candidate, fold, avg(turnover) filter (i > 1) as t from (select *, row_number() over (partition by as_of, candidate, fold order by week_date) as i from glo) group by 1, 2, 3) using (as_of, candidate, fold)"""))
def _(spark, weekly):
    return rounded(gt.fold_metrics(weekly).select("as_of", "candidate", "fold", "return_weeks", "net_active_return", "active_ir", "turnover"))


BLOCKS.update(
    {
        "gpair": ("glo", """select c.as_of, c.candidate, c.fold, c.week_date, c.net - b.net as delta, row_number() over (partition by c.as_of, c.candidate, c.fold order by c.week_date) - 1 as i,
              count(*) over (partition by c.as_of, c.candidate, c.fold) as n from glo c join glo b on b.as_of = c.as_of and b.fold = c.fold and b.week_date = c.week_date and b.candidate = 'incumbent' where c.candidate <> 'incumbent'"""),
        # At the last date a week has no outcome yet, which makes the bound missing and its check fail.
        # Circular blocks of four weeks; a block's first week is a hash of its name.
        "gdraw": ("gpair", """select p.as_of, p.candidate, p.fold, rep, p.i, p.n, (('0x' || substr(md5(concat_ws('|', p.as_of, p.fold, rep, p.i // 4)), 1, 12))::bigint % p.n + p.i % 4) % p.n as at
              from gpair p cross join (select unnest(range(1, 501)) as rep)"""),
        "gboot": ("gdraw gpair", """select as_of, candidate, case when count(gain) = count(*) then quantile_cont(gain, 0.1) end as lower from (
              select d.as_of, d.candidate, rep, case when count(g.delta) = count(*) then 52 * sum(g.delta) / count(*) end as gain from gdraw d join gpair g on g.as_of = d.as_of and g.candidate = d.candidate and g.fold = d.fold and g.i = d.at group by all)
            group by 1, 2"""),
    }
)


@gated("g02_block_bootstrap", with_blocks("gboot", f"select as_of, candidate, {r('lower')} as lower_annual_gain from gboot"))
def _(spark, weekly):
    return rounded(gt.block_bootstrap(weekly, check=False))


GATE3 = """select m.as_of, m.candidate, m.ir - i.ir as ir_gain, m.net - i.net as net_gain, wins, worst, yrs from gm m join gm i on i.as_of = m.as_of and i.candidate = 'incumbent'
    join (select c.as_of, c.candidate, count(*) filter (c.ir - b.ir > 0) as wins, min(c.ir - b.ir) as worst from gmf c join gmf b on b.as_of = c.as_of and b.fold = c.fold and b.candidate = 'incumbent' group by 1, 2) f
      on f.as_of = m.as_of and f.candidate = m.candidate
    join (select c.as_of, c.candidate, count(*) filter (c.net - b.net > 0) as yrs from gmy c join gmy b on b.as_of = c.as_of and b.y = c.y and b.candidate = 'incumbent' group by 1, 2) y
      on y.as_of = m.as_of and y.candidate = m.candidate where m.candidate <> 'incumbent'"""


BLOCKS["gchk"] = ("gm gmf gmy gboot", f"""select *, c1 and c2 and c3 and c4 and c5 as ok from (select g.*, lower, ir_gain >= 0.1 as c1, net_gain >= 0.005 as c2, wins >= 3 as c3, worst >= -0.25 as c4, coalesce(lower > 0, false) as c5
    from ({GATE3}) g join gboot using (as_of, candidate))""")
GATE_COLUMNS = f"""{r('ir_gain')} as ir_gain, {r('net_gain')} as annualized_net_active_gain, wins as fold_ir_wins, {r('worst')} as worst_fold_ir_gain, yrs as positive_years, {r('lower')} as lower_annual_gain,
    c1 as ir_gain_at_least_0_10, c2 as annual_net_gain_at_least_0_5pct, c3 as fold_ir_wins_at_least_3, c4 as no_fold_ir_loss_below_0_25, c5 as bootstrap_lower_gain_positive, ok as eligible"""


@gated("g03_protection_gate", with_blocks("gchk", f"select as_of, candidate, {GATE_COLUMNS} from gchk"))
def _(spark, weekly):
    return rounded(gt.gate(weekly, gt.block_bootstrap(weekly, check=False)))


POSITIONS = "candidate string, position int"
WINNER = """select d.as_of, coalesce(w.candidate, 'incumbent') as selected from (select distinct as_of from gm) d left join (
    select c.as_of, arg_max(c.candidate, struct_pack(a := m.ir, b := m.net)) as candidate from gchk c join gm m using (as_of, candidate) where c.ok group by 1) w using (as_of)"""


@gated("g04_winner_choice", with_blocks("gm gchk", WINNER))
def _(spark, weekly):
    gates = gt.gate(weekly, gt.block_bootstrap(weekly, check=False))
    order = spark.createDataFrame([(c, i) for i, c in enumerate(CANDIDATES)], POSITIONS)
    return gt.choose_winner(gt.stitched_metrics(weekly), gates, order)


@gated("g04_winner_without_bootstrap", with_blocks("gm gchk", WINNER.replace("where c.ok", "where c.c3")))
def _(spark, weekly):
    """The same choice when the fold-win check alone decides, so that challengers win somewhere."""
    gates = gt.gate(weekly, gt.block_bootstrap(weekly, check=False)).withColumn("eligible", F.col("fold_ir_wins_at_least_3"))
    order = spark.createDataFrame([(c, i) for i, c in enumerate(CANDIDATES)], POSITIONS)
    return gt.choose_winner(gt.stitched_metrics(weekly), gates, order)


@query("g05_selected_scores", with_blocks("frame", f"""select m.ticker, m.week_date, case when year(m.week_date) % 2 = 0 then 'reversal' else 'incumbent' end as selected_candidate,
    {r('case when year(m.week_date) % 2 = 0 then v.prediction else m.prediction end')} as score from (select * from frame where model = 'momentum') m
    left join (select * from frame where model = 'reversal') v using (ticker, week_date)"""))
def _(spark, sf):
    rows = scored(spark, sf)
    base = rows.filter("model = 'momentum'").select(F.lit("trees").alias("model"), "week_date", "ticker", "score")
    other = rows.filter("model = 'reversal'").select(F.lit("trees").alias("model"), F.lit("reversal").alias("candidate"), "week_date", "ticker", "score")
    won = views.dense_weeks(spark, sf).select(
        F.lit("trees").alias("model"), "week_date", F.when(F.year("week_date") % 2 == 0, "reversal").otherwise("incumbent").alias("selected"))
    return rounded(gt.assemble_selected(base, other, won).select("ticker", "week_date", "selected_candidate", "score"))


@gated("g06_candidate_rows", with_blocks("gm gchk", f"""select m.as_of, m.candidate, {r('m.ir')} as active_ir, {r('m.net')} as net_active_return, w.selected = m.candidate as selected, m.candidate = 'incumbent' as incumbent,
    c.ok as gate_eligible, c.wins as fold_ir_wins, {r('c.lower')} as bootstrap_10pct_lower_annual_gain, c.yrs as positive_years,
    '{{"signal":"' || case m.candidate when 'incumbent' then 'return_4w' when 'reversal' then '0 - return_1w' else '0 - return_13w' end || '"}}' as params
    from gm m left join gchk c using (as_of, candidate) join w using (as_of)""", {"w": WINNER}))
def _(spark, weekly):
    gates = gt.gate(weekly, gt.block_bootstrap(weekly, check=False))
    metrics = gt.stitched_metrics(weekly)
    rows = [(i, c, {"signal": e}, {} if c == "incumbent" else {"signal": e}) for i, (c, e) in enumerate(CANDIDATES.items())]
    table = spark.createDataFrame(rows, "position int, candidate string, params map<string,string>, changed map<string,string>")
    winners = gt.choose_winner(metrics, gates, table.select("candidate", "position"))
    return rounded(gt.flatten_candidates(metrics, table, gates, winners).select(
        "as_of", "candidate", "active_ir", "net_active_return", "selected", "incumbent", "gate_eligible", "fold_ir_wins", "bootstrap_10pct_lower_annual_gain", "positive_years", "params"))
