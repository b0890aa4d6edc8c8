"""Queries over scores, outcomes, portfolios and metrics (Q, O, B, E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators import outcomes as out
from ..operators import portfolio as pf
from ..operators import retention as ret
from ..operators import scoring as sc
from . import views
from .inputs import final_events
from .registry import BLOCKS, query, r, rounded, trades_sql, with_blocks

MW = ["model", "week_date"]


def outcomes(spark, sf):
    """Returns of every ticker and week with what followed."""
    return out.realized_outcomes(views.dense_returns(spark, sf), views.universe(spark, sf), weeks=views.dense_weeks(spark, sf))


def frame(spark, sf):
    """Scored rows with outcomes; scores ride along with the returns, so the
    outcome side is never joined back to them."""
    rows = outcomes(spark, sf)
    columns = ["model", "ticker", "sector", "week_date", "prediction", "next_week_date", "stock_return_fwd",
               "sector_return_fwd", "raw_active_return_fwd", "active_return_fwd"]
    return views.as_models(rows, views.MODELS).select(*columns).filter("prediction is not null")


def scored(spark, sf):
    return frame(spark, sf).withColumnRenamed("prediction", "score")


def members(spark, sf):
    return sc.assign_quintiles(frame(spark, sf), highest_first=True, layout=views.universe(spark, sf))


def cols(names, alias=""):
    return ", ".join(f"{r(alias + n)} as {n}" for n in names)


IR = "case when stddev_samp({x}) > 0 then sqrt(52) * avg({x}) / stddev_samp({x}) end"
BLOCKS.update(
    {
        "quint": ("ranked", "select *, case when n >= 5 then ((place - 1) * 5 // n + 1)::int end as quintile from ranked"),
        "qperf0": ("quint", """select model, week_date, quintile, any_value(next_week_date) as next_week_date, count(*) as holdings,
              count(*) filter (stock_return_fwd is not null and sector_return_fwd is not null and raw_active_return_fwd is not null) as observed_holdings,
              avg(prediction) as mean_prediction, avg(active_return_fwd) as z, avg(stock_return_fwd) as p, avg(sector_return_fwd) as b, avg(raw_active_return_fwd) as a
            from quint where quintile is not null group by 1, 2, 3"""),
        "qperf": ("qperf0", """select model, week_date, quintile, next_week_date, holdings, observed_holdings, mean_prediction, ok as complete,
              case when ok then z end as mean_forward_zscore, case when ok then p end as portfolio_return, case when ok then b end as benchmark_return, case when ok then a end as active_return
            from (select *, bool_and(holdings = observed_holdings) over (partition by model, week_date) as ok from qperf0)"""),
        "qcum": ("qperf", """select *, case when bad = 0 then pw - 1 end as cumulative_portfolio_return, case when bad = 0 then bw - 1 end as cumulative_benchmark_return,
              case when bad = 0 then aw - 1 end as compounded_active_spread, case when bad = 0 then asum end as cumulative_active_return,
              case when bad = 0 then pw - bw end as cumulative_excess_return, case when bad = 0 then pw / bw - 1 end as relative_wealth_return
            from (select *, count(*) filter (active_return is null) over w as bad, product(1 + portfolio_return) over w as pw, product(1 + benchmark_return) over w as bw,
              product(1 + active_return) over w as aw, sum(active_return) over w as asum from qperf window w as (partition by model, quintile order by week_date))"""),
        # Long/short legs and their trades.
        "lspos": ("ranked", """select model, week_date, ticker, raw_active_return_fwd as a,
              case when (place - 1) * 5 // n = 0 then 1.0::double / ceil(n / 5) else -1.0::double / floor(n / 5) end as w
            from ranked where n >= 5 and ((place - 1) * 5 // n in (0, 4))"""),
        # Weeks below five names hold nothing and break the turnover chain.
        "lsdates": ("lspos", """select model, week_date, lag(week_date) over w as prev_week, lead(week_date) over w as next_week
            from (select distinct model, week_date from lspos) window w as (partition by model order by week_date)"""),
        "lstr": ("lspos lsdates", trades_sql("lspos", "lsdates")),
        "lsweek": ("lspos lstr lsdates", """select g.model, g.week_date, gross_return, case when k.week_date - k.prev_week = 7 then traded / 2 end as turnover,
              coalesce(case when k.week_date - k.prev_week = 7 then traded / 2 end, 1) as cost_turnover
            from (select model, week_date, avg(a) filter (w > 0) - avg(a) filter (w < 0) as gross_return from lspos group by 1, 2) g
            join lsdates k using (model, week_date) join lstr using (model, week_date)"""),
        # Exact top 20% book and its weekly evaluation.
        "book": ("ranked", "select model, week_date, ticker, place, ceil(0.2::double * n)::int as n_hold, 1.0::double / ceil(0.2::double * n) as w from ranked where n >= 5 and place <= ceil(0.2::double * n)"),
        "booktr": ("book mweeks", trades_sql("book", "mweeks")),
        "lo": ("book frame booktr mweeks", """select model, week_date, coalesce(holdings, 0) as holdings, gs as gross_stock_return, ga as gross_active_return, gs - 0.0005::double * d as net_stock_return, ga - 0.0005::double * d as net_active_return,
              0.0005::double * d as transaction_cost, d / 2 as turnover, ga is not null as complete
            from mweeks left join (select model, week_date, count(*) as holdings, case when count(raw_active_return_fwd) = count(*) then sum(w * raw_active_return_fwd) end as ga,
                case when count(stock_return_fwd) = count(*) then sum(w * stock_return_fwd) end as gs, sum(w) as gross from book join frame using (model, week_date, ticker) group by 1, 2) s using (model, week_date)
            left join (select k.model, k.week_date, case when k.week_date - k.prev_week = 7 then traded end as tr from mweeks k join booktr using (model, week_date)) t using (model, week_date)
            cross join lateral (select case when gross is not null then coalesce(tr, gross) end as d)"""),
        "dcg50": ("lab", """select model, week_date, max(n) as n, count(active_return_fwd) as seen,
              sum(label / log2(place + 1)) filter (place <= least(50, n)) as dcg, sum(label / log2(n + 1 - frst + 1)) filter (n + 1 - frst <= least(50, n)) as ideal,
              case when min(rs) < max(rs) and min(rt) < max(rt) then corr(rt, rs) end as ic from lab group by 1, 2"""),
        "cap": ("lab book", """select model, week_date, case when n >= 5 then count(*) filter (best <= ceil(0.2::double * n) and w is not null) / count(*) filter (best <= ceil(0.2::double * n)) end as capture
            from (select model, week_date, ticker, n, row_number() over (partition by model, week_date order by active_return_fwd desc nulls last, ticker) as best from lab)
            left join book using (model, week_date, ticker) group by 1, 2, n"""),
        "lorank": ("dcg50 cap", """select model, week_date, case when n = seen then capture end as q1_capture, case when n = seen then ic end as rank_ic,
              case when n = seen and ideal > 0 then dcg / ideal end as ndcg_at_50 from dcg50 join cap using (model, week_date)"""),
        "lofull": ("lo lorank", "select * from lo left join lorank using (model, week_date)"),
        "lsy": ("lab", """select model, week_date, max(n) as n_scored, count(active_return_fwd) as n_observed,
              {d} as ls_d, {i} as ls_i, {sd} as sh_d, {si} as sh_i,
              avg(active_return_fwd) filter (place <= ceil(0.2::double * n)) - avg(active_return_fwd) filter (place > n - ceil(0.2::double * n)) as spread,
              case when min(rs) < max(rs) and min(rt) < max(rt) then corr(rt, rs) end as ic from lab group by 1, 2""".format(
            d="sum(label / log2(place + 1)) filter (place <= ceil(n / 5))",
            i="sum(label / log2(n + 1 - frst + 1)) filter (n + 1 - frst <= ceil(n / 5))",
            sd="sum((4 - label) / log2(n + 1 - place + 1)) filter (n + 1 - place <= ceil(n / 5))",
            si="sum((4 - label) / log2(frst + 1)) filter (frst <= ceil(n / 5))")),
        "lsn": ("lsy", """select *, n_scored = n_observed as whole, case when ls_i > 0 then ls_d / ls_i else 0 end as l, case when sh_i > 0 then sh_d / sh_i else 0 end as s from lsy"""),
        "kpos": ("ranked", """select model, week_date, ticker, case when place <= ceil(0.2::double * n) then 1 else -1 end / ceil(0.2::double * n) as w from ranked
            where n >= 2 and (place <= ceil(0.2::double * n) or place > n - ceil(0.2::double * n))"""),
        "ktr": ("kpos mweeks", trades_sql("kpos", "mweeks")),
        "evw": ("lsn ktr mweeks", """select model, week_date, n_scored, n_observed, case when whole then l end as long_ndcg, case when whole then s end as short_ndcg,
              case when whole then (l + s) / 2 end as ls_ndcg, case when whole then spread end as q1_q5_spread, case when whole then ic end as spearman,
              case when k.week_date - k.prev_week = 7 then traded / 2 end as turnover
            from lsn join mweeks k using (model, week_date) left join ktr using (model, week_date)"""),
        "cmp0": ("dcg50 lsweek quint", """select model, week_date, d.n as scored_stocks, least(50, d.n) as effective_ndcg_k, case when d.n >= 5 and d.n = seen then ic end as rank_ic,
              case when d.n >= 5 and d.n = seen then case when ideal > 0 then dcg / ideal else 0 end end as ndcg_at_50,
              case when d.n = obs then act end as q1_q5_active_return, case when d.n = obs then stk end as q1_q5_stock_return, turnover
            from dcg50 d left join lsweek using (model, week_date) join (select model, week_date, count(*) filter (stock_return_fwd is not null and sector_return_fwd is not null and raw_active_return_fwd is not null) as obs,
              avg(raw_active_return_fwd) filter (quintile = 1) - avg(raw_active_return_fwd) filter (quintile = 5) as act,
              avg(stock_return_fwd) filter (quintile = 1) - avg(stock_return_fwd) filter (quintile = 5) as stk from quint group by 1, 2) using (model, week_date)"""),
        "cmpw": ("cmp0", """select *, count(*) filter (rank_ic is not null and ndcg_at_50 is not null) over d = m as common_ranking_week,
              count(*) filter (q1_q5_active_return is not null and q1_q5_stock_return is not null) over d = m as common_returns_week, count(*) filter (turnover is not null) over d = m as common_turnover_week
            from cmp0 cross join (select count(distinct model) as m from cmp0) window d as (partition by week_date)"""),
    }
)

# --- Q: membership ------------------------------------------------------------


@query("q01_same_date_scoring", with_blocks("rets", f"""select 'linear' as model, ticker, sector, week_date, week_date as model_as_of,
    {r("case when return_1w is not null and return_4w is not null then a + b * return_1w + c * return_4w end")} as prediction
    from rets join (select week_date, avg(return_1w) as a, coalesce(max(return_1w), 0) as b, coalesce(min(return_4w), 0) as c from rets group by 1 having avg(return_1w) is not null) using (week_date)"""))
def _(spark, sf):
    rets = views.dense_returns(spark, sf)
    models = rets.groupBy("week_date").agg(
        F.avg("return_1w").alias("intercept"),
        F.array(F.coalesce(F.max("return_1w"), F.lit(0.0)), F.coalesce(F.min("return_4w"), F.lit(0.0))).alias("coefficients"),
    ).filter("intercept is not null")
    return rounded(sc.linear_scores(rets, models, ["return_1w", "return_4w"], "linear"))


@query("q02_quintiles", with_blocks("scores", """select model, ticker, week_date, case when n >= 5 and prediction is not null then ((p - 1) * 5 // n + 1)::int end as quintile from (
    select *, row_number() over (partition by model, week_date order by prediction nulls last, ticker) as p, count(prediction) over (partition by model, week_date) as n from scores)"""))
def _(spark, sf):
    return sc.assign_quintiles(views.scores(spark, sf), layout=views.universe(spark, sf)).select("model", "ticker", "week_date", "quintile")


@query("q02_quintiles_by_sector", with_blocks("scores", """select model, ticker, sector, week_date, case when n >= 5 and prediction is not null then ((p - 1) * 5 // n + 1)::int end as quintile from (
    select *, row_number() over (partition by model, week_date, sector order by prediction desc nulls last, ticker) as p, count(prediction) over (partition by model, week_date, sector) as n from scores)"""))
def _(spark, sf):
    return sc.assign_quintiles(views.scores(spark, sf), scope="sector", highest_first=True, layout=views.universe(spark, sf)).select(
        "model", "ticker", "sector", "week_date", "quintile")


@query("q03_predicted_ranks", with_blocks("ranked", f"""select model, ticker, week_date, place::int as predicted_rank,
    {r("(rank() over (partition by model, week_date order by prediction) + (count(*) over (partition by model, week_date, prediction) - 1) / 2.0) / n")} as predicted_percentile from ranked"""))
def _(spark, sf):
    return rounded(sc.predicted_ranks(frame(spark, sf), views.universe(spark, sf)).select("model", "ticker", "week_date", "predicted_rank", "predicted_percentile"))


@query("q04_selection_flags", with_blocks("ranked", """select model, ticker, week_date, n >= 2 and place <= ceil(0.2::double * n) as long_selected,
    n >= 2 and place > n - ceil(0.2::double * n) as short_selected from ranked"""))
def _(spark, sf):
    return sc.selection_flags(frame(spark, sf), layout=views.universe(spark, sf)).select("model", "ticker", "week_date", "long_selected", "short_selected")


@query("q05_ground_truth_ranks", with_blocks("frame", """select model, ticker, week_date, ok as ground_truth_complete_week, case when ok then rk end as ground_truth_rank from (select *,
    bool_and(active_return_fwd is not null) over (partition by model, week_date) as ok,
    (rank() over (partition by model, week_date order by active_return_fwd desc nulls last) + (count(*) over (partition by model, week_date, active_return_fwd) - 1) / 2.0)::double as rk from frame)"""))
def _(spark, sf):
    return sc.ground_truth_ranks(frame(spark, sf), layout=views.universe(spark, sf)).select(
        "model", "ticker", "week_date", "ground_truth_complete_week", "ground_truth_rank")


@query("q07_universe_differences", with_blocks("frame px", """select * from (select coalesce(a.model, b.model) as model, coalesce(a.week_date, b.week_date) as week_date, coalesce(a.ticker, b.ticker) as ticker,
      case when a.ticker is null then 'not_scored' when b.ticker is null then 'not_in_panel' end as problem from a full join b on a.model = b.model and a.week_date = b.week_date and a.ticker = b.ticker) where problem is not null""", {
    "a": "select distinct model, week_date, ticker from frame",
    "b": "select distinct k.model, p.week_date, p.ticker from px p join (select distinct model, week_date from frame) k using (week_date)"}))
def _(spark, sf):
    return sc.universe_differences(frame(spark, sf), views.px_weekly(spark, sf))


@query("q08_replay_differences", with_blocks("scores", f"""select model, week_date, ticker, {r('prediction')} as first, {r('prediction * (1 + 1e-9) + 1e-6')} as second from scores
    where prediction is not null and abs(prediction - (prediction * (1 + 1e-9) + 1e-6)) > 1e-11 + 1e-10 * abs(prediction * (1 + 1e-9) + 1e-6) and week_date >= date '2001-01-01'"""))
def _(spark, sf):
    a = views.scores(spark, sf)
    moved = F.when(F.col("week_date") >= "2001-01-01", F.col("prediction") * (1 + 1e-9) + 1e-6).otherwise(F.col("prediction"))
    return rounded(sc.replay_differences(a, a.withColumn("prediction", moved)))


# --- O: outcomes --------------------------------------------------------------

FWD = ["stock_return_fwd", "sector_return_fwd", "raw_active_return_fwd"]


@query("o01_forward_returns", with_blocks("fwd", f"select ticker, sector, week_date, next_week_date, {cols(FWD)} from fwd"))
def _(spark, sf):
    df = out.forward_returns(views.dense_returns(spark, sf), views.universe(spark, sf), views.dense_weeks(spark, sf))
    return rounded(df.select("ticker", "sector", "week_date", "next_week_date", *FWD))


@query("o02_return_provenance", with_blocks("fwd", "select week_date, case when stock_return_fwd is not null then 'raw_feature_snapshot' else 'unobserved' end as return_source, count(*) as n_rows from fwd group by all"))
def _(spark, sf):
    df = out.forward_returns(views.dense_returns(spark, sf), views.universe(spark, sf), views.dense_weeks(spark, sf))
    return df.groupBy("week_date", "return_source").agg(F.count(F.lit(1)).alias("n_rows"))


@query("o03_event_terminal_value", with_blocks("fwd rets", f"""select f.ticker, f.week_date, {r('case when hit then cash else f.stock_return_fwd end')} as stock_return_fwd,
    {r('case when hit then b.m else f.sector_return_fwd end')} as sector_return_fwd, {r('case when hit then cash - b.m else f.raw_active_return_fwd end')} as raw_active_return_fwd,
    case when hit then 'cash_acquisition' when f.stock_return_fwd is not null then 'raw_feature_snapshot' else 'unobserved' end as return_source
    from fwd f left join (select ticker, max(week_date) as week_date, arg_max(adj_close, week_date) as c from dense group by 1) e on e.ticker = f.ticker and e.week_date = f.week_date and f.next_week_date = e.week_date + 7
    left join (select week_date, sector, avg(return_1w) as m from rets group by 1, 2) b on b.week_date = f.next_week_date and b.sector = f.sector
    cross join lateral (select e.ticker is not null and f.stock_return_fwd is null as hit, e.c * 1.1::double / e.c - 1 as cash)"""))
def _(spark, sf):
    rets = views.dense_returns(spark, sf)
    done = out.apply_events(out.forward_returns(rets, views.universe(spark, sf), views.dense_weeks(spark, sf)), rets, final_events(spark, sf))
    return rounded(done.select("ticker", "week_date", *FWD, "return_source"))


@query("o03_event_violations", with_blocks("fwd", """select ticker, week_date, 'overwrites_observed_return' as problem from fwd where stock_return_fwd is not null and week_date = date '1999-06-02'"""))
def _(spark, sf):
    rets = views.dense_returns(spark, sf)
    fwd = out.forward_returns(rets, views.universe(spark, sf), views.dense_weeks(spark, sf))
    wrong = rets.filter("week_date = '1999-06-02'").select(
        "ticker", "week_date", F.date_add("week_date", 7).alias("next_week_date"), F.date_add("week_date", 3).alias("event_date"),
        F.lit("cash_acquisition").alias("event_type"), F.col("adj_close").alias("cash_per_share"), F.col("adj_close").alias("start_close"))
    return out.event_violations(fwd, rets, wrong)


@query("o04_outcomes_after_membership", with_blocks("quint", f"select model, ticker, week_date, quintile, {cols(FWD)} from quint"))
def _(spark, sf):
    fixed = sc.assign_quintiles(views.scores(spark, sf), highest_first=True, layout=views.universe(spark, sf)).filter("prediction is not null").select(
        "model", "ticker", "week_date", "quintile")
    fwd = out.forward_returns(views.dense_returns(spark, sf), views.universe(spark, sf), views.dense_weeks(spark, sf)).select("ticker", "week_date", *FWD)
    return rounded(out.attach_outcomes(fixed, fwd))


# --- B: portfolios ------------------------------------------------------------

PERF = ["mean_prediction", "mean_forward_zscore", "portfolio_return", "benchmark_return", "active_return"]
CUM = ["cumulative_active_return", "compounded_active_spread", "cumulative_portfolio_return", "cumulative_benchmark_return", "cumulative_excess_return", "relative_wealth_return"]


@query("b01_quintile_performance", with_blocks("qperf", f"select model, week_date, quintile, next_week_date, holdings, observed_holdings, {cols(PERF)}, complete from qperf"))
def _(spark, sf):
    return rounded(pf.quintile_performance(members(spark, sf)))


@query("b02_cumulative_series", with_blocks("qcum", f"select model, week_date, quintile, {cols(CUM)} from qcum"))
def _(spark, sf):
    return rounded(pf.cumulative_series(pf.quintile_performance(members(spark, sf))).select("model", "week_date", "quintile", *CUM))


@query("b03_endpoints", with_blocks("qcum", f"""select model, quintile, week_date, next_week_date, holdings, {cols(CUM)} from (
    select *, row_number() over (partition by model, quintile order by week_date desc) as rn from qcum where cumulative_active_return is not null) where rn = 1"""))
def _(spark, sf):
    done = pf.endpoints(pf.cumulative_series(pf.quintile_performance(members(spark, sf))))
    return rounded(done.select("model", "quintile", "week_date", "next_week_date", "holdings", *CUM))


def long_short(spark, sf):
    return pf.long_short_weekly(scored(spark, sf), active="raw_active_return_fwd", layout=views.universe(spark, sf))


@query("b04_long_short_weekly", with_blocks("lsweek", f"select model, week_date, {cols(['gross_return', 'turnover', 'cost_turnover'])} from lsweek"))
def _(spark, sf):
    return rounded(long_short(spark, sf))


COSTS = ["annualized_return", "information_ratio", "cumulative_return", "max_drawdown", "mean_weekly_turnover"]


def costs_sql(source, gross="gross_return", turn="cost_turnover"):
    net = f"{gross} - 2.0::double * cost_bps / 10000 * {turn}"
    ir = IR.format(x="net")
    return f"""select model, cost_bps, {r('52 * avg(net)')} as annualized_return, {r(ir)} as information_ratio,
      {r('arg_max(wealth, week_date) - 1')} as cumulative_return, {r('min(wealth / greatest(peak, 1) - 1)')} as max_drawdown, {r('avg(t)')} as mean_weekly_turnover, count(*) as return_weeks
      from (select *, max(wealth) over (partition by model, cost_bps order by week_date) as peak from (
        select *, product(1 + net) over (partition by model, cost_bps order by week_date) as wealth from (
          select model, week_date, cost_bps, {turn} as t, {net} as net from {source} cross join (select unnest([0, 5, 10, 25]) as cost_bps)))) group by 1, 2"""


@query("b05_cost_scenarios", with_blocks("lsweek", costs_sql("(select * from lsweek where gross_return is not null)")))
def _(spark, sf):
    return rounded(pf.cost_scenarios(long_short(spark, sf).filter("gross_return is not null")))


@query("b06_target_weights", with_blocks("book", f"select model, week_date, ticker, place::int as rank, n_hold, {r('w')} as weight from book"))
def _(spark, sf):
    return rounded(pf.target_weights(scored(spark, sf), layout=views.universe(spark, sf)))


# Week by week: the book of one week decides what the next one keeps.
BOOKS = {
    "ordered": """select model, week_date, row_number() over (partition by model order by week_date) as i, names, n, case when n >= 5 then ceil(0.2::double * n)::int else 0 end as n_hold
        from (select model, week_date, list(ticker order by place) as names, max(n) as n from ranked group by 1, 2)""",
    "reach": "select *, names[1:ceil({buffer} * n)::int] as inside from ordered",
    "walk": """with recursive w as (select model, 0::bigint as i, []::bigint[] as held from (select distinct model from reach) union all
        select r.model, r.i, list_filter(r.inside, lambda x: list_contains(r.keep, x) or list_contains(list_filter(r.names[1:r.n_hold], lambda y: not list_contains(r.keep, y))[1:r.n_hold - len(r.keep)], x)) as held
        from (select r.*, list_filter(r.inside, lambda x: list_contains(w.held, x))[1:r.n_hold] as keep from w join reach r on r.model = w.model and r.i = w.i + 1) r) select * from w""",
}
# The buffer that each year's weeks use where it is chosen by date.
CHOSEN_BUFFERS = (0.20, 0.25, 0.30)
CHOSEN_SQL = f"(case year(week_date) % 3 " + " ".join(f"when {i} then {b}::double" for i, b in enumerate(CHOSEN_BUFFERS)) + " end)"


def buffered(spark, sf, variant):
    buffer, weighted = ret.VARIANTS[variant]
    by_week = None
    if buffer is None:
        choice = F.element_at(F.array(*[F.lit(b) for b in CHOSEN_BUFFERS]), F.year("week_date") % 3 + 1)
        by_week, buffer = views.dense_weeks(spark, sf).select("week_date", choice.alias("buffer")), 0.20
    return ret.buffered_holdings(scored(spark, sf), buffer=buffer, buffer_by_week=by_week, rank_weighted=weighted, layout=views.universe(spark, sf))


for name, (share, weighted) in ret.VARIANTS.items():
    books = {k: sql.replace("{buffer}", CHOSEN_SQL if share is None else f"{share}::double") for k, sql in BOOKS.items()}
    weight = "case when n_hold > 1 then 1.25 - 0.5::double * (slot - 1) / (n_hold - 1) else 1 end / n_hold" if weighted else "1.0::double / n_hold"
    sql = with_blocks("ranked", f"""select model, week_date, ticker, slot::int as slot, n_hold, {r(weight)} as weight
        from (select model, i, unnest(held) as ticker, generate_subscripts(held, 1) as slot from walk) join ordered using (model, i)""", books)
    for full in [f"b07_{name}", *(["b07_retention_buffer"] if name == "buffer_20_30" else [])]:
        query(full, sql)(lambda spark, sf, name=name: rounded(buffered(spark, sf, name).select("model", "week_date", "ticker", "slot", "n_hold", "weight")))


@query("b08_rank_weighted", with_blocks("book", f"""select model, week_date, ticker, {r('case when n_hold > 1 then 1.25 - 0.5 * (place - 1) / (n_hold - 1) else 1 end / n_hold')} as weight from book"""))
def _(spark, sf):
    book = pf.target_weights(scored(spark, sf), rank_weighted=True, layout=views.universe(spark, sf))
    return rounded(book.select("model", "week_date", "ticker", "weight"))


LO = ["gross_stock_return", "gross_active_return", "net_stock_return", "net_active_return", "transaction_cost", "turnover"]
RANKS = ["q1_capture", "rank_ic", "ndcg_at_50"]


def long_only(spark, sf):
    return ev.evaluate_exact_q1(scored(spark, sf), active="raw_active_return_fwd", stock="stock_return_fwd", target="active_return_fwd",
                                layout=views.universe(spark, sf))


@query("b09_long_only_weekly", with_blocks("lofull", f"select model, week_date, holdings, {cols(LO)}, complete, {cols(RANKS)} from lofull"))
def _(spark, sf):
    return rounded(long_only(spark, sf))


METRICS = {
    "annualized_stock_return": "case when count(gross_stock_return) = count(*) then 52 * avg(gross_stock_return) end",
    "annualized_net_stock_return": "case when count(net_stock_return) = count(*) then 52 * avg(net_stock_return) end",
    "annualized_active_return": "52 * avg(gross_active_return)",
    "net_active_return": "52 * avg(net_active_return)",
    "active_ir": IR.format(x="net_active_return"),
}


B10_SQL = "select m.*, t.turnover from (select model, count(*) as return_weeks, " + ", ".join(f"{r(e)} as {n}" for n, e in METRICS.items()) + f""",
    {r('sum(net_active_return)')} as net_cumulative_active_return, {r('avg(q1_capture)')} as q1_capture, {r('avg(rank_ic)')} as rank_ic, {r('avg(ndcg_at_50)')} as ndcg_at_50,
    {r('52 * avg(transaction_cost)')} as annualized_transaction_cost, {r('sum(transaction_cost)')} as total_transaction_cost,
    {r('min(wealth / greatest(peak, 1) - 1)')} as max_drawdown, {r('pow(arg_max(wealth, week_date), 52.0 / count(*)) - 1')} as net_stock_cagr
    from (select *, max(wealth) over (partition by model order by week_date) as peak from (select *, product(1 + net_stock_return) over (partition by model order by week_date) as wealth from lofull where complete)) group by 1) m
    join (select model, {r('avg(turnover)')} as turnover from (select *, row_number() over (partition by model order by week_date) as i from lofull) where i > 1 group by 1) t using (model)"""


@query("b10_portfolio_metrics", with_blocks("lofull", B10_SQL))
def _(spark, sf):
    return rounded(pf.portfolio_metrics(long_only(spark, sf)))


@query("b11_yearly_performance", with_blocks("lofull", "select model, year(week_date)::int as year, count(*) as weeks, " + ", ".join(f"{r(e)} as {n}" for n, e in METRICS.items()) + " from lofull where complete group by 1, 2"))
def _(spark, sf):
    return rounded(pf.yearly_performance(long_only(spark, sf)))


@query("b12_sub_buckets", with_blocks("book frame mweeks", f"""select model, week_date, subbucket, coalesce(h, 0) as holdings, {r('a')} as active_return, {r('s')} as stock_return
    from mweeks cross join (select unnest([1, 2, 3, 4, 5]) as subbucket) left join (select model, week_date, ((place - 1) * 5 // n_hold + 1)::int as subbucket, count(*) as h,
      case when count(raw_active_return_fwd) = count(*) then avg(raw_active_return_fwd) end as a, case when count(stock_return_fwd) = count(*) then avg(stock_return_fwd) end as s
      from book join frame using (model, week_date, ticker) group by 1, 2, 3) using (model, week_date, subbucket)"""))
def _(spark, sf):
    return rounded(pf.sub_buckets(scored(spark, sf), active="raw_active_return_fwd", stock="stock_return_fwd", layout=views.universe(spark, sf)))


@query("b13_long_only_net_ir", with_blocks("book frame booktr", f"""select model, {r("coalesce(" + IR.format(x='net') + ", -1e6)")} as net_ir from (
    select model, week_date, avg(raw_active_return_fwd) - 0.0005::double * any_value(traded) as net from book join frame using (model, week_date, ticker) join booktr using (model, week_date) group by 1, 2) group by 1"""))
def _(spark, sf):
    return rounded(pf.long_only_net_ir(scored(spark, sf), active="raw_active_return_fwd", layout=views.universe(spark, sf)))


@query("b13_long_short_net_ir", with_blocks("lsweek", f"""select model, {r("coalesce(" + IR.format(x='(gross_return - 0.002::double * cost_turnover)') + ", -1e6)")} as net_ir from lsweek group by 1"""))
def _(spark, sf):
    return rounded(pf.long_short_net_ir(scored(spark, sf), active="raw_active_return_fwd", layout=views.universe(spark, sf)))


def by_status(spark, sf):
    """The two models read as two statuses of one model."""
    weekly = long_only(spark, sf)
    status = F.when(F.col("model") == "momentum", "incumbent").otherwise("protected_selection")
    return weekly.withColumn("status", status).withColumn("model", F.lit("trees"))


@query("b14_change_versus_incumbent", with_blocks("lofull", f"""select 'trees' as model, case when s.model = 'momentum' then 'incumbent' else 'protected_selection' end as status, {r('ir')} as active_ir, {r('net')} as net_active_return,
    {r('ir - bir')} as ir_change_vs_incumbent, {r('net - bnet')} as annual_net_active_change_vs_incumbent from (select model, {METRICS['active_ir']} as ir, 52 * avg(net_active_return) as net from lofull where complete group by 1) s
    cross join (select {METRICS['active_ir']} as bir, 52 * avg(net_active_return) as bnet from lofull where complete and model = 'momentum')"""))
def _(spark, sf):
    metrics = pf.portfolio_metrics(by_status(spark, sf), ["model", "status"])
    done = pf.change_versus_baseline(metrics)
    return rounded(done.select("model", "status", "active_ir", "net_active_return", "ir_change_vs_incumbent", "annual_net_active_change_vs_incumbent"))


# --- E: metrics ---------------------------------------------------------------

ERRORS = ["mse", "rmse", "mae", "r2", "pearson_ic", "spearman_ic", "zero_baseline_mse"]
E1 = """select {k}, count(a) as n, avg((a - p) * (a - p)) as mse, sqrt(avg((a - p) * (a - p))) as rmse, avg(abs(a - p)) as mae,
    case when count(a) > 1 and var_pop(a) > 0 then 1 - avg((a - p) * (a - p)) / var_pop(a) end as r2, case when count(a) > 1 and var_pop(a) > 0 and var_pop(p) > 0 then corr(a, p) end as pearson_ic,
    case when count(a) > 1 and var_pop(a) > 0 and var_pop(p) > 0 then corr(ra, rp) filter (a is not null) end as spearman_ic, avg(a * a) as zero_baseline_mse from (
      select *, rank() over (partition by {k} order by a nulls last) + (count(*) over (partition by {k}, a) - 1) / 2.0 as ra, rank() over (partition by {k} order by p nulls last) + (count(*) over (partition by {k}, p) - 1) / 2.0 as rp
      from (select *, case when active_return_fwd is not null then prediction end as p, case when prediction is not null then active_return_fwd end as a from frame)) group by {k}"""
BLOCKS["regw"] = ("frame", E1.format(k="model, week_date"))
BLOCKS["regm"] = ("frame", E1.format(k="model").replace("from frame)", "from (select * replace (round(active_return_fwd, 9) as active_return_fwd) from frame))"))


@query("e01_regression_metrics_weekly", with_blocks("regw", f"select model, week_date, n, {cols(ERRORS)} from regw"))
def _(spark, sf):
    return rounded(ev.regression_metrics(frame(spark, sf), MW, layout=views.universe(spark, sf)))


@query("e01_regression_metrics_total", with_blocks("regm", f"select model, n, {cols(ERRORS)} from regm"))
def _(spark, sf):
    # A whole model history is one group: its size is measured, not assumed.
    # Scores equal up to float noise in different weeks must tie.
    rows = frame(spark, sf).withColumn("active_return_fwd", F.round("active_return_fwd", 9))
    return rounded(ev.regression_metrics(rows, ["model"]))


@query("e02_ic_statistics", with_blocks("regw", f"""select model, {r('avg(spearman_ic)')} as mean_weekly_ic, {r('stddev_samp(spearman_ic)')} as weekly_ic_std,
    {r('avg((spearman_ic > 0)::int)')} as positive_weekly_ic_fraction, count(spearman_ic) as ic_weeks from regw group by 1"""))
def _(spark, sf):
    return rounded(ev.ic_statistics(ev.regression_metrics(frame(spark, sf), MW, layout=views.universe(spark, sf))))


@query("e03_ndcg_at_50", with_blocks("dcg50", f"select model, week_date, n as n_scored, {r('case when n = seen then case when ideal > 0 then dcg / ideal else 0 end end')} as ndcg from dcg50"))
def _(spark, sf):
    return rounded(ev.ndcg_at(frame(spark, sf), 50, layout=views.universe(spark, sf)))


@query("e04_symmetric_ndcg", with_blocks("lsn", f"select model, week_date, n_scored, {r('case when whole then l end')} as long_ndcg, {r('case when whole then s end')} as short_ndcg, {r('case when whole then (l + s) / 2 end')} as ls_ndcg from lsn"))
def _(spark, sf):
    return rounded(ev.symmetric_ndcg(frame(spark, sf), layout=views.universe(spark, sf)))


EVAL = ["long_ndcg", "short_ndcg", "ls_ndcg", "q1_q5_spread", "spearman", "turnover"]


def weekly_evaluation(spark, sf):
    return ev.evaluate_scores(frame(spark, sf), layout=views.universe(spark, sf))


@query("e05_weekly_evaluation", with_blocks("evw", f"select model, week_date, n_scored, n_observed, {cols(EVAL)} from evw"))
def _(spark, sf):
    return rounded(weekly_evaluation(spark, sf))


SUM6 = ", ".join(f"{r(f'avg({c})')} as mean_{c}" for c in ev.SUMMARY) + f", {r(IR.format(x='q1_q5_spread'))} as q1_q5_information_ratio, count(ls_ndcg) as n_groups"


@query("e06_metric_summary", with_blocks("evw", f"select model, {SUM6} from evw group by 1"))
def _(spark, sf):
    return rounded(ev.summarize_metrics(weekly_evaluation(spark, sf)))


@query("e07_q1_capture", with_blocks("lorank", f"select model, week_date, {cols(RANKS)} from lorank"))
def _(spark, sf):
    return rounded(ev.weekly_rank_metrics(scored(spark, sf), target="active_return_fwd", layout=views.universe(spark, sf)))


CMP = ["rank_ic", "ndcg_at_50", "q1_q5_active_return", "q1_q5_stock_return", "turnover"]


def comparison(spark, sf):
    return ev.comparative_weekly(frame(spark, sf), views.universe(spark, sf))


@query("e08_comparative_weekly", with_blocks("cmpw", f"select model, week_date, scored_stocks, effective_ndcg_k, {cols(CMP)}, common_ranking_week, common_returns_week, common_turnover_week from cmpw"))
def _(spark, sf):
    return rounded(comparison(spark, sf))


E8_SUMMARY_SQL = f"""select model, {r('avg(ic)')} as rank_ic, {r('avg(nd)')} as ndcg_at_50, {r('52 * avg(ac)')} as q1_q5_annualized_return, {r(IR.format(x='ac'))} as q1_q5_annualized_ir,
    {r('avg(tu)')} as mean_weekly_turnover, {r('52 * avg(st)')} as q1_q5_annualized_stock_return, {r(IR.format(x='st'))} as q1_q5_annualized_stock_ir, count(ic) as ranking_weeks, count(ac) as return_weeks, count(tu) as turnover_observations
    from (select model, case when common_ranking_week then rank_ic end as ic, case when common_ranking_week then ndcg_at_50 end as nd, case when common_returns_week then q1_q5_active_return end as ac,
      case when common_returns_week then q1_q5_stock_return end as st, case when common_turnover_week then turnover end as tu from cmpw) group by 1"""


@query("e08_comparative_summary", with_blocks("cmpw", E8_SUMMARY_SQL))
def _(spark, sf):
    return rounded(ev.comparative_summary(comparison(spark, sf)))


@query("e08_comparative_costs", with_blocks("cmpw", costs_sql("(select model, week_date, q1_q5_active_return as g, coalesce(turnover, 1) as ct from cmpw where common_returns_week)", "g", "ct")))
def _(spark, sf):
    return rounded(ev.comparative_costs(comparison(spark, sf)))


@query("e09_fold_metrics", with_blocks("evw", "select model, " + ", ".join(f"{r(f'avg({c})')} as {c}" for c in (*[f"mean_{c}" for c in ev.SUMMARY], "q1_q5_information_ratio")) + """, sum(n_groups)::bigint as n_groups
    from (select model, year(week_date) as fold, """ + ", ".join(f"avg({c}) as mean_{c}" for c in ev.SUMMARY) + f", {IR.format(x='q1_q5_spread')} as q1_q5_information_ratio, count(ls_ndcg) as n_groups from evw group by 1, 2) group by 1"))
def _(spark, sf):
    yearly = weekly_evaluation(spark, sf).withColumn("fold", F.year("week_date"))
    return rounded(ev.fold_summary(ev.summarize_metrics(yearly, ["model", "fold"]), ["model"]))


@query("sql_surface", with_blocks("ranked", f"""select model, week_date, ((place - 1) * 5 // n + 1)::int as quintile, count(*) as n, {r('sum(place / log2(place + 1))')} as gain from ranked group by 1, 2, 3"""))
def _(spark, sf):
    from ..functions.sql import register_sql

    register_sql(spark, {"crosswise_ranked": sc.predicted_ranks(frame(spark, sf), views.universe(spark, sf))})
    return rounded(spark.sql("""select model, week_date, quintile_of(predicted_rank, n) as quintile, count(*) as n, sum(dcg_gain(predicted_rank, predicted_rank)) as gain
        from (select *, count(*) over (partition by model, week_date) as n from crosswise_ranked) group by 1, 2, 3"""))


