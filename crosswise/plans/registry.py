"""Registered queries and the shared SQL building blocks of their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# Added before rounding on both sides: exact decimal halves (prices are cents
# over small integers) would otherwise round differently in the two engines.
NUDGE = 3.7e-9


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column for comparison; adding zero turns -0.0 into 0.0. Scaled and
    rounded as numbers, as the SQL's round does: F.round goes through decimal text, which costs
    more than the panel."""
    scale = 10.0**digits
    return df.select(
        *[(F.rint((F.col(c) + NUDGE) * scale) / scale + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


def r(expr: str, digits: int = 6) -> str:
    return f"(round(({expr})::double + {NUDGE}::double, {digits}) + 0)::double"


# name -> (CTEs it reads, SQL)
BLOCKS: dict[str, tuple[str, str]] = {
    "smap": ("", "select s_suppkey as ticker, n_regionkey as sector from supplier join nation on s_nationkey = n_nationkey"),
    "quotes": ("", "select l_suppkey as ticker, l_shipdate::date as date, 1000 + l_extendedprice / l_quantity / 500 as adj_close from lineitem"),
    "px": (
        "quotes smap",
        """select p.ticker, sector, week_date, adj_close from (
             select ticker, date + (((10 - isodow(date)) % 7)::int) as week_date, avg(adj_close) as adj_close
             from quotes group by 1, 2) p join smap using (ticker)""",
    ),
    "dense": (
        "px",
        """select ticker, sector, unnest(generate_series(week_date, coalesce(nxt - 7, week_date), interval 7 day))::date as week_date, adj_close
           from (select *, lead(week_date) over (partition by ticker order by week_date) as nxt from px)""",
    ),
    "rets": (
        "dense",
        """select *, adj_close / lag(adj_close, 1) over w - 1 as return_1w, adj_close / lag(adj_close, 4) over w - 1 as return_4w,
             adj_close / lag(adj_close, 13) over w - 1 as return_13w
           from dense window w as (partition by ticker order by week_date)""",
    ),
    "scores": (
        "rets",
        """select 'momentum' as model, ticker, sector, week_date, return_4w as prediction from rets
           union all select 'reversal', ticker, sector, week_date, 0 - return_1w from rets""",
    ),
    "dweeks": (
        "dense",
        """select week_date, lag(week_date) over (order by week_date) as prev_week_date, lead(week_date) over (order by week_date) as next_week_date
           from (select distinct week_date from dense)""",
    ),
    "act": (
        "rets",
        "select *, return_1w - avg(return_1w) over (partition by week_date, sector) as a, avg(return_1w) over (partition by week_date, sector) as sector_return from rets",
    ),
    "actq": ("act", "select week_date, sector, quantile_cont(a, 0.01) as lo, quantile_cont(a, 0.99) as hi, count(a) as n from act group by 1, 2"),
    "actp": (
        "act actq",
        """select ticker, sector, week_date, return_1w, sector_return, a,
             case when a is not null then (rank() over (partition by week_date, sector order by w nulls last) + (count(*) over (partition by week_date, sector, w) - 1) / 2.0 - 0.5) / n end as p
           from (select act.*, n, case when a is not null then greatest(least(a, hi), lo) end as w from act join actq using (week_date, sector))""",
    ),
    "target": (
        "actp",
        """select ticker, sector, week_date, return_1w, sector_return, a as raw_active_return,
             case when stddev_pop(p) over w > 1e-12 then (p - avg(p) over w) / stddev_pop(p) over w when p is not null then 0 end as active_return_train
           from actp window w as (partition by week_date)""",
    ),
    "fwd": (
        "target dweeks",
        """select t.ticker, t.sector, t.week_date, k.next_week_date, f.return_1w as stock_return_fwd, f.sector_return as sector_return_fwd,
             f.raw_active_return as raw_active_return_fwd, f.active_return_train as active_return_fwd
           from target t join dweeks k using (week_date) left join target f on f.ticker = t.ticker and f.week_date = k.next_week_date""",
    ),
    # Scored rows with their outcomes: the input of every backtest query.
    "frame": (
        "scores fwd",
        """select s.model, s.ticker, s.sector, s.week_date, s.prediction, f.next_week_date, f.stock_return_fwd, f.sector_return_fwd,
             f.raw_active_return_fwd, f.active_return_fwd
           from scores s join fwd f using (ticker, week_date) where s.prediction is not null""",
    ),
    "ranked": (
        "frame",
        """select *, row_number() over (partition by model, week_date order by prediction desc, ticker) as place,
             count(*) over (partition by model, week_date) as n from frame""",
    ),
    "mweeks": (
        "frame",
        """select model, week_date, lag(week_date) over w as prev_week, lead(week_date) over w as next_week
           from (select distinct model, week_date from frame) window w as (partition by model order by week_date)""",
    ),
    # State of the ranking metrics: outcome order, average ranks, labels.
    "outr": (
        "ranked",
        """select *, case when active_return_fwd is not null then row_number() over (partition by model, week_date order by active_return_fwd nulls last, ticker) end as frst,
             rank() over (partition by model, week_date order by active_return_fwd nulls last) + (count(*) over (partition by model, week_date, active_return_fwd) - 1) / 2.0 as rt,
             rank() over (partition by model, week_date order by prediction) + (count(*) over (partition by model, week_date, prediction) - 1) / 2.0 as rs
           from ranked""",
    ),
    "lab": ("outr", "select *, case when n < 2 then 0 else least(greatest(ceil(frst / n * 5) - 1, 0), 4) end as label from outr"),
}


def with_blocks(names: str, final: str, extra: dict[str, str] | None = None, swap: dict[str, tuple[str, str]] | None = None) -> str:
    """WITH clause of the named blocks and everything they read; `swap` holds blocks that
    stand in for those of their names."""
    order: list[str] = []
    blocks = BLOCKS | (swap or {})

    def visit(name: str) -> None:
        if name not in order:
            for needed in blocks[name][0].split():
                visit(needed)
            order.append(name)

    for name in names.split():
        visit(name)
    parts = [f"{n} as ({blocks[n][1]})" for n in order] + [f"{n} as ({s})" for n, s in (extra or {}).items()]
    return "with " + ",\n".join(parts) + "\n" + final


def trades_sql(pos: str, weeks: str, keys: str = "model") -> str:
    """Traded dollars from positions (keys, week_date, ticker, w): signed legs
    of this week minus last week's, summed per name, then in absolute terms."""
    return f"""select {keys}, week_date, sum(abs(d)) as traded from (
        select {keys}, week_date, ticker, sum(w) as d from (
            select {keys}, week_date, ticker, w from {pos}
            union all
            select {keys}, k.next_week, ticker, -w from {pos} join {weeks} k using ({keys}, week_date) where k.next_week is not null)
        group by all) group by all"""
