"""Queries over sinks and streams (K, M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import wednesday_on_or_after
from ..operators import calendar as cal
from ..operators import features as feat
from ..operators import portfolio as pf
from ..operators import scoring as sc
from ..sources import sinks
from ..sources import snapshots as snap
from ..sources.storage import cut_lineage, shared_folder
from ..streaming import landing, messages
from . import views
from .backtests import by_status, frame, members
from .inputs import day_tasks, feature_panel, session_days
from .registry import BLOCKS, query, r, rounded, with_blocks


def half_published(spark, sf):
    """A root that already holds the weeks before 1998."""
    root = shared_folder(spark)
    rows = views.px_weekly(spark, sf)
    sinks.publish_weeks(rows.filter("week_date < '1998-01-01'"), root)
    return rows, root


@query("k01_publish_plan", with_blocks("px", "select week_date, count(*) as expected_stocks, week_date < date '1998-01-01' as stored, case when week_date < date '1998-01-01' then 'skip_existing' else 'upload' end as action from px group by 1"))
def _(spark, sf):
    rows, root = half_published(spark, sf)
    plan = sinks.publish_plan(rows, root)
    return plan.select("week_date", "expected_stocks", (F.col("existing_objects") > 0).alias("stored"), "action")


@query("k02_publish_panel", with_blocks("px", "select week_date, case when week_date < date '1998-01-01' then 'skipped_existing' else 'uploaded' end as status, count(*) as rows from px group by 1"))
def _(spark, sf):
    rows, root = half_published(spark, sf)
    return sinks.publish_weeks(rows, root)


@query("k02_concurrent_publish", with_blocks("px", """select week_date, case when week_date < date '1996-01-01' then 'skipped_existing' when week_date < date '1998-01-01' then 'skipped_concurrent_existing' else 'uploaded' end as status,
    count(*) as rows from px group by 1"""))
def _(spark, sf):
    """Planned when the root holds the weeks before 1996; another writer fills those before 1998 in between."""
    root = shared_folder(spark)
    rows = cut_lineage(views.px_weekly(spark, sf))
    sinks.publish_weeks(rows.filter("week_date < '1996-01-01'"), root)
    planned = cut_lineage(sinks.publish_plan(rows, root))
    sinks.publish_weeks(rows.filter("week_date < '1998-01-01'"), root)
    return sinks.publish_weeks(rows, root, planned=planned)


@query("k03_manifest", with_blocks("px", "select count(*) as rows, count(distinct week_date) as weeks, 'v1' as panel_version from px"))
def _(spark, sf):
    root = shared_folder(spark)
    stats = views.px_weekly(spark, sf).groupBy("week_date").count().agg(F.sum("count").alias("rows"), F.count(F.lit(1)).alias("weeks")).first()
    manifest = {"panel_version": "v1", "rows": stats["rows"], "weeks": stats["weeks"], "published_at_utc": "first"}
    sinks.publish_manifest(spark, root, manifest)
    path = sinks.publish_manifest(spark, root, {**manifest, "published_at_utc": "second"})
    stored = spark.read.text(path).select(F.from_json("value", "panel_version string, rows bigint, weeks bigint").alias("m"))
    return stored.select("m.*")


@query("k04_build_metadata", with_blocks("elig train dgrid", """select (select max(week_date) from elig) as inference_week, (select count(*) from elig) as panel_rows, (select count(*) from train) as training_rows,
    (select count(*) from elig where eligible and week_date = (select max(week_date) from elig)) as inference_rows, (select count(*) filter (adj_close is null) from dgrid) as missing_ticker_sessions"""))
def _(spark, sf):
    days = session_days(spark, sf)
    grid = cal.session_grid(views.px_daily(spark, sf, day_tasks(spark, sf, days)), days.select("price_date"))
    root = shared_folder(spark)
    sinks.write_outputs({"weekly_panel": feature_panel(spark, sf, days)}, root)
    # Both splits come from the written panel, which is built once.
    panel = spark.read.parquet(f"{root}/weekly_panel")
    sinks.write_outputs({"training": feat.training_rows(panel), "inference": feat.inference_rows(panel)}, root)
    tables = ("weekly_panel", "training", "inference")
    back = {name: spark.read.parquet(f"{root}/{name}") for name in tables}
    return sinks.build_metadata(back["weekly_panel"], back["training"], back["inference"], grid)


@query("k05_evaluation_outputs", with_blocks("qperf", "select count(*) as weekly_rows, count(*) filter (complete) as complete_rows from qperf"))
def _(spark, sf):
    root = shared_folder(spark)
    sinks.write_outputs({"quintile_returns": pf.quintile_performance(members(spark, sf))}, root)
    return spark.read.parquet(f"{root}/quintile_returns").agg(F.count(F.lit(1)).alias("weekly_rows"), F.count_if("complete").alias("complete_rows"))


@query("k06_best_result", with_blocks("lofull", f"select week_date, holdings, {r('net_active_return')} as net_active_return, {r('turnover')} as turnover from lofull where model = 'reversal' and complete"))
def _(spark, sf):
    best = sinks.best_result(by_status(spark, sf), "trees", "protected_selection")
    return rounded(best.select("week_date", "holdings", "net_active_return", "turnover"))


@query("k07_result_cache", with_blocks("px", f"select week_date, {r('avg(adj_close)')} as mean_close from px group by 1"))
def _(spark, sf):
    folder = shared_folder(spark)
    def build():
        return views.px_weekly(spark, sf).groupBy("week_date").agg(F.avg("adj_close").alias("mean_close"))
    snap.cached_result(spark, folder, f"mean_close {sf}", build)
    return rounded(snap.cached_result(spark, folder, f"mean_close {sf}", build))


@query("k08_prediction_partitions", with_blocks("quint", "select week_date, model, count(*) as n_scored, count(quintile) as n_members from quint group by 1, 2"))
def _(spark, sf):
    root = shared_folder(spark)
    scores = sc.assign_quintiles(frame(spark, sf), highest_first=True, layout=views.universe(spark, sf))
    sinks.publish_weeks(scores.select("week_date", "model", "ticker", "sector", "prediction", "quintile"), root)
    return spark.read.parquet(root).groupBy("week_date", "model").agg(F.count(F.lit(1)).alias("n_scored"), F.count("quintile").alias("n_members"))


# --- M: streams ---------------------------------------------------------------

FEATURES = ["return_1w", "return_4w"]
BLOCKS["ev"] = ("", """select event_id, user_id::varchar as ticker, ts::date as price_date, (ts::date + (((10 - isodow(ts)) % 7)::int)) as week_date, value as adj_close, value / 100 as return_1w,
    case when event_type = 'error' then 'old_version' else 'v1' end as version, event_type from events""")


def event_messages(events):
    """Events encoded as feature messages: errors carry an old version, views
    lack a feature and clicks lack an identifier."""
    day = F.to_date("ts")
    rows = events.select(
        "event_id", F.col("ts").cast("timestamp").alias("at"), "event_type", F.col("user_id").cast("string").alias("ticker"), day.alias("price_date"),
        wednesday_on_or_after(day).alias("week_date"), F.col("value").alias("adj_close"), (F.col("value") / 100).alias("return_1w"), F.lit(None).cast("double").alias("return_4w"))
    body = F.struct(
        F.when(F.col("event_type") == "error", "old_version").otherwise("v1").alias("feature_version"), F.lit("d1").alias("data_version"),
        F.col("ticker").alias("Ticker"), F.date_format("week_date", "yyyy-MM-dd").alias("week_date"), F.date_format("price_date", "yyyy-MM-dd").alias("price_date"),
        "adj_close", *FEATURES)
    text = F.to_json(body, {"ignoreNullFields": "false"})
    broken = F.when(F.col("event_type") == "view", F.regexp_replace(text, ',"return_4w":null', "")).when(
        F.col("event_type") == "click", F.regexp_replace(text, '"Ticker":"[^"]*"', '"Ticker":""')).otherwise(text)
    return rows.select("event_id", "at", messages.message_key(F.lit("v1"), F.lit("d1"), F.date_format("week_date", "yyyy-MM-dd"), "ticker").alias("key"), broken.alias("value"))


def stream(spark, sf):
    source = spark.readStream.schema(views.SCHEMAS["events"]).option("pathGlobFilter", "events.parquet").parquet(sf)
    return event_messages(source)


VALID = "event_type not in ('error', 'view', 'click')"


@query("m01_feature_messages", with_blocks("rets", f"""select 'v1|d1|' || strftime(week_date, '%Y-%m-%d') || '|' || ticker as key, week_date, ticker::varchar as ticker, {r('adj_close')} as adj_close, {r('return_1w')} as return_1w, {r('return_4w')} as return_4w from rets"""))
def _(spark, sf):
    rows = views.dense_returns(spark, sf).withColumn("price_date", F.col("week_date"))
    made = messages.to_messages(rows, FEATURES, "v1", "d1")
    back = messages.valid(messages.parse(made, FEATURES, "v1"))
    return rounded(back.select("key", "week_date", "ticker", "adj_close", *FEATURES))


@query("m03_parse_and_validate", with_blocks("ev", f"""select case when event_type = 'click' then 'missing_identifiers' when event_type = 'error' then 'unexpected_feature_version' when event_type = 'view' then 'missing_features' else 'valid' end as outcome,
    count(*) as n from ev group by 1"""))
def _(spark, sf):
    parsed = messages.parse(event_messages(views.table(spark, sf, "events")), FEATURES, "v1")
    return parsed.groupBy(F.coalesce("problem", F.lit("valid")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def landed(spark, sf):
    """Run the stream to its end twice: the second start has nothing to do."""
    root, checkpoint = shared_folder(spark), shared_folder(spark)
    for _ in range(2):
        parsed = messages.valid(messages.parse(stream(spark, sf), FEATURES, "v1")).drop("value", "at")
        landing.land_features(parsed, root, checkpoint).awaitTermination()
    return root


LATEST = f"select week_date, ticker, arg_max(adj_close, event_id) as adj_close, max(event_id) as event_id, count(*) as n from ev where {VALID} group by 1, 2"


@query("m04_idempotent_sink", with_blocks("ev", f"select week_date, ticker, {r('adj_close')} as adj_close from ({LATEST})"))
def _(spark, sf):
    newest = landing.latest(spark, landed(spark, sf), order=("batch", "event_id"))
    return rounded(newest.select("week_date", "ticker", "adj_close"))


@query("m05_raw_landing", "select count(*) as n_messages, count(distinct user_id) as n_tickers from events where event_type <> 'click'")
def _(spark, sf):
    root = shared_folder(spark)
    landing.land_raw(stream(spark, sf), root, shared_folder(spark)).awaitTermination()
    ticker = F.get_json_object("value", "$.Ticker")
    per = spark.read.text(root).filter(ticker != "").groupBy(ticker.alias("t")).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("n_messages"), F.count(F.lit(1)).alias("n_tickers"))


@query("m06_compaction", with_blocks("ev", f"select week_date, count(*) as n_stocks, {r('sum(adj_close)')} as total from ({LATEST}) group by 1"))
def _(spark, sf):
    root = shared_folder(spark)
    landing.compact(landing.latest(spark, landed(spark, sf), order=("batch", "event_id")), root)
    return rounded(spark.read.parquet(root).groupBy("week_date").agg(F.count(F.lit(1)).alias("n_stocks"), F.sum("adj_close").alias("total")))


@query("m07_weekly_ready", with_blocks("ev", f"select week_date, 'weekly-data-ready' as event, count(distinct ticker) as n_received, 10::bigint as n_expected from ev where {VALID} group by 1 having count(distinct ticker) >= 10"))
def _(spark, sf):
    root = shared_folder(spark)
    expected = views.table(spark, sf, "events").select(wednesday_on_or_after(F.to_date("ts")).alias("week_date")).distinct().withColumn("n_expected", F.lit(10).cast("bigint"))
    counts = landing.weekly_completeness(messages.valid(messages.parse(stream(spark, sf), FEATURES, "v1")))
    landing.announce_ready(counts, expected, root, shared_folder(spark)).awaitTermination()
    return spark.read.parquet(root).select("week_date", "event", "n_received", "n_expected")
