import json

import numpy as np
import pandas as pd
import pytest
from helpers import pdf, week

from crosswise.functions.columns import ticker_key
from crosswise.functions.sql import register_sql
from crosswise.operators import calendar as cal
from crosswise.operators import features as feat
from crosswise.sources import prices as src
from crosswise.sources import sectors as sec
from crosswise.sources import sinks
from crosswise.sources import snapshots as snap
from crosswise.sources.storage import cut_lineage, list_files, shared_folder, week_files
from crosswise.streaming import landing, messages


def daily_prices(n_days=420, seed=2):
    """Two tickers on weekdays; B misses one quote and starts later."""
    rng = np.random.default_rng(seed)
    days = pd.bdate_range("2020-01-01", periods=n_days)
    rows = [("A", d.date(), float(p)) for d, p in zip(days, 100 * np.cumprod(1 + rng.normal(0, 0.01, n_days)))]
    rows += [("B", d.date(), float(p)) for i, (d, p) in enumerate(zip(days, 50 * np.cumprod(1 + rng.normal(0, 0.01, n_days)))) if i > 5 and i != 200]
    return rows, [d.date() for d in days]


def test_feature_panel_matches_pandas(spark):
    rows, days = daily_prices()
    prices = spark.createDataFrame(rows, "ticker string, date date, adj_close double")
    sessions = spark.createDataFrame([(d,) for d in days], "price_date date")
    got = pdf(feat.build_feature_panel(prices, sessions), "ticker", "week_date")
    frame = pd.DataFrame(rows, columns=["ticker", "date", "p"])
    for t, g in frame.groupby("ticker"):
        p = g.set_index("date").p.reindex([d for d in days if d >= g.date.min()])
        r = p.pct_change(fill_method=None)
        d = p.diff()
        gain, loss = d.clip(lower=0).rolling(14).mean(), (-d.clip(upper=0)).rolling(14).mean()
        want = pd.DataFrame({
            "volatility_20d": r.rolling(20).std() * np.sqrt(252), "volatility_60d": r.rolling(60).std() * np.sqrt(252),
            "price_to_sma20": p / p.rolling(20).mean() - 1, "price_to_sma60": p / p.rolling(60).mean() - 1,
            "bollinger_z20": (p - p.rolling(20).mean()) / p.rolling(20).std(), "rsi14_simple": 100 * gain / (gain + loss),
            "close_to_high252": p / p.rolling(252).max() - 1})
        mine = got[got.ticker == t].set_index("price_date")
        for c in want:
            assert np.allclose(mine[c].astype(float), want[c].reindex(mine.index), equal_nan=True), (t, c)
        weekly = p.reindex(mine.index)
        assert np.allclose(mine.return_13w.astype(float), weekly / weekly.shift(13) - 1, equal_nan=True)
        assert np.allclose(mine.momentum_12_1.astype(float), weekly.shift(4) / weekly.shift(52) - 1, equal_nan=True)
    panel = feat.build_feature_panel(prices, sessions)
    assert feat.inference_rows(panel).count() == got[(got.week_date == got.week_date.max()) & got.eligible].shape[0]
    assert "target_return_1w" not in feat.inference_rows(panel).columns
    report = feat.build_report(cal.session_grid(prices, sessions), panel).first()
    assert report["missing_ticker_sessions"] == 1


def test_flat_prices_have_neutral_rsi_and_zero_bollinger(spark):
    days = [d.date() for d in pd.bdate_range("2020-01-01", periods=30)]
    grid = spark.createDataFrame([("A", d, 10.0) for d in days], "ticker string, price_date date, adj_close double")
    last = pdf(feat.daily_features(grid), "price_date").iloc[-1]
    assert last.rsi14_simple == 50 and last.bollinger_z20 == 0 and last.volatility_20d == 0


def test_calendar_falls_back_to_the_previous_session_and_refuses_unknown_days(spark):
    days = [d.date() for d in pd.bdate_range("2020-01-01", periods=20)]
    prices = spark.createDataFrame([("A", d, 1.0) for d in days if d.isoformat() != "2020-01-15"], "ticker string, date date, adj_close double")
    holidays = spark.createDataFrame([("2020-01-15",)], "date string").selectExpr("cast(date as date) date")
    sessions = cal.session_calendar(prices, holidays)
    rows = {r["week_date"].isoformat(): r["price_date"].isoformat() for r in cal.snapshot_calendar(prices, sessions).collect()}
    assert rows["2020-01-15"] == "2020-01-14" and rows["2020-01-22"] == "2020-01-22"
    with pytest.raises(ValueError, match="session calendar"):
        cal.snapshot_calendar(prices, sessions.filter("price_date <> '2020-01-16'"))


def test_price_scan_rejects_bad_rows(spark, tmp_path):
    good = "Ticker,Date,Open,Adj Close\n A ,2020-01-01,1,2.5\nB,2020-01-01,1,3\n"
    (tmp_path / "good.csv").write_text(good)
    assert pdf(src.read_prices(spark, str(tmp_path / "good.csv")), "ticker").ticker.tolist() == ["A", "B"]
    for name, line in {"dup": "A,2020-01-01,1,9", "neg": "C,2020-01-01,1,-1", "blank": " ,2020-01-01,1,1", "nan": "C,2020-01-01,1,NaN"}.items():
        (tmp_path / f"{name}.csv").write_text(good + line + "\n")
        with pytest.raises(ValueError, match="Invalid price rows"):
            src.read_prices(spark, str(tmp_path / f"{name}.csv"))


def test_incremental_append_keeps_only_new_dates(spark):
    schema = "ticker string, date string, adj_close double"
    stored = spark.createDataFrame([("A", "2020-01-01", 1.0), ("B", "2020-01-01", 1.0)], schema).selectExpr("ticker", "cast(date as date) date", "adj_close")
    new = spark.createDataFrame([("A", "2020-01-01", 9.0), ("A", "2020-01-02", 2.0), ("A", "2020-01-09", 2.0)], schema).selectExpr("ticker", "cast(date as date) date", "adj_close")
    assert src.append_new(stored, new).count() == 2
    report = {r["problem"]: r["n"] for r in src.append_report(stored, new).collect()}
    assert report == {"duplicate_key": 0, "absent_ticker": 1, "missing_wednesday": 1, "price_jump": 1}


def test_sector_maps_prefer_the_first_and_refuse_conflicts(spark):
    one = spark.createDataFrame([("BRK.B", "Financials")], "ticker string, sector string")
    two = spark.createDataFrame([("brk-b", "Financials"), ("A", "Health"), ("", "X")], "ticker string, sector string")
    got = {r["ticker_key"]: r["ticker"] for r in sec.load_sector_map([one, two]).collect()}
    assert got == {"BRK-B": "BRK.B", "A": "A"}
    with pytest.raises(ValueError, match="Conflicting"):
        sec.load_sector_map([one, two.replace({"Financials": "Energy"}, subset=["sector"])])


def snapshot_rows(spark, weeks):
    return spark.createDataFrame([(f"T{i}", week(w), week(w), 1.0 + i) for w in weeks for i in range(3)],
                                 "ticker string, week_date date, price_date date, adj_close double")


def test_publishing_is_idempotent_and_verified(spark):
    root = shared_folder(spark)
    first = pdf(sinks.publish_weeks(snapshot_rows(spark, [0, 1]), root))
    assert set(first.status) == {"uploaded"}
    before = {(r["path"], r["modified"]) for r in week_files(spark, root).collect()}
    plan = {r["week_date"]: r["action"] for r in sinks.publish_plan(snapshot_rows(spark, [0, 1, 2]), root).collect()}
    assert plan == {week(0): "skip_existing", week(1): "skip_existing", week(2): "upload"}
    second = {r["week_date"]: r["status"] for r in sinks.publish_weeks(snapshot_rows(spark, [0, 1, 2]), root).collect()}
    assert second[week(2)] == "uploaded" and second[week(0)] == "skipped_existing"
    assert before <= {(r["path"], r["modified"]) for r in week_files(spark, root).collect()}
    planned = cut_lineage(sinks.publish_plan(snapshot_rows(spark, [2, 3, 4]), root))
    sinks.publish_weeks(snapshot_rows(spark, [3]), root)  # another writer
    third = {r["week_date"]: r["status"] for r in sinks.publish_weeks(snapshot_rows(spark, [2, 3, 4]), root, planned=planned).collect()}
    assert third == {week(2): "skipped_existing", week(3): "skipped_concurrent_existing", week(4): "uploaded"}
    assert snap.read_snapshots(spark, root).count() == 15
    assert snap.read_snapshots(spark, root, start=week(2).isoformat()).count() == 9
    with pytest.raises(ValueError, match="Duplicate"):
        snapshot_rows(spark, [0]).write.mode("append").partitionBy("week_date").json(root)
        snap.read_snapshots(spark, root)
    assert len(snap.fingerprint(list_files(spark, root), root).first()["fingerprint"]) == 64


def test_of_two_writers_one_gets_each_week(spark, monkeypatch):
    """Both writers have found weeks 1 and 2 free and staged them before either moves one."""
    root = shared_folder(spark)
    sinks.publish_weeks(snapshot_rows(spark, [0]), root)
    stage, statuses = sinks.stage_weeks, {}

    def overtaken(rows, where, partition="week_date"):
        staged = stage(rows, where, partition)
        monkeypatch.setattr(sinks, "stage_weeks", stage)
        statuses["other"] = {r["week_date"]: r["status"] for r in sinks.publish_weeks(snapshot_rows(spark, [1, 2]).withColumn("adj_close", messages.F.lit(99.0)), where).collect()}
        return staged

    monkeypatch.setattr(sinks, "stage_weeks", overtaken)
    own = {r["week_date"]: r["status"] for r in sinks.publish_weeks(snapshot_rows(spark, [0, 1, 2, 3]), root).collect()}
    assert statuses["other"] == {week(1): "uploaded", week(2): "uploaded"}
    assert own == {week(0): "skipped_existing", week(1): "skipped_concurrent_existing", week(2): "skipped_concurrent_existing", week(3): "uploaded"}
    kept = pdf(snap.read_snapshots(spark, root), "week_date", "ticker")
    assert len(kept) == 12 and (kept.adj_close == 99.0).tolist() == [False] * 3 + [True] * 6 + [False] * 3


def test_a_claim_never_replaces_a_week(spark):
    root = shared_folder(spark)
    first, second = (sinks.stage_weeks(snapshot_rows(spark, [0]).limit(n), root) for n in (1, 2))
    assert sinks.claim_week(spark, first, root, f"week_date={week(0)}")
    assert not sinks.claim_week(spark, second, root, f"week_date={week(0)}")
    assert spark.read.parquet(root).count() == 1
    with pytest.raises(Exception, match="week_date"):
        sinks.claim_week(spark, second, root, f"week_date={week(5)}")


def test_plan_counts_missing_json_tickers(spark, tmp_path):
    folder = tmp_path / "in" / f"week_date={week(0)}"
    folder.mkdir(parents=True)
    (folder / "T0.json").write_text("{}")
    row = sinks.publish_plan(snapshot_rows(spark, [0]), str(tmp_path / "in")).first()
    assert row["action"] == "skip_existing" and row["missing_expected_json_tickers"] == 2


def test_manifest_is_written_once(spark):
    root = shared_folder(spark)
    path = sinks.publish_manifest(spark, root, {"rows": 3, "published_at_utc": "a"})
    sinks.publish_manifest(spark, root, {"rows": 3, "published_at_utc": "b"})
    assert json.loads(spark.read.text(path).first()["value"])["published_at_utc"] == "a"
    with pytest.raises(ValueError, match="rows"):
        sinks.publish_manifest(spark, root, {"rows": 4, "published_at_utc": "a"})


def test_identifiers_and_formats_are_checked(spark, tmp_path):
    with pytest.raises(ValueError, match="identifier"):
        snap.panel_scan(spark, "panel; drop", "2020-01-01")
    with pytest.raises(ValueError, match="Unsupported"):
        snap.read_table(spark, str(tmp_path / "x.txt"))
    (tmp_path / "events.json").write_text(json.dumps([{"ticker": "A", "week_date": "2022-01-05", "cash_per_share": 70.0}, {"ticker": "B"}]))
    assert snap.read_events(spark, str(tmp_path / "events.json")).count() == 2
    calls = []
    def build():
        calls.append(1)
        return spark.range(3)
    folder = shared_folder(spark)
    assert [snap.cached_result(spark, folder, "q", build).count() for _ in range(2)] == [3, 3] and len(calls) == 1


FEATURES = ["return_1w", "volatility_20d"]


def feature_messages(spark, rows):
    df = spark.createDataFrame(rows, "ticker string, week_date date, adj_close double, return_1w double").selectExpr("*", "week_date price_date", "cast(null as double) volatility_20d")
    return messages.to_messages(df, FEATURES, "v1", "d1")


def test_messages_are_made_and_parsed_once(spark):
    """A filter on `problem` repeats neither the encoding nor the parsing of a message."""
    made = feature_messages(spark, [("A", week(0), 10.0, 0.1), ("B", week(0), 11.0, float("inf")), ("C", week(0), 12.0, None)])
    valid = messages.valid(messages.parse(made, FEATURES, "v1"))
    plan = valid._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(name) for name in ("from_json", "StructsToJsonEvaluator", "jsonObjectKeys")] == [1, 1, 1]
    assert sorted((r["ticker"], r[FEATURES[0]]) for r in valid.collect()) == [("A", 0.1), ("B", None), ("C", None)]


def test_messages_round_trip_and_bad_ones_are_named(spark):
    made = feature_messages(spark, [("A", week(0), 10.0, 0.1), ("B", week(0), 11.0, float("nan"))])
    first = {r["key"]: json.loads(r["value"]) for r in made.collect()}
    assert first[f"v1|d1|{week(0)}|B"]["return_1w"] is None and "target_return_1w" not in first[f"v1|d1|{week(0)}|A"]
    good = json.dumps(first[f"v1|d1|{week(0)}|A"])
    bad = [("ok", good), ("text", "no json"), ("id", good.replace('"A"', '""')), ("version", good.replace("v1", "v0")), ("feature", good.replace('"return_1w"', '"other"'))]
    parsed = messages.parse(spark.createDataFrame(bad, "key string, value string"), FEATURES, "v1")
    assert {r["key"]: r["problem"] for r in messages.rejected(parsed).collect()} == {
        "text": "not_json", "id": "missing_identifiers", "version": "unexpected_feature_version", "feature": "missing_features"}
    assert messages.valid(parsed).count() == 1
    with pytest.raises(Exception, match="Invalid feature message"):
        messages.strict(parsed).collect()


def test_landing_survives_replay_and_keeps_the_newest(spark, tmp_path):
    inbox, root = str(tmp_path / "inbox"), shared_folder(spark)
    def start(checkpoint):
        stream = spark.readStream.schema("key string, value string").json(inbox)
        landing.land_features(messages.valid(messages.parse(stream, FEATURES, "v1")).drop("value"), root, checkpoint).awaitTermination()
    feature_messages(spark, [("A", week(0), 10.0, 0.1), ("B", week(0), 11.0, 0.2)]).coalesce(1).write.json(inbox)
    one = shared_folder(spark)
    start(one)
    feature_messages(spark, [("A", week(0), 12.0, 0.3)]).coalesce(1).write.mode("append").json(inbox)
    start(one)
    start(one)
    got = pdf(landing.latest(spark, root), "ticker")
    assert got.adj_close.tolist() == [12.0, 11.0]
    # A lost checkpoint replays everything into the same folders.
    start(shared_folder(spark))
    assert landing.latest(spark, root).count() == 2
    landing.compact(landing.latest(spark, root), f"{root}_compact")
    assert spark.read.parquet(f"{root}_compact").count() == 2


def test_ready_event_is_emitted_once_when_complete(spark, tmp_path):
    """Replays within a batch, in the next one and a year later (after the old horizon of 30 days)
    neither count nor announce again."""
    inbox, root, checkpoint = str(tmp_path / "inbox"), shared_folder(spark), shared_folder(spark)
    expected = spark.createDataFrame([(week(0), 2), (week(52), 3)], "week_date date, n_expected bigint")

    def start():
        stream = spark.readStream.schema("key string, value string").json(inbox)
        counts = landing.weekly_completeness(messages.valid(messages.parse(stream, FEATURES, "v1")))
        landing.announce_ready(counts, expected, root, checkpoint).awaitTermination()

    a, b = ("A", week(0), 1.0, 0.1), ("B", week(0), 1.0, 0.1)
    later = [(t, week(52), 1.0, 0.1) for t in "ABC"]
    for rows in ([a, a], [a], [b], [later[0], later[1], a], [("C", week(0), 1.0, 0.1), b], [later[0], later[1], a], [later[2]]):
        feature_messages(spark, rows).coalesce(1).write.mode("append").json(inbox)
        start()
    events = sorted((r["week_date"], r["event"], r["n_received"], r["batch"]) for r in spark.read.option("basePath", root).parquet(root).collect())
    assert events == [(week(0), "weekly-data-ready", 2, 2), (week(52), "weekly-data-ready", 3, 6)]


def test_sql_functions(spark):
    register_sql(spark)
    row = spark.sql("select ticker_key(' brk.b ') k, quintile_of(12, 12) q, relevance_of(1D, 10) r, centered_percentile(1.5D, 2) p").first()
    assert (row["k"], row["q"], row["r"], row["p"]) == ("BRK-B", 5, 0, 0.5)
    assert spark.range(1).select(ticker_key(messages.F.lit("a.b"))).first()[0] == "A-B"


def test_session_grid_fills_gaps_and_quotes_outside_the_calendar_have_no_row(spark):
    sessions = spark.createDataFrame([(f"2024-01-{d:02d}",) for d in (2, 3, 5, 8)], "d string").selectExpr("cast(d as date) price_date")
    quotes = [("A", "2024-01-03", 1.0), ("A", "2024-01-04", 2.0), ("A", "2024-01-08", 3.0), ("B", "2024-01-01", 4.0), ("B", "2024-01-05", None), ("C", "2024-01-09", 5.0), ("C", None, 6.0)]
    prices = spark.createDataFrame(quotes, "ticker string, date string, adj_close double").withColumn("date", cal.F.col("date").cast("date"))
    rows = sorted((r["ticker"], r["price_date"].day, r["adj_close"]) for r in cal.session_grid(prices, sessions).collect())
    assert [r[:2] for r in rows] == [("A", 3), ("A", 5), ("A", 8), ("B", 2), ("B", 3), ("B", 5), ("B", 8)]
    assert [r[2] for r in rows] == [1.0, None, 3.0, None, None, None, None]
    assert cal.session_grid(prices.limit(0), sessions).count() == 0 and cal.session_grid(prices, sessions.limit(0)).count() == 0
