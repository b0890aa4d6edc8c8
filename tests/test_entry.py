import pytest

import __spark_entry__ as entry
import compare

SF = "/root/testdata/sf0.001"
CHECKED = ["c03_asof_sessions", "f12_decile_relevance", "p06_centered_percentile", "flagship_panel", "q02_quintiles", "o03_event_terminal_value",
           "b04_long_short_weekly", "b06_target_weights", "b08_rank_weighted", "b09_long_only_weekly", "b10_portfolio_metrics", "b11_yearly_performance", "b12_sub_buckets",
           "b13_long_only_net_ir", "b14_change_versus_incumbent", "k06_best_result", "e05_weekly_evaluation", "e07_q1_capture", "g05_selected_scores", "m03_parse_and_validate"]


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 110


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert {"ticker", "week_date", "return_1w_train", "active_return_fwd"} <= set(df.columns) and df.count() > 0


@pytest.mark.parametrize("name", CHECKED)
def test_queries_match_sql(spark, name):
    report = compare.compare(spark, compare.duck(SF), SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert report.startswith("ok"), report
