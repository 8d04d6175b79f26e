"""A cross-section of the registered queries against DuckDB on the small tables."""

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"
KEYS = [
    "flagship_ic", "add", "ts_mean", "ema", "supertrend", "rank", "alpha_034", "load_panel", "scan_json_facts", "append_only_merge",
    "normalize_names", "attach_fundamentals", "interval_join", "independent_mask", "summarize_ic", "residual_ic", "bh_reject",
    "select_book", "cohort_returns", "risk_model", "quarterly_series", "state_after_filing", "trade_stats", "dq_score", "seasonal",
    "session_calendar", "stream_append_only", "stream_daily_news",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("key", KEYS)
def test_matches_duckdb(spark, con, key):
    verdict = compare(spark, con, key, SF, entry.queries(), entry.oracle_sql())
    assert verdict is None or "only nulls" in verdict, verdict


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 1
