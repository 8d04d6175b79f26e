"""Time the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from quantloom.plans import QUERIES
from quantloom.session import local_session

HEADLINE = [
    "flagship_ic", "log_returns", "ts_mean", "ts_rank", "ts_corr", "ema", "macd", "adx", "supertrend", "rank", "xs_zscore", "alpha_017",
    "alpha_034", "append_only_merge", "attach_filings", "attach_fundamentals", "interval_join", "daily_rank_ic", "decile_table", "residual_ic",
    "bh_reject", "quarterly_series", "trade_stats", "select_book", "cohort_returns", "risk_model", "decompose", "keyword_sentiment",
    "normalize_names", "stream_daily_news",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/region.parquet").count()
    times = {}
    for key in HEADLINE:
        began = time.perf_counter()
        QUERIES[key](spark, folder).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - began, 3)
        print(f"{key} {times[key]}", file=sys.stderr)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": folder.rstrip("/").split("sf")[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
