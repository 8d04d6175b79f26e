"""The merge of all sources: same as one at a time, one exchange by symbol, late and nameless events."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quantloom.operators import joins as jn

DAY = dt.date(2024, 1, 1)


def day(k):
    return DAY + dt.timedelta(days=k)


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(s, day(k), 10.0 + s + k / 7, 100.0 * (k + 1)) for s in (1, 2, 3) for k in range(0, 60, 2)]
    rows += [(None, day(4), 1.0, 1.0), (1, None, 1.0, 1.0)]
    return spark.createDataFrame(rows, "symbol long, date date, close double, volume double")


@pytest.fixture(scope="module")
def sources(spark):
    keyed = [(s, day(k), float(k + (s or 0))) for s in (1, 2, None) for k in (1, 5, 5, 11, 30, 41, 200)]
    base = spark.createDataFrame(keyed, "symbol long, day date, x double")
    accounts = "equity ni_ttm revenue_ttm gp_ttm assets assets_1y ocf_ttm ltdebt cash rd_ttm capex_ttm opinc_ttm".split()
    return {
        "filings": base.select("symbol", F.col("day").alias("filed"), (F.col("x") * 100).alias("shares_out")),
        "news": base.select("symbol", "day", F.col("x").alias("tone"), F.lit(2.0).alias("articles")),
        "insiders": base.select("symbol", F.col("day").alias("filed"), *[F.col("x").alias(c) for c in ("buy_shares", "n_buyers", "n_sellers")], F.lit(1.0).alias("sell_shares")),
        "short_interest": base.select("symbol", F.col("day").alias("settled"), F.col("x").alias("short_interest"), F.lit(3.0).alias("days_to_cover")),
        "fundamentals": base.select("symbol", F.col("day").alias("filed"), *[(F.col("x") + i).alias(c) for i, c in enumerate(accounts)]),
        "short_volume": base.select("symbol", "day", F.col("x").alias("short_ratio_day")),
        "institutions": base.select("symbol", F.col("day").alias("usable_from"), *[F.col("x").alias(c) for c in ("inst_shares", "inst_holders", "inst_top5")]),
        "page_views": base.select("symbol", "day", F.col("x").alias("views")),
        "sector": spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "symbol long, sector string"),
    }


def rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)


def test_all_at_once_is_one_at_a_time(panel, sources):
    together = jn.attach_all(panel, sources).cache()
    for name in ("news", "fundamentals", "page_views"):
        alone = jn.attach_all(panel, {"filings": sources["filings"], name: sources[name]})
        assert rows(together.select(*alone.columns)) == rows(alone)
    together.unpersist()


def test_the_panel_moves_once(spark, panel, sources):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        some = {name: df for name, df in sources.items() if name != "sector"}
        text = jn.attach_all(panel, some)._jdf.queryExecution().executedPlan().toString()
        by_symbol = [line for line in text.splitlines() if "Exchange hashpartitioning(symbol#" in line and line.split("hashpartitioning(")[1].split(")")[0].count("#") == 1]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(by_symbol) == 1


def test_values_late_events_and_rows_without_keys(spark, panel, sources):
    late = spark.createDataFrame([(3, day(500), 1.0, 1.0, 1.0, 1.0)], "symbol long, filed date, buy_shares double, sell_shares double, n_buyers double, n_sellers double")
    got = {(r["symbol"], r["date"]): r for r in jn.attach_all(panel, sources | {"insiders": sources["insiders"].unionByName(late)}).collect()}
    assert len(got) == panel.count()
    # filings of days 5 land on session 6 and are known from the next one, 8; the larger of two equal days wins
    assert [got[1, day(k)]["marketcap"] is None for k in (0, 2, 4, 6, 8)] == [True, True, False, False, False]
    assert got[1, day(8)]["marketcap"] == pytest.approx((10 + 1 + 8 / 7) * 600 / 1e6)
    assert got[1, day(8)]["filing_days"] == 0 and got[1, day(12)]["filing_days"] == 2
    assert got[2, day(6)]["news_articles"] == 4 and got[2, day(6)]["news_tone"] == 7 and got[2, day(8)]["news_articles"] == 0
    assert got[3, day(6)]["news_articles"] is None and got[3, day(6)]["insider_buys"] == 0  # known by a trade past the last session
    assert got[1, day(2)]["wiki_views"] == 2 and got[1, day(4)]["wiki_views"] is None and got[3, day(2)]["wiki_views"] is None
    assert [got[s, day(6)]["sector"] for s in (1, 2, 3)] == ["a", "b", "Unknown"]
    nobody = got[None, day(4)]
    assert nobody["marketcap"] is None and nobody["news_articles"] is None and nobody["sector"] == "Unknown"
    assert got[1, None]["marketcap"] is None and got[1, None]["wiki_views"] is None


def test_announcement_reacts_on_the_next_session(spark, panel):
    surprises = [(1, day(10), 250.0), (1, day(10), 3.0), (None, day(4), 9.0), (3, day(500), 1.0)]
    told = spark.createDataFrame(surprises, "symbol long, day date, surprise double")
    got = {(r["symbol"], r["date"]): r for r in jn.pead(panel, told).collect()}
    before, first, later = (got[1, day(k)] for k in (10, 12, 14))
    assert (before["days_since_earn"], before["last_surprise"], before["ear_react"]) == (90.0, 0.0, 0.0)
    move = (11 + 12 / 7) / (11 + 8 / 7) - 1
    assert (first["days_since_earn"], first["last_surprise"]) == (1.0, 3.0) and first["ear_react"] == pytest.approx(move)
    assert later["surprise_decay"] == pytest.approx(3.0 * 2.718281828459045**-0.1)
    assert {got[k]["last_surprise"] for k in got if k[0] != 1} == {0.0}
