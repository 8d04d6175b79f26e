"""Window operators against pandas, and their causality."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.operators import indicators as ind
from quantloom.operators.alphas import ALPHAS
from quantloom.operators.panel import Panel
from quantloom.plans.registry import Tables


def make_bars(symbols=4, days=300, seed=0):
    rng = np.random.default_rng(seed)
    dates = pd.bdate_range("2020-01-01", periods=days)
    rows = []
    for s in range(symbols):
        close = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, days)))
        open_ = close * (1 + rng.normal(0, 0.005, days))
        high = np.maximum(open_, close) * (1 + abs(rng.normal(0, 0.004, days)))
        low = np.minimum(open_, close) * (1 - abs(rng.normal(0, 0.004, days)))
        volume = rng.integers(100, 1000, days).astype(float)
        rows.append(pd.DataFrame({"symbol": f"S{s}", "date": dates.date, "open": open_, "high": high, "low": low, "close": close, "volume": volume}))
    return pd.concat(rows, ignore_index=True)


@pytest.fixture(scope="module")
def bars():
    return make_bars()


def run(spark, pdf, formula):
    p = Panel(spark.createDataFrame(pdf), len(pdf))
    out = formula(p)
    return p.df.select("symbol", "date", out.alias("v")).toPandas().sort_values(["symbol", "date"])["v"].to_numpy(dtype=float)


def by_symbol(pdf, fn):
    parts = [fn(g.reset_index(drop=True)) for _, g in pdf.sort_values(["symbol", "date"]).groupby("symbol")]
    return np.concatenate([np.asarray(x, dtype=float) for x in parts])


CASES = {
    "mean": (lambda p: p.mean(p.close, 10), lambda g: g.close.rolling(10).mean()),
    "std": (lambda p: p.std(p.close, 10), lambda g: g.close.rolling(10).std()),
    "rank": (lambda p: p.ts_rank(p.volume, 10), lambda g: g.volume.rolling(10).rank(pct=True)),
    "argmax": (lambda p: p.argmax(p.close, 10), lambda g: g.close.rolling(10).apply(lambda a: 9 - np.argmax(a), raw=True)),
    "skew": (lambda p: p.skew(p.close, 20), lambda g: g.close.rolling(20).skew()),
    "kurt": (lambda p: p.kurt(p.close, 20), lambda g: g.close.rolling(20).kurt()),
    "corr": (lambda p: p.corr(p.close, p.volume, 10), lambda g: g.close.rolling(10).corr(g.volume)),
    "cov": (lambda p: p.cov(p.close, p.volume, 10), lambda g: g.close.rolling(10).cov(g.volume)),
    "ema": (lambda p: p.ema(p.close, 20), lambda g: g.close.ewm(span=20, adjust=False).mean()),
    "ema_short": (lambda p: p.ema(p.close, 3), lambda g: g.close.ewm(span=3, adjust=False).mean()),
    "ema_long": (lambda p: p.ema(p.close, 200), lambda g: g.close.ewm(span=200, adjust=False).mean()),
    "ema_adjusted": (lambda p: p.ema(p.close, 20, True, 20), lambda g: g.close.ewm(span=20, min_periods=20).mean()),
    "decay": (
        lambda p: p.decay_linear(p.close, 5),
        lambda g: g.close.rolling(5).apply(lambda a: np.dot(a, np.arange(1, 6)) / 15, raw=True),
    ),
    "iqr": (
        lambda p: p.pctile(p.close, 0.75, 10) - p.pctile(p.close, 0.25, 10),
        lambda g: g.close.rolling(10).quantile(0.75) - g.close.rolling(10).quantile(0.25),
    ),
    "fft": (
        lambda p: ind.fft_components(p)["fft_2"],
        lambda g: g.close.rolling(20).apply(lambda a: abs(np.fft.fft(a - np.linspace(a[0], a[-1], 20))[2]), raw=True),
    ),
    "trend_r2": (
        lambda p: ind.trend_features(p)["trend_r2_20d"],
        lambda g: g.close.rolling(20).apply(lambda a: np.corrcoef(np.arange(20), a)[0, 1] ** 2, raw=True),
    ),
    "rsi": (
        lambda p: ind.rsi(p),
        lambda g: 100
        - 100
        / (
            1
            + g.close.diff().clip(lower=0).fillna(0).ewm(span=14, adjust=False).mean()
            / ((-g.close.diff()).clip(lower=0).fillna(0).ewm(span=14, adjust=False).mean() + 1e-10)
        ),
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_against_pandas(spark, bars, name):
    ours, theirs = CASES[name]
    got, want = run(spark, bars, ours), by_symbol(bars, theirs)
    assert (np.isnan(got) == np.isnan(want)).all()
    np.testing.assert_allclose(got, want, rtol=1e-8, atol=1e-8)


def test_long_recursion_does_not_overflow(spark):
    pdf = make_bars(1, 3000, seed=3)
    got = run(spark, pdf, lambda p: p.ema(p.close, 3))
    np.testing.assert_allclose(got, by_symbol(pdf, lambda g: g.close.ewm(span=3, adjust=False).mean()), rtol=1e-9)


@pytest.mark.parametrize("name", ["alpha_002", "alpha_017", "alpha_026", "alpha_034", "alpha_053"])
def test_future_rows_never_change_the_past(spark, bars, name):
    cut = sorted(bars.date.unique())[250]
    bent = bars.copy()
    late = bent.date >= cut
    bent.loc[late, ["open", "high", "low", "close", "volume"]] *= 1.7
    early = (bars.sort_values(["symbol", "date"]).date < cut).to_numpy()
    a, b = run(spark, bars, ALPHAS[name])[early], run(spark, bent, ALPHAS[name])[early]
    np.testing.assert_allclose(a, b, rtol=1e-9, equal_nan=True)


def test_psar_matches_a_plain_loop(spark, bars):
    from quantloom.operators.sequences import parabolic_sar

    got = parabolic_sar(spark.createDataFrame(bars)).toPandas().sort_values(["symbol", "date"])

    def loop(g):
        h, l, c = g.high.to_list(), g.low.to_list(), g.close.to_list()
        sar, way, ep, af = [c[0]], [1], 0.0, 0.02
        for i in range(1, len(c)):
            v = sar[-1] + af * (ep - sar[-1])
            if way[-1] == 1:
                v = min([v, l[i - 1]] + ([l[i - 2]] if i > 1 else []))
                if l[i] < v:
                    v, ep, af, w = ep, l[i], 0.02, -1
                else:
                    w = 1
                    if h[i] > ep:
                        ep, af = h[i], min(af + 0.02, 0.2)
            else:
                v = max([v, h[i - 1]] + ([h[i - 2]] if i > 1 else []))
                if h[i] > v:
                    v, ep, af, w = ep, h[i], 0.02, 1
                else:
                    w = -1
                    if l[i] < ep:
                        ep, af = l[i], min(af + 0.02, 0.2)
            sar.append(v)
            way.append(w)
        return np.array(sar) * 10 + np.array(way)

    np.testing.assert_allclose(got.psar * 10 + got.direction, by_symbol(bars, loop), rtol=1e-12)


@pytest.fixture(scope="module")
def gappy(bars):
    """Missing values, flat stretches and a level far above the moves."""
    made = bars.assign(close=bars.close + 1e5, x=bars.volume.where(bars.index % 7 != 3), y=bars.high)
    made.loc[40:120, "close"] = 123456.1
    made.loc[450:520, "x"] = np.nan
    return made


LONG = {
    "std": (lambda p: p.std(p.close, 40, 10), lambda g: g.close.rolling(40, 10).std()),
    "std_pop": (lambda p: p.std(p.col("x"), 50, 5, ddof=0), lambda g: g.x.rolling(50, 5).std(ddof=0)),
    "cov": (lambda p: p.cov(p.close, p.col("x"), 60, 20), lambda g: g.close.rolling(60, 20).cov(g.x)),
    "corr": (lambda p: p.corr(p.col("y"), p.col("x"), 60, 20), lambda g: g.y.rolling(60, 20).corr(g.x)),
    "slope": (
        lambda p: p.slope(p.col("y"), p.volume, 50),
        lambda g: g.y.rolling(50).cov(g.volume) / g.volume.rolling(50).var(),
    ),
}


@pytest.mark.parametrize("name", LONG)
def test_long_frames_are_merged_from_blocks(spark, gappy, name):
    formula, want = LONG[name]
    pdf = gappy.assign(x=gappy.x.astype(object).where(gappy.x.notna(), None))
    df = spark.createDataFrame(pdf).withColumn("x", F.col("x").cast("double"))
    p = Panel(df, len(pdf))
    out = formula(p)
    made = p.df.select("symbol", "date", out.alias("v"))
    got = made.toPandas().sort_values(["symbol", "date"])["v"].to_numpy(dtype=float)
    np.testing.assert_allclose(got, by_symbol(gappy, want), rtol=1e-6, atol=1e-6)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"RowFrame, -\d+, currentrow", plan)  # no frame is summed anew at each row


def test_flat_long_frames_are_exactly_flat(spark, gappy):
    got = run(spark, gappy.drop(columns="x"), lambda p: p.std(p.close, 40))[79:121]
    assert (got == 0).all()


def test_symbols_bound_a_date_where_rows_do_not(spark, tmp_path):
    """More rows than a window may hold, but few symbols: the window form stays, whatever the number of rows."""
    rows = [(s, f"1996-01-{d:02d}", d, 1, s, 10.0 * d + s, 2.0) for s in range(4) for d in range(1, 29)]
    names = "l_suppkey long, l_shipdate string, l_orderkey long, l_linenumber long, l_partkey long, l_extendedprice double, l_quantity double"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.conf.set("quantloom.window.maxGroupRows", "20")
    try:
        t = Tables(spark, str(tmp_path))
        assert t.day_rows("lineitem") == 4
        assert t.panel("long").bounded
        spark.conf.set("quantloom.window.maxGroupRows", "3")
        assert not t.panel("long").bounded
    finally:
        spark.conf.unset("quantloom.window.maxGroupRows")


def test_rows_change_sides_as_seldom_as_formulas_allow(spark, bars):
    p = Panel(spark.createDataFrame(bars), len(bars))
    value = ALPHAS["alpha_037"](p)
    plan = p.df.select("symbol", "date", value.alias("v"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 2  # by symbol, then by date
