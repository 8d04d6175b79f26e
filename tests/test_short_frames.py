"""Frames of a few rows are read as columns: no list, map or moment is built anew for every row, and missing values count as before."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.operators.panel import Panel
from quantloom.operators.sequences import iv_sequences


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"symbol": np.repeat(["a", "b", "c"], 60), "date": np.tile(pd.bdate_range("2024-01-01", periods=60).date, 3), "x": rng.normal(50, 2, 180)})
    pdf.loc[rng.choice(180, 25, replace=False), "x"] = np.nan
    pdf.loc[pdf.symbol == "c", "x"] = 7.0
    return pdf


def frame(spark, pdf, *columns):
    return spark.createDataFrame(pdf).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def test_higher_order_moments_and_percentiles(spark, rows):
    p = Panel(frame(spark, rows, "x"), len(rows))
    x = F.col("x")
    made = {"skew": p.skew(x, 10, 4), "kurt": p.kurt(x, 10, 4, corrected=False), "high": p.pctile(x, 0.75, 10, 4), "low": p.pctile(x, 0.2, 10, 4)}
    df = p.df.select("symbol", "date", *[c.alias(n) for n, c in made.items()])
    plan = planned(df)
    assert not any(word in plan for word in ("percentile(", "skewness(", "kurtosis(", "collect_list("))
    got = df.toPandas().sort_values(["symbol", "date"])

    def population(a):
        d = a - a.mean()
        return np.nan if (d == 0).all() else (d**4).mean() / (d**2).mean() ** 2 - 3

    roll = [g.x.rolling(10, min_periods=4) for _, g in rows.groupby("symbol")]
    raw = [g.x.rolling(10, min_periods=1) for _, g in rows.groupby("symbol")]
    seen = np.concatenate([r.count() for r in raw]) >= 4
    want = {
        "skew": np.concatenate([r.skew() for r in roll]),
        "kurt": np.where(seen, np.concatenate([r.apply(lambda a: population(a[~np.isnan(a)]), raw=True) for r in raw]), np.nan),
        "high": np.concatenate([r.quantile(0.75) for r in roll]),
        "low": np.concatenate([r.quantile(0.2) for r in roll]),
    }
    for name, values in want.items():
        np.testing.assert_allclose(got[name].astype(float), values, rtol=1e-8, atol=1e-8, err_msg=name)


def test_iv_sequences(spark):
    rng = np.random.default_rng(6)
    n = 120
    pdf = pd.DataFrame({"symbol": np.repeat(["a", "b"], n), "date": np.tile(pd.bdate_range("2024-01-01", periods=n).date, 2), "iv": rng.normal(20, 4, 2 * n), "vix": rng.normal(18, 3, 2 * n)})
    pdf.loc[[30, 200], "iv"] = np.nan
    pdf.loc[[90], "vix"] = np.nan
    df = iv_sequences(frame(spark, pdf, "iv", "vix"), 20)
    plan = planned(df)
    assert "collect_list(" not in plan and "lambda" not in plan
    got = df.toPandas().sort_values(["symbol", "date"])
    want = []
    for s, g in pdf.groupby("symbol"):
        iv, vix, day = g.iv.to_numpy(), g.vix.to_numpy(), g.date.to_list()
        for i in range(20, n):
            a, v = iv[i - 20 : i], vix[i - 20 : i]
            if not (np.isnan(a).any() or np.isnan(v).any()):
                m = a.mean()
                state = 2 if a[-1] > 1.2 * m else 0 if a[-1] < 0.8 * m else 1
                want.append((s, day[i], np.polyfit(range(20), a, 1)[0], np.diff(a).std(), state, v[-1] - a[-1], (a[-1] - m) / (m + 1e-6)))
    want = pd.DataFrame(want, columns=got.columns)
    assert got[["symbol", "date"]].to_numpy().tolist() == want[["symbol", "date"]].to_numpy().tolist()
    np.testing.assert_allclose(got.iloc[:, 2:].astype(float), want.iloc[:, 2:].astype(float), rtol=1e-8, atol=1e-8)
