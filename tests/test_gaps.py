"""Averages over gaps, groups with null keys, and the shared folder."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.operators.panel import Panel
from quantloom.session import shared_dir


@pytest.mark.parametrize(("span", "adjust"), [(1, True), (1, False), (5, True), (30, True)])
def test_ewm_carries_over_long_gaps(spark, span, adjust):
    rng = np.random.default_rng(2)
    values = [None] * 3 + rng.normal(50, 5, 60).tolist() + [None] * 1150 + rng.normal(20, 1, 5).tolist() + [None, 7.0, None]
    day = datetime.date(2000, 1, 1)
    rows = [("s", day + datetime.timedelta(i), v) for i, v in enumerate(values)]
    p = Panel(spark.createDataFrame(rows, "symbol string, date date, x double"), len(rows))
    v = p.ema(F.col("x"), span, adjust)
    got = p.df.select("date", v.alias("v")).toPandas().sort_values("date")["v"].to_numpy(dtype=float)
    want = pd.Series(values, dtype=float).ewm(span=span, adjust=adjust).mean().to_numpy()
    np.testing.assert_allclose(got, want, rtol=1e-9, equal_nan=True)


@pytest.mark.parametrize("rows", [10, None])
def test_null_groups_are_groups(spark, rows):
    data = [("a", None, 1.0), ("b", None, 3.0), ("c", datetime.date(2024, 1, 1), 5.0), ("d", datetime.date(2024, 1, 1), 7.0)]
    p = Panel(spark.createDataFrame(data, "symbol string, date date, x double"), rows)
    mean, rank = p.cs_mean(F.col("x")), p.rank(F.col("x"))
    got = {r["symbol"]: (r["m"], r["r"]) for r in p.df.select("symbol", mean.alias("m"), rank.alias("r")).collect()}
    assert got == {"a": (2.0, 0.5), "b": (2.0, 1.0), "c": (6.0, 0.5), "d": (6.0, 1.0)}


def test_no_folder_is_an_error():
    class Bare:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            getConf = staticmethod(dict)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Bare)
