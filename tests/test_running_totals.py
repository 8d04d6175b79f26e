"""Trailing covariances from running totals against windows recomputed row by row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import portfolio as pf


def test_trailing_moments(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in ("a", "b"):
        for i in sorted(rng.choice(400, 300, replace=False).tolist()):
            x, y = rng.normal(0, 0.02, 2).tolist()
            rows.append((k, i, None if i % 17 == 0 else x, float("nan") if i % 23 == 0 else y))
    df = spark.createDataFrame(rows, "k string, i int, x double, y double")
    n, cov = pf.trailing_moments(F.col("x"), F.col("y"), ["k"], "i", 50)
    got = {(r["k"], r["i"]): (r["n"], r["c"]) for r in df.select("k", "i", n.alias("n"), cov.alias("c")).collect()}
    for k, i, _, _ in rows:
        held = [(x, y) for q, j, x, y in rows if q == k and i - 50 <= j < i and x is not None and y == y]
        assert got[k, i][0] == len(held)
        if len(held) > 1:
            assert got[k, i][1] == pytest.approx(np.cov(np.array(held).T)[0, 1], abs=1e-14)
        else:
            assert got[k, i][1] is None
