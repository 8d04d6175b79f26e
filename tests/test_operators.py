"""Operators without a SQL twin, and hand-made fixtures."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.functions import normal, options
from quantloom.operators import evaluation as ev
from quantloom.operators import learning as ml
from quantloom.operators import reports as rp
from quantloom.operators.sequences import session_calendar


def test_implied_vol_round_trip(spark):
    rng = np.random.default_rng(0)
    n = 500
    s, k = rng.uniform(50, 150, n), rng.uniform(50, 150, n)
    t, v, call = rng.uniform(0.1, 2, n), rng.uniform(0.1, 1.5, n), rng.integers(0, 2, n).astype(bool)
    q = options.price(s, k, t, 0.02, v, call)
    df = spark.createDataFrame(pd.DataFrame({"q": q, "s": s, "k": k, "t": t, "c": call, "v": v}))
    got = df.select("v", "q", options.implied_vol("q", "s", "k", "t", F.lit(0.02), "c").alias("iv"), "s", "k", "t", "c").toPandas()
    ok = got["iv"].notna()
    assert ok.mean() > 0.9
    back = options.price(got.s[ok], got.k[ok], got.t[ok], 0.02, got.iv[ok], got.c[ok].to_numpy())
    np.testing.assert_allclose(back, got.q[ok], atol=1e-6)


def test_implied_vol_outside_the_bounds_is_null(spark):
    df = spark.createDataFrame([(0.0, 100.0, 90.0, 1.0, True), (12.0, 100.0, 90.0, 0.0, True)], "q double, s double, k double, t double, c boolean")
    assert [r[0] for r in df.select(options.implied_vol("q", "s", "k", "t", F.lit(0.0), "c")).collect()] == [None, None]


def test_sidak_and_tail(spark):
    assert normal.sidak_level(1) == pytest.approx(1.959964, abs=1e-6)
    assert normal.sidak_level(20) == pytest.approx(3.0157, abs=1e-3)
    p = spark.createDataFrame([(1.959964,)], "t double").select(normal.onesided_p(F.col("t"), 1)).first()[0]
    assert p == pytest.approx(0.025, abs=1e-7)


def test_benjamini_hochberg_textbook(spark):
    ps = [0.0001, 0.0004, 0.0019, 0.0095, 0.0201, 0.0278, 0.0298, 0.0344, 0.0459, 0.324, 0.4262, 0.5719, 0.6528, 0.759, 1.0]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    assert sorted(r.p for r in ev.bh_flags(df, "p", 0.05).where("rejected = 1").collect()) == ps[:4]


def test_caps_reach_the_fixed_point(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for g in range(30):
        w = rng.uniform(0.1, 5, 6)
        caps = [float(c) if rng.random() < 0.6 else None for c in rng.uniform(0.02, 0.3, 6)]
        x, held = w / w.sum(), {}
        while True:
            over = [i for i in range(6) if caps[i] is not None and i not in held and x[i] > caps[i] + 1e-12]
            if not over:
                break
            held.update({i: caps[i] for i in over})
            free = [i for i in range(6) if i not in held]
            room, total = max(0.0, 1 - sum(held.values())), sum(x[i] for i in free)
            x = np.array([held[i] if i in held else x[i] / total * room for i in range(6)])
        for i in range(6):
            rows.append((g, str(i), float(w[i]), caps[i]))
            want[(g, str(i))] = x[i]
    df = spark.createDataFrame(rows, "g int, name string, w double, cap double")
    for r in rp.cap_redistribute(df, ["g"], "w", "cap", "name").collect():
        assert r.capped == pytest.approx(want[(r.g, r.name)], abs=1e-9)


def test_clusters_follow_chains(spark):
    pairs = spark.createDataFrame([("a", "b", 0.9), ("b", "c", -0.8), ("c", "d", 0.75), ("e", "f", 0.2)], "a string, b string, corr double")
    nodes = spark.createDataFrame([(n,) for n in "abcdef"], "node string")
    got = {r.node: r.cluster for r in ev.clusters(pairs, nodes, 0.7).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e", "f": "f"}


def test_holidays(spark):
    bounds = spark.createDataFrame([(dt.date(2022, 1, 1), dt.date(2025, 12, 31))], "first date, last date")
    days = {r.date for r in session_calendar(bounds).collect()}
    closed = ["2022-04-15", "2023-04-07", "2024-03-29", "2022-06-20", "2022-12-26", "2023-01-02", "2023-11-23", "2024-05-27", "2025-01-09", "2025-07-04"]
    assert not {dt.date.fromisoformat(d) for d in closed} & days
    assert {dt.date(2021, 12, 31), dt.date(2022, 1, 3), dt.date(2022, 1, 3)} & days
    assert sum(d.year == 2023 for d in days) == 250 and sum(d.year == 2024 for d in days) == 252


def test_folds_keep_labels_out_of_the_test(spark):
    days = spark.createDataFrame([(dt.date(2020, 1, 1) + dt.timedelta(i),) for i in range(100)], "date date")
    folds = ml.fold_table(days, train=40, test=20, step=20, purge=6, min_tail=5).orderBy("fold").collect()
    assert len(folds) == 3
    for f in folds:
        assert (f.test_start - f.train_end).days == 7



def test_normal_tail_is_exact_in_both_tails():
    z = np.append(np.linspace(-9.0, 36.0, 20_001), [0.0, np.inf, -np.inf])
    want = np.array([0.5 * math.erfc(v / math.sqrt(2.0)) for v in z])
    np.testing.assert_allclose(normal.upper_tail(z), want, rtol=1e-12)
    assert np.isnan(normal.upper_tail(np.array([np.nan])))
    p = np.geomspace(1e-12, 0.5, 500)
    np.testing.assert_allclose(normal.upper_tail(normal.upper_point(p)), p, rtol=1e-11)
