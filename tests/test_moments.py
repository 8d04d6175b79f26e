"""Factor models from moments, against numpy on the rows of each window."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.operators import moments as fm

FS, GROUPS = ["f1", "f2", "f3"], {"real": ["f1", "f2"], "noise": ["f3"]}


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(12)
    dates, names = pd.date_range("2020-01-01", periods=90, freq="D"), range(40)
    df = pd.DataFrame([(s, d.date()) for d in dates for s in names], columns=["symbol", "date"])
    for f in FS:
        df[f] = rng.normal(size=len(df)) * 50 + 7
    df.loc[rng.random(len(df)) < 0.02, "f2"] = np.nan
    df.loc[df.date == dates[3].date(), "f3"] = 1.0  # flat
    df["label"] = 0.03 * (df.f1 - 7) / 50 + rng.normal(size=len(df)) * 0.02
    df.loc[df.date == dates[-1].date(), "label"] = np.nan
    return df


@pytest.fixture(scope="module")
def rows(spark, table):
    df = spark.createDataFrame(table.astype(object).where(table.notna(), None).values.tolist(), "symbol long, date date, f1 double, f2 double, f3 double, label double")
    return fm.standardised(df, FS).persist()


def z_scores(table):
    z = table.copy()
    for f in FS:
        by = z.groupby("date")[f]
        sd = by.transform("std")
        z[f] = ((z[f] - by.transform("mean")) / sd.where(sd > 0)).fillna(0.0)
    z["ord"] = z.date.rank(method="dense").astype(int)
    return z


def windows(spark):
    return spark.createDataFrame([(0, 1, 40, 47, 60, 61, 75), (1, 16, 55, 62, 75, 76, 90)], "fold int, fit_lo int, fit_hi int, val_lo int, val_hi int, out_lo int, out_hi int")


def test_every_fold_has_the_ridge_fit_of_its_rows(spark, table, rows):
    z = z_scores(table)
    got = {r["fold"]: r for r in fm.linear_fits(fm.date_moments(rows, GROUPS, "label"), windows(spark), GROUPS).collect()}
    for fold, lo, hi in ((0, 1, 40), (1, 16, 55)):
        own = z[z.ord.between(lo, hi) & z.label.notna()]
        for g, fs in GROUPS.items():
            x, y = own[fs].to_numpy(), own.label.to_numpy()
            xc = x - x.mean(0)
            b = np.linalg.solve(xc.T @ xc / len(y) + fm.RIDGE * np.eye(len(fs)), xc.T @ (y - y.mean()) / len(y))
            assert np.allclose([got[fold][f"b_{g}_{f}"] for f in fs], b, atol=1e-9)
            assert abs(got[fold][f"b_{g}"] - (y.mean() - x.mean(0) @ b)) < 1e-9


def test_split_is_the_best_of_all_cuts(spark, table, rows):
    z = z_scores(table)
    own = z[z.ord.between(1, 40) & z.label.notna()]
    best = []
    for f in ("f1", "f2"):
        place = np.clip(np.floor((own[f] + fm.REACH) * fm.BINS / (2 * fm.REACH)), 0, fm.BINS - 1)
        for k in range(fm.BINS - 1):
            low, high = own.label[place <= k], own.label[place > k]
            if len(low) and len(high):
                best.append((own.label.var(ddof=0) * len(own) - low.var(ddof=0) * len(low) - high.var(ddof=0) * len(high), f, k, low.mean(), high.mean()))
    gain, f, k, low, high = max(best)
    cut = fm.split_fits(fm.date_bins(rows, FS, "label"), windows(spark), GROUPS).where("fold = 0").first()["c_real"]
    assert (cut["feature"], cut["bin"]) == (f, k) == ("f1", k)
    assert np.allclose([cut["low"], cut["high"]], [low, high])


def test_planted_factor_is_weighted_and_predicts_unseen_sessions(spark, rows):
    fitted, weights, blend = fm.ensembles(rows, windows(spark), GROUPS, "label", 20)
    share = {(r["fold"], r["factor_group"]): r["blend"] for r in blend.collect()}
    assert all(share[k, "real"] > 0.7 for k in (0, 1)) and all(abs(share[k, "real"] + share[k, "noise"] - 1) < 1e-9 for k in (0, 1))
    total = weights.groupBy("fold", "factor_group").agg(F.sum("weight").alias("w")).collect()
    assert all(abs(r["w"] - 1) < 1e-9 for r in total) and len(total) == 4
    out = fm.blended(fm.predictions(rows, fitted, windows(spark), "out", GROUPS), weights, blend, GROUPS).toPandas()
    assert out.groupby("fold").date.nunique().tolist() == [15, 15] and out.label.isna().sum() == 40
    seen = out[out.label.notna()]
    assert seen.groupby("fold").apply(lambda x: x.pred.corr(x.label), include_groups=False).min() > 0.5


def test_equal_weights_where_nothing_is_positive(spark, rows):
    bad = rows.withColumn("label", F.when(F.col("ord") <= 40, F.col("label")).otherwise(-F.col("label")))
    _, weights, blend = fm.ensembles(bad, windows(spark).where("fold = 0"), {"real": ["f1"]}, "label", 20)
    assert [r["weight"] for r in weights.collect()] == [0.5, 0.5] and blend.first()["blend"] == 1.0


def test_votes_put_the_planted_feature_first(rows):
    got = fm.feature_votes(rows, FS, "label", 2).collect()
    assert got[0]["feature"] == "f1" and got[0]["votes"] == 2 and len(got) == 2


def test_sessions_are_numbered_without_another_read_of_the_panel(spark):
    source = spark.range(60).selectExpr("id AS symbol", "date_add(date'2020-01-01', cast(id % 5 AS int)) AS date", "cast(id * id AS double) AS f1")
    made = fm.standardised(source, ["f1"])
    assert made._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 2  # the rows and their statistics
    assert {(str(r["date"]), r["ord"]) for r in made.collect()} == {(f"2020-01-0{i}", i) for i in range(1, 6)}


@pytest.mark.parametrize("bound", [1000, None])
def test_columns_ranked_side_by_side_have_the_ics_of_each_alone(spark, rows, bound, tmp_path):
    from quantloom.operators.evaluation import daily_rank_ic

    spark.sparkContext.setCheckpointDir(str(tmp_path))
    void = F.when(F.col("fold") == 0, F.col("z_f3"))  # a fold without a fit has nulls in all of its rows
    made = rows.crossJoin(spark.createDataFrame([(0,), (1,)], "fold int")).withColumn("void", void)
    columns = {"z_f1": ("a", "x"), "z_f2": ("a", "y"), "void": ("b", "x")}
    both = fm._ics(made, columns, "label", 10, bound, ["factor_group", "model"])
    got = {(r["fold"], r["factor_group"], r["model"]): r["ic"] for r in both.collect()}
    assert set(got) == {(fold, *key) for fold in (0, 1) for key in columns.values()} and got[1, "b", "x"] is None
    for c, key in columns.items():
        alone = daily_rank_ic(made.where("label IS NOT NULL"), c, "label", 10, 1000, by=["fold"]).groupBy("fold").agg(F.avg("ic").alias("ic"))
        assert {r["fold"]: round(r["ic"], 12) for r in alone.collect()} == {f: round(got[f, *key], 12) for f in (0, 1) if got[f, *key] is not None}


def test_columns_are_ranked_without_copies_of_the_rows(spark):
    made = spark.range(100).selectExpr("0 AS fold", "date'2020-01-01' AS date", "id * 1D AS p", "id * 2D AS q", "id * 3D AS label")
    plan = fm._ics(made, {"p": ("p",), "q": ("q",)}, "label", 10, 1000, ["model"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan[plan.index("+- Window [") :]  # what is exploded is a row a session, above the ranks
