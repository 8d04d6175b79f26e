"""A factor holds a symbol once a date: several factors in one frame do not widen a date's groups."""

from pyspark.sql import functions as F

from quantloom.plans import scoring
from quantloom.plans.registry import Tables

SF = "/root/testdata/sf0.001"


def test_factors_do_not_count_as_rows_of_a_date(spark):
    t = Tables(spark, SF)
    spark.conf.set("quantloom.window.maxGroupRows", str(t.rows("lineitem")))
    try:
        one = scoring.factor_ic(t, "long", 2)
    finally:
        spark.conf.unset("quantloom.window.maxGroupRows")
    # the distributed form stores its input
    assert "ExistingRDD" not in one._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("quantloom.window.maxGroupRows", "0")
    try:
        other = scoring.factor_ic(t, "long", 2)
    finally:
        spark.conf.unset("quantloom.window.maxGroupRows")
    key = lambda df: sorted((r["factor"], str(r["date"]), round(r["ic"], 9), r["n"]) for r in df.collect())
    assert one.where(F.col("ic").isNotNull()).count() > 0 and key(one) == key(other)


def test_partitions_of_a_panel_grow_with_its_rows(spark, monkeypatch):
    from quantloom import session

    df = spark.range(10).withColumnRenamed("id", "symbol")
    monkeypatch.setattr(session, "SPREAD_ROWS", 100)
    assert session.spread(df, "symbol", 2001).rdd.getNumPartitions() == 21
    assert session.spread(df, "symbol", 100).rdd.getNumPartitions() == 8


def test_perturbed_panels_are_dealt_by_rows(spark, monkeypatch):
    from quantloom.plans import QUERIES
    from quantloom import session

    monkeypatch.setattr(session, "SPREAD_ROWS", 500)
    df = QUERIES["future_perturbation"](spark, SF)
    parts = -(-Tables(spark, SF).rows("lineitem") // 500)
    assert "hashpartitioning(symbol" in df._jdf.queryExecution().executedPlan().toString()
    assert f", {parts}), REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()
    assert df.first()["max_change"] == 0
