"""Hit rates, trade statistics, regimes and weights: plain aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.evaluation import correlation

C = F.col


def hit(pred: Column, actual: Column) -> Column:
    """1.0 when both move to the same side, null when either is missing."""
    return (F.signum(pred) == F.signum(actual)).cast("double")


def win_rates(df: DataFrame, pred: Column, actual: Column) -> list[Column]:
    h = hit(pred, actual)
    return [F.avg(h).alias("overall"), F.avg(F.when(pred > 0, h)).alias("buy"), F.avg(F.when(pred < 0, h)).alias("sell")]


def ic_proportional(df: DataFrame, ic: str, floor: float, power: float) -> DataFrame:
    """max(ic − floor, 0)^power over its sum; null when every one is zero."""
    raw = df.withColumn("_w", F.pow(F.greatest(C(ic) - floor, F.lit(0.0)), F.lit(power)))
    total = raw.agg(F.sum("_w")).scalar()
    return raw.withColumn("weight", F.try_divide(C("_w"), total)).drop("_w")


def cap_redistribute(df: DataFrame, group: list[str], weight: str, cap: str, name: str) -> DataFrame:
    """Weights capped, the room shared among the free ones in proportion, as a fixed point.

    Names ordered by cap over weight: a prefix is capped, and one scale holds for the rest. A group holds
    the factors of a registry, so its window is small.
    """
    w = Window.partitionBy(*group)
    n = df.withColumn("_w", C(weight) / F.sum(weight).over(w))
    ratio = F.coalesce(C(cap) / C("_w"), F.lit(1e300))
    order = w.orderBy("_r", name).rowsBetween(Window.unboundedPreceding, -1)
    n = n.withColumn("_r", ratio)
    capped_before = F.coalesce(F.sum(F.coalesce(C(cap), F.lit(0.0))).over(order), F.lit(0.0))
    used_before = F.coalesce(F.sum("_w").over(order), F.lit(0.0))
    n = n.withColumn("_l", F.greatest(F.lit(0.0), 1 - capped_before) / (1 - used_before))
    n = n.withColumn("_over", F.coalesce(C("_l") * C("_w") > C(cap) + 1e-12, F.lit(False)))
    scale = F.min_by(F.when(~C("_over"), C("_l")), F.when(~C("_over"), F.struct("_r", name))).over(w)
    return n.withColumn("capped", F.when(C("_over"), C(cap)).otherwise(C("_w") * scale)).drop("_w", "_r", "_l", "_over")


def regime(series: DataFrame) -> DataFrame:
    """Trend, volatility band and combined regime per date; ``series`` has date, price, vix: one row a session."""
    w = Window.orderBy("date")
    mean = lambda k: F.when(F.count("price").over(w.rowsBetween(1 - k, 0)) == k, F.avg("price").over(w.rowsBetween(1 - k, 0)))
    s = series.withColumns({"ma20": mean(20), "ma50": mean(50), "ret20": (C("price") / F.lag("price", 20).over(w) - 1) * 100})
    p, a, b, r = C("price"), C("ma20"), C("ma50"), C("ret20")
    trend = (
        F.when((p > a) & (a > b) & (r > 5), "STRONG_UP").when((p > a) & (r > 0), "UP")
        .when((p < a) & (a < b) & (r < -5), "STRONG_DOWN").when((p < a) & (r < 0), "DOWN").otherwise("SIDEWAYS")
    )
    v = C("vix")
    # fixed values: volatility bands
    band = F.when(v < 15, "VERY_LOW").when(v < 20, "LOW").when(v < 30, "ELEVATED").when(v < 40, "HIGH").otherwise("EXTREME")
    s = s.withColumns({"trend": trend, "vix_band": band})
    calm = C("vix_band").isin("VERY_LOW", "LOW")
    name = (
        F.when(C("trend").isin("STRONG_UP", "UP") & calm, "BULL")
        .when(C("trend").isin("STRONG_DOWN", "DOWN") & ~calm, "BEAR")
        .when(C("vix_band").isin("HIGH", "EXTREME"), "HIGH_VOL")
        .when((C("trend") == "SIDEWAYS") & calm, "LOW_VOL")
        .otherwise("NEUTRAL")
    )
    return s.select("date", "trend", "vix_band", name.alias("regime"))


# fixed values: regime → stop loss, take profit, position size
REGIME_PARAMS = {
    "BULL": (0.030, 0.035, 0.25),
    "BEAR": (0.015, 0.020, 0.10),
    "HIGH_VOL": (0.020, 0.025, 0.15),
    "LOW_VOL": (0.025, 0.030, 0.20),
    "NEUTRAL": (0.025, 0.025, 0.15),
}


def regime_params(regimes: DataFrame) -> DataFrame:
    table = regimes.sparkSession.createDataFrame(
        [(k, *v) for k, v in REGIME_PARAMS.items()], "regime string, stop_loss double, take_profit double, position_size double"
    )
    return regimes.join(F.broadcast(table), "regime")


def symbol_report(df: DataFrame, pred: Column, actual: Column) -> DataFrame:
    error = actual - pred
    g = df.groupBy("symbol").agg(
        F.count(error).alias("n"), F.avg(hit(pred, actual)).alias("accuracy"), F.avg(error).alias("bias"),
        F.avg(F.abs(error)).alias("mae"), correlation(pred, actual).alias("corr"),
    )
    return g.withColumn("problem", ((C("accuracy") < 0.45) | (C("mae") > 1.0)).cast("int"))
