"""Panel cleaning, labels, splits and universe filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.elementwise import div

FAR = "2100-01-01"


def by_symbol() -> Window:
    return Window.partitionBy("symbol").orderBy("date")


def clean_ohlcv(df: DataFrame) -> DataFrame:
    """Complete, consistent bars; missing volume is zero, jumps above 50% are flagged, not dropped."""
    whole = df.dropna(subset=["open", "high", "low", "close"]).fillna(0.0, subset=["volume"])
    inside = lambda c: F.col(c).between(F.col("low"), F.col("high"))
    kept = whole.where((F.col("high") >= F.col("low")) & inside("open") & inside("close"))
    move = div(F.col("close"), F.lag("close").over(by_symbol())) - 1
    return kept.withColumn("jump", F.coalesce(F.abs(move) > 0.5, F.lit(False)).cast("int"))


def total_return_index(df: DataFrame) -> DataFrame:
    """Close adjusted by dividends and splits: first close times the product of (1 + return)."""
    w = by_symbol()
    split = F.when(F.col("splits") == 0, 1.0).otherwise(F.col("splits"))
    gain = div(F.col("close") * split + F.col("dividends"), F.lag("close").over(w))
    stepped = df.withColumn("_g", F.coalesce(gain, F.lit(1.0)))
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    return stepped.withColumn("adj_close", F.first("close").over(past) * F.product("_g").over(past)).drop("_g")


def adjust_ohlc(df: DataFrame, adjusted: str) -> DataFrame:
    """Scale open, high and low by adjusted close over close; the factor is 1 where it is unknown."""
    factor = F.coalesce(div(F.col(adjusted), F.col("close")), F.lit(1.0))
    return df.withColumns({c: F.col(c) * factor for c in ("open", "high", "low")} | {"close": F.col("close") * factor})


def extend_panel(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Add the symbols of ``extra`` that ``base`` lacks."""
    missing = extra.join(base.select("symbol").distinct(), "symbol", "left_anti")
    return base.unionByName(missing.select(*base.columns))


def generate_labels(df: DataFrame, horizon: int, buffer: float) -> DataFrame:
    """Forward log return and its class; the last ``horizon`` rows of a symbol have no label and go."""
    ahead = F.lead("close", horizon).over(by_symbol())
    made = df.withColumn("future_return", F.when(ahead.isNotNull(), F.ln(ahead / F.col("close"))))
    kept = made.where(F.col("future_return").isNotNull())
    return kept.withColumn("label", (F.col("future_return") > buffer).cast("int"))


def clean_dataset(df: DataFrame, features: list[str], label: str, warmup: int) -> DataFrame:
    """Labelled rows, features forward-filled per symbol, the first ``warmup`` rows dropped, then zero-filled.

    Features missing in more than 90% of the rows are dropped; that one-row aggregate is read on the driver.
    """
    share = df.agg(*[F.avg(F.col(f).isNull().cast("double")).alias(f) for f in features]).first()
    kept = [f for f in features if share[f] is not None and share[f] <= 0.9]
    rows = df.drop(*[f for f in features if f not in kept]).where(F.col(label).isNotNull()).dropna("all", subset=kept)
    w = by_symbol()
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.withColumns(
        {f: F.last(f, ignorenulls=True).over(past) for f in kept} | {"_n": F.row_number().over(w)}
    )
    return filled.where(F.col("_n") > warmup).drop("_n").fillna(0.0, subset=kept)


def session_table(df: DataFrame) -> DataFrame:
    """Distinct sessions with their ordinal from 1: one row per calendar day at most."""
    return df.select("date").distinct().withColumn("ord", F.row_number().over(Window.orderBy("date")))


def split_train_test(df: DataFrame, share: float = 0.8) -> DataFrame:
    """Mark rows train or test; the test part begins at the date of index int(share · dates)."""
    sessions = session_table(df)
    n = sessions.agg(F.count(F.lit(1))).scalar()
    cut = sessions.where(F.col("ord") == F.floor(n * share) + 1).select("date").scalar()
    return df.withColumn("part", F.when(F.col("date") < cut, "train").otherwise("test"))


def restore_prediction_day(labelled: DataFrame, featured: DataFrame, features: list[str]) -> DataFrame:
    """Give back the last date, which has no label yet, with its missing features set to zero."""
    last = featured.agg(F.max("date").alias("date"))
    day = featured.join(F.broadcast(last), "date").withColumn("future_return", F.lit(None).cast("double"))
    day = day.fillna(0.0, subset=features)
    return labelled.unionByName(day.select(*labelled.columns))


def liquidity_reasons(df: DataFrame, min_rows: int, min_price: float, min_dollars: float) -> DataFrame:
    """Per symbol the first test that fails: history, last close, then mean dollar volume of its last 20 rows."""
    back = Window.partitionBy("symbol").orderBy(F.col("date").desc())
    ranked = df.withColumn("_r", F.row_number().over(back))
    facts = ranked.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("history"),
        F.max_by("close", "date").alias("last_close"),
        F.avg(F.when(F.col("_r") <= 20, F.col("close") * F.col("volume"))).alias("adv_20d"),
    )
    return facts.withColumn(
        "reason",
        F.when(F.col("history") < min_rows, "insufficient_history")
        .when(F.col("last_close") < min_price, "below_min_price")
        .when(F.col("adv_20d") < min_dollars, "below_min_dollar_volume")
        .otherwise("ok"),
    )


def segment(date: Column, bounds: list[tuple[str, str, str]]) -> Column:
    """Name of the half-open [start, end) tier a date lies in; ``bounds`` holds (name, start, end)."""
    made = F.lit(None).cast("string")
    for name, start, end in reversed(bounds):
        made = F.when((date >= F.lit(start).cast("date")) & (date < F.lit(end).cast("date")), name).otherwise(made)
    return made


def tier_of(date: Column, review: Column) -> Column:
    """Tier as of a review date: dev before twelve months ahead of it, holdout up to it, fresh from it on."""
    return F.when(date < F.add_months(review, -12), "dev").when(date < review, "holdout").otherwise("fresh")


def risk_levels(df: DataFrame, entry: Column, side: Column, atr: Column) -> DataFrame:
    """Stop and take prices: ATR multiples clamped to a band, fixed shares without an ATR."""
    # fixed values: ATR multiples, floors, ceilings and fallback shares
    stop = _clamped(atr * 3.0 / entry, 0.015, 0.12, 0.05)
    take = _clamped(atr * 6.0 / entry, 0.025, 0.25, 0.10)
    long = side == "long"
    return df.withColumns(
        {
            "stop_price": F.when(long, entry * (1 - stop)).otherwise(entry * (1 + stop)),
            "take_price": F.when(long, entry * (1 + take)).otherwise(entry * (1 - take)),
            "basis": F.when(atr.isNotNull(), "atr").otherwise("fixed_pct_fallback"),
        }
    )


def _clamped(x: Column, low: float, high: float, fallback: float) -> Column:
    bounded = F.greatest(F.lit(low), F.least(x, F.lit(high)))
    return F.when(x.isNotNull(), bounded).otherwise(F.lit(fallback))
