"""Features over short sequences and calendars, recursions that need a loop, and grouped user functions.

Grouped pandas functions get one symbol at a time. Bars are unique per (symbol, date), so a group holds
at most one row per session whatever the size of the data.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.elementwise import div

C = F.col
# fixed values: one-off closures
CLOSURES = ("2012-10-29", "2012-10-30", "2018-12-05", "2025-01-09")


def seasonal(bars: DataFrame, least: int = 3) -> DataFrame:
    """Mean return of the same calendar month over strictly earlier years."""
    ends = bars.groupBy("symbol", F.trunc("date", "month").alias("ym")).agg(F.max_by("close", "date").alias("close"))
    w = Window.partitionBy("symbol").orderBy("ym")
    monthly = ends.withColumn("ret", div(C("close"), F.lag("close").over(w)) - 1)
    earlier = Window.partitionBy("symbol", F.month("ym")).orderBy("ym").rowsBetween(Window.unboundedPreceding, -1)
    made = monthly.withColumn("seasonal_month", F.when(F.count("ret").over(earlier) >= least, F.avg("ret").over(earlier)))
    rows = bars.withColumn("ym", F.trunc("date", "month"))
    return rows.join(made.select("symbol", "ym", "seasonal_month"), ["symbol", "ym"], "left").drop("ym")


def _slope(values: Column, n: int) -> Column:
    """Least-squares slope of an array of length n on its positions."""
    mid = (n - 1) / 2
    scale = sum((i - mid) ** 2 for i in range(n))
    parts = F.transform(values, lambda v, i: v * (i - mid))
    return F.aggregate(parts, F.lit(0.0), lambda s, v: s + v) / scale


def _mean(values: Column, start: int, length: int) -> Column:
    return F.aggregate(F.slice(values, start, length), F.lit(0.0), lambda s, v: s + v) / length


def sentiment_sequences(daily: DataFrame, n: int = 7) -> DataFrame:
    """Features of the ``n`` days before each day: slope, spread, spike, momentum, intensity, divergence."""
    w = Window.partitionBy("symbol").orderBy("date")
    before = w.rowsBetween(-n, -1)
    zero = lambda c: F.coalesce(C(c).cast("double"), F.lit(0.0))
    rows = daily.withColumns(
        {
            "_s": F.collect_list(zero("sentiment_mean")).over(before),
            "_d": F.collect_list(zero("sentiment_std")).over(before),
            "_c": F.collect_list(zero("articles")).over(before),
        }
    ).where(F.size("_s") == n)
    s, c = C("_s"), C("_c")
    mean = _mean(s, 1, n)
    sq = F.aggregate(F.transform(s, lambda v: (v - mean) * (v - mean)), F.lit(0.0), lambda a, v: a + v) / n
    flat = F.array_min(s) == F.array_max(s)
    busy = _mean(c, 1, n)
    return rows.select(
        "symbol", "date",
        F.when(flat, 0.0).otherwise(_slope(s, n)).alias("trend"),
        F.when(flat, 0.0).otherwise(F.sqrt(sq)).alias("volatility"),
        (_mean(s, n - 1, 2) < _mean(s, 1, n - 2) - 0.3).cast("int").alias("negative_spike"),
        (_mean(s, n - 2, 3) - _mean(s, 1, 3)).alias("momentum"),
        F.when(busy > 0, _mean(c, n - 1, 2) / busy).otherwise(1.0).alias("intensity"),
        _mean(C("_d"), 1, n).alias("divergence"),
    )


def iv_sequences(rows: DataFrame, n: int = 20) -> DataFrame:
    """Features of the ``n`` rows before each row of ``iv`` and ``vix``; any missing value drops the row.

    The rows before are columns, oldest first, so that the formulas are compiled; functions over lists are interpreted element by element.
    """
    w = Window.partitionBy("symbol").orderBy("date")
    a = [C(f"_a{i}") for i in range(n)]
    whole = F.when(C("iv").isNotNull() & C("vix").isNotNull(), 1)
    seen = [F.count(whole).over(w.rowsBetween(Window.unboundedPreceding, end)) for end in (-1, -n - 1)]
    made = rows.withColumns({f"_a{i}": F.lag("iv", n - i).over(w) for i in range(n)} | {"_v": F.lag("vix", 1).over(w), "_n": seen[0] - seen[1]})
    made = made.where(C("_n") == n)
    total = lambda values: reduce(lambda s, x: s + x, values, F.lit(0.0))
    steps = [y - x for x, y in zip(a, a[1:])]
    mid = (n - 1) / 2
    trend = total(x * (i - mid) for i, x in enumerate(a)) / sum((i - mid) ** 2 for i in range(n))
    made = made.withColumns({"_mean": total(a) / n, "_centre": total(steps) / (n - 1), "_trend": trend})
    spread = total((x - C("_centre")) * (x - C("_centre")) for x in steps) / (n - 1)
    last, mean = a[-1], C("_mean")
    return made.select(
        "symbol", "date",
        C("_trend").alias("iv_trend"), F.sqrt(spread).alias("iv_volatility"),
        F.when(last > mean * 1.2, 2).when(last < mean * 0.8, 0).otherwise(1).alias("iv_regime"),
        (C("_v") - last).alias("vix_iv_spread"), ((last - mean) / (mean + 1e-6)).alias("iv_mean_reversion"),
    )


def parabolic_sar(bars: DataFrame, start: float = 0.02, top: float = 0.2) -> DataFrame:
    """Stop-and-reverse level and direction. Each step needs the one before, so a symbol's bars, which the calendar bounds, are folded in order.

    The extreme point begins at zero, as the reproduced definition has it. The fold runs over blocks, so that what it gathers is not
    copied at every bar.
    """
    block = 64
    w = Window.partitionBy("symbol").orderBy("date")
    day = F.struct(
        "date", "high", "low", "close",
        F.least(F.lag("low", 1).over(w), F.lag("low", 2).over(w)).alias("floor"),
        F.greatest(F.lag("high", 1).over(w), F.lag("high", 2).over(w)).alias("ceiling"),
    )
    days = bars.select("symbol", day.alias("day")).groupBy("symbol").agg(F.array_sort(F.collect_list("day")).alias("days"))

    def bound(value: Column, then) -> Column:
        """``then`` of a value that is computed once."""
        return F.element_at(F.transform(F.array(value), then), 1)

    def step(s: Column, x: Column) -> Column:
        up, extreme, pace = s["side"] > 0, s["extreme"], s["pace"]
        ahead = s["level"] + pace * (extreme - s["level"])
        raw = F.when(up, F.least(ahead, x["floor"])).otherwise(F.greatest(ahead, x["ceiling"]))

        def turned(raw: Column) -> Column:
            return F.struct(raw.alias("raw"), F.when(up, x["low"] < raw).otherwise(x["high"] > raw).alias("crossed"))

        def moved(t: Column) -> Column:
            crossed = t["crossed"]
            reach = F.when(up == crossed, x["low"]).otherwise(x["high"])
            further = F.when(up, reach > extreme).otherwise(reach < extreme)
            level, side = F.when(crossed, extreme).otherwise(t["raw"]), F.when(crossed, -s["side"]).otherwise(s["side"])
            quick = F.when(crossed, F.lit(start)).when(further, F.least(pace + start, F.lit(top))).otherwise(pace)
            point = F.struct(x["date"].alias("date"), level.alias("psar"), side.alias("direction"))
            return state(level, side, F.when(crossed | further, reach).otherwise(extreme), quick, F.concat(s["out"], F.array(point)))

        return bound(raw, lambda r: bound(turned(r), moved))

    def state(level, side, extreme, pace, out) -> Column:
        return F.struct(level.alias("level"), side.alias("side"), extreme.alias("extreme"), pace.alias("pace"), out.alias("out"))

    first = F.element_at("days", 1)
    begun = F.array(F.struct(first["date"].alias("date"), first["close"].alias("psar"), F.lit(1.0).alias("direction")))
    none = F.slice(begun, 1, 0)

    def over_block(s: Column, k: Column) -> Column:
        inner = F.aggregate(F.slice("days", k * block + 2, F.lit(block)), state(s["level"], s["side"], s["extreme"], s["pace"], none), step)
        return bound(inner, lambda r: state(r["level"], r["side"], r["extreme"], r["pace"], F.concat(s["out"], r["out"])))

    blocks = F.sequence(F.lit(0), F.floor((F.size("days") - 1) / block).cast("int"))
    folded = F.aggregate(blocks, state(first["close"], F.lit(1.0), F.lit(0.0), F.lit(start), begun), over_block, lambda s: s["out"])
    return days.select("symbol", F.explode(folded).alias("p")).select("symbol", "p.date", "p.psar", "p.direction")


def rolling_apply(panel, x: Column, w: int, fn) -> Column:
    """``fn`` of the array of the last ``w`` values, as a Column; null until the frame is full."""
    a = panel.stage(F.collect_list(x).over(Window.partitionBy("symbol").orderBy("date").rowsBetween(-(w - 1), 0)))
    return F.when(F.size(a) == w, fn(a))


def per_symbol(df: DataFrame, fn, columns: dict[str, str]) -> DataFrame:
    """A user function of one symbol's rows in date order, giving the named columns next to the key.

    ``fn`` takes and returns a pandas frame with as many rows; a single column is a series or a transform.
    """
    kind = dict(df.dtypes)["symbol"]
    schema = ", ".join([f"symbol {kind}", "date date", *[f"{n} {k}" for n, k in columns.items()]])

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("date").reset_index(drop=True)
        made = fn(g)
        made = made.to_frame(next(iter(columns))) if isinstance(made, pd.Series) else made
        return pd.concat([g[["symbol", "date"]], made[list(columns)]], axis=1)

    return df.groupBy("symbol").applyInPandas(run, schema)


def _easter(year: Column) -> Column:
    """Easter Sunday by the anonymous Gregorian computus."""
    d = lambda x, k: F.floor(x / k)
    a, b, c = year % 19, d(year, 100), year % 100
    e = (19 * a + b - d(b, 4) - d(b - d(b + 8, 25) + 1, 3) + 15) % 30
    f = (32 + 2 * (b % 4) + 2 * d(c, 4) - e - c % 4) % 7
    g = d(a + 11 * e + 22 * f, 451)
    n = e + f - 7 * g + 114
    return F.make_date(year, d(n, 31).cast("int"), (n % 31 + 1).cast("int"))


def session_calendar(bounds: DataFrame, closures: tuple[str, ...] = CLOSURES) -> DataFrame:
    """Exchange sessions between ``first`` and ``last`` of a one-row table, with ordinal and neighbours."""
    days = bounds.select(F.explode(F.sequence("first", "last")).alias("date"))
    d = C("date")
    y, m, dom, wd = F.year(d), F.month(d), F.dayofmonth(d), F.weekday(d)

    def nth(month, weekday, n):
        return (m == month) & (wd == weekday) & (F.ceil(dom / 7) == n)

    def observed(month, day):
        on = (m == month) & (dom == day)
        before = F.date_add(d, 1)
        after = F.date_sub(d, 1)
        friday = (wd == 4) & (F.month(before) == month) & (F.dayofmonth(before) == day)
        monday = (wd == 0) & (F.month(after) == month) & (F.dayofmonth(after) == day)
        return on | friday | monday

    new_year = ((m == 1) & (dom == 1)) | ((m == 1) & (dom == 2) & (wd == 0))
    holiday = (
        new_year | nth(1, 0, 3) | nth(2, 0, 3) | (d == F.date_sub(_easter(y), 2)) | ((m == 5) & (wd == 0) & (dom > 24))
        | ((y >= 2022) & observed(6, 19)) | observed(7, 4) | nth(9, 0, 1) | nth(11, 3, 4) | observed(12, 25)
        | d.cast("string").isin(*closures)
    )
    w = Window.orderBy("date")  # one row per calendar day
    return days.where((wd < 5) & ~holiday).select(
        "date", F.row_number().over(w).alias("ord"), F.lag("date").over(w).alias("previous"), F.lead("date").over(w).alias("next")
    )
