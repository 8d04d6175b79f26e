"""Data-quality checks: issue tables of (check, subject, value, severity), and repair."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.elementwise import div
from quantloom.operators.ranking import percentiles

C = F.col


def _issues(df: DataFrame, check: str, values: dict[str, Column], severity) -> DataFrame:
    one = df.agg(*[v.cast("double").alias(n) for n, v in values.items()])
    long = one.unpivot([], list(values), "subject", "value")
    return long.select(F.lit(check).alias("check"), "subject", "value", severity(C("value")).alias("severity"))


def _grade(warn: float, critical: float):
    return lambda v: F.when(v > critical, "CRITICAL").when(v > warn, "WARNING").otherwise("OK")


def missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null percentage per column: over 10 is a warning, over 20 critical."""
    shares = {c: F.avg(C(c).isNull().cast("double")) * 100 for c in columns}
    return _issues(df, "missing", shares, _grade(10, 20))


def anomalies(df: DataFrame, prices: list[str]) -> DataFrame:
    """Counts of non-positive prices and of moves over 50%, the moves within each symbol."""
    w = Window.partitionBy("symbol").orderBy("date")
    moved = df.withColumns({f"_m_{c}": F.abs(div(C(c), F.lag(c).over(w)) - 1) for c in prices})
    values = {f"{c}_nonpositive": F.count_if(C(c) <= 0) for c in prices}
    values |= {f"{c}_jump": F.count_if(C(f"_m_{c}") > 0.5) for c in prices}
    return _issues(moved, "anomalies", values, lambda v: F.when(v > 0, "WARNING").otherwise("OK"))


def staleness(df: DataFrame, as_of: Column) -> DataFrame:
    """Age in days of the newest row: over 3 is a warning, over 7 critical."""
    return _issues(df, "staleness", {"date": F.datediff(F.max(as_of), F.max("date"))}, _grade(3, 7))


def consistency(df: DataFrame) -> DataFrame:
    """Duplicate keys, high below low, close outside the bar."""
    copies = df.groupBy("symbol", "date").agg(F.count(F.lit(1)).alias("_n"))
    dup = _issues(copies, "consistency", {"duplicates": F.coalesce(F.sum(C("_n") - 1), F.lit(0))}, _flag)
    values = {
        "high_below_low": F.count_if(C("high") < C("low")),
        "close_outside": F.count_if((C("close") > C("high")) | (C("close") < C("low"))),
    }
    return dup.unionByName(_issues(df, "consistency", values, _flag))


def _flag(v: Column) -> Column:
    return F.when(v > 0, "WARNING").otherwise("OK")


def outliers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of rows outside Q1 − 3·IQR .. Q3 + 3·IQR, flagged above 5%; quartiles are exact at any size."""
    made = []
    for c in columns:
        q = percentiles(df, [], c, {"q1": 0.25, "q3": 0.75})
        q1, q3 = q.select("q1").scalar(), q.select("q3").scalar()
        width = (q3 - q1) * 3
        outside = (C(c) < q1 - width) | (C(c) > q3 + width)
        made.append(_issues(df.withColumn("_o", outside), "outliers", {c: F.avg(C("_o").cast("double")) * 100}, _grade(5, 1e9)))
    return reduce(lambda a, b: a.unionByName(b), made)


def score(issues: DataFrame) -> DataFrame:
    """Share of the checks without any finding."""
    per = issues.groupBy("check").agg(F.max((C("severity") != "OK").cast("int")).alias("_bad"))
    return per.agg(F.count(F.lit(1)).alias("checks"), F.avg(1.0 - C("_bad")).alias("score"))


def autofix(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per key, gaps filled forward then backward within the symbol, rows without a positive close dropped."""
    rest = [c for c in df.columns if c not in ("symbol", "date")]
    once = df.groupBy("symbol", "date").agg(*[F.min(c).alias(c) for c in rest])
    w = Window.partitionBy("symbol").orderBy("date")
    past, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    filled = {c: F.coalesce(F.last(c, ignorenulls=True).over(past), F.first(c, ignorenulls=True).over(ahead)) for c in columns}
    return once.withColumns(filled).where(C("close") > 0)
