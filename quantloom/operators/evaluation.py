"""Signal evaluation: rank IC and its statistics, deciles, turnover, residual IC, redundancy.

Per-date work is rank (see ``operators.panel``) followed by aggregates with map-side combine. Series
with one row per date are small by nature, and windows over them are bounded by the calendar.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.functions.elementwise import div
from quantloom.functions.rounding import snap
from quantloom.operators.cleaning import session_table
from quantloom.operators.panel import Panel

C = F.col


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation as an aggregate, null when either side is flat (``corr`` raises there)."""
    a, b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    flat = (F.min(a) == F.max(a)) | (F.min(b) == F.max(b))
    return F.when(~flat, snap(div(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))))


def daily_rank_ic(df: DataFrame, pred: str, target: str, min_names: int, max_rows=None, by=()) -> DataFrame:
    """(by…, date, ic, n): Spearman correlation per date over the rows where both sides are present."""
    by = list(by)
    p = Panel(df.where(C(pred).isNotNull() & C(target).isNotNull()), max_rows)
    a, b = p.rank(C(pred), by=by), p.rank(C(target), by=by)
    daily = p.df.groupBy(*by, "date").agg(correlation(a, b).alias("ic"), F.count(F.lit(1)).alias("n"))
    return daily.where((C("n") >= min_names) & C("ic").isNotNull())


def long_form(df: DataFrame, columns: list[str], keep: list[str], name="factor", value="score") -> DataFrame:
    return df.unpivot(keep, columns, name, value)


def summarize_ic(ic: DataFrame, lags: int = 0, by=(), value: str = "ic") -> DataFrame:
    """Count, mean, std, Newey-West t (Bartlett weights), information ratio and share positive, per ``by``."""
    by = list(by)
    series = Window.partitionBy(*by)
    dated = series.orderBy("date")
    d = ic.where(C(value).isNotNull()).withColumn("_d", C(value) - F.avg(value).over(series))
    d = d.withColumns({f"_l{k}": C("_d") * F.lag("_d", k).over(dated) for k in range(1, lags + 1)})
    made = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_days"),
        F.avg(value).alias("ic_mean"),
        F.stddev_samp(value).alias("ic_std"),
        F.avg(C("_d") * C("_d")).alias("_g0"),
        *[F.avg(f"_l{k}").alias(f"_g{k}") for k in range(1, lags + 1)],
        F.avg((C(value) > 0).cast("double")).alias("pct_positive"),
    )
    spread = C("_g0")
    for k in range(1, lags + 1):
        spread = spread + F.coalesce(C(f"_g{k}"), F.lit(0.0)) * (2.0 * (1.0 - k / (lags + 1)))
    n = C("n_days")
    t = C("ic_mean") / C("ic_std") * F.sqrt(n) if lags == 0 else C("ic_mean") / F.sqrt(F.greatest(spread, F.lit(1e-18)) / n)
    return made.select(
        *by,
        "n_days",
        "ic_mean",
        "ic_std",
        F.when(C("ic_std") > 0, t).alias("t_stat"),
        F.when(C("ic_std") > 0, C("ic_mean") / C("ic_std")).alias("ic_ir"),
        "pct_positive",
    )


def portfolio_metrics(daily: DataFrame, by=(), value: str = "ret", year: int = 252) -> DataFrame:
    """Return, volatility, Sharpe, Sortino, drawdown, Calmar and win rate of a daily series, per ``by``."""
    by = list(by)
    w = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    curve = daily.where(C(value).isNotNull()).withColumn("_e", F.product(1 + C(value)).over(w))
    curve = curve.withColumn("_dd", C("_e") / F.max("_e").over(w) - 1)
    lost = F.when(C(value) < 0, C(value))
    g = curve.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_days"),
        F.max_by("_e", "date").alias("_end"),
        F.avg(value).alias("_m"),
        F.stddev_samp(value).alias("_sd"),
        F.stddev_samp(lost).alias("_down"),
        F.min("_dd").alias("max_drawdown"),
        F.avg((C(value) > 0).cast("double")).alias("daily_win_rate"),
    )
    ann = F.pow(C("_end"), F.lit(float(year)) / C("n_days")) - 1
    root = float(year) ** 0.5
    return g.select(
        *by,
        "n_days",
        (C("_end") - 1).alias("total_return"),
        ann.alias("ann_return"),
        (C("_sd") * root).alias("ann_vol"),
        (div(C("_m"), C("_sd")) * root).alias("sharpe"),
        (div(C("_m"), C("_down")) * root).alias("sortino"),
        "max_drawdown",
        F.when(C("max_drawdown") < 0, ann / F.abs("max_drawdown")).alias("calmar"),
        "daily_win_rate",
    )


def rolling_mean_ic(ic: DataFrame, by: list[str], w: int, minp: int) -> DataFrame:
    fr = Window.partitionBy(*by).orderBy("date").rowsBetween(-(w - 1), 0)
    return ic.withColumn("rolling", F.when(F.count("ic").over(fr) >= minp, F.avg("ic").over(fr)))


def dev_baseline(rolling: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    inside = rolling.where((C("date") >= F.lit(start).cast("date")) & (C("date") < F.lit(end).cast("date")))
    return inside.groupBy(*by).agg(F.avg("rolling").alias("dev_mean"), F.stddev_samp("rolling").alias("dev_std"))


def trailing_run(flag: Column, ordinal: Column) -> Column:
    """Aggregate: length of the run of true flags ending at the last row."""
    return F.max(ordinal) - F.coalesce(F.max(F.when(~F.coalesce(flag, F.lit(False)), ordinal)), F.lit(0))


def evaluate_alerts(rolling: DataFrame, base: DataFrame, weights: DataFrame, by: str, warn: int, alert: int) -> DataFrame:
    """WARN after ``warn`` sessions below mean − std, ALERT after ``alert`` below zero while the weight is positive."""
    seen = rolling.where(C("rolling").isNotNull())
    seen = seen.withColumn("_o", F.row_number().over(Window.partitionBy(by).orderBy("date")))
    runs = seen.join(base, by, "left").groupBy(by).agg(
        trailing_run(C("rolling") < C("dev_mean") - C("dev_std"), C("_o")).alias("below_band"),
        trailing_run(C("rolling") < 0, C("_o")).alias("below_zero"),
        F.first("dev_std").alias("dev_std"),
    )
    joined = weights.join(runs, by, "left")
    status = (
        F.when(C("below_zero").isNull() | C("dev_std").isNull(), "NO_DATA")
        .when((C("below_zero") >= alert) & (C("weight") > 0), "ALERT")
        .when(C("below_band") >= warn, "WARN")
        .otherwise("OK")
    )
    return joined.select(by, status.alias("status"), "below_band", "below_zero")


def decile_means(df: DataFrame, score: str, label: str, min_names: int, max_rows=None, n_dec: int = 10) -> DataFrame:
    """(date, dec, mean): mean label per score decile; ties are split by symbol."""
    p = Panel(df.where(C(score).isNotNull() & C(label).isNotNull()), max_rows)
    n = p.cs_count(C(score))
    dec = p.stage(F.least(F.floor(F.try_divide(p.place(C(score)) * n_dec, n)) + 1, F.lit(n_dec)).cast("int"))
    kept = p.df.where(n >= min_names)
    return kept.groupBy("date", dec.alias("dec")).agg(F.avg(label).alias("mean"))


def decile_table(means: DataFrame, lags: int, n_dec: int = 10) -> DataFrame:
    """One row: dates, 10−1 spread with Newey-West t, monotonicity of the decile means, share positive."""
    spread = means.groupBy("date").agg(
        (F.max(F.when(C("dec") == n_dec, C("mean"))) - F.max(F.when(C("dec") == 1, C("mean")))).alias("spread")
    )
    stats = summarize_ic(spread, lags, value="spread")
    level = means.groupBy("dec").agg(F.avg("mean").alias("mean"))
    ranked = level.withColumn("_r", F.rank().over(Window.orderBy("mean")).cast("double"))  # at most n_dec rows
    mono = ranked.agg(correlation(C("_r"), C("dec").cast("double"))).scalar()
    return stats.select(
        C("n_days").alias("n_dates"),
        C("ic_mean").alias("spread_mean"),
        C("t_stat").alias("spread_t"),
        mono.alias("monotonicity"),
        C("pct_positive").alias("share_positive"),
    )


def turnover(df: DataFrame, score: str, hold: int, share: float = 0.1, max_rows=None) -> DataFrame:
    """Mean of 1 − overlap of the top share between t and t + hold, and the mean lag-hold autocorrelation."""
    p = Panel(df.where(C(score).isNotNull()).select("symbol", "date", score), max_rows)
    k = F.greatest(F.lit(1), F.floor(p.cs_count(C(score)) * share))
    top = p.stage(p.place(C(score), descending=True) <= k)
    sessions = session_table(p.df.select("date"))
    picked = p.df.where(top).select("symbol", "date").join(F.broadcast(sessions), "date")
    later = picked.select("symbol", (C("ord") - hold).alias("ord"), F.lit(1).alias("_kept"))
    last = sessions.agg(F.max("ord")).scalar()
    kept = picked.join(later, ["symbol", "ord"], "left").where(C("ord") <= last - hold)
    daily = kept.groupBy("ord").agg((1 - F.count("_kept") / F.count(F.lit(1))).alias("t"))
    w = Window.partitionBy("symbol").orderBy("date")
    lagged = p.df.select("symbol", "date", score).withColumn("_b", F.lag(score, hold).over(w))
    both = lagged.withColumn("_a", F.when(C("_b").isNotNull(), C(score)))
    auto = both.groupBy("symbol").agg(correlation(C("_a"), C("_b")).alias("ac"), F.count(score).alias("n"))
    mean_ac = auto.where(C("n") > hold + 5).agg(F.avg("ac")).scalar()
    return daily.agg(F.avg("t").alias("turnover")).withColumn("autocorr", mean_ac)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _solve(covs: pd.Series, cov_y: pd.Series) -> pd.Series:
    """Least-squares coefficients of each date from its covariances: k × k at most, never the rows."""
    made = []
    for flat, y in zip(covs, cov_y):
        k = len(y)
        made.append(np.linalg.lstsq(np.asarray(flat, dtype=float).reshape(k, k), np.asarray(y, dtype=float), rcond=None)[0])
    return pd.Series(made)


def residuals(df: DataFrame, y: str, others: list[str], out: str) -> DataFrame:
    """Per-date least-squares residual of ``y`` on ``others`` (with intercept).

    Only covariances are aggregated per date; the rows of a date are never gathered.
    """
    whole = df.dropna(subset=[y, *others])
    moments = whole.groupBy("date").agg(
        F.array(*[F.covar_samp(a, b) for a in others for b in others]).alias("_xx"),
        F.array(*[F.covar_samp(a, y) for a in others]).alias("_xy"),
        F.array(F.avg(y), *[F.avg(a) for a in others]).alias("_m"),
        F.count(F.lit(1)).alias("_n"),
    )
    fits = moments.where(C("_n") > len(others)).select("date", "_m", _solve("_xx", "_xy").alias("_b"))
    joined = whole.join(F.broadcast(fits), "date")  # one row per session
    value = C(y) - C("_m")[0]
    for i, a in enumerate(others):
        value = value - C("_b")[i] * (C(a) - C("_m")[i + 1])
    return joined.withColumn(out, snap(value)).drop("_b", "_m")


def residual_ic(df, y, others, label, min_names, max_rows=None) -> DataFrame:
    return daily_rank_ic(residuals(df.dropna(subset=[label]), y, others, "_res"), "_res", label, min_names, max_rows)


def factor_corr(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair of columns: one aggregate, one row per pair."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[correlation(C(a), C(b)).alias(f"{a}|{b}") for a, b in pairs])
    made = one.unpivot([], [f"`{c}`" for c in one.columns], "pair", "corr")
    return made.select(
        F.substring_index("pair", "|", 1).alias("a"), F.substring_index("pair", "|", -1).alias("b"), "corr"
    )


def rank_correlation(df: DataFrame, a: str, b: str, stride: int, min_names: int, max_rows=None) -> DataFrame:
    """Daily Spearman correlation of two columns on every ``stride``-th date."""
    whole = df.where(C(a).isNotNull() & C(b).isNotNull())
    sessions = session_table(whole).where((C("ord") - 1) % stride == 0).select("date")
    sampled = whole.join(F.broadcast(sessions), "date", "left_semi")
    return daily_rank_ic(sampled, a, b, min_names, max_rows)


def residual_rank_ic(df: DataFrame, cand: str, ref: str, label: str, min_names: int, max_rows=None) -> DataFrame:
    """IC of the candidate's ranks less their per-date regression on the reference's ranks."""
    p = Panel(df.dropna(subset=[cand, ref, label]), max_rows)
    n = p.cs_count(C(cand))
    rc, rr = p.stage(p.rank(C(cand)) * n), p.stage(p.rank(C(ref)) * n)
    ranked = p.df.select("symbol", "date", label, rc.alias("_rc"), rr.alias("_rr"))
    return daily_rank_ic(residuals(ranked, "_rc", ["_rr"], "_res"), "_res", label, min_names, max_rows)


def clusters(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(node, cluster): connected components of the pairs with |corr| ≥ threshold.

    Each round a node takes the smallest label among its neighbours, then labels are halved by
    following them once; the loop ends when an aggregate finds no change.
    """
    from quantloom.session import cut

    edges = pairs.where(F.abs("corr") >= threshold).select("a", "b")
    edges = edges.unionByName(edges.select(C("b").alias("a"), C("a").alias("b"))).distinct()
    labels = nodes.select("node", C("node").alias("cluster"))
    while True:
        near = edges.join(labels, C("b") == C("node")).groupBy(C("a").alias("node")).agg(F.min("cluster").alias("_near"))
        step = labels.join(near, "node", "left").select(
            "node", F.least("cluster", "_near").alias("cluster"), C("cluster").alias("_old")
        )
        jump = step.select(C("node").alias("cluster"), C("cluster").alias("_next"))
        step = cut(step.join(jump, "cluster", "left").select("node", F.least("cluster", "_next").alias("cluster"), "_old"))
        if step.where(C("cluster") != C("_old")).limit(1).count() == 0:
            return step.select("node", "cluster")
        labels = step.select("node", "cluster")


def composite(columns: list[str], need_share: float = 0.3) -> Column:
    """Mean of the members present, null unless at least ceil(share · m) of them are."""
    import math

    need = max(1, math.ceil(need_share * len(columns)))
    present = sum((C(c).isNotNull().cast("int") for c in columns), F.lit(0))
    total = sum((F.coalesce(C(c), F.lit(0.0)) for c in columns), F.lit(0.0))
    return F.when(present >= need, total / present)


def bh_flags(df: DataFrame, p: str, q: float) -> DataFrame:
    """Benjamini-Hochberg step-up: ``rejected`` per row and the ``threshold``, exact for a family of any size."""
    from quantloom.operators.ranking import value_ranks

    ranks = value_ranks(df, [], p)
    passing = ranks.where(C(p) <= q * (C("less") + C("n")) / C("total"))
    level = passing.agg(F.coalesce(F.max(p), F.lit(0.0))).scalar()
    any_hit = passing.agg(F.count(F.lit(1))).scalar()
    return df.withColumns({"threshold": level, "rejected": ((C(p) <= level) & (any_hit > 0)).cast("int")})
