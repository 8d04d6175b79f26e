"""Score smoothing, selection, cohort returns, risk model and attribution: joins, windows, aggregates.

Selection takes the best k names of a date with ``row_number() <= k``; Spark keeps the k best of each
map task before the exchange (window group limit), so a date never gathers in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.elementwise import div
from quantloom.operators.cleaning import session_table

C = F.col
DAY_WEIGHTS = [0.1, 0.15, 0.2, 0.25, 0.3]  # fixed values: oldest to newest session


def _share(k: Column, age: Column, weights: list[float]) -> Column:
    """Weight of the value that is ``age`` places old among k: the last k weights, renormalised."""
    m = len(weights)
    table = [[weights[m - k_ + (k_ - 1 - a)] / sum(weights[m - k_ :]) for a in range(k_)] for k_ in range(1, m + 1)]
    lookup = F.array(*[F.array(*[F.lit(v) for v in row]) for row in table])
    return F.element_at(F.element_at(lookup, k.cast("int")), age.cast("int") + 1)


def smooth_scores(scores: DataFrame, value: str, weights: list[float]) -> DataFrame:
    """Per symbol the weighted mean over the last sessions of the table; any null in them gives null."""
    sessions = session_table(scores.select("date"))
    last = sessions.agg(F.max("ord")).scalar()
    recent = scores.join(F.broadcast(sessions.where(C("ord") > last - len(weights))), "date")
    w = Window.partitionBy("symbol")
    aged = recent.withColumns(
        {"_k": F.count(F.lit(1)).over(w), "_age": F.row_number().over(w.orderBy(C("ord").desc())) - 1}
    )
    total = F.sum(C(value) * _share(C("_k"), C("_age"), weights))
    missing = F.count_if(C(value).isNull()) > 0
    return aged.groupBy("symbol").agg(F.when(~missing, total).alias(value))


def smooth_panel(values: DataFrame, value: str, weights: list[float]) -> DataFrame:
    """The same rule for every row: its symbol's values of the last sessions, newest first.

    The rows of a symbol inside the trailing range of session ordinals are the grid without its gaps.
    """
    sessions = session_table(values.select("date"))
    m = len(weights)
    fr = Window.partitionBy("symbol").orderBy("ord").rangeBetween(-(m - 1), 0)
    rows = values.join(F.broadcast(sessions), "date").withColumn("_a", F.collect_list(value).over(fr))
    k = F.size("_a")
    total = F.aggregate(
        F.transform("_a", lambda x, i: x * _share(k, k - 1 - i, weights)), F.lit(0.0), lambda s, x: s + x
    )
    return rows.withColumn(value, F.when(k > 0, total)).drop("_a", "ord")


def trend_mask(rules: dict[str, float]) -> Column:
    """Every metric above its bound; a missing metric fails."""
    ok = F.lit(True)
    for name, bound in rules.items():
        ok = ok & F.coalesce(C(name) > bound, F.lit(False))
    return ok


def _top(df: DataFrame, order: list[Column], k: int, by=("date",), out: str = "rank") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(C(out) <= k)


def select_book(
    cands: DataFrame, pred: str, vol: str, top_n: int, min_confidence: float, min_stocks: int, vol_floor: float
) -> DataFrame:
    """Per date the top names by |prediction|, sized by confidence over volatility; no trade below ``min_stocks``."""
    c = cands.where(C(pred).isNotNull()).withColumn("confidence", F.abs(pred))
    c = _top(c, [C("confidence").desc(), C("symbol")], top_n)
    c = c.where((C("confidence") >= min_confidence) & (C(pred) != 0))
    day = Window.partitionBy("date")  # at most top_n rows from here on
    c = c.withColumn("_n", F.count(F.lit(1)).over(day)).where(C("_n") >= min_stocks)
    c = c.withColumn("_v", F.when(C(vol).isNotNull(), F.greatest(C(vol), F.lit(vol_floor))))
    fill = F.coalesce(F.percentile("_v", F.lit(0.5)).over(day), F.lit(0.02))
    c = c.withColumn("sizing_weight", C("confidence") / F.coalesce("_v", fill))
    return c.withColumns(
        {
            "position_pct": C("sizing_weight") / F.sum("sizing_weight").over(day) * 100,
            "side": F.when(C(pred) > 0, "long").otherwise("short"),
            "rank": F.row_number().over(day.orderBy(C("confidence").desc(), "symbol")),
        }
    ).drop("_n", "_v")


def select_capped(cands: DataFrame, pred: str, vol: str, top_n: int, min_stocks: int, sides: dict | None = None) -> DataFrame:
    """Top names by |prediction| over volatility; per-side gross when ``sides`` is given; names capped."""
    c = _top(cands.where(C(pred).isNotNull()), [F.abs(pred).desc(), C("symbol")], top_n)
    day = Window.partitionBy("date")
    c = c.withColumn("_n", F.count(F.lit(1)).over(day)).where(C("_n") >= min_stocks)
    fill = F.coalesce(F.percentile(C(vol), F.lit(0.5)).over(day), F.lit(0.3))
    c = c.withColumn("_w", F.abs(pred) / F.when(C(vol).isNotNull(), F.greatest(C(vol), F.lit(0.10))).otherwise(fill))
    c = c.withColumn("direction", F.signum(pred)).where(C("direction") != 0)
    cap = F.lit(max(0.15, 2.0 / top_n))
    if sides is None:
        share = C("_w") / F.sum("_w").over(day)
    else:
        gross = F.when(C("direction") > 0, sides[1]).otherwise(sides[-1])
        share = C("_w") / F.sum("_w").over(Window.partitionBy("date", "direction")) * gross
    return c.withColumn("weight", F.least(share, cap)).drop("_n", "_w", "rank")


def select_simple(cands: DataFrame, pred: str, top_n: int = 10, max_weight: float = 0.2) -> DataFrame:
    """Top names by |prediction|, proportional weights, capped."""
    c = _top(cands.where(C(pred).isNotNull() & (C(pred) != 0)), [F.abs(pred).desc(), C("symbol")], top_n)
    share = F.abs(pred) / F.sum(F.abs(pred)).over(Window.partitionBy("date"))
    return c.withColumns({"weight": F.least(share, F.lit(max_weight)), "direction": F.signum(pred)}).drop("rank")


def rebalance_days(sessions: DataFrame) -> DataFrame:
    """Daily, weekly (Monday) and monthly (first day) rebalance flags."""
    return sessions.select(
        "date",
        F.lit(1).alias("daily"),
        (F.weekday("date") == 0).cast("int").alias("weekly"),
        (F.dayofmonth("date") == 1).cast("int").alias("monthly"),
    )


def cohort_marks(book: DataFrame, prices: DataFrame, hold: int, cost: float) -> DataFrame:
    """(date, entry_date, symbol, weight, direction, mark, cost): one row per held session of each cohort.

    A book selected at t enters at the next open, is marked open → close, then close → close for
    ``hold`` sessions, and ends early at a missing price. Half the cost falls on the first and last mark.
    """
    sessions = session_table(prices.select("date"))
    last = sessions.agg(F.max("ord")).scalar()
    px = prices.join(F.broadcast(sessions), "date").select("symbol", "ord", "date", "open", "close")
    picked = book.join(F.broadcast(sessions), "date").select(
        "symbol", C("ord").alias("_t"), C("date").alias("entry_date"), "weight", "direction"
    )
    picked = picked.where(C("_t") < last).withColumn("_last", F.least(F.lit(hold), last - C("_t")))
    entry = px.select("symbol", (C("ord") - 1).alias("_t"), C("open").alias("_entry"))
    entered = picked.join(entry, ["symbol", "_t"]).where(C("_entry") > 0)
    held = entered.withColumn("_h", F.explode(F.sequence(F.lit(1), C("_last"))))
    marked = held.withColumn("ord", C("_t") + C("_h")).join(px.drop("open"), ["symbol", "ord"])
    cohort = Window.partitionBy("entry_date", "symbol").orderBy("_h")  # at most ``hold`` rows
    marked = marked.withColumns(
        {"_seen": F.row_number().over(cohort), "_prev": F.coalesce(F.lag("close").over(cohort), C("_entry"))}
    ).where(C("_seen") == C("_h"))
    charge = (F.when(C("_h") == 1, cost / 2).otherwise(0.0) + F.when(C("_h") == C("_last"), cost / 2).otherwise(0.0))
    w = C("weight") / hold
    return marked.select(
        "date", "entry_date", "symbol", w.alias("weight"), "direction",
        (w * (C("direction") * (C("close") / C("_prev") - 1) - charge)).alias("mark"), (w * charge).alias("cost"),
    )


def one_day_returns(book: DataFrame, prices: DataFrame, cost: float) -> DataFrame:
    """Next open to next close of the book, less a round trip, by signal date."""
    from quantloom.operators.joins import next_session_prices

    nxt = next_session_prices(prices).select("symbol", "date", "next_open", "next_close")
    rows = book.join(nxt, ["symbol", "date"]).where(C("next_open") > 0)
    gain = C("direction") * (C("next_close") / C("next_open") - 1) - cost
    return rows.groupBy("date").agg(F.sum(C("weight") * gain).alias("ret"))


def risk_rows(prices: DataFrame, window: int, min_periods: int, max_rows=None) -> DataFrame:
    """Per (date, symbol): return, market and sector return, ex-ante beta, and residual; they add up exactly.

    The market is the equal-weight mean of the date. Beta covers the ``window`` sessions before the row. Names without a
    sector form the sector "Unknown".
    """
    w = Window.partitionBy("symbol").orderBy("date")
    prices = prices.withColumn("sector", F.coalesce("sector", F.lit("Unknown")))
    rows = prices.withColumn("r", div(C("close"), F.lag("close").over(w)) - 1).where(C("r").isNotNull())
    market = rows.groupBy("date").agg(F.avg("r").alias("market"))
    sessions = session_table(market.select("date"))
    before = Window.orderBy("ord").rowsBetween(-window, -1)  # one row per session
    series = market.join(sessions, "date").withColumn("_var", F.var_samp("market").over(before))
    rows = rows.join(F.broadcast(series), "date")
    past = Window.partitionBy("symbol").orderBy("ord").rangeBetween(-window, -1)
    cov = F.when(F.count("r").over(past) >= min_periods, F.covar_samp("r", "market").over(past))
    beta = div(cov, C("_var"))
    rows = rows.withColumn("_b", beta)
    clipped = F.greatest(F.lit(-1.0), F.least("_b", F.lit(3.0)))
    rows = rows.withColumn("beta", F.when(C("_b").isNull(), 1.0).otherwise(clipped))
    rows = rows.withColumn("_res", C("r") - C("beta") * C("market"))
    sector = rows.groupBy("date", "sector").agg(F.avg("_res").alias("sector_ret"))
    rows = rows.join(sector, ["date", "sector"])
    return rows.select("date", "ord", "symbol", "sector", "r", "market", "beta", "sector_ret", (C("_res") - C("sector_ret")).alias("eps"))


def decompose(risk: DataFrame, weights: DataFrame) -> DataFrame:
    """Daily market, sector and selection components of a book and its exposures: they sum to Σ weight · return."""
    held = weights.groupBy("date", "symbol").agg(F.sum("weight").alias("w")).join(risk, ["date", "symbol"])
    return held.groupBy("date").agg(
        F.sum(C("w") * C("beta") * C("market")).alias("market"),
        F.sum(C("w") * C("sector_ret")).alias("sector"),
        F.sum(C("w") * C("eps")).alias("selection"),
        F.sum(C("w") * C("r")).alias("model_total"),
        F.sum(C("w") * C("beta")).alias("beta_exposure"),
        F.sum("w").alias("net_weight"),
        F.sum(F.abs("w")).alias("gross_weight"),
    )


def trailing_moments(x: Column, y: Column, keys: list[str], order: str, window: int) -> tuple[Column, Column]:
    """Count and sample covariance of x and y over the ``window`` positions of ``order`` before a row, which it leaves out.

    Sums up to the row less sums up to the window's start: each is one running total, whatever the window. Positions are
    unique within the keys. Pairs with a null or NaN are left out. x and y should lie near 0, as returns do.
    """
    both = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    rows = Window.partitionBy(*keys).orderBy(order)
    before, old = rows.rowsBetween(Window.unboundedPreceding, -1), rows.rangeBetween(Window.unboundedPreceding, -window - 1)

    def total(v: Column) -> Column:
        kept = F.when(both, v).otherwise(F.lit(0).cast("double"))
        return F.coalesce(F.sum(kept).over(before), F.lit(0.0)) - F.coalesce(F.sum(kept).over(old), F.lit(0.0))

    n = total(F.lit(1.0))
    return n, F.when(n > 1, (total(x * y) - total(x) * total(y) / n) / (n - 1))


def vol_forecast(risk: DataFrame, weights: DataFrame, window: int, min_periods: int) -> DataFrame:
    """Annualised ex-ante volatility per date from trailing factor covariances and residual variances.

    Factors are the market and the sectors, so a session is one row with a few dozen factors, and its pairs are made from
    that row: a pair's covariance is a difference of running totals.
    """
    by_sector = risk.groupBy("date", "ord", "sector").agg(F.max("sector_ret").alias("v"), F.max("market").alias("m"))
    listed = F.collect_list(F.when(C("sector").isNotNull(), F.struct(C("sector").alias("f"), "v")))
    market = F.array(F.struct(F.lit("MKT").alias("f"), F.max("m").alias("v")))
    sessions = by_sector.groupBy("date", "ord").agg(F.concat(market, listed).alias("fs"))
    first = sessions.select("date", "ord", "fs", F.explode("fs").alias("a"))
    pairs = first.select("date", "ord", C("a.f").alias("f"), C("a.v").alias("v"), F.explode("fs").alias("b")).select(
        "date", "ord", "f", "v", C("b.f").alias("g"), C("b.v").alias("u")
    ).where(C("f") <= C("g"))
    n, cov = trailing_moments(C("v"), C("u"), ["f", "g"], "ord", window)
    covs = pairs.select("date", "f", "g", F.when(n >= min_periods, cov).alias("c"), F.when(C("f") == C("g"), 1).otherwise(2).alias("times"))
    n, var = trailing_moments(C("eps"), C("eps"), ["symbol"], "ord", window)
    idio = F.when(n >= min_periods, F.greatest(var, F.lit(0.0)))
    held = weights.join(risk.withColumn("iv", idio), ["date", "symbol"])
    day = Window.partitionBy("date")  # a book, a few names
    fill = F.coalesce(F.percentile("iv", F.lit(0.5)).over(day), F.lit(0.0004))
    held = held.withColumn("_iv", F.coalesce("iv", fill))
    expo = held.groupBy("date").agg(F.lit("MKT").alias("f"), F.sum(C("weight") * C("beta")).alias("x")).unionByName(
        held.groupBy("date", C("sector").alias("f")).agg(F.sum("weight").alias("x"))
    )
    other = expo.select("date", C("f").alias("g"), C("x").alias("y"))
    systematic = (
        covs.join(expo, ["date", "f"]).join(other, ["date", "g"]).groupBy("date")
        .agg(F.sum(C("c") * C("times") * C("x") * C("y")).alias("_s"), F.count_if(C("c").isNull()).alias("_gaps"))
    )
    own = held.groupBy("date").agg(F.sum(C("weight") * C("weight") * C("_iv")).alias("_i"))
    total = C("_s") + C("_i")
    both = systematic.join(own, "date").where((C("_gaps") == 0) & (total >= 0))
    return both.select("date", F.sqrt(total * 252).alias("ann_vol"))


def summarize_attribution(daily: DataFrame, year: int = 252) -> DataFrame:
    picks = [F.count(F.lit(1)).alias("n_days"), (F.avg("model_total") * year).alias("ann_total")]
    for c in ("market", "sector", "selection"):
        picks.append((F.avg(c) * year).alias(f"ann_{c}"))
        picks.append((div(F.avg(c), F.stddev_samp(c)) * float(year) ** 0.5).alias(f"ir_{c}"))
    picks += [F.avg(c).alias(f"avg_{c}") for c in ("beta_exposure", "net_weight", "gross_weight")]
    picks.append(div(F.var_samp(C("market") + C("sector")), F.var_samp("model_total")).alias("systematic_share"))
    return daily.agg(*picks)


def drawdown_duration(daily: DataFrame, value: str = "ret") -> DataFrame:
    """Largest drawdown and the longest run of sessions below the running peak."""
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # one row per session
    e = daily.withColumn("_e", F.product(1 + C(value)).over(w))
    e = e.withColumn("_dd", C("_e") / F.max("_e").over(w) - 1)
    e = e.withColumn("_g", F.sum((C("_dd") >= 0).cast("int")).over(w))
    runs = e.groupBy("_g").agg(F.count_if(C("_dd") < 0).alias("_run"), F.min("_dd").alias("_low"))
    return runs.agg(F.min("_low").alias("max_drawdown"), F.max("_run").alias("duration"))
