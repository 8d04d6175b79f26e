"""Event-time reconstruction: intervals from change logs, quarters from cumulative filings, states, versions.

Every window here is over rows already reduced to one per (key, date) or (key, period).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.rounding import snap

C = F.col
FAR_PAST = "1900-01-01"


def index_intervals(changes: DataFrame, current: DataFrame) -> DataFrame:
    """Change log (symbol, date, kind ±1) → half-open membership intervals.

    A symbol whose first event is a removal was a member from the date the current table gives, or from
    the far past. A current member ends open; one that is not ends at its last event.
    """
    ev = changes.select("symbol", "date", "kind").distinct()
    w = Window.partitionBy("symbol").orderBy("date", "kind")
    marked = ev.withColumns({"_prev": F.lag("kind").over(w), "_last": F.max("date").over(Window.partitionBy("symbol"))})
    turns = marked.where(C("_prev").isNull() | (C("_prev") != C("kind")))
    turns = turns.withColumn("_next", F.lead("date").over(w))
    facts = current.select("symbol", C("added").alias("_added"), F.lit(True).alias("_current"))
    both = turns.join(facts, "symbol", "left")
    far = F.lit(FAR_PAST).cast("date")
    opened = both.where(C("kind") == 1).select(
        "symbol", C("date").alias("start"),
        F.when(C("_next").isNotNull(), C("_next")).when(C("_current").isNull(), C("_last")).alias("end"),
    )
    before = both.where((C("kind") == -1) & C("_prev").isNull()).select(
        "symbol", F.coalesce("_added", far).alias("start"), C("date").alias("end")
    )
    quiet = facts.join(ev.select("symbol").distinct(), "symbol", "left_anti").select(
        "symbol", F.coalesce("_added", far).alias("start"), F.lit(None).cast("date").alias("end")
    )
    return opened.unionByName(before).unionByName(quiet)


def hysteresis_membership(ranks: DataFrame, enter: tuple, leave: tuple, last_price: DataFrame, as_of: Column) -> DataFrame:
    """Enter inside one rank band, leave outside a wider one: the state is the last signal seen."""
    r = C("rank")
    signal = F.when(r.between(*enter), 1).when((r < leave[0]) | (r > leave[1]), -1)
    w = Window.partitionBy("symbol").orderBy("date")
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    state = ranks.withColumn("_s", F.coalesce(F.last(signal, ignorenulls=True).over(past), F.lit(-1)))
    turns = state.withColumn("_p", F.coalesce(F.lag("_s").over(w), F.lit(-1))).where(C("_s") != C("_p"))
    ends = turns.withColumn("_end", F.lead("date").over(w)).where(C("_s") == 1)
    rows = ends.join(last_price, "symbol", "left")
    gone = F.when(C("last_price") < F.date_sub(as_of, 45), C("last_price"))
    return rows.select("symbol", F.date_add("date", 1).alias("start"), F.coalesce("_end", gone).alias("end"))


def first_filed(facts: DataFrame) -> DataFrame:
    """Earliest filing per (symbol, metric, start, end); the preferred tag breaks ties."""
    order = F.struct("filed", "pref", "val")
    one = facts.groupBy("symbol", "metric", "start", "end").agg(F.min_by(F.struct("filed", "val"), order).alias("_r"))
    return one.select("symbol", "metric", "start", "end", "_r.filed", "_r.val")


def quarterly_series(facts: DataFrame, quarter=(75, 105), year=(350, 380)) -> DataFrame:
    """Quarter values: direct facts, differences along a year-to-date chain, and year less three quarters."""
    keys = ["symbol", "metric"]
    dated = facts.where(C("start").isNotNull()).withColumn("_dur", F.datediff("end", "start"))
    inside = C("_dur").between(*quarter)
    direct = dated.where(inside).select(*keys, "end", "val", "filed")
    w = Window.partitionBy(*keys, "start").orderBy("end")
    chain = dated.where(inside | (C("_dur") > quarter[1])).withColumns(
        {"_pe": F.lag("end").over(w), "_pv": F.lag("val").over(w), "_pf": F.lag("filed").over(w)}
    )
    stepped = chain.where((C("_dur") > quarter[1]) & F.datediff("end", "_pe").between(*quarter)).select(
        *keys, "end", (C("val") - C("_pv")).alias("val"), F.greatest("filed", "_pf").alias("filed")
    )

    def once(df):
        best = df.groupBy(*keys, "end").agg(F.min_by(F.struct("val", "filed"), F.struct("filed", "val")).alias("_r"))
        return best.select(*keys, "end", "_r.val", "_r.filed")

    known = once(direct.unionByName(stepped))
    years = dated.where(C("_dur").between(*year)).select(
        *keys, C("start").alias("_ys"), C("end").alias("_ye"), C("val").alias("_yv"), C("filed").alias("_yf")
    )
    pairs = years.join(known, keys)
    within = (C("end") > C("_ys")) & (C("end") <= F.date_sub("_ye", 60))
    close = F.abs(F.datediff("end", "_ye")) <= 10
    rest = pairs.groupBy(*keys, "_ys", "_ye", "_yv", "_yf").agg(
        F.count_if(within).alias("_n"), F.count_if(close).alias("_c"),
        F.sum(F.when(within, C("val"))).alias("_s"), F.max(F.when(within, C("filed"))).alias("_f"),
    )
    last = rest.where((C("_n") == 3) & (C("_c") == 0)).select(
        *keys, C("_ye").alias("end"), (C("_yv") - C("_s")).alias("val"), F.greatest("_yf", "_f").alias("filed")
    )
    return once(known.unionByName(last))


def ttm_events(quarters: DataFrame, span=(240, 300)) -> DataFrame:
    """Sum of four quarters whose ends span about three quarters; known at the latest of their filings."""
    w = Window.partitionBy("symbol", "metric").orderBy("end")
    four = w.rowsBetween(-3, 0)
    made = quarters.withColumns(
        {"_first": F.lag("end", 3).over(w), "_sum": F.sum("val").over(four), "_filed": F.max("filed").over(four)}
    )
    kept = made.where(F.datediff("end", "_first").between(*span))
    return kept.select("symbol", "metric", "end", C("_sum").alias("val"), C("_filed").alias("filed"))


def stock_events(facts: DataFrame) -> DataFrame:
    """Instant values: the first filing per period end."""
    one = facts.groupBy("symbol", "metric", "end").agg(F.min_by(F.struct("filed", "val"), F.struct("filed", "val")).alias("_r"))
    return one.select("symbol", "metric", "end", "_r.filed", "_r.val")


def state_after_filing(events: DataFrame, metrics: list[str], stale_days: int = 400) -> DataFrame:
    """Wide state known after each filing, carried forward, null once its period is too old."""
    latest = events.groupBy("symbol", "metric", "filed").agg(F.max_by(F.struct("val", "end"), C("end")).alias("_r"))
    wide = latest.groupBy("symbol", "filed").agg(
        *[F.max(F.when(C("metric") == m, C("_r"))).alias(m) for m in metrics], F.max("_r.end").alias("period_end")
    )
    past = Window.partitionBy("symbol").orderBy("filed").rowsBetween(Window.unboundedPreceding, 0)
    carried = wide.withColumns({m: F.last(m, ignorenulls=True).over(past) for m in metrics})
    value = lambda m: F.when(F.datediff("period_end", C(f"{m}.end")) <= stale_days, C(f"{m}.val"))
    return carried.select("symbol", "filed", "period_end", *[value(m).alias(m) for m in metrics])


def fundamental_features(panel: DataFrame, ttm: DataFrame, stocks: DataFrame, max_age_days: int = 400) -> DataFrame:
    """Value, profitability, investment and accrual ratios as known on each date, clipped to ±10."""
    from quantloom.operators.joins import asof_join

    rows = panel
    for name, source in (("ni", ttm), ("cfo", ttm), ("assets", stocks), ("equity", stocks), ("shares", stocks)):
        one = source.where(C("metric") == name).groupBy("symbol", C("filed").alias("date")).agg(
            F.max_by(F.struct("val", "end"), C("end")).alias("_r")
        ).select("symbol", "date", C("_r.val").alias("_v"), C("_r.end").alias("_e"))
        rows = asof_join(rows, one, "date", ["_v", "_e"])
        fresh = F.datediff("date", "_e") <= max_age_days
        rows = rows.withColumn(f"_{name}", F.when(fresh, C("_v"))).drop("_v", "_e", "at_right")
    cap = C("_shares") * C("close")
    ratio = lambda a, b: F.try_divide(a, F.nullif(b, F.lit(0.0)))
    clip = lambda x: F.when(x.isNotNull(), F.greatest(F.lit(-10.0), F.least(x, F.lit(10.0))))
    return rows.select(
        "symbol", "date",
        clip(ratio(C("_ni"), cap)).alias("ep_ttm"),
        clip(ratio(C("_equity"), cap)).alias("bp"),
        clip(ratio(C("_ni"), C("_equity"))).alias("roe_ttm"),
        clip(ratio(C("_ni") - C("_cfo"), C("_assets"))).alias("accruals_ttm"),
    )


def merge_versions(orders: DataFrame) -> DataFrame:
    """An order and its replacements as one: quantities add up, the price is weighted by fills."""
    filled = F.sum("filled_qty")
    g = orders.groupBy("base_id").agg(
        F.sum("qty").alias("qty"), filled.alias("filled_qty"),
        (F.sum(C("filled_qty") * C("price")) / F.nullif(filled, F.lit(0.0))).alias("filled_price"),
        F.max_by("status", "version").alias("status"), F.count(F.lit(1)).alias("versions"),
    )
    return g


def exposure(positions: DataFrame, pending: DataFrame) -> DataFrame:
    """Gross and short exposure by symbol: positions and the unfilled part of entry orders."""
    both = positions.select("symbol", F.abs("value").alias("v"), (C("value") < 0).alias("short")).unionByName(
        pending.select("symbol", (C("remaining") * C("price")).alias("v"), (C("side") == "sell").alias("short"))
    )
    return both.groupBy("symbol").agg(
        F.sum("v").alias("gross"), F.coalesce(F.sum(F.when(C("short"), C("v"))), F.lit(0.0)).alias("short")
    )


def slippage(fills: DataFrame, by: list[str], trim: float = 0.1) -> DataFrame:
    """Mean, exact median and trimmed mean of signed slippage in basis points, per group of any size."""
    from quantloom.operators.ranking import percentiles, value_ranks

    sign = F.when(C("side") == "buy", 1.0).otherwise(-1.0)
    bp = fills.withColumn("bp", snap(F.try_divide(sign * (C("fill") - C("bench")), C("bench")) * 1e4)).where(C("bp").isNotNull())
    stats = bp.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("bp").alias("mean_bp"))
    median = percentiles(bp, by, "bp", {"median_bp": 0.5})
    ranks = value_ranks(bp, by, "bp")
    cutoff = F.floor(C("total") * trim)
    # copies of a value that fall inside the kept positions
    kept = F.greatest(F.lit(0), F.least(C("less") + C("n"), C("total") - cutoff) - F.greatest(C("less"), cutoff))
    trimmed = ranks.groupBy(*by).agg((F.sum(C("bp") * kept) / F.sum(kept)).alias("trimmed_bp"))
    return stats.join(median, by).join(trimmed, by)


def exec_arm(symbol: Column, date: Column) -> Column:
    """Deterministic A/B arm: parity of the first byte of the hash of symbol and date."""
    digit = F.substring(F.sha2(F.concat_ws("|", symbol.cast("string"), date), 256), 2, 1)
    return F.when(digit.isin(*"13579bdf"), "limit").otherwise("market")
