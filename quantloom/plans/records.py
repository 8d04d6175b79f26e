"""Queries of reports, data quality, event-time reconstruction and live records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.functions.rounding import snap
from quantloom.operators import evaluation as ev
from quantloom.operators import history as hs
from quantloom.operators import quality as dq
from quantloom.operators import reports as rp
from quantloom.operators.ranking import with_pct_rank
from quantloom.plans.ingest import DIRTY, dirty
from quantloom.plans.joining import INTERVALS, intervals
from quantloom.plans.oracle import snap_sql
from quantloom.plans.registry import query
from quantloom.plans.scoring import LX, corr_sql, rk, scored
from quantloom.sources.incremental import distinct_keep_last, pick

C = F.col
HIT = "CASE WHEN f4 IS NOT NULL AND label IS NOT NULL THEN CAST(sign(f4) = sign(label) AS DOUBLE) END"

# -- reports -------------------------------------------------------------------------------------------


@query(
    "find_duplicate",
    """WITH l AS (SELECT sha1(event_type || '|' || CAST(user_id % 50 AS VARCHAR)) AS h, event_id, ts, row_number() OVER (PARTITION BY event_type, user_id % 50 ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE ts < TIMESTAMP '2024-01-15')
    SELECT e.event_id, l.event_id AS earlier FROM events e JOIN l ON l.h = sha1(e.event_type || '|' || CAST(e.user_id % 50 AS VARCHAR)) AND l.r = 1 WHERE e.ts >= TIMESTAMP '2024-01-15'""",
)
def find_duplicate(t):
    """Latest earlier record with the same canonical definition."""
    ev_ = t.events.select("event_id", "ts", F.sha1(F.concat_ws("|", "event_type", (C("user_id") % 50).cast("string"))).alias("h"))
    ledger = pick(ev_.where(C("ts") < "2024-01-15"), ["h"], F.struct("ts", "event_id"), last=True)
    return ev_.where(C("ts") >= "2024-01-15").join(ledger.select("h", C("event_id").alias("earlier")), "h").select("event_id", "earlier")


@query(
    "latest_per_key",
    "SELECT event_type, user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
)
def latest_per_key(t):
    rows = t.events.select("event_type", "user_id", "event_id", "ts")
    return pick(rows, ["event_type", "user_id"], F.struct("ts", "event_id"), last=True).drop("ts")


@query(
    "ic_proportional",
    f"""WITH {LX}, g AS (SELECT symbol, {corr_sql("(-f4)", "label")} AS ic FROM fx WHERE f4 IS NOT NULL AND label IS NOT NULL GROUP BY symbol), w AS (SELECT *, pow(greatest(ic - 0.01, 0), 0.5) AS w FROM g)
    SELECT symbol, ic, w / nullif(sum(w) OVER (), 0) AS weight FROM w""",
    q="ic weight",
)
def ic_proportional(t):
    ic = scored(t, "long").where(C("f4").isNotNull() & C("label").isNotNull()).groupBy("symbol").agg(ev.correlation(-C("f4"), C("label")).alias("ic"))
    return rp.ic_proportional(ic, "ic", 0.01, 0.5)


@query(
    "cap_redistribute",
    """WITH w AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderpriority AS factor, sum(o_totalprice) AS w FROM orders GROUP BY ALL),
    n AS (SELECT month, factor, w / sum(w) OVER (PARTITION BY month) AS w, CASE factor WHEN '1-URGENT' THEN 0.15 WHEN '2-HIGH' THEN 0.22 END AS cap FROM w),
    k AS (SELECT a.month, a.x, greatest(0, 1 - a.c) / nullif(sum(CASE WHEN NOT list_contains(a.x, n.factor) THEN n.w ELSE 0 END), 0) AS scale, count(*) FILTER (WHERE list_contains(a.x, n.factor)) AS held
      FROM (SELECT DISTINCT month, x, c FROM n, (VALUES ([]::VARCHAR[], 0.0), (['1-URGENT'], 0.15), (['2-HIGH'], 0.22), (['1-URGENT', '2-HIGH'], 0.37)) s(x, c)) a JOIN n USING (month) GROUP BY a.month, a.x, a.c),
    ok AS (SELECT k.month, k.x, k.scale FROM k JOIN n USING (month) GROUP BY k.month, k.x, k.scale
      HAVING bool_and(CASE WHEN list_contains(k.x, n.factor) THEN n.w * k.scale > n.cap - 1e-12 ELSE n.cap IS NULL OR n.w * k.scale <= n.cap + 1e-12 END)),
    one AS (SELECT month, arg_min(x, len(x)) AS x, arg_min(scale, len(x)) AS scale FROM ok GROUP BY month)
    SELECT month, factor, CASE WHEN list_contains(x, factor) THEN cap ELSE n.w * scale END AS capped FROM n JOIN one USING (month)""",
    q="capped",
    d="month",
)
def cap_redistribute(t):
    f = C("o_orderpriority")
    w = t.orders.groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("month"), f.alias("factor")).agg(F.sum("o_totalprice").alias("w"))
    w = w.withColumn("cap", F.when(C("factor") == "1-URGENT", 0.15).when(C("factor") == "2-HIGH", 0.22))
    return rp.cap_redistribute(w, ["month"], "w", "cap", "factor").select("month", "factor", "capped")


@query(
    "horizon_eval",
    """WITH b AS (SELECT symbol, date, close, """
    + snap_sql("((close - open) / open)")
    + """ AS p, row_number() OVER w AS rn, lead(close, 1) OVER w AS c1, lead(close, 5) OVER w AS c5, lead(close, 20) OVER w AS c20 FROM {long} WINDOW w AS (PARTITION BY symbol ORDER BY date)),
    h AS ("""
    + " UNION ALL ".join(f"SELECT {h} AS h, p, {snap_sql(f'(c{h} / close - 1)')} AS a FROM b WHERE c{h} IS NOT NULL" for h in (1, 5, 20))
    + f"""), r AS (SELECT *, {rk("p", "h")} AS rp, {rk("a", "h")} AS ra, {rk("p", "h")} / count(*) OVER (PARTITION BY h) AS pct, CAST(sign(p) = sign(a) AS DOUBLE) AS hit FROM h)
    SELECT h, {corr_sql("rp", "ra")} AS ic, avg(hit) AS overall, avg(hit) FILTER (WHERE p > 0) AS buy, avg(hit) FILTER (WHERE p < 0) AS sell,
      avg(a) FILTER (WHERE pct > 0.9) AS top, avg(a) FILTER (WHERE pct <= 0.1) AS bottom, avg(a) FILTER (WHERE pct > 0.9) - avg(a) FILTER (WHERE pct <= 0.1) AS spread FROM r GROUP BY h""",
    q="ic overall buy sell top bottom spread",
)
def horizon_eval(t):
    w = Window.partitionBy("symbol").orderBy("date")
    made = t.long_bars().select(
        snap((C("close") - C("open")) / C("open")).alias("p"),
        *[snap(F.lead("close", h).over(w) / C("close") - 1).alias(str(h)) for h in (1, 5, 20)],
    )
    long = made.unpivot(["p"], ["1", "5", "20"], "h", "a").where(C("a").isNotNull())
    # pooled over everything: ranks come from the bucketed form, never from one window over a horizon
    ranked = with_pct_rank(with_pct_rank(long, ["h"], "p", "rp"), ["h"], "a", "ra")
    top, low = C("rp") > 0.9, C("rp") <= 0.1
    return ranked.groupBy(C("h").cast("int").alias("h")).agg(
        ev.correlation(C("rp"), C("ra")).alias("ic"), *rp.win_rates(ranked, C("p"), C("a")),
        F.avg(F.when(top, C("a"))).alias("top"), F.avg(F.when(low, C("a"))).alias("bottom"),
        (F.avg(F.when(top, C("a"))) - F.avg(F.when(low, C("a")))).alias("spread"),
    )


@query(
    "win_rates",
    f"WITH {LX}, h AS (SELECT *, {HIT} AS hit FROM fx) SELECT avg(hit) AS overall, avg(hit) FILTER (WHERE f4 > 0) AS buy, avg(hit) FILTER (WHERE f4 < 0) AS sell FROM h",
    q="overall buy sell",
)
def win_rates(t):
    df = scored(t, "long")
    return df.agg(*rp.win_rates(df, C("f4"), C("label")))


@query(
    "confidence_buckets",
    f"""WITH {LX}, h AS (SELECT *, {HIT} AS hit, abs(f4) AS c FROM fx) SELECT CASE WHEN c <= 0.1 THEN '0-0.1' WHEN c <= 0.3 THEN '0.1-0.3' WHEN c <= 0.5 THEN '0.3-0.5' ELSE '0.5-1' END AS bucket,
    count(hit) AS n, avg(hit) AS hit_rate FROM h WHERE c > 0 AND c <= 1 GROUP BY 1""",
    q="hit_rate",
)
def confidence_buckets(t):
    """Right-closed bins of |prediction| and their hit rate."""
    df = scored(t, "long").withColumns({"c": F.abs("f4"), "hit": rp.hit(C("f4"), C("label"))})
    bucket = F.when(C("c") <= 0.1, "0-0.1").when(C("c") <= 0.3, "0.1-0.3").when(C("c") <= 0.5, "0.3-0.5").otherwise("0.5-1")
    kept = df.where((C("c") > 0) & (C("c") <= 1))
    return kept.groupBy(bucket.alias("bucket")).agg(F.count("hit").alias("n"), F.avg("hit").alias("hit_rate"))


@query(
    "stock_score",
    f"""WITH {LX}, r AS (SELECT *, {HIT} AS hit, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM fx WHERE f4 IS NOT NULL AND label IS NOT NULL)
    SELECT symbol, 0.7 * avg(hit) + 0.3 * (1 - least(avg(abs(label - f4)) / 2.0, 1)) AS score FROM r WHERE k <= 30 GROUP BY symbol HAVING count(*) >= 15""",
    q="score",
)
def stock_score(t):
    back = Window.partitionBy("symbol").orderBy(C("date").desc())
    df = scored(t, "long").where(C("f4").isNotNull() & C("label").isNotNull())
    g = df.withColumn("k", F.row_number().over(back)).where(C("k") <= 30).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.avg(rp.hit(C("f4"), C("label"))).alias("acc"), F.avg(F.abs(C("label") - C("f4"))).alias("mae")
    )
    return g.where(C("n") >= 15).select("symbol", (0.7 * C("acc") + 0.3 * (1 - F.least(C("mae") / 2.0, F.lit(1.0)))).alias("score"))


@query(
    "stock_stability",
    f"""WITH {LX}, m AS (SELECT symbol, date_trunc('month', date) AS month, avg({HIT}) AS acc FROM fx WHERE label IS NOT NULL AND f4 IS NOT NULL GROUP BY ALL HAVING count(*) >= 5)
    SELECT symbol, avg(acc) * (1 - stddev_pop(acc)) AS stability, count(*) AS months FROM m GROUP BY symbol HAVING count(*) >= 3""",
    q="stability",
)
def stock_stability(t):
    df = scored(t, "long").where(C("f4").isNotNull() & C("label").isNotNull())
    m = df.groupBy("symbol", F.trunc("date", "month").alias("month")).agg(
        F.avg(rp.hit(C("f4"), C("label"))).alias("acc"), F.count(F.lit(1)).alias("n")
    )
    g = m.where(C("n") >= 5).groupBy("symbol").agg(
        (F.avg("acc") * (1 - F.stddev_pop("acc"))).alias("stability"), F.count(F.lit(1)).alias("months")
    )
    return g.where(C("months") >= 3)


TRADES = """tr AS (SELECT symbol, date, (close - open) * volume AS pnl, CASE CAST(volume AS BIGINT) % 3 WHEN 0 THEN 'stop' WHEN 1 THEN 'take' ELSE 'time' END AS reason FROM {long})"""


def trades(t):
    k = C("volume").cast("long") % 3
    reason = F.when(k == 0, "stop").when(k == 1, "take").otherwise("time")
    return t.long_bars().select("symbol", "date", ((C("close") - C("open")) * C("volume")).alias("pnl"), reason.alias("reason"))


@query(
    "trade_stats",
    f"""WITH {TRADES} SELECT symbol, reason, CAST(dayofweek(date) AS INTEGER) AS day, count(*) AS n, sum(pnl) AS pnl, count(*) FILTER (WHERE pnl > 0) AS wins, count(*) FILTER (WHERE pnl < 0) AS losses,
    sum(pnl) FILTER (WHERE pnl > 0) / abs(sum(pnl) FILTER (WHERE pnl < 0)) AS profit_factor FROM tr GROUP BY GROUPING SETS ((symbol), (reason), (dayofweek(date)), ())""",
    q="pnl profit_factor",
)
def trade_stats(t):
    tr = trades(t).withColumn("day", (F.dayofweek("date") - 1).cast("int"))
    won, lost = F.when(C("pnl") > 0, C("pnl")), F.when(C("pnl") < 0, C("pnl"))
    return tr.groupingSets([[C("symbol")], [C("reason")], [C("day")], []], "symbol", "reason", "day").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pnl").alias("pnl"), F.count(won).alias("wins"), F.count(lost).alias("losses"),
        (F.sum(won) / F.abs(F.sum(lost))).alias("profit_factor"),
    )


@query(
    "performance_report",
    f"""WITH {LX} SELECT symbol, count(label - f4) AS n, avg({HIT}) AS accuracy, avg(label - f4) AS bias, avg(abs(label - f4)) AS mae,
    {corr_sql("CASE WHEN f4 IS NOT NULL AND label IS NOT NULL THEN f4 END", "CASE WHEN f4 IS NOT NULL AND label IS NOT NULL THEN label END")} AS corr,
    CASE WHEN avg({HIT}) < 0.45 OR avg(abs(label - f4)) > 1.0 THEN 1 ELSE 0 END AS problem FROM fx GROUP BY symbol""",
    q="accuracy bias mae corr",
)
def performance_report(t):
    return rp.symbol_report(scored(t, "long"), C("f4"), C("label"))


@query(
    "factor_attribution_prop",
    f"""WITH {TRADES}, w AS (SELECT * FROM (VALUES ('momentum', 0.5), ('value', 0.3), ('volatility', 0.2)) v(factor, weight))
    SELECT factor, sum(pnl * weight) AS pnl, sum(pnl * weight) FILTER (WHERE pnl > 0) AS won, sum(pnl * weight) FILTER (WHERE pnl < 0) AS lost,
    sum(pnl * weight) / (SELECT sum(pnl) FROM tr) AS share FROM tr, w GROUP BY factor""",
    q="pnl won lost share",
)
def factor_attribution_prop(t):
    # fixed values: example factor weights; sums first, so the trades are never multiplied by the factors
    weights = F.create_map(*[F.lit(x) for kv in (("momentum", 0.5), ("value", 0.3), ("volatility", 0.2)) for x in kv])
    p = C("pnl")
    sums = trades(t).agg(F.sum(p).alias("all"), F.sum(F.when(p > 0, p)).alias("won"), F.sum(F.when(p < 0, p)).alias("lost"))
    rows = sums.select("all", "won", "lost", F.explode(weights).alias("factor", "w"))
    return rows.select("factor", (C("all") * C("w")).alias("pnl"), (C("won") * C("w")).alias("won"), (C("lost") * C("w")).alias("lost"), C("w").alias("share"))


REG = """ix AS (SELECT date, avg(close) AS price, avg(high - low) / avg(close) * 35 AS vix FROM {long} GROUP BY date),
  sg AS (SELECT date, price, vix, CASE WHEN count(price) OVER (ORDER BY date ROWS 19 PRECEDING) = 20 THEN avg(price) OVER (ORDER BY date ROWS 19 PRECEDING) END AS a,
    CASE WHEN count(price) OVER (ORDER BY date ROWS 49 PRECEDING) = 50 THEN avg(price) OVER (ORDER BY date ROWS 49 PRECEDING) END AS b, (price / lag(price, 20) OVER (ORDER BY date) - 1) * 100 AS r FROM ix),
  tv AS (SELECT date, CASE WHEN price > a AND a > b AND r > 5 THEN 'STRONG_UP' WHEN price > a AND r > 0 THEN 'UP' WHEN price < a AND a < b AND r < -5 THEN 'STRONG_DOWN' WHEN price < a AND r < 0 THEN 'DOWN' ELSE 'SIDEWAYS' END AS trend,
    CASE WHEN vix < 15 THEN 'VERY_LOW' WHEN vix < 20 THEN 'LOW' WHEN vix < 30 THEN 'ELEVATED' WHEN vix < 40 THEN 'HIGH' ELSE 'EXTREME' END AS vix_band FROM sg),
  rg AS (SELECT *, CASE WHEN trend IN ('STRONG_UP', 'UP') AND vix_band IN ('VERY_LOW', 'LOW') THEN 'BULL' WHEN trend IN ('STRONG_DOWN', 'DOWN') AND vix_band NOT IN ('VERY_LOW', 'LOW') THEN 'BEAR'
    WHEN vix_band IN ('HIGH', 'EXTREME') THEN 'HIGH_VOL' WHEN trend = 'SIDEWAYS' AND vix_band IN ('VERY_LOW', 'LOW') THEN 'LOW_VOL' ELSE 'NEUTRAL' END AS regime FROM tv)"""


def regimes(t):
    ix = t.long_bars().groupBy("date").agg(F.avg("close").alias("price"), (F.avg(C("high") - C("low")) / F.avg("close") * 35).alias("vix"))
    return rp.regime(ix)


@query("market_regime", f"WITH {REG} SELECT date, trend, vix_band, regime FROM rg", d="date")
def market_regime(t):
    return regimes(t)


@query(
    "regime_params",
    f"""WITH {REG}, pr AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for k, (a, b, c) in rp.REGIME_PARAMS.items())}) v(regime, stop_loss, take_profit, position_size))
    SELECT date, regime, stop_loss, take_profit, position_size FROM rg JOIN pr USING (regime)""",
    d="date",
)
def regime_params(t):
    return rp.regime_params(regimes(t).select("date", "regime"))


# -- data quality --------------------------------------------------------------------------------------

COLS = ["open", "high", "low", "close", "volume"]


def _grade_sql(v, warn, critical):
    return f"CASE WHEN {v} > {critical} THEN 'CRITICAL' WHEN {v} > {warn} THEN 'WARNING' ELSE 'OK' END"


def _issue_sql(check, values, severity):
    return " UNION ALL ".join(
        f"SELECT '{check}' AS \"check\", '{n}' AS subject, v AS value, {severity('v')} AS severity FROM (SELECT CAST({x} AS DOUBLE) AS v FROM {src})"
        for n, (x, src) in values.items()
    )


MISSING = _issue_sql("missing", {c: (f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0 END) * 100", "d") for c in COLS}, lambda v: _grade_sql(v, 10, 20))
ANOM = _issue_sql(
    "anomalies",
    {
        "close_nonpositive": ("count(*) FILTER (WHERE close <= 0)", "d"),
        "close_jump": ("count(*) FILTER (WHERE m > 0.5)", "(SELECT abs(close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1) AS m FROM d)"),
    },
    lambda v: f"CASE WHEN {v} > 0 THEN 'WARNING' ELSE 'OK' END",
)
STALE = _issue_sql("staleness", {"date": ("date_diff('day', max(date), DATE '2001-12-01')", "d")}, lambda v: _grade_sql(v, 3, 7))
CONS = _issue_sql(
    "consistency",
    {
        "duplicates": ("coalesce(sum(n - 1), 0)", "(SELECT count(*) AS n FROM d GROUP BY symbol, date)"),
        "high_below_low": ("count(*) FILTER (WHERE high < low)", "d"),
        "close_outside": ("count(*) FILTER (WHERE close > high OR close < low)", "d"),
    },
    lambda v: f"CASE WHEN {v} > 0 THEN 'WARNING' ELSE 'OK' END",
)
OUT = _issue_sql(
    "outliers",
    {c: (f"avg(CASE WHEN {c} < q[1] - 3 * (q[2] - q[1]) OR {c} > q[2] + 3 * (q[2] - q[1]) THEN 1.0 WHEN {c} IS NOT NULL THEN 0 END) * 100", f"d, (SELECT quantile_cont({c}, [0.25, 0.75]) AS q FROM d)") for c in ("close", "volume")},
    lambda v: _grade_sql(v, 5, 1e9),
)


@query("dq_missing", f"WITH d AS {DIRTY} {MISSING}", q="value")
def dq_missing(t):
    return dq.missing(dirty(t), COLS)


@query("dq_anomalies", f"WITH d AS {DIRTY} {ANOM}", q="value")
def dq_anomalies(t):
    return dq.anomalies(dirty(t), ["close"])


def as_of():
    return F.lit("2001-12-01").cast("date")


@query("dq_staleness", f"WITH d AS {DIRTY} {STALE}", q="value")
def dq_staleness(t):
    return dq.staleness(dirty(t), as_of())


@query("dq_consistency", f"WITH d AS {DIRTY} {CONS}", q="value")
def dq_consistency(t):
    return dq.consistency(dirty(t))


@query("dq_outliers", f"WITH d AS {DIRTY} {OUT}", q="value")
def dq_outliers(t):
    return dq.outliers(dirty(t), ["close", "volume"])


@query(
    "dq_score",
    f"""WITH d AS {DIRTY}, i AS ({MISSING} UNION ALL {ANOM} UNION ALL {STALE} UNION ALL {CONS} UNION ALL {OUT})
    SELECT count(*) AS checks, avg(1.0 - bad) AS score FROM (SELECT "check", max(CASE WHEN severity <> 'OK' THEN 1 ELSE 0 END) AS bad FROM i GROUP BY 1)""",
    q="score",
)
def dq_score(t):
    from quantloom.session import cut

    d = cut(dirty(t))
    parts = [dq.missing(d, COLS), dq.anomalies(d, ["close"]), dq.staleness(d, as_of()), dq.consistency(d), dq.outliers(d, ["close", "volume"])]
    return dq.score(reduce(lambda a, b: a.unionByName(b), parts))


@query(
    "dq_autofix",
    f"""WITH d AS {DIRTY}, u AS (SELECT symbol, date, min(close) AS close, min(volume) AS volume FROM d GROUP BY ALL)
    SELECT * FROM (SELECT symbol, date, coalesce(last_value(close IGNORE NULLS) OVER p, first_value(close IGNORE NULLS) OVER a) AS close, coalesce(last_value(volume IGNORE NULLS) OVER p, first_value(volume IGNORE NULLS) OVER a) AS volume FROM u
    WINDOW p AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) WHERE close > 0""",
    d="date",
)
def dq_autofix(t):
    d = dirty(t)
    return dq.autofix(d.unionByName(d), ["close", "volume"]).select("symbol", "date", "close", "volume")


# -- aggregated sources --------------------------------------------------------------------------------


@query(
    "membership_counts",
    f"""SELECT CAST(y AS INTEGER) AS year, count(i.symbol) AS members FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders) LEFT JOIN {INTERVALS} i
    ON i.start <= make_date(y, 6, 30) AND make_date(y, 6, 30) < coalesce(i."end", DATE '2100-01-01') GROUP BY y""",
)
def membership_counts(t):
    """Members on 30 June of each year: an interval is expanded to its years, then joined by equality."""
    years = t.orders.select(F.year("o_orderdate").alias("year")).distinct()
    last = years.agg(F.max("year")).scalar()
    mid = lambda y: F.make_date(y, F.lit(6), F.lit(30))
    iv = intervals(t).withColumn("year", F.explode(F.sequence(F.year("start"), F.greatest(F.year("start"), last))))
    inside = (C("start") <= mid(C("year"))) & (mid(C("year")) < F.coalesce("end", F.lit("2100-01-01").cast("date")))
    counts = iv.where(inside).groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    return years.join(counts, "year", "left").select("year", F.coalesce("n", F.lit(0)).alias("members"))


@query(
    "shares_by_filing",
    """WITH s AS (SELECT l_orderkey AS filing, CAST(l_shipdate AS DATE) AS period_end, sum(l_quantity) AS shares FROM lineitem GROUP BY ALL)
    SELECT filing, period_end, shares FROM (SELECT *, row_number() OVER (PARTITION BY filing ORDER BY period_end DESC) AS r FROM s) WHERE r = 1""",
    d="period_end",
)
def shares_by_filing(t):
    s = t.lineitem.groupBy(C("l_orderkey").alias("filing"), F.to_date("l_shipdate").alias("period_end")).agg(F.sum("l_quantity").alias("shares"))
    return pick(s, ["filing"], C("period_end"), last=True)


@query(
    "insider_daily",
    """SELECT l_suppkey AS symbol, CAST(o_orderdate AS DATE) AS filed, sum(l_quantity) FILTER (WHERE l_returnflag = 'A') AS buy_shares, sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS sell_shares,
    sum(l_extendedprice) FILTER (WHERE l_returnflag = 'A') AS buy_value, sum(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS sell_value,
    count(DISTINCT o_custkey) FILTER (WHERE l_returnflag = 'A') AS n_buyers, count(DISTINCT o_custkey) FILTER (WHERE l_returnflag = 'R') AS n_sellers
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag IN ('A', 'R') GROUP BY ALL""",
    q="buy_value sell_value",
)
def insider_daily(t):
    """Transactions joined to their filing: shares, value and distinct owners per side."""
    rows = t.lineitem.where(C("l_returnflag").isin("A", "R")).join(t.orders, C("l_orderkey") == C("o_orderkey"))
    side = lambda s, c: F.when(C("l_returnflag") == s, C(c))
    return rows.groupBy(C("l_suppkey").alias("symbol"), F.to_date("o_orderdate").cast("string").alias("filed")).agg(
        F.sum(side("A", "l_quantity")).alias("buy_shares"), F.sum(side("R", "l_quantity")).alias("sell_shares"),
        F.sum(side("A", "l_extendedprice")).alias("buy_value"), F.sum(side("R", "l_extendedprice")).alias("sell_value"),
        F.count_distinct(side("A", "o_custkey")).alias("n_buyers"), F.count_distinct(side("R", "o_custkey")).alias("n_sellers"),
    )


@query(
    "institutional_quarterly",
    """WITH h AS (SELECT l_suppkey AS symbol, date_trunc('quarter', o_orderdate) AS period, o_custkey AS manager, o_orderkey AS filing, o_orderdate AS filed, sum(l_quantity) AS shares
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
    f AS (SELECT period, manager, arg_min(filing, (filed, filing)) AS filing FROM h GROUP BY ALL),
    m AS (SELECT symbol, period, manager, sum(shares) AS shares FROM h JOIN f USING (period, manager, filing) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY symbol, period ORDER BY shares DESC, manager) AS k FROM m)
    SELECT symbol, CAST(CAST(period AS DATE) AS VARCHAR) AS period, sum(shares) AS inst_shares, count(DISTINCT manager) AS inst_holders, sum(shares) FILTER (WHERE k <= 5) / sum(shares) AS top5_share FROM r GROUP BY ALL""",
    q="top5_share",
)
def institutional_quarterly(t):
    """First filing per manager and quarter; holdings, holders and the share of the five largest."""
    h = t.lineitem.join(t.orders, C("l_orderkey") == C("o_orderkey")).groupBy(
        C("l_suppkey").alias("symbol"), F.trunc("o_orderdate", "quarter").alias("period"), C("o_custkey").alias("manager"),
        C("o_orderkey").alias("filing"), C("o_orderdate").alias("filed"),
    ).agg(F.sum("l_quantity").alias("shares"))
    first = h.groupBy("period", "manager").agg(F.min_by("filing", F.struct("filed", "filing")).alias("filing"))
    m = h.join(first, ["period", "manager", "filing"]).groupBy("symbol", "period", "manager").agg(F.sum("shares").alias("shares"))
    w = Window.partitionBy("symbol", "period").orderBy(C("shares").desc(), "manager")
    # the five largest are filtered by row_number, which Spark limits before the exchange
    top = m.withColumn("k", F.row_number().over(w)).where(C("k") <= 5).groupBy("symbol", "period").agg(F.sum("shares").alias("top"))
    total = m.groupBy("symbol", "period").agg(F.sum("shares").alias("inst_shares"), F.count(F.lit(1)).alias("inst_holders"))
    return total.join(top, ["symbol", "period"]).select(
        "symbol", C("period").cast("string").alias("period"), "inst_shares", "inst_holders", (C("top") / C("inst_shares")).alias("top5_share")
    )


@query(
    "pivot_iv",
    """WITH g AS (SELECT user_id AS symbol, CAST(ts AS DATE) AS date, avg(value) FILTER (WHERE event_type = 'click') AS iv_call, avg(value) FILTER (WHERE event_type = 'view') AS iv_put FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL)
    SELECT symbol, date, iv_call, iv_put, CASE WHEN iv_call IS NULL THEN iv_put WHEN iv_put IS NULL THEN iv_call ELSE (iv_call + iv_put) / 2 END AS iv_atm, iv_put - iv_call AS iv_skew FROM g""",
    q="iv_call iv_put iv_atm iv_skew",
    d="date",
)
def pivot_iv(t):
    rows = t.events.where(C("event_type").isin("click", "view"))
    g = rows.groupBy(C("user_id").alias("symbol"), F.to_date("ts").alias("date")).pivot("event_type", ["click", "view"]).agg(F.avg("value"))
    call, put = C("click"), C("view")
    atm = F.coalesce((call + put) / 2, call, put)
    return g.select("symbol", "date", call.alias("iv_call"), put.alias("iv_put"), atm.alias("iv_atm"), (put - call).alias("iv_skew"))


# -- event-time reconstruction -------------------------------------------------------------------------

N = "(SELECT count(*) FROM supplier)"
CHG = f"""ch AS (SELECT DISTINCT o_custkey % {N} AS symbol, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END AS kind FROM orders WHERE o_orderstatus <> 'P')"""


def owner(t):
    return C("o_custkey") % t.rows("supplier")


@query(
    "index_intervals",
    f"""WITH {CHG}, cu AS (SELECT s_suppkey AS symbol, CASE WHEN s_suppkey % 4 = 0 THEN DATE '1994-06-01' END AS added FROM supplier WHERE s_suppkey % 2 = 0),
    m AS (SELECT *, lag(kind) OVER (PARTITION BY symbol ORDER BY date, kind) AS prev, max(date) OVER (PARTITION BY symbol) AS last FROM ch),
    x AS (SELECT *, lead(date) OVER (PARTITION BY symbol ORDER BY date, kind) AS nxt FROM m WHERE prev IS NULL OR prev <> kind)
    SELECT symbol, date AS start, CASE WHEN nxt IS NOT NULL THEN nxt WHEN symbol NOT IN (SELECT symbol FROM cu) THEN last END AS "end" FROM x WHERE kind = 1
    UNION ALL SELECT x.symbol, coalesce(cu.added, DATE '1900-01-01'), date FROM x LEFT JOIN cu USING (symbol) WHERE kind = -1 AND prev IS NULL
    UNION ALL SELECT symbol, coalesce(added, DATE '1900-01-01'), NULL FROM cu WHERE symbol NOT IN (SELECT symbol FROM ch)""",
    d='start "end"',
)
def index_intervals(t):
    o = t.orders.where(C("o_orderstatus") != "P").select(
        owner(t).alias("symbol"), F.to_date("o_orderdate").alias("date"), F.when(C("o_orderstatus") == "F", 1).otherwise(-1).alias("kind")
    )
    current = t.supplier.where(C("s_suppkey") % 2 == 0).select(
        C("s_suppkey").alias("symbol"), F.when(C("s_suppkey") % 4 == 0, F.lit("1994-06-01").cast("date")).alias("added")
    )
    return hs.index_intervals(o, current)


RANKED = """mr AS (SELECT symbol, last_day(date) AS date, row_number() OVER (PARTITION BY last_day(date) ORDER BY sum(volume) DESC, symbol) AS rank, max(date) AS seen FROM {long} GROUP BY symbol, last_day(date))"""


def monthly_ranks(t):
    from quantloom.operators.panel import Panel

    m = t.long_bars().groupBy("symbol", F.last_day("date").alias("date")).agg(F.sum("volume").alias("volume"))
    p = Panel(m, t.day_rows("lineitem"))
    place = p.place(C("volume"), descending=True)
    return p.df.select("symbol", "date", place.alias("rank"))


@query(
    "hysteresis_membership",
    f"""WITH {RANKED}, lp AS (SELECT symbol, max(date) AS last_price FROM {{long}} GROUP BY symbol), ao AS (SELECT max(last_price) + 30 AS as_of FROM lp),
    s AS (SELECT *, coalesce(last_value(CASE WHEN rank BETWEEN 20 AND 60 THEN 1 WHEN rank < 10 OR rank > 70 THEN -1 END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING), -1) AS st FROM mr),
    tn AS (SELECT * FROM (SELECT *, coalesce(lag(st) OVER (PARTITION BY symbol ORDER BY date), -1) AS pv FROM s) WHERE st <> pv),
    e AS (SELECT *, lead(date) OVER (PARTITION BY symbol ORDER BY date) AS nx FROM tn)
    SELECT symbol, date + 1 AS start, coalesce(nx, CASE WHEN last_price < as_of - 45 THEN last_price END) AS "end" FROM e JOIN lp USING (symbol), ao WHERE st = 1""",
    d='start "end"',
)
def hysteresis_membership(t):
    last = t.long_bars().groupBy("symbol").agg(F.max("date").alias("last_price"))
    as_of_ = F.date_add(t.lineitem.agg(F.to_date(F.max("l_shipdate"))).scalar(), 30)
    return hs.hysteresis_membership(monthly_ranks(t), (20, 60), (10, 70), last, as_of_)


# facts by (symbol, metric, start, end): direct quarters for even symbols, year-to-date chains for odd ones, and full years
FACTS = f"""o AS (SELECT o_custkey % {N} AS symbol, CASE WHEN o_orderkey % 2 = 0 THEN 'ni' ELSE 'cfo' END AS metric, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q, CAST(date_trunc('year', o_orderdate) AS DATE) AS y, sum(o_totalprice) AS v FROM orders GROUP BY ALL),
  c AS (SELECT *, sum(v) OVER (PARTITION BY symbol, metric, y ORDER BY q) AS ytd, sum(v) OVER (PARTITION BY symbol, metric, y) AS yr, count(*) OVER (PARTITION BY symbol, metric, y) AS n FROM o),
  fa AS (SELECT symbol, metric, q AS start, CAST(q + INTERVAL 3 MONTH AS DATE) - 1 AS "end", CAST(q + INTERVAL 3 MONTH AS DATE) + 30 AS filed, v AS val FROM c WHERE symbol % 2 = 0 AND month(q) < 10
    UNION ALL SELECT symbol, metric, y, CAST(q + INTERVAL 3 MONTH AS DATE) - 1, CAST(q + INTERVAL 3 MONTH AS DATE) + 40, ytd FROM c WHERE symbol % 2 = 1
    UNION ALL SELECT symbol, metric, y, CAST(y + INTERVAL 12 MONTH AS DATE) - 1, CAST(y + INTERVAL 12 MONTH AS DATE) + 60, yr FROM c WHERE symbol % 2 = 0 AND n = 4 AND month(q) = 1)"""


def facts(t):
    o = t.orders.groupBy(
        owner(t).alias("symbol"), F.when(C("o_orderkey") % 2 == 0, "ni").otherwise("cfo").alias("metric"),
        F.trunc("o_orderdate", "quarter").alias("q"), F.trunc("o_orderdate", "year").alias("y"),
    ).agg(F.sum("o_totalprice").alias("v"))
    year = Window.partitionBy("symbol", "metric", "y")
    c = o.withColumns({"ytd": F.sum("v").over(year.orderBy("q")), "yr": F.sum("v").over(year), "n": F.count(F.lit(1)).over(year)})
    after = F.add_months("q", 3)
    even = C("symbol") % 2 == 0

    def part(where, start, end, lag, val):
        return c.where(where).select("symbol", "metric", C(start).alias("start"), F.date_sub(end, 1).alias("end"), F.date_add(end, lag).alias("filed"), C(val).alias("val"))

    made = [
        part(even & (F.month("q") < 10), "q", after, 30, "v"), part(~even, "y", after, 40, "ytd"),
        part(even & (C("n") == 4) & (F.month("q") == 1), "y", F.add_months("y", 12), 60, "yr"),
    ]
    return reduce(lambda a, b: a.unionByName(b), made)


@query(
    "first_filed_facts",
    f"""WITH {FACTS}, d AS (SELECT *, 1 AS pref FROM fa UNION ALL SELECT symbol, metric, start, "end", filed + 90, val * 2, 1 FROM fa UNION ALL SELECT symbol, metric, start, "end", filed, val * 3, 2 FROM fa)
    SELECT symbol, metric, start, "end", arg_min(filed, (filed, pref, val)) AS filed, arg_min(val, (filed, pref, val)) AS val FROM d GROUP BY symbol, metric, start, "end\"""",
    q="val",
    d='start "end" filed',
)
def first_filed_facts(t):
    f = facts(t)
    late = f.withColumns({"filed": F.date_add("filed", 90), "val": C("val") * 2})
    other = f.withColumn("val", C("val") * 3).withColumn("pref", F.lit(2))
    both = f.unionByName(late).withColumn("pref", F.lit(1)).unionByName(other)
    return hs.first_filed(both)


def quarters_sql(lo=75, hi=105):
    return f"""{FACTS}, dd AS (SELECT *, date_diff('day', start, "end") AS dur FROM fa),
  k0 AS (SELECT symbol, metric, "end", val, filed FROM dd WHERE dur BETWEEN {lo} AND {hi}
    UNION ALL SELECT symbol, metric, "end", val - pv, greatest(filed, pf) FROM (SELECT *, lag("end") OVER w AS pe, lag(val) OVER w AS pv, lag(filed) OVER w AS pf FROM dd WHERE dur >= {lo} WINDOW w AS (PARTITION BY symbol, metric, start ORDER BY "end"))
      WHERE dur > {hi} AND date_diff('day', pe, "end") BETWEEN {lo} AND {hi}),
  k1 AS (SELECT symbol, metric, "end", arg_min(val, (filed, val)) AS val, min(filed) AS filed FROM k0 GROUP BY symbol, metric, "end"),
  yy AS (SELECT d.symbol, d.metric, d."end", d.val - sum(k1.val) FILTER (WHERE k1."end" > d.start AND k1."end" <= d."end" - 60) AS val, greatest(d.filed, max(k1.filed) FILTER (WHERE k1."end" > d.start AND k1."end" <= d."end" - 60)) AS filed
    FROM dd d JOIN k1 USING (symbol, metric) WHERE d.dur BETWEEN 350 AND 380 GROUP BY d.symbol, d.metric, d.start, d."end", d.val, d.filed
    HAVING count(*) FILTER (WHERE k1."end" > d.start AND k1."end" <= d."end" - 60) = 3 AND count(*) FILTER (WHERE abs(date_diff('day', k1."end", d."end")) <= 10) = 0),
  qs AS (SELECT symbol, metric, "end", arg_min(val, (filed, val)) AS val, min(filed) AS filed FROM (SELECT * FROM k1 UNION ALL SELECT * FROM yy) GROUP BY symbol, metric, "end"),
  tt AS (SELECT symbol, metric, "end", s AS val, f AS filed FROM (SELECT *, lag("end", 3) OVER w AS first, sum(val) OVER (w ROWS 3 PRECEDING) AS s, max(filed) OVER (w ROWS 3 PRECEDING) AS f FROM qs WINDOW w AS (PARTITION BY symbol, metric ORDER BY "end"))
    WHERE date_diff('day', first, "end") BETWEEN 240 AND 300)"""


@query("quarterly_series", f"WITH {quarters_sql()} SELECT * FROM qs", q="val", d='"end" filed')
def quarterly_series(t):
    return hs.quarterly_series(facts(t))


@query("ttm_events", f"WITH {quarters_sql()} SELECT * FROM tt", q="val", d='"end" filed')
def ttm_events(t):
    return hs.ttm_events(hs.quarterly_series(facts(t)))


@query("extract_concepts", f"WITH {quarters_sql(60, 120)} SELECT * FROM qs", q="val", d='"end" filed')
def extract_concepts(t):
    """The second extractor: the same reconstruction with wider quarter bounds."""
    return hs.quarterly_series(facts(t), quarter=(60, 120))


@query(
    "ttm_availability",
    f"""WITH {quarters_sql(60, 120)} SELECT symbol, metric, max(filed) OVER w AS avail, sum(val) OVER w AS val FROM qs
    WINDOW w AS (PARTITION BY symbol, metric ORDER BY "end" ROWS 3 PRECEDING) QUALIFY count(*) OVER w = 4""",
    q="val",
    d="avail",
)
def ttm_availability(t):
    four = Window.partitionBy("symbol", "metric").orderBy("end").rowsBetween(-3, 0)
    qs = hs.quarterly_series(facts(t), quarter=(60, 120))
    made = qs.select("symbol", "metric", F.max("filed").over(four).alias("avail"), F.sum("val").over(four).alias("val"), F.count(F.lit(1)).over(four).alias("n"))
    return made.where(C("n") == 4).drop("n")


STOCKS = f"""sk AS (SELECT o_custkey % {N} AS symbol, CASE o_orderkey % 3 WHEN 0 THEN 'assets' WHEN 1 THEN 'equity' ELSE 'shares' END AS metric, last_day(CAST(o_orderdate AS DATE)) AS "end", CAST(o_orderdate AS DATE) + 45 AS filed, o_totalprice AS val FROM orders),
  se AS (SELECT symbol, metric, "end", min(filed) AS filed, arg_min(val, (filed, val)) AS val FROM sk GROUP BY symbol, metric, "end")"""


def stocks(t):
    k = C("o_orderkey") % 3
    return t.orders.select(
        owner(t).alias("symbol"), F.when(k == 0, "assets").when(k == 1, "equity").otherwise("shares").alias("metric"),
        F.last_day("o_orderdate").alias("end"), F.date_add("o_orderdate", 45).alias("filed"), C("o_totalprice").alias("val"),
    )


@query("stock_events", f"WITH {STOCKS} SELECT * FROM se", d='"end" filed')
def stock_events(t):
    return hs.stock_events(stocks(t))


@query(
    "state_after_filing",
    f"""WITH {STOCKS}, l AS (SELECT symbol, metric, filed, arg_max({{'v': val, 'e': "end"}}, "end") AS r FROM se GROUP BY ALL),
    w AS (SELECT symbol, filed, max(r) FILTER (WHERE metric = 'assets') AS a, max(r) FILTER (WHERE metric = 'equity') AS e, max(r) FILTER (WHERE metric = 'shares') AS s, max(r.e) AS period_end FROM l GROUP BY ALL),
    c AS (SELECT symbol, filed, period_end, last_value(a IGNORE NULLS) OVER p AS a, last_value(e IGNORE NULLS) OVER p AS e, last_value(s IGNORE NULLS) OVER p AS s FROM w WINDOW p AS (PARTITION BY symbol ORDER BY filed ROWS UNBOUNDED PRECEDING))
    SELECT symbol, filed, period_end, CASE WHEN date_diff('day', a.e, period_end) <= 60 THEN a.v END AS assets, CASE WHEN date_diff('day', e.e, period_end) <= 60 THEN e.v END AS equity, CASE WHEN date_diff('day', s.e, period_end) <= 60 THEN s.v END AS shares FROM c""",
    d="filed period_end",
)
def state_after_filing(t):
    return hs.state_after_filing(hs.stock_events(stocks(t)), ["assets", "equity", "shares"], 60)


def _asof_sql(prev, name, src):
    return f"""u_{name} AS (SELECT symbol, filed, arg_max(val, "end") AS v, max("end") AS e FROM {src} WHERE metric = '{name}' GROUP BY ALL),
    j_{name} AS (SELECT {prev}.*, CASE WHEN date_diff('day', e, date) <= 400 THEN v END AS {name} FROM {prev} ASOF LEFT JOIN u_{name} ON {prev}.symbol = u_{name}.symbol AND {prev}.date >= u_{name}.filed)"""


def _clip_sql(a, b):
    x = f"({a}) / nullif({b}, 0)"
    return f"CASE WHEN {x} IS NOT NULL THEN greatest(-10, least({x}, 10)) END"


@query(
    "fundamental_features",
    f"""WITH {quarters_sql()}, {STOCKS}, pb AS (SELECT symbol, date, close FROM {{long}}), {_asof_sql("pb", "ni", "tt")}, {_asof_sql("j_ni", "cfo", "tt")}, {_asof_sql("j_cfo", "assets", "se")}, {_asof_sql("j_assets", "equity", "se")}, {_asof_sql("j_equity", "shares", "se")}
    SELECT symbol, date, {_clip_sql("ni", "shares * close")} AS ep_ttm, {_clip_sql("equity", "shares * close")} AS bp, {_clip_sql("ni", "equity")} AS roe_ttm, {_clip_sql("ni - cfo", "assets")} AS accruals_ttm FROM j_shares""",
    q="ep_ttm bp roe_ttm accruals_ttm",
    d="date",
)
def fundamental_features(t):
    ttm = hs.ttm_events(hs.quarterly_series(facts(t)))
    return hs.fundamental_features(t.long_bars().select("symbol", "date", "close"), ttm, hs.stock_events(stocks(t)))


@query(
    "merge_order_versions",
    """SELECT l_orderkey AS base_id, sum(l_quantity) AS qty, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS filled_qty,
    sum(CASE WHEN l_linestatus = 'F' THEN l_extendedprice ELSE 0 END) / nullif(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END), 0) AS filled_price,
    arg_max(l_linestatus, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS status, count(*) AS versions FROM lineitem GROUP BY l_orderkey""",
    q="filled_price",
)
def merge_order_versions(t):
    done = C("l_linestatus") == "F"
    o = t.lineitem.select(
        C("l_orderkey").alias("base_id"), C("l_quantity").alias("qty"), F.when(done, C("l_quantity")).otherwise(0.0).alias("filled_qty"),
        (C("l_extendedprice") / C("l_quantity")).alias("price"), C("l_linestatus").alias("status"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("version"),
    )
    return hs.merge_versions(o)


@query(
    "exposure",
    """SELECT symbol, sum(v) AS gross, coalesce(sum(v) FILTER (WHERE short), 0) AS short FROM (
    SELECT l_suppkey AS symbol, l_extendedprice AS v, l_returnflag = 'R' AS short FROM lineitem WHERE l_linestatus = 'F'
    UNION ALL SELECT l_suppkey, l_quantity * 1.5 * l_extendedprice / l_quantity, l_returnflag = 'R' FROM lineitem WHERE l_linestatus = 'O' AND l_discount > 0.02) GROUP BY symbol""",
    q="gross short",
)
def exposure(t):
    sold = C("l_returnflag") == "R"
    held = t.lineitem.where(C("l_linestatus") == "F").select(
        C("l_suppkey").alias("symbol"), F.when(sold, -C("l_extendedprice")).otherwise(C("l_extendedprice")).alias("value")
    )
    pending = t.lineitem.where((C("l_linestatus") == "O") & (C("l_discount") > 0.02)).select(
        C("l_suppkey").alias("symbol"), (C("l_quantity") * 1.5).alias("remaining"), (C("l_extendedprice") / C("l_quantity")).alias("price"),
        F.when(sold, "sell").otherwise("buy").alias("side"),
    )
    return hs.exposure(held, pending)


@query(
    "exec_arm",
    """SELECT symbol, date, CASE WHEN contains('13579bdf', substr(sha256(CAST(symbol AS VARCHAR) || '|' || CAST(date AS VARCHAR)), 2, 1)) THEN 'limit' ELSE 'market' END AS arm FROM {long}""",
    d="date",
)
def exec_arm(t):
    return t.long_bars().select("symbol", "date", hs.exec_arm(C("symbol"), C("date").cast("string")).alias("arm"))


@query(
    "slippage",
    f"""WITH b AS (SELECT symbol, date, open FROM {{long}}), f AS (SELECT l_returnflag AS kind, l_linestatus AS arm, {snap_sql("(CASE WHEN l_discount < 0.05 THEN 1 ELSE -1 END * (l_extendedprice / l_quantity - open) / open * 1e4)")} AS bp
      FROM lineitem JOIN b ON l_suppkey = symbol AND CAST(l_shipdate AS DATE) = date),
    r AS (SELECT *, row_number() OVER (PARTITION BY kind, arm ORDER BY bp) AS k, count(*) OVER (PARTITION BY kind, arm) AS n FROM f)
    SELECT kind, arm, max(n) AS n, avg(bp) AS mean_bp, quantile_cont(bp, 0.5) AS median_bp, avg(bp) FILTER (WHERE k > floor(n * 0.1) AND k <= n - floor(n * 0.1)) AS trimmed_bp FROM r GROUP BY ALL""",
    q="mean_bp median_bp trimmed_bp",
)
def slippage(t):
    b = t.long_bars().select("symbol", "date", C("open").alias("bench"))
    fills = t.lineitem.select(
        C("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("date"), C("l_returnflag").alias("kind"), C("l_linestatus").alias("arm"),
        F.when(C("l_discount") < 0.05, "buy").otherwise("sell").alias("side"), (C("l_extendedprice") / C("l_quantity")).alias("fill"),
    ).join(b, ["symbol", "date"])
    return hs.slippage(fills, ["kind", "arm"])


@query(
    "distinct_keep_last",
    "SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
)
def distinct_keep_last_(t):
    rows = t.events.select("user_id", "event_type", "value", "ts", "event_id")
    return distinct_keep_last(rows, ["user_id", "event_type"], F.struct("ts", "event_id")).select("user_id", "event_type", "value")
