"""Queries of smoothing, selection, portfolio returns, risk and attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions.rounding import snap
from quantloom.operators import evaluation as ev
from quantloom.operators import indicators as ind
from quantloom.operators import portfolio as pf
from quantloom.operators.cleaning import session_table
from quantloom.plans.oracle import snap_sql
from quantloom.plans.registry import query
from quantloom.plans.scoring import FX, METRICS, metrics_sql, scored
from quantloom.sources.incremental import pick

C = F.col
W5 = pf.DAY_WEIGHTS


def _share_sql(k, age):
    m = len(W5)
    arms = " ".join(
        f"WHEN {k} = {n} AND {age} = {a} THEN {W5[m - n + (n - 1 - a)] / sum(W5[m - n :])!r}" for n in range(1, m + 1) for a in range(n)
    )
    return f"CASE {arms} END"


@query(
    "smooth_scores",
    f"""WITH {FX}, s AS (SELECT date, row_number() OVER (ORDER BY date) AS ord FROM (SELECT DISTINCT date FROM fx)),
    r AS (SELECT symbol, f4, count(*) OVER (PARTITION BY symbol) AS k, row_number() OVER (PARTITION BY symbol ORDER BY ord DESC) - 1 AS age
      FROM fx JOIN s USING (date) WHERE ord > (SELECT max(ord) FROM s) - 5)
    SELECT symbol, CASE WHEN count(*) FILTER (WHERE f4 IS NULL) = 0 THEN sum(f4 * {_share_sql("k", "age")}) END AS f4 FROM r GROUP BY symbol""",
    q="f4",
)
def smooth_scores(t):
    return pf.smooth_scores(scored(t).select("symbol", "date", "f4"), "f4", W5)


@query(
    "smooth_panel",
    f"""WITH {FX}, s AS (SELECT date, row_number() OVER (ORDER BY date) AS ord FROM (SELECT DISTINCT date FROM fx)),
    v AS (SELECT symbol, date, ord, CASE WHEN symbol % 7 = 0 AND f2 > 3 THEN NULL ELSE f3 END AS f3 FROM fx JOIN s USING (date)),
    j AS (SELECT a.symbol, a.date, b.f3, count(*) OVER (PARTITION BY a.symbol, a.date) AS k,
      row_number() OVER (PARTITION BY a.symbol, a.date ORDER BY b.ord DESC) - 1 AS age
      FROM v a JOIN v b ON a.symbol = b.symbol AND b.ord BETWEEN a.ord - 4 AND a.ord AND b.f3 IS NOT NULL)
    SELECT v.symbol, v.date, x.f3 FROM v LEFT JOIN (SELECT symbol, date, sum(f3 * {_share_sql("k", "age")}) AS f3 FROM j GROUP BY ALL) x USING (symbol, date)""",
    q="f3",
    d="date",
)
def smooth_panel(t):
    f3 = F.when((C("symbol") % 7 == 0) & (C("f2") > 3), None).otherwise(C("f3"))
    return pf.smooth_panel(scored(t).select("symbol", "date", f3.alias("f3")), "f3", W5)


@query(
    "mcap_rank",
    """WITH b AS (SELECT * FROM {long}), m AS (SELECT symbol, date_trunc('month', date) AS month, max(date) AS date, arg_max(close, date) AS close FROM b GROUP BY ALL),
    sh AS (SELECT symbol, day, arg_max(val, key) AS shares FROM (SELECT o_custkey % (SELECT count(*) FROM supplier) AS symbol, CAST(o_orderdate AS DATE) AS day, o_totalprice AS val, o_orderkey AS key FROM orders) GROUP BY ALL),
    c AS (SELECT m.symbol, m.date, CAST(m.month AS DATE) AS month, m.close * sh.shares AS cap FROM m ASOF LEFT JOIN sh ON m.symbol = sh.symbol AND m.date - 45 >= sh.day)
    SELECT symbol, month, cap, CAST(row_number() OVER (PARTITION BY month ORDER BY cap DESC, symbol) AS BIGINT) AS rank FROM c WHERE cap IS NOT NULL""",
    q="cap",
    d="month",
)
def mcap_rank(t):
    """Month-end price times the shares known 45 days earlier, ranked within the month."""
    from quantloom.operators.joins import asof_join
    from quantloom.operators.panel import Panel

    month = F.trunc("date", "month")
    ends = t.long_bars().groupBy("symbol", month.alias("month")).agg(F.max("date").alias("date"), F.max_by("close", "date").alias("close"))
    n = t.rows("supplier")
    shares = t.orders.groupBy((C("o_custkey") % n).alias("symbol"), F.to_date("o_orderdate").alias("day")).agg(
        F.max_by("o_totalprice", "o_orderkey").alias("shares")
    )
    lagged = ends.withColumn("day", F.date_sub("date", 45))
    caps = asof_join(lagged, shares, "day", ["shares"]).select("symbol", C("month").alias("date"), (C("close") * C("shares")).alias("cap"))
    p = Panel(caps.where(C("cap").isNotNull()), t.day_rows("lineitem"))
    place = p.place(C("cap"), descending=True)
    return p.df.select("symbol", C("date").alias("month"), "cap", place.cast("long").alias("rank"))


def volatile(t):
    """Dense scores with a short trailing volatility; null until three returns are seen."""
    from pyspark.sql import Window

    fr = Window.partitionBy("symbol").orderBy("date").rowsBetween(-4, 0)
    vol = F.when(F.count("f1").over(fr) >= 3, snap(F.stddev_samp("f1").over(fr)))
    return scored(t).select("symbol", "date", C("f4").alias("pred"), vol.alias("vol"))


VX = f"""{FX}, vx AS (SELECT symbol, date, f4 AS pred, {snap_sql("CASE WHEN count(f1) OVER f >= 3 THEN stddev_samp(f1) OVER f END")} AS vol FROM fx
  WINDOW f AS (PARTITION BY symbol ORDER BY date ROWS 4 PRECEDING))"""


def book_sql(src, top=10, minc=0.05, mins=5, floor=0.1):
    return f"""(WITH a AS (SELECT *, abs(pred) AS confidence, row_number() OVER (PARTITION BY date ORDER BY abs(pred) DESC, symbol) AS rk FROM {src} WHERE pred IS NOT NULL),
      b AS (SELECT *, count(*) OVER (PARTITION BY date) AS n FROM a WHERE rk <= {top} AND confidence >= {minc} AND pred <> 0),
      c AS (SELECT *, CASE WHEN vol IS NOT NULL THEN greatest(vol, {floor}) END AS v FROM b WHERE n >= {mins}),
      d AS (SELECT *, confidence / coalesce(v, median(v) OVER (PARTITION BY date), 0.02) AS sizing_weight FROM c)
      SELECT symbol, date, pred, CASE WHEN pred > 0 THEN 'long' ELSE 'short' END AS side, sizing_weight,
        sizing_weight / sum(sizing_weight) OVER (PARTITION BY date) * 100 AS position_pct,
        CAST(row_number() OVER (PARTITION BY date ORDER BY confidence DESC, symbol) AS INTEGER) AS rank FROM d)"""


BOOK = ["symbol", "date", "pred", "side", "sizing_weight", "position_pct", "rank"]


@query(
    "select_book",
    f"WITH {VX} SELECT * FROM {book_sql('(SELECT * FROM vx WHERE date = (SELECT max(date) FROM vx))')}",
    q="pred sizing_weight position_pct",
    d="date",
)
def select_book(t):
    v = volatile(t)
    day = v.where(C("date") == t.dense_bars().agg(F.max("date")).scalar())
    return pf.select_book(day, "pred", "vol", 10, 0.05, 5, 0.1).select(*BOOK)


@query("books_from_predictions", f"WITH {VX} SELECT * FROM {book_sql('vx')}", q="pred sizing_weight position_pct", d="date")
def books_from_predictions(t):
    return pf.select_book(volatile(t), "pred", "vol", 10, 0.05, 5, 0.1).select(*BOOK)


TREND = """tr AS (SELECT *, CASE WHEN row_number() OVER w >= 30 THEN (close / lag(close, 6) OVER w - 1) * 100 END AS return_7d,
  CASE WHEN row_number() OVER w >= 30 THEN (avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS 6 PRECEDING) / avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS 29 PRECEDING) - 1) * 100 END AS trend_strength
  FROM {long} WINDOW w AS (PARTITION BY symbol ORDER BY date))"""
_OK = "coalesce(return_7d > 0, FALSE) AND coalesce(trend_strength > -5, FALSE)"
RULES = {"return_7d": 0.0, "trend_strength": -5.0}


def trended(t):
    p = t.panel("long")
    made = ind.trend_metrics(p)
    return p.df.select("symbol", "date", "open", "close", *[made[n].alias(n) for n in RULES])


@query("trend_mask", f"WITH {TREND} SELECT symbol, date, CASE WHEN {_OK} THEN 1 ELSE 0 END AS ok FROM tr", d="date")
def trend_mask(t):
    return trended(t).select("symbol", "date", pf.trend_mask(RULES).cast("int").alias("ok"))


_BLEND = snap_sql("(0.6 * (close - open) / open + 0.4 * return_7d / 100)")


@query(
    "daily_book",
    f"""WITH {TREND}, cd AS (SELECT symbol, date, {_BLEND} AS pred, abs(trend_strength) / 100 AS vol FROM tr WHERE {_OK}) SELECT * FROM {book_sql("cd", 5, 0.01, 2, 0.02)}""",
    q="pred sizing_weight position_pct",
    d="date",
)
def daily_book(t):
    """Blend of two scores, trend filter, selection, on every date."""
    blended = pf_blend({"body": 0.6, "week": 0.4}, trended(t).withColumns(
        {"body": (C("close") - C("open")) / C("open"), "week": C("return_7d") / 100}
    ))
    cands = blended.where(pf.trend_mask(RULES)).withColumn("vol", F.abs("trend_strength") / 100)
    return pf.select_book(cands, "pred", "vol", 5, 0.01, 2, 0.02).select(*BOOK)


def pf_blend(weights: dict[str, float], df):
    """Σ score · weight over the factors present in the frame."""
    total = sum((C(n) * w for n, w in weights.items() if n in df.columns), F.lit(0.0))
    return df.withColumn("pred", snap(total))


@query("blend", f"WITH {FX} SELECT symbol, date, {snap_sql('(0.5 * f4 + 0.3 * f1)')} AS pred FROM fx", q="pred", d="date")
def blend(t):
    return pf_blend({"f4": 0.5, "f1": 0.3, "absent": 0.2}, scored(t)).select("symbol", "date", "pred")


def capped_sql(sides=None):
    share = "w / sum(w) OVER (PARTITION BY date)" if sides is None else f"w / sum(w) OVER (PARTITION BY date, direction) * CASE WHEN direction > 0 THEN {sides[1]} ELSE {sides[-1]} END"
    return f"""(WITH a AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY abs(pred) DESC, symbol) AS rk FROM vx WHERE pred IS NOT NULL),
      b AS (SELECT *, count(*) OVER (PARTITION BY date) AS n, coalesce(median(vol) OVER (PARTITION BY date), 0.3) AS fill FROM a WHERE rk <= 10),
      c AS (SELECT *, abs(pred) / coalesce(CASE WHEN vol IS NOT NULL THEN greatest(vol, 0.1) END, fill) AS w, CAST(sign(pred) AS DOUBLE) AS direction FROM b WHERE n >= 5)
      SELECT symbol, date, direction, least({share}, 0.2) AS weight FROM c WHERE direction <> 0)"""


@query("select_capped", f"WITH {VX} SELECT * FROM {capped_sql({1: 0.75, -1: 0.25})}", q="weight", d="date")
def select_capped(t):
    return pf.select_capped(volatile(t), "pred", "vol", 10, 5, {1: 0.75, -1: 0.25}).select("symbol", "date", "direction", "weight")


def simple_sql(src, top=10):
    return f"""(SELECT symbol, date, CAST(sign(pred) AS DOUBLE) AS direction, least(abs(pred) / sum(abs(pred)) OVER (PARTITION BY date), 0.2) AS weight FROM (
      SELECT *, row_number() OVER (PARTITION BY date ORDER BY abs(pred) DESC, symbol) AS rk FROM {src} WHERE pred IS NOT NULL AND pred <> 0) WHERE rk <= {top})"""


@query("select_simple", f"WITH {VX} SELECT * FROM {simple_sql('vx')}", q="weight", d="date")
def select_simple(t):
    return pf.select_simple(volatile(t), "pred").select("symbol", "date", "direction", "weight")


@query(
    "core_portfolio",
    f"""WITH {FX} SELECT symbol, {snap_sql("(avg(f1) / stddev_samp(f1))")} AS stability FROM fx GROUP BY symbol ORDER BY stability DESC, symbol LIMIT 5""",
    q="stability",
)
def core_portfolio(t):
    s = scored(t).groupBy("symbol").agg(snap(F.avg("f1") / F.stddev_samp("f1")).alias("stability"))
    return s.orderBy(C("stability").desc(), "symbol").limit(5)


@query(
    "satellite_portfolio",
    f"""WITH {FX} SELECT symbol, date, rank FROM (SELECT symbol, date, CAST(row_number() OVER (PARTITION BY date ORDER BY abs(f4) DESC, symbol) AS INTEGER) AS rank FROM fx) WHERE rank <= 2""",
    d="date",
)
def satellite_portfolio(t):
    return pf._top(scored(t), [F.abs("f4").desc(), C("symbol")], 2).select("symbol", "date", "rank")


@query(
    "rebalance_calendar",
    """SELECT DISTINCT date, 1 AS daily, CASE WHEN dayofweek(date) = 1 THEN 1 ELSE 0 END AS weekly, CASE WHEN day(date) = 1 THEN 1 ELSE 0 END AS monthly FROM {long}""",
    d="date",
)
def rebalance_calendar(t):
    return pf.rebalance_days(session_table(t.long_bars().select("date")))


@query(
    "latest_per_symbol",
    """SELECT symbol, date, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS r FROM {long} WHERE date <= DATE '1999-06-30') WHERE r = 1""",
    d="date",
)
def latest_per_symbol(t):
    b = t.long_bars().select("symbol", "date", "close").where(C("date") <= "1999-06-30")
    return pick(b, ["symbol"], C("date"), last=True)


@query(
    "latest_atr",
    """WITH b AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS prev FROM {long}),
    a AS (SELECT symbol, date, CASE WHEN count(*) OVER w >= 14 THEN avg(greatest(high - low, abs(high - prev), abs(low - prev))) OVER w END AS atr FROM b WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 13 PRECEDING))
    SELECT symbol, arg_max(atr, date) AS atr, max(date) AS date FROM a WHERE atr IS NOT NULL GROUP BY symbol HAVING count(*) >= 450""",
    q="atr",
    d="date",
)
def latest_atr(t):
    p = t.panel("long")
    a = p.stage(ind.atr(p, 14))
    g = p.df.where(a.isNotNull()).groupBy("symbol").agg(
        F.max_by(a, "date").alias("atr"), F.max("date").alias("date"), F.count(F.lit(1)).alias("n")
    )
    return g.where(C("n") >= 450).drop("n")


# -- returns -------------------------------------------------------------------------------------------

COH = f"""{VX}, bk AS (SELECT * FROM {simple_sql("vx")}), b AS (SELECT * FROM {{dense}}), s AS (SELECT date, row_number() OVER (ORDER BY date) AS ord FROM (SELECT DISTINCT date FROM b)),
  px AS (SELECT symbol, ord, date, open, close FROM b JOIN s USING (date)), ls AS (SELECT max(ord) AS l FROM s),
  en AS (SELECT k.symbol, k.date AS entry_date, s.ord AS t, k.weight / 5 AS weight, k.direction, p.open AS entry, least(5, l - s.ord) AS last FROM bk k JOIN s USING (date), ls, px p
    WHERE s.ord < l AND p.symbol = k.symbol AND p.ord = s.ord + 1 AND p.open > 0),
  hd AS (SELECT en.*, p.ord - t AS h, p.date, p.close, row_number() OVER (PARTITION BY entry_date, en.symbol ORDER BY p.ord) AS seen,
    coalesce(lag(p.close) OVER (PARTITION BY entry_date, en.symbol ORDER BY p.ord), entry) AS prev FROM en JOIN px p ON p.symbol = en.symbol AND p.ord > t AND p.ord <= t + last),
  mk AS (SELECT *, CASE WHEN h = 1 THEN 0.0015 ELSE 0 END + CASE WHEN h = last THEN 0.0015 ELSE 0 END AS charge FROM hd WHERE seen = h),
  mm AS (SELECT date, entry_date, symbol, weight, direction, weight * (direction * (close / prev - 1) - charge) AS mark, weight * charge AS cost FROM mk)"""


def book(t):
    return pf.select_simple(volatile(t), "pred").select("symbol", "date", "direction", "weight")


def marks(t):
    return pf.cohort_marks(book(t), t.dense_bars().select("symbol", "date", "open", "close"), 5, 0.003)


def net_return(name):
    """Daily return of the book at a thousandth of the equity, less a daily carry: a plausible size."""
    return (F.sum("mark") / 1000 - 0.002).alias(name)


@query("cohort_returns", f"WITH {COH} SELECT date, sum(mark) AS ret FROM mm GROUP BY date", q="ret", d="date")
def cohort_returns(t):
    return marks(t).groupBy("date").agg(F.sum("mark").alias("ret"))


@query(
    "one_day_returns",
    f"""WITH {VX}, bk AS (SELECT * FROM {simple_sql("vx")}), n AS (SELECT symbol, date, lead(open) OVER w AS o, lead(close) OVER w AS c FROM {{dense}} WINDOW w AS (PARTITION BY symbol ORDER BY date))
    SELECT date, sum(weight * (direction * (c / o - 1) - 0.003)) AS ret FROM bk JOIN n USING (symbol, date) WHERE o > 0 GROUP BY date""",
    q="ret",
    d="date",
)
def one_day_returns(t):
    return pf.one_day_returns(book(t), t.dense_bars(), 0.003)


@query(
    "cohort_returns_grid",
    f"""WITH {COH} SELECT date, entry_date, sum(mark) AS pnl, sum(weight) AS weight, sum(weight * direction) AS net_weight, sum(cost) AS cost FROM mm GROUP BY ALL""",
    q="pnl weight net_weight cost",
    d="date entry_date",
)
def cohort_returns_grid(t):
    return marks(t).groupBy("date", "entry_date").agg(
        F.sum("mark").alias("pnl"), F.sum("weight").alias("weight"), F.sum(C("weight") * C("direction")).alias("net_weight"),
        F.sum("cost").alias("cost"),
    )


@query(
    "replay_variants",
    f"""WITH {VX}, n AS (SELECT symbol, date, lead(open) OVER w AS o, lead(close) OVER w AS c FROM {{dense}} WINDOW w AS (PARTITION BY symbol ORDER BY date)),
    fl AS (SELECT * FROM vx WHERE vol IS NOT NULL AND vol < 2)"""
    + " SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{name}' AS variant, date, sum(weight * (direction * (c / o - 1) - 0.003)) AS ret FROM {simple_sql(src)} JOIN n USING (symbol, date) WHERE o > 0 GROUP BY date"
        for name, src in (("raw", "vx"), ("filter", "fl"))
    )
    + ")",
    q="ret",
    d="date",
)
def replay_variants(t):
    v, bars = volatile(t), t.dense_bars()
    variants = {"raw": v, "filter": v.where(C("vol") < 2)}
    made = [
        pf.one_day_returns(pf.select_simple(df, "pred"), bars, 0.003).select(F.lit(n).alias("variant"), "date", "ret")
        for n, df in variants.items()
    ]
    return made[0].unionByName(made[1])


@query(
    "segment_report",
    f"""WITH {COH}, dr AS (SELECT date, CASE WHEN date < DATE '2024-01-16' THEN 'dev' ELSE 'holdout' END AS tier, sum(mark) / 1000 - 0.002 AS ret FROM mm GROUP BY ALL)
    SELECT * FROM {metrics_sql("dr", "tier")} UNION ALL SELECT 'all' AS tier, * FROM {metrics_sql("dr")}""",
    q=METRICS,
)
def segment_report(t):
    daily = marks(t).groupBy("date").agg(net_return("ret"))
    tier = F.when(C("date") < "2024-01-16", "dev").otherwise("holdout")
    both = daily.withColumn("tier", F.explode(F.array(tier, F.lit("all"))))
    return ev.portfolio_metrics(both, by=["tier"])


# -- risk ----------------------------------------------------------------------------------------------

RK = """b AS (SELECT * FROM {long_sector}), rr AS (SELECT * FROM (SELECT symbol, date, sector, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS r FROM b) WHERE r IS NOT NULL),
  s AS (SELECT date, row_number() OVER (ORDER BY date) AS ord, m AS market FROM (SELECT date, avg(r) AS m FROM rr GROUP BY date)),
  sv AS (SELECT *, var_samp(market) OVER (ORDER BY ord ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING) AS v FROM s),
  r1 AS (SELECT rr.*, sv.ord, sv.market, CASE WHEN count(r) OVER w >= 20 THEN covar_samp(r, market) OVER w END / nullif(sv.v, 0) AS b0 FROM rr JOIN sv USING (date)
    WINDOW w AS (PARTITION BY symbol ORDER BY ord RANGE BETWEEN 252 PRECEDING AND 1 PRECEDING)),
  r2 AS (SELECT *, CASE WHEN b0 IS NULL OR isnan(b0) THEN 1 ELSE greatest(-1, least(b0, 3)) END AS beta FROM r1),
  r3 AS (SELECT *, r - beta * market AS res FROM r2),
  rk AS (SELECT date, ord, symbol, sector, r, market, beta, avg(res) OVER (PARTITION BY date, sector) AS sector_ret, res - avg(res) OVER (PARTITION BY date, sector) AS eps FROM r3)"""


def risk(t):
    prices = t.long_bars().join(t.sectors(), "symbol").select("symbol", "date", "close", "sector")
    return pf.risk_rows(prices, 252, 20)


@query(
    "risk_model",
    f"WITH {RK} SELECT date, symbol, r, market, beta, sector_ret, eps FROM rk",
    q="r market beta sector_ret eps",
    d="date",
)
def risk_model(t):
    return risk(t).select("date", "symbol", "r", "market", "beta", "sector_ret", "eps")


LB = f"""lb AS (SELECT symbol, date, weight * direction AS weight FROM {simple_sql("(SELECT symbol, date, " + snap_sql("((close - open) / open)") + " AS pred FROM {long})")})"""
DC = f"""{RK}, {LB}, dc AS (SELECT date, sum(weight * beta * market) AS market, sum(weight * sector_ret) AS sector, sum(weight * eps) AS selection, sum(weight * r) AS model_total,
  sum(weight * beta) AS beta_exposure, sum(weight) AS net_weight, sum(abs(weight)) AS gross_weight FROM lb JOIN rk USING (date, symbol) GROUP BY date)"""
PARTS = "market sector selection model_total beta_exposure net_weight gross_weight"


def long_weights(t):
    b = t.long_bars().select("symbol", "date", snap((C("close") - C("open")) / C("open")).alias("pred"))
    return pf.select_simple(b, "pred").select("symbol", "date", (C("weight") * C("direction")).alias("weight"))


@query("decompose", f"WITH {DC} SELECT * FROM dc", q=PARTS, d="date")
def decompose(t):
    return pf.decompose(risk(t), long_weights(t))


@query(
    "summarize_attribution",
    f"""WITH {DC} SELECT count(*) AS n_days, avg(model_total) * 252 AS ann_total, avg(market) * 252 AS ann_market, avg(market) / stddev_samp(market) * sqrt(252) AS ir_market,
    avg(sector) * 252 AS ann_sector, avg(sector) / stddev_samp(sector) * sqrt(252) AS ir_sector, avg(selection) * 252 AS ann_selection, avg(selection) / stddev_samp(selection) * sqrt(252) AS ir_selection,
    avg(beta_exposure) AS avg_beta_exposure, avg(net_weight) AS avg_net_weight, avg(gross_weight) AS avg_gross_weight, var_samp(market + sector) / var_samp(model_total) AS systematic_share FROM dc""",
    q="ann_total ann_market ir_market ann_sector ir_sector ann_selection ir_selection avg_beta_exposure avg_net_weight avg_gross_weight systematic_share",
)
def summarize_attribution(t):
    return pf.summarize_attribution(pf.decompose(risk(t), long_weights(t)))


@query(
    "vol_forecast",
    f"""WITH {RK}, {LB}, se AS (SELECT DISTINCT ord, date, 'MKT' AS f, market AS v FROM rk UNION ALL SELECT ord, date, sector, max(sector_ret) FROM rk GROUP BY ALL),
    cv AS (SELECT a.date, a.f, b.f AS g, CASE WHEN count(a.v) OVER w >= 60 THEN covar_samp(a.v, b.v) OVER w END AS c FROM se a JOIN se b ON a.ord = b.ord
      WINDOW w AS (PARTITION BY a.f, b.f ORDER BY a.ord RANGE BETWEEN 120 PRECEDING AND 1 PRECEDING)),
    iv AS (SELECT date, symbol, sector, beta, CASE WHEN count(eps) OVER w >= 60 THEN var_samp(eps) OVER w END AS iv FROM rk WINDOW w AS (PARTITION BY symbol ORDER BY ord RANGE BETWEEN 120 PRECEDING AND 1 PRECEDING)),
    hd AS (SELECT *, coalesce(iv, median(iv) OVER (PARTITION BY date), 0.0004) AS iv2 FROM lb JOIN iv USING (date, symbol)),
    ex AS (SELECT date, 'MKT' AS f, sum(weight * beta) AS x FROM hd GROUP BY date UNION ALL SELECT date, sector, sum(weight) FROM hd GROUP BY ALL),
    sy AS (SELECT cv.date, sum(c * e.x * h.x) AS s, count(*) FILTER (WHERE c IS NULL) AS gaps FROM cv JOIN ex e ON e.date = cv.date AND e.f = cv.f JOIN ex h ON h.date = cv.date AND h.f = cv.g GROUP BY cv.date),
    ow AS (SELECT date, sum(weight * weight * iv2) AS i FROM hd GROUP BY date)
    SELECT date, sqrt((s + i) * 252) AS ann_vol FROM sy JOIN ow USING (date) WHERE gaps = 0 AND s + i >= 0""",
    q="ann_vol",
    d="date",
)
def vol_forecast(t):
    return pf.vol_forecast(risk(t), long_weights(t), 120, 60)


@query(
    "live_attribution",
    f"""WITH {RK}, ps AS (SELECT l_suppkey AS symbol, sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS qty FROM lineitem WHERE l_shipdate < (SELECT max(l_shipdate) FROM lineitem) GROUP BY ALL),
    pv AS (SELECT symbol, date, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS prev FROM b),
    wt AS (SELECT symbol, date, qty * prev / (SELECT sum(abs(c_acctbal)) FROM customer) AS weight FROM ps JOIN pv USING (symbol) WHERE date = (SELECT max(date) FROM b) AND prev IS NOT NULL)
    SELECT date, sum(weight * beta * market) AS market, sum(weight * sector_ret) AS sector, sum(weight * eps) AS selection, sum(weight * r) AS model_total,
      sum(weight * beta) AS beta_exposure, sum(weight) AS net_weight, sum(abs(weight)) AS gross_weight FROM wt JOIN rk USING (date, symbol) GROUP BY date""",
    q=PARTS,
    d="date",
)
def live_attribution(t):
    """Positions at yesterday's close over equity, decomposed for the last session."""
    from pyspark.sql import Window

    last = t.lineitem.agg(F.max("l_shipdate")).scalar()
    signed = F.when(C("l_returnflag") == "R", -C("l_quantity")).otherwise(C("l_quantity"))
    qty = t.lineitem.where(C("l_shipdate") < last).groupBy(C("l_suppkey").alias("symbol")).agg(F.sum(signed).alias("qty"))
    prev = t.long_bars().withColumn("prev", F.lag("close").over(Window.partitionBy("symbol").orderBy("date")))
    today = prev.where(C("date") == F.to_date(t.lineitem.agg(F.max("l_shipdate")).scalar()))
    equity = t.customer.agg(F.sum(F.abs("c_acctbal"))).scalar()
    weights = qty.join(today, "symbol").where(C("prev").isNotNull()).select("symbol", "date", (C("qty") * C("prev") / equity).alias("weight"))
    return pf.decompose(risk(t), weights)


@query(
    "drawdown_duration",
    f"""WITH {COH}, dr AS (SELECT date, sum(mark) / 1000 - 0.002 AS ret FROM mm GROUP BY date), e AS (SELECT date, product(1 + ret) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS e FROM dr),
    d AS (SELECT date, e / max(e) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM e), g AS (SELECT *, sum(CASE WHEN dd >= 0 THEN 1 ELSE 0 END) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS g FROM d)
    SELECT min(low) AS max_drawdown, max(run) AS duration FROM (SELECT g, count(*) FILTER (WHERE dd < 0) AS run, min(dd) AS low FROM g GROUP BY g)""",
    q="max_drawdown",
)
def drawdown_duration(t):
    return pf.drawdown_duration(marks(t).groupBy("date").agg(net_return("ret")))


@query(
    "perf_metrics_full",
    f"""WITH {COH}, dr AS (SELECT date, sum(mark) / 1000 - 0.002 AS ret, sum(cost) AS cost, sum(weight) AS held FROM mm GROUP BY date)
    SELECT m.*, c.costs, c.turnover, c.profit_factor, c.cagr FROM {metrics_sql("dr")} m, (SELECT sum(cost) AS costs, avg(held) AS turnover,
      sum(ret) FILTER (WHERE ret > 0) / abs(sum(ret) FILTER (WHERE ret < 0)) AS profit_factor,
      pow(product(1 + ret), 365.25 / date_diff('day', min(date), max(date))) - 1 AS cagr FROM dr) c""",
    q=METRICS + " costs turnover profit_factor cagr",
)
def perf_metrics_full(t):
    from quantloom.session import cut

    daily = cut(marks(t).groupBy("date").agg(net_return("ret"), F.sum("cost").alias("cost"), F.sum("weight").alias("held")))
    years = F.datediff(F.max("date"), F.min("date")) / 365.25
    more = daily.agg(
        F.sum("cost").alias("costs"), F.avg("held").alias("turnover"),
        (F.sum(F.when(C("ret") > 0, C("ret"))) / F.abs(F.sum(F.when(C("ret") < 0, C("ret"))))).alias("profit_factor"),
        (F.pow(F.product(1 + C("ret")), 1 / years) - 1).alias("cagr"), F.lit(1).alias("_one"),
    )
    return ev.portfolio_metrics(daily).withColumn("_one", F.lit(1)).join(more, "_one").drop("_one")


EQ = f"""{COH}, eq AS (SELECT date, 100000 * product(1 + r) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS equity FROM (SELECT date, sum(mark) / 1000 - 0.002 AS r FROM mm GROUP BY date)),
  er AS (SELECT date, equity, equity / lag(equity) OVER (ORDER BY date) - 1 AS ret, equity / max(equity) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM eq)"""


def equity(t):
    from pyspark.sql import Window

    w = Window.orderBy("date")  # one row per session
    daily = marks(t).groupBy("date").agg(net_return("r"))
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    return daily.select("date", (100000 * F.product(1 + C("r")).over(past)).alias("equity"))


@query(
    "equity_metrics",
    f"""WITH {EQ} SELECT arg_max(equity, date) / arg_min(equity, date) - 1 AS total_return, avg(ret) / stddev_pop(ret) * sqrt(252) AS sharpe, min(dd) AS max_drawdown,
    count(*) FILTER (WHERE ret > 0) AS up_days, count(*) FILTER (WHERE ret < 0) AS down_days, avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0 END) AS win_rate FROM er""",
    q="total_return sharpe max_drawdown win_rate",
)
def equity_metrics(t):
    from pyspark.sql import Window

    w = Window.orderBy("date")
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    e = equity(t).withColumns({"ret": C("equity") / F.lag("equity").over(w) - 1, "dd": C("equity") / F.max("equity").over(past) - 1})
    return e.agg(
        (F.max_by("equity", "date") / F.min_by("equity", "date") - 1).alias("total_return"),
        (F.avg("ret") / F.stddev_pop("ret") * 252**0.5).alias("sharpe"), F.min("dd").alias("max_drawdown"),
        F.count_if(C("ret") > 0).alias("up_days"), F.count_if(C("ret") < 0).alias("down_days"),
        F.avg((C("ret") > 0).cast("double")).alias("win_rate"),
    )
