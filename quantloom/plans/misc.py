"""Queries of sequences, set operations, user functions, options, learning, live records and streams."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.functions.options import implied_vol
from quantloom.functions.rounding import snap
from quantloom.operators import evaluation as ev
from quantloom.operators import indicators as ind
from quantloom.operators import joins as jn
from quantloom.operators import learning as ml
from quantloom.operators import moments as fm
from quantloom.operators import portfolio as pf
from quantloom.operators import sequences as sq
from quantloom.operators.cleaning import session_table
from quantloom.operators.panel import Panel
from quantloom.operators.reports import hit
from quantloom.plans.books import EQ, equity
from quantloom.plans.joining import BASE, INTERVALS, intervals, order_events, weekday_bars
from quantloom.plans.oracle import snap_sql
from quantloom.plans.registry import query
from quantloom.plans.scoring import FX, LX, METRICS, STATS, daily_returns, ic_sql, metrics_sql, nw_sql, scored
from quantloom.session import shared_dir, spread, written
from quantloom.sources.incremental import pick
from quantloom.streaming import jobs

C = F.col

# -- sequences -----------------------------------------------------------------------------------------


@query(
    "seasonal",
    """WITH b AS (SELECT * FROM {long}), m AS (SELECT symbol, date_trunc('month', date) AS ym, arg_max(close, date) AS close FROM b GROUP BY ALL),
    r AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY ym) - 1 AS ret FROM m),
    s AS (SELECT symbol, ym, CASE WHEN count(ret) OVER w >= 3 THEN avg(ret) OVER w END AS seasonal_month FROM r WINDOW w AS (PARTITION BY symbol, month(ym) ORDER BY ym ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT b.symbol, b.date, s.seasonal_month FROM b LEFT JOIN s ON b.symbol = s.symbol AND date_trunc('month', b.date) = s.ym""",
    q="seasonal_month",
    d="date",
)
def seasonal(t):
    return sq.seasonal(t.long_bars()).select("symbol", "date", "seasonal_month")


DS = """ds AS (SELECT user_id % 40 AS symbol, CAST(ts AS DATE) AS date, avg(value / 500) AS sentiment_mean, coalesce(stddev_samp(value / 500), 0) AS sentiment_std, count(*) AS articles FROM events GROUP BY ALL)"""


def day_sentiment(t):
    v = C("value") / 500
    return t.events.groupBy((C("user_id") % 40).alias("symbol"), F.to_date("ts").alias("date")).agg(
        F.avg(v).alias("sentiment_mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("sentiment_std"), F.count(F.lit(1)).alias("articles")
    )


@query(
    "sentiment_sequences",
    f"""WITH {DS}, x AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n, CAST(row_number() OVER (PARTITION BY symbol ORDER BY date) AS DOUBLE) AS t FROM ds)
    SELECT symbol, date, trend, volatility, negative_spike, momentum, intensity, divergence FROM (SELECT symbol, date, n, regr_slope(sentiment_mean, t) OVER w AS trend, stddev_pop(sentiment_mean) OVER w AS volatility,
      CASE WHEN avg(sentiment_mean) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) < avg(sentiment_mean) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 7 PRECEDING AND 3 PRECEDING) - 0.3 THEN 1 ELSE 0 END AS negative_spike,
      avg(sentiment_mean) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) - avg(sentiment_mean) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 7 PRECEDING AND 5 PRECEDING) AS momentum,
      avg(articles) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) / avg(articles) OVER w AS intensity, avg(sentiment_std) OVER w AS divergence
      FROM x WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)) WHERE n > 7""",
    q="trend volatility momentum intensity divergence",
    d="date",
)
def sentiment_sequences(t):
    return sq.sentiment_sequences(day_sentiment(t))


@query(
    "iv_sequences",
    """WITH x AS (SELECT symbol, date, close AS iv, avg(close) OVER (PARTITION BY date) AS vix, row_number() OVER w AS n, CAST(row_number() OVER w AS DOUBLE) AS t, close - lag(close) OVER w AS dc FROM {long} WINDOW w AS (PARTITION BY symbol ORDER BY date)),
    y AS (SELECT symbol, date, n, regr_slope(iv, t) OVER f AS iv_trend, stddev_pop(dc) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING) AS iv_volatility, lag(iv) OVER w AS l, avg(iv) OVER f AS m, lag(vix) OVER w AS v
      FROM x WINDOW w AS (PARTITION BY symbol ORDER BY date), f AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
    SELECT symbol, date, iv_trend, iv_volatility, CASE WHEN l > m * 1.2 THEN 2 WHEN l < m * 0.8 THEN 0 ELSE 1 END AS iv_regime, v - l AS vix_iv_spread, (l - m) / (m + 1e-6) AS iv_mean_reversion FROM y WHERE n > 20""",
    q="iv_trend iv_volatility vix_iv_spread iv_mean_reversion",
    d="date",
)
def iv_sequences(t):
    p = t.panel("long")
    vix = p.cs_mean(p.close)
    return sq.iv_sequences(p.df.select("symbol", "date", C("close").alias("iv"), vix.alias("vix")))


@query(
    "news_features",
    BASE
    + """, n AS (SELECT symbol, session AS date, avg(val / 1000) AS tone, CAST(sum(key % 4) AS DOUBLE) AS articles FROM ge GROUP BY ALL)
    SELECT symbol, date, tone - lag(tone, 5) OVER w AS tone_change_5, CASE WHEN count(tone) OVER a >= 20 THEN (tone - avg(tone) OVER a) / stddev_samp(tone) OVER a END AS tone_z60,
      CASE WHEN count(articles) OVER b >= 10 THEN articles / nullif(avg(articles) OVER b, 0) END AS article_spike, CASE WHEN count(tone) OVER b >= 10 THEN -stddev_samp(tone) OVER b END AS tone_stability
    FROM n WINDOW w AS (PARTITION BY symbol ORDER BY date), a AS (PARTITION BY symbol ORDER BY date ROWS 59 PRECEDING), b AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING)""",
    q="tone_change_5 tone_z60 article_spike tone_stability",
    d="date",
)
def news_features(t):
    """Calendar-day news on its session, then change, z-score, spike and stability per symbol."""
    days = order_events(t).select("symbol", "day", (C("val") / 1000).alias("tone"), (C("key") % 4).cast("double").alias("articles"))
    landed = jn.to_session(days, "day", session_table(weekday_bars(t)), strict=False)
    daily = landed.groupBy("symbol", C("session").alias("date")).agg(F.avg("tone").alias("tone"), F.sum("articles").alias("articles"))
    p = Panel(daily)
    tone, art = C("tone"), C("articles")
    made = {
        "tone_change_5": tone - p.lag(tone, 5),
        "tone_z60": p.div(tone - p.mean(tone, 60, 20), p.std(tone, 60, 20)),
        "article_spike": p.div(art, p.mean(art, 20, 10)),
        "tone_stability": -p.std(tone, 20, 10),
    }
    return p.df.select("symbol", "date", *[c.alias(n) for n, c in made.items()])


@query(
    "psar",
    """WITH RECURSIVE b AS (SELECT symbol, date, high, low, close, row_number() OVER w AS i, least(lag(low) OVER w, lag(low, 2) OVER w) AS low_, greatest(lag(high) OVER w, lag(high, 2) OVER w) AS high_
      FROM {long} WINDOW w AS (PARTITION BY symbol ORDER BY date)),
    p AS (SELECT symbol, date, i, close AS psar, 1.0::DOUBLE AS direction, 0.0::DOUBLE AS extreme, 0.02::DOUBLE AS pace FROM b WHERE i = 1
      UNION ALL SELECT symbol, date, i, CASE WHEN crossed THEN extreme ELSE raw END, CASE WHEN crossed THEN -direction ELSE direction END, CASE WHEN crossed OR further THEN reach ELSE extreme END,
        CASE WHEN crossed THEN 0.02 WHEN further THEN least(pace + 0.02, 0.2) ELSE pace END
      FROM (SELECT *, CASE WHEN direction > 0 THEN reach > extreme ELSE reach < extreme END AS further
      FROM (SELECT *, CASE WHEN (direction > 0) = crossed THEN low ELSE high END AS reach
      FROM (SELECT *, CASE WHEN direction > 0 THEN low < raw ELSE high > raw END AS crossed
      FROM (SELECT b.symbol, b.date, b.i, high, low, direction, extreme, pace, CASE WHEN direction > 0 THEN least(psar + pace * (extreme - psar), low_) ELSE greatest(psar + pace * (extreme - psar), high_) END AS raw
      FROM p JOIN b ON b.symbol = p.symbol AND b.i = p.i + 1)))))
    SELECT symbol, date, psar, direction FROM p""",
    q="psar",
    d="date",
)
def psar(t):
    return sq.parabolic_sar(t.long_bars())


# -- sets ----------------------------------------------------------------------------------------------


@query("union_panels", "SELECT symbol, date, close FROM {long}", d="date")
def union_panels(t):
    b = t.long_bars().select("symbol", "date", "close")
    return b.where(F.year("date") < 1996).unionByName(b.where(F.year("date") >= 1996))


@query(
    "union_sources",
    "SELECT symbol, date, close FROM {long} UNION ALL SELECT user_id + 100000000, CAST(ts AS DATE), arg_max(value, ts) FROM events GROUP BY user_id, CAST(ts AS DATE)",
    d="date",
)
def union_sources(t):
    added = t.dense_bars().select((C("symbol") + 100000000).alias("symbol"), "date", "close")
    return t.long_bars().select("symbol", "date", "close").unionByName(added)


_KEYS = f"SELECT DISTINCT o_custkey % (SELECT count(*) FROM supplier) AS symbol, CAST(o_orderdate AS DATE) AS date FROM orders"


@query("intersect_keys", f"SELECT symbol, date FROM {{long}} INTERSECT {_KEYS}", d="date")
def intersect_keys(t):
    return t.long_bars().select("symbol", "date").join(order_keys(t), ["symbol", "date"], "left_semi")


def order_keys(t):
    return t.orders.select((C("o_custkey") % t.rows("supplier")).alias("symbol"), F.to_date("o_orderdate").alias("date"))


@query("except_keys", f"SELECT symbol, date FROM {{long}} EXCEPT {_KEYS}", d="date")
def except_keys(t):
    return t.long_bars().select("symbol", "date").join(order_keys(t).distinct(), ["symbol", "date"], "left_anti")


@query(
    "set_overlap",
    """WITH a AS (SELECT symbol, date, row_number() OVER (PARTITION BY date ORDER BY close DESC, symbol) AS r1, row_number() OVER (PARTITION BY date ORDER BY high - low DESC, symbol) AS r2 FROM {dense})
    SELECT date, count(*) FILTER (WHERE r1 <= 20 AND r2 <= 20) AS overlap FROM a WHERE r1 <= 20 GROUP BY date""",
    d="date",
)
def set_overlap(t):
    b = t.dense_bars().withColumn("range", C("high") - C("low"))
    first = pf._top(b, [C("close").desc(), C("symbol")], 20).select("date", "symbol")
    second = pf._top(b, [C("range").desc(), C("symbol")], 20).select("date", "symbol", F.lit(1).alias("both"))
    return first.join(second, ["date", "symbol"], "left").groupBy("date").agg(F.count("both").alias("overlap"))


@query(
    "resolve_universe",
    """SELECT symbol, arg_min(name, seq) AS universe FROM (SELECT s_suppkey AS symbol, 'suppliers' AS name, 1 AS seq FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT l_suppkey, 'traded', 2 FROM lineitem WHERE l_quantity > 45) GROUP BY symbol""",
)
def resolve_universe(t):
    """Union of named symbol sets; the first set that names a symbol keeps it."""
    a = t.supplier.where(C("s_acctbal") > 0).select(C("s_suppkey").alias("symbol"), F.lit("suppliers").alias("universe"), F.lit(1).alias("seq"))
    b = t.lineitem.where(C("l_quantity") > 45).select(C("l_suppkey").alias("symbol"), F.lit("traded").alias("universe"), F.lit(2).alias("seq"))
    return pick(a.unionByName(b), ["symbol"], C("seq"), last=False).drop("seq")


@query(
    "panel_fingerprint",
    "SELECT count(*) AS n, bit_xor(CAST('0x' || substr(md5(CAST(symbol AS VARCHAR) || '|' || CAST(date AS VARCHAR)), 1, 15) AS BIGINT)) AS digest FROM {long}",
)
def panel_fingerprint(t):
    """Digest of the keys that does not depend on their order."""
    key = F.md5(F.concat_ws("|", C("symbol").cast("string"), C("date").cast("string")))
    return t.long_bars().agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.conv(F.substring(key, 1, 15), 16, 10).cast("long")).alias("digest"))


# -- user functions ------------------------------------------------------------------------------------


@query(
    "rolling_apply_udf",
    "SELECT symbol, date, CASE WHEN count(*) OVER w = 10 THEN (max(close) OVER w - min(close) OVER w) / (first_value(close) OVER w) END AS value FROM {long} WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 9 PRECEDING)",
    q="value",
    d="date",
)
def rolling_apply_udf(t):
    p = t.panel("long")
    made = sq.rolling_apply(p, p.close, 10, lambda a: (F.array_max(a) - F.array_min(a)) / F.element_at(a, 1))
    return p.df.select("symbol", "date", made.alias("value"))


PAST = "(PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)"


@query("groupby_apply_series", f"SELECT symbol, date, close / max(close) OVER {PAST} - 1 AS drawdown FROM {{long}}", q="drawdown", d="date")
def groupby_apply_series(t):
    bars = t.long_bars().select("symbol", "date", "close")
    return sq.per_symbol(bars, lambda g: g["close"] / g["close"].cummax() - 1, {"drawdown": "double"})


@query("groupby_apply_frame", f"SELECT symbol, date, max(close) OVER {PAST} AS top, min(close) OVER {PAST} AS bottom FROM {{long}}", d="date")
def groupby_apply_frame(t):
    bars = t.long_bars().select("symbol", "date", "close")
    made = lambda g: g.assign(top=g["close"].cummax(), bottom=g["close"].cummin())
    return sq.per_symbol(bars, made, {"top": "double", "bottom": "double"})


@query("groupby_transform_udf", "SELECT symbol, date, close - avg(close) OVER (PARTITION BY symbol) AS centred FROM {long}", q="centred", d="date")
def groupby_transform_udf(t):
    bars = t.long_bars().select("symbol", "date", "close")
    return sq.per_symbol(bars, lambda g: g["close"] - g["close"].mean(), {"centred": "double"})


REGISTRY = {
    "delta_5": ("ts", ["close"], lambda p: p.close - p.lag(p.close, 5)),
    "body": ("ew", ["open", "close"], lambda p: p.close - p.open),
    "volume_rank": ("cs", ["volume"], lambda p: p.rank(p.volume)),
    "mean_10": ("ts", ["close"], lambda p: p.mean(p.close, 10)),
}


def apply_registry(p: Panel, names) -> dict:
    """Columns of named definitions; a definition whose source column is absent is an error."""
    made = {}
    for n in names:
        _, needs, build = REGISTRY[n]
        absent = [c for c in needs if c not in p.df.columns]
        if absent:
            raise ValueError(f"{n} needs {absent}, which the panel lacks")
        made[n] = build(p)
    return made


REG_SQL = """SELECT symbol, date, close - lag(close, 5) OVER w AS delta_5, close - open AS body,
  (rank() OVER (PARTITION BY date ORDER BY volume) + (count(*) OVER (PARTITION BY date, volume) - 1) / 2.0) / count(*) OVER (PARTITION BY date) AS volume_rank FROM {long} WINDOW w AS (PARTITION BY symbol ORDER BY date)"""


@query("feature_registry", REG_SQL, q="delta_5 body volume_rank", d="date")
def feature_registry(t):
    p = t.panel("long")
    made = apply_registry(p, ["delta_5", "body", "volume_rank"])
    return p.df.select("symbol", "date", *[c.alias(n) for n, c in made.items()])


@query("stored_features", f"SELECT symbol, date, delta_5, body FROM ({REG_SQL})", q="delta_5 body", d="date")
def stored_features(t):
    """Definitions adopted in a stored registry table, which is as small as the registry."""
    table = t.spark.createDataFrame(
        [("delta_5", "adopted"), ("body", "adopted"), ("mean_10", "removed")], "name string, status string"
    )
    names = sorted(r.name for r in table.where(C("status") == "adopted").collect())
    p = t.panel("long")
    made = apply_registry(p, names)
    return p.df.select("symbol", "date", *[c.alias(n) for n, c in made.items()])


@query(
    "registry_triggers",
    """WITH m AS (SELECT user_id AS id, CASE WHEN count(*) FILTER (WHERE event_type = 'error') >= 8 THEN 'ALERT' WHEN count(*) FILTER (WHERE event_type = 'error') >= 5 THEN 'WARN' ELSE 'OK' END AS status FROM events GROUP BY user_id),
    r AS (SELECT DISTINCT user_id AS id, CASE WHEN user_id % 3 = 0 THEN 'probation' ELSE 'structural' END AS tier, CASE WHEN user_id % 11 = 0 THEN 'removed' ELSE 'adopted' END AS state FROM events)
    SELECT id, tier, CASE WHEN state = 'adopted' AND tier = 'probation' AND status IN ('WARN', 'ALERT') THEN 'removed' ELSE state END AS state, CASE WHEN state = 'adopted' AND tier = 'structural' AND status = 'ALERT' THEN 1 ELSE 0 END AS review FROM r LEFT JOIN m USING (id)""",
)
def registry_triggers(t):
    """Probation with a warning or alert is removed; structural with an alert is flagged for review."""
    u = C("user_id")
    errors = t.events.groupBy(u.alias("id")).agg(F.count_if(C("event_type") == "error").alias("n"))
    status = F.when(C("n") >= 8, "ALERT").when(C("n") >= 5, "WARN").otherwise("OK")
    monitor = errors.select("id", status.alias("status"))
    registry = t.events.select(u.alias("id")).distinct().select(
        "id", F.when(C("id") % 3 == 0, "probation").otherwise("structural").alias("tier"), F.when(C("id") % 11 == 0, "removed").otherwise("adopted").alias("state")
    )
    live = C("state") == "adopted"
    removed = live & (C("tier") == "probation") & C("status").isin("WARN", "ALERT")
    review = live & (C("tier") == "structural") & (C("status") == "ALERT")
    both = registry.join(monitor, "id", "left")
    return both.select("id", "tier", F.when(removed, "removed").otherwise(C("state")).alias("state"), review.cast("int").alias("review"))


@query("candidate_builders", "SELECT symbol, date, close - open AS body, high - low AS spread FROM {long}", q="body spread", d="date")
def candidate_builders(t):
    """Dataset → dataset builders plugged in by name."""
    builders = {
        "body": lambda df: df.withColumn("body", C("close") - C("open")),
        "spread": lambda df: df.withColumn("spread", C("high") - C("low")),
    }
    df = t.long_bars()
    for name in ("body", "spread"):
        df = df.transform(builders[name])
    return df.select("symbol", "date", "body", "spread")


# -- options and calendar ------------------------------------------------------------------------------


def _tail_sql(z: str, far: str) -> str:
    """P(Z > z·√2) as DuckDB text: the series near 0, elsewhere the rule of ``functions.normal`` at ``far`` = |z| within [0.5, 40]."""
    series = " + ".join(f"{(-1) ** n / (math.factorial(n) * (2 * n + 1))!r} * pow({z}, {2 * n + 1})" for n in range(14))
    nodes = " + ".join(f"{2 * math.exp(-((k / 2) ** 2))!r} / ({(k / 2) ** 2!r} + {far} * {far})" for k in range(1, 14))
    pole = f"CASE WHEN {far} < 2 * pi() THEN 2 / (exp(4 * pi() * {far}) - 1) ELSE 0 END"
    rule = f"(0.5 * {far} * exp(-{far} * {far}) / pi() * (1 / ({far} * {far}) + {nodes}) - {pole})"
    return f"0.5 * CASE WHEN abs({z}) < 0.5 THEN 1 - 2 / sqrt(pi()) * ({series}) WHEN {z} > 0 THEN {rule} ELSE 2 - {rule} END"


_QUOTES = "l_orderkey, l_linenumber, spot, strike, years, quote, call"
_IV_SQL = f"""WITH RECURSIVE q AS (SELECT l_orderkey, l_linenumber, p_retailprice::DOUBLE AS spot, p_retailprice::DOUBLE * (0.9 + l_discount * 2)::DOUBLE AS strike,
    l_quantity::DOUBLE / 50 AS years, p_retailprice::DOUBLE * (0.02 + l_tax)::DOUBLE AS quote, l_returnflag = 'A' AS call FROM lineitem JOIN part ON l_partkey = p_partkey),
  v AS (SELECT *, strike * exp(-0.02::DOUBLE * years) AS paid, CASE WHEN call THEN 1::DOUBLE ELSE -1::DOUBLE END AS side FROM q),
  h AS (SELECT *, quote > greatest(0::DOUBLE, side * (spot - paid)) + 1e-6 AND years > 0 AS ok, 0 AS step, 0.01::DOUBLE AS low, 5::DOUBLE AS high FROM v
    UNION ALL
    SELECT {_QUOTES}, paid, side, ok, step + 1, CASE WHEN above THEN low ELSE mid END, CASE WHEN above THEN mid ELSE high END FROM (
      SELECT *, side * (spot * ({_tail_sql("z1", "f1")}) - paid * ({_tail_sql("z2", "f2")})) > quote AS above FROM (
        SELECT *, least(greatest(abs(z1), 0.5::DOUBLE), 40::DOUBLE) AS f1, least(greatest(abs(z2), 0.5::DOUBLE), 40::DOUBLE) AS f2 FROM (
          SELECT *, -side * d1 / sqrt(2) AS z1, -side * (d1 - mid * sqrt(years)) / sqrt(2) AS z2 FROM (
            SELECT *, (ln(spot / strike) + (0.02::DOUBLE + mid * mid / 2) * years) / (mid * sqrt(years)) AS d1 FROM (
              SELECT *, (low + high) / 2 AS mid FROM h WHERE ok AND step < 60))))))
  SELECT {_QUOTES.removesuffix("call")} CAST(call AS INTEGER) AS call, CASE WHEN ok THEN (low + high) / 2 END AS iv FROM h WHERE NOT ok OR step = 60"""


@query("implied_vol_job", _IV_SQL, q="iv spot strike years quote")
def implied_vol_job(t):
    """One quote per line item: strike around the part's price, premium a share of it."""
    l = t.lineitem.join(t.part, C("l_partkey") == C("p_partkey"))
    spot = C("p_retailprice")
    rows = l.select(
        "l_orderkey", "l_linenumber", spot.alias("spot"), (spot * (0.9 + C("l_discount") * 2)).alias("strike"),
        (C("l_quantity") / 50).alias("years"), (spot * (0.02 + C("l_tax"))).alias("quote"), (C("l_returnflag") == "A").alias("call"),
    )
    return rows.withColumn("iv", implied_vol("quote", "spot", "strike", "years", F.lit(0.02), "call"))


CHAIN = """oc AS (SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date, l_returnflag AS kind, l_extendedprice / l_quantity AS strike, l_orderkey AS expiry, l_linenumber AS ln, l_discount AS iv, open AS spot
  FROM lineitem JOIN {long} b ON l_suppkey = b.symbol AND CAST(l_shipdate AS DATE) = b.date)"""


def chain(t):
    b = t.long_bars().select("symbol", "date", C("open").alias("spot"))
    return t.lineitem.select(
        C("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("date"), C("l_returnflag").alias("kind"),
        (C("l_extendedprice") / C("l_quantity")).alias("strike"), C("l_orderkey").alias("expiry"), C("l_discount").alias("iv"),
    ).join(b, ["symbol", "date"])


@query("atm_contracts", f"WITH {CHAIN} SELECT symbol, date, kind, arg_min(strike, (abs(strike - spot), expiry, strike)) AS strike FROM oc GROUP BY ALL", d="date")
def atm_contracts(t):
    """Nearest strike, then nearest expiry, per symbol, date and type."""
    rows = chain(t).select("symbol", "date", "kind", "strike", "expiry", "spot")
    order = F.struct(F.abs(C("strike") - C("spot")), C("expiry"), C("strike"))
    return rows.groupBy("symbol", "date", "kind").agg(F.min_by("strike", order).alias("strike"))


@query("ntm_iv", f"WITH {CHAIN} SELECT symbol, date, avg(iv) * 100 AS iv FROM oc WHERE kind = 'A' AND strike BETWEEN spot * 0.95 AND spot * 1.05 GROUP BY ALL", q="iv", d="date")
def ntm_iv(t):
    near = chain(t).where((C("kind") == "A") & C("strike").between(C("spot") * 0.95, C("spot") * 1.05))
    return near.groupBy("symbol", "date").agg((F.avg("iv") * 100).alias("iv"))


@query(
    "iv_proxy",
    """WITH b AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY date)) AS r FROM {long}),
    v AS (SELECT symbol, date, CASE WHEN count(r) OVER w >= 20 THEN stddev_samp(r) OVER w * sqrt(252) END AS rv, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM b WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING)),
    s AS (SELECT symbol, avg(rv) FILTER (WHERE k <= 20) AS recent FROM v GROUP BY symbol), c AS (SELECT l_suppkey AS symbol, avg(l_discount) AS iv FROM lineitem GROUP BY ALL)
    SELECT v.symbol, v.date, CASE WHEN recent > 0 THEN rv * (c.iv / recent) ELSE rv END AS iv_proxy FROM v JOIN s USING (symbol) JOIN c USING (symbol)""",
    q="iv_proxy",
    d="date",
)
def iv_proxy(t):
    """Realised volatility scaled so that its last 20 values average the current implied one."""
    p = t.panel("long")
    rv = p.stage(ind.volatility(p, 20) * 252**0.5)
    back = p.rows_left()
    rows = p.df.select("symbol", "date", rv.alias("rv"), back.alias("k"))
    recent = rows.groupBy("symbol").agg(F.avg(F.when(C("k") < 20, C("rv"))).alias("recent"))
    now = t.lineitem.groupBy(C("l_suppkey").alias("symbol")).agg(F.avg("l_discount").alias("iv"))
    joined = rows.join(recent, "symbol").join(now, "symbol")
    scaled = F.when(C("recent") > 0, C("rv") * (C("iv") / C("recent"))).otherwise(C("rv"))
    return joined.select("symbol", "date", scaled.alias("iv_proxy"))


@query(
    "session_calendar",
    """WITH d AS (SELECT CAST(unnest(generate_series((SELECT date_trunc('year', min(o_orderdate)) FROM orders), (SELECT max(o_orderdate) FROM orders), INTERVAL 1 DAY)) AS DATE) AS date),
    ys AS (SELECT DISTINCT year(date) AS y FROM d),
    g AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM ys), h AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS e FROM g),
    l AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - e - c % 4) % 7 AS f FROM h), m AS (SELECT *, e + f - 7 * ((a + 11 * e + 22 * f) // 451) + 114 AS n FROM l),
    hol AS (SELECT make_date(y, n // 31, n % 31 + 1) - 2 AS date FROM m
      UNION ALL SELECT CASE WHEN dayofweek(make_date(y, 1, 1)) = 0 THEN make_date(y, 1, 2) ELSE make_date(y, 1, 1) END FROM ys
      UNION ALL SELECT CASE dayofweek(x) WHEN 6 THEN x - 1 WHEN 0 THEN x + 1 ELSE x END FROM (SELECT make_date(y, 7, 4) AS x FROM ys UNION ALL SELECT make_date(y, 12, 25) FROM ys UNION ALL SELECT make_date(y, 6, 19) FROM ys WHERE y >= 2022)
      UNION ALL SELECT date FROM d WHERE (dayofweek(date) = 1 AND ((month(date) IN (1, 2) AND day(date) BETWEEN 15 AND 21) OR (month(date) = 5 AND day(date) >= 25) OR (month(date) = 9 AND day(date) <= 7))) OR (dayofweek(date) = 4 AND month(date) = 11 AND day(date) BETWEEN 22 AND 28))
    SELECT date, CAST(row_number() OVER (ORDER BY date) AS INTEGER) AS ord, lag(date) OVER (ORDER BY date) AS previous, lead(date) OVER (ORDER BY date) AS next FROM d WHERE dayofweek(date) BETWEEN 1 AND 5 AND date NOT IN (SELECT date FROM hol)""",
    d="date previous next",
)
def session_calendar(t):
    bounds = t.orders.agg(F.to_date(F.date_trunc("year", F.min("o_orderdate"))).alias("first"), F.to_date(F.max("o_orderdate")).alias("last"))
    return sq.session_calendar(bounds)


@query(
    "expression_hash",
    "SELECT event_type, user_id % 20 AS w, substr(sha1('ts_mean(' || event_type || ', ' || CAST(user_id % 20 AS VARCHAR) || ')'), 1, 12) AS hash, count(*) AS n FROM events GROUP BY ALL",
)
def expression_hash(t):
    """Short hash of a canonical definition, as a column."""
    text = F.concat(F.lit("ts_mean("), C("event_type"), F.lit(", "), (C("user_id") % 20).cast("string"), F.lit(")"))
    return t.events.groupBy("event_type", (C("user_id") % 20).alias("w"), F.substring(F.sha1(text), 1, 12).alias("hash")).agg(F.count(F.lit(1)).alias("n"))


# -- live records --------------------------------------------------------------------------------------


@query(
    "outcome_backfill",
    f"""WITH b AS (SELECT *, lead(open) OVER w AS no, lead(close) OVER w AS nc FROM {{long}} WINDOW w AS (PARTITION BY symbol ORDER BY date)),
    s AS (SELECT symbol, date, {snap_sql("((close - open) / open * 100)")} AS pred, close, no, nc FROM b WHERE close > 0 AND no > 0)
    SELECT symbol, date, (no / close - 1) * 100 AS gap_pct, (nc / no - 1) * 100 AS actual_return, (nc / close - 1) * 100 AS expected_return, (nc / close - 1) * 100 - (nc / no - 1) * 100 AS gap_impact,
      (nc / close - 1) * 100 - pred AS prediction_error, CASE WHEN (pred > 0 AND nc > close) OR (pred < 0 AND nc < close) THEN 1 ELSE 0 END AS direction_correct, floor(5000 / no) * (nc - no) AS pnl FROM s""",
    q="gap_pct actual_return expected_return gap_impact prediction_error pnl",
    d="date",
)
def outcome_backfill(t):
    """Outcome of each signal at the next session's prices, with whole shares; bad prices stay pending."""
    rows = jn.next_session_prices(t.long_bars()).where((C("close") > 0) & (C("next_open") > 0))
    o, c, pred = C("next_open"), C("next_close"), C("pred")
    rows = rows.withColumn("pred", snap((C("close") - C("open")) / C("open") * 100))
    actual, expected = (c / o - 1) * 100, (c / C("close") - 1) * 100
    right = ((pred > 0) & (c > C("close"))) | ((pred < 0) & (c < C("close")))
    return rows.select(
        "symbol", "date", ((o / C("close") - 1) * 100).alias("gap_pct"), actual.alias("actual_return"), expected.alias("expected_return"),
        (expected - actual).alias("gap_impact"), (expected - pred).alias("prediction_error"), right.cast("int").alias("direction_correct"),
        (F.floor(5000 / o) * (c - o)).alias("pnl"),
    )


@query("live_metrics", f"WITH {EQ} SELECT * FROM {metrics_sql('(SELECT date, ret FROM er)')}", q=METRICS)
def live_metrics(t):
    w = Window.orderBy("date")  # one row per session
    return ev.portfolio_metrics(equity(t).withColumn("ret", C("equity") / F.lag("equity").over(w) - 1))


_CMP = ["total_return", "sharpe", "max_drawdown", "daily_win_rate"]


@query(
    "live_vs_backtest",
    f"WITH {LX}, d AS (SELECT date, avg(f1) / 100 AS ret FROM fx GROUP BY date), a AS (SELECT * FROM {metrics_sql('(SELECT * FROM d WHERE date >= DATE ' + chr(39) + '2000-01-01' + chr(39) + ')')}), b AS (SELECT * FROM {metrics_sql('d')}) "
    + " UNION ALL ".join(f"SELECT '{m}' AS metric, a.{m} AS live, b.{m} AS backtest, a.{m} - b.{m} AS difference FROM a, b" for m in _CMP),
    q="live backtest difference",
)
def live_vs_backtest(t):
    from quantloom.session import cut

    daily = cut(daily_returns(t))
    live = ev.portfolio_metrics(daily.where(C("date") >= "2000-01-01")).select(*_CMP).unpivot([], _CMP, "metric", "live")
    back = ev.portfolio_metrics(daily).select(*_CMP).unpivot([], _CMP, "metric", "backtest")
    return live.join(back, "metric").withColumn("difference", C("live") - C("backtest"))


_FRESH = """fr AS (SELECT symbol, max(date) AS last, CASE WHEN date_diff('day', max(date), (SELECT max(date) FROM {long})) <= 5 THEN 'OK' WHEN date_diff('day', max(date), (SELECT max(date) FROM {long})) <= 15 THEN 'WARN' ELSE 'FAIL' END AS status FROM {long} GROUP BY symbol)"""


def freshness(t):
    newest = t.lineitem.agg(F.to_date(F.max("l_shipdate"))).scalar()
    age = F.datediff(newest, C("last"))
    last = t.long_bars().groupBy("symbol").agg(F.max("date").alias("last"))
    return last.withColumn("status", F.when(age <= 5, "OK").when(age <= 15, "WARN").otherwise("FAIL"))


@query("freshness_check", f"WITH {_FRESH} SELECT * FROM fr", d="last")
def freshness_check(t):
    return freshness(t)


@query(
    "worst_status",
    f"WITH {_FRESH} SELECT symbol % 10 AS desk, CASE max(CASE status WHEN 'FAIL' THEN 3 WHEN 'WARN' THEN 2 ELSE 1 END) WHEN 3 THEN 'FAIL' WHEN 2 THEN 'WARN' ELSE 'OK' END AS status FROM fr GROUP BY 1",
)
def worst_status(t):
    level = F.when(C("status") == "FAIL", 3).when(C("status") == "WARN", 2).otherwise(1)
    worst = freshness(t).groupBy((C("symbol") % 10).alias("desk")).agg(F.max(level).alias("l"))
    return worst.select("desk", F.when(C("l") == 3, "FAIL").when(C("l") == 2, "WARN").otherwise("OK").alias("status"))


@query(
    "per_stock_accuracy",
    f"""WITH {LX}, a AS (SELECT symbol, count(*) AS n, avg(CAST(sign(f4) = sign(label) AS DOUBLE)) AS accuracy, avg(abs(label - f4)) AS mae FROM fx WHERE f4 IS NOT NULL AND label IS NOT NULL GROUP BY symbol)
    SELECT *, CASE WHEN accuracy >= 0.55 THEN 'good' WHEN accuracy >= 0.5 THEN 'fair' ELSE 'poor' END AS band FROM a""",
    q="accuracy mae",
)
def per_stock_accuracy(t):
    df = scored(t, "long").where(C("f4").isNotNull() & C("label").isNotNull())
    g = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg(hit(C("f4"), C("label"))).alias("accuracy"), F.avg(F.abs(C("label") - C("f4"))).alias("mae"))
    return g.withColumn("band", F.when(C("accuracy") >= 0.55, "good").when(C("accuracy") >= 0.5, "fair").otherwise("poor"))


@query(
    "recency_weights",
    "WITH w AS (SELECT symbol, date, exp(date_diff('day', (SELECT max(date) FROM {long}), date) * ln(2) / 180) AS w FROM {long}) SELECT symbol, date, w / avg(w) OVER () AS weight FROM w",
    q="weight",
    d="date",
)
def recency_weights(t):
    """Half-life weights with mean one; the mean is one aggregate."""
    import math

    b = t.long_bars().select("symbol", "date")
    newest = t.lineitem.agg(F.to_date(F.max("l_shipdate"))).scalar()
    w = b.withColumn("w", F.exp(F.datediff("date", newest) * (math.log(2) / 180)))
    return w.select("symbol", "date", (C("w") / w.agg(F.avg("w")).scalar()).alias("weight"))


@query("rename_market_columns", "SELECT symbol, date, high AS spy_high, low AS spy_low FROM {long}", d="date")
def rename_market_columns(t):
    """Suffix rename that first drops stale targets."""
    b = t.long_bars().withColumn("spy_high", F.lit(0.0))
    targets = {"high": "spy_high", "low": "spy_low"}
    return b.drop(*targets.values()).withColumnsRenamed(targets).select("symbol", "date", *targets.values())


# -- learning ------------------------------------------------------------------------------------------

GROUPS = {"price": ["f1", "f4"], "activity": ["f2", "f3"], "absent": ["g1"]}


@query(
    "factor_groups",
    f"WITH {LX} SELECT 'price' AS factor_group, 'f1' AS feature, count(f1) AS filled FROM fx UNION ALL SELECT 'price', 'f4', count(f4) FROM fx UNION ALL SELECT 'activity', 'f2', count(f2) FROM fx UNION ALL SELECT 'activity', 'f3', count(f3) FROM fx",
)
def factor_groups(t):
    df = scored(t, "long")
    found = ml.factor_groups(df.columns, GROUPS)
    names = [f for fs in found.values() for f in fs]
    owner = F.create_map(*[F.lit(x) for g, fs in found.items() for f in fs for x in (f, g)])
    counts = df.agg(*[F.count(f).alias(f) for f in names]).unpivot([], names, "feature", "filled")
    return counts.select(owner[C("feature")].alias("factor_group"), "feature", "filled")


def folds_sql(train, test, step, purge, tail=0):
    return f"""s AS (SELECT date, row_number() OVER (ORDER BY date) AS ord FROM (SELECT DISTINCT date FROM {{long}})), n AS (SELECT max(ord) AS n FROM s),
    i AS (SELECT unnest(range({train}, n, {step})) AS i, n FROM n), k AS (SELECT *, lag(i + {test} <= n) OVER (ORDER BY i) AS before FROM i),
    f AS (SELECT (i - {train}) // {step} AS fold, i - {train} + 1 AS a, i - {purge} AS b, i + 1 AS c, least(i + {test}, n) AS d FROM k WHERE i + {test} <= n OR ({tail} > 0 AND n - i >= {tail} AND coalesce(before, TRUE)))
    SELECT CAST(fold AS INTEGER) AS fold, sa.date AS train_start, sb.date AS train_end, sc.date AS test_start, sd.date AS test_end FROM f JOIN s sa ON sa.ord = a JOIN s sb ON sb.ord = b JOIN s sc ON sc.ord = c JOIN s sd ON sd.ord = d"""


FOLD = "train_start train_end test_start test_end"


@query("generate_folds", "WITH " + folds_sql(500, 250, 250, 25, 20), d=FOLD)
def generate_folds(t):
    return ml.fold_table(t.long_bars(), 500, 250, 250, 25, min_tail=20)


@query("generate_splits", "WITH " + folds_sql(400, 120, 60, 5), d=FOLD)
def generate_splits(t):
    return ml.fold_table(t.long_bars(), 400, 120, 60, 5)


@query(
    "purged_inner_split",
    "WITH s AS (SELECT date, row_number() OVER (ORDER BY date) AS ord FROM (SELECT DISTINCT date FROM {long})), c AS (SELECT floor(max(ord) * 0.85) AS c FROM s) SELECT b.symbol, b.date, CASE WHEN ord > c THEN 'inner_val' WHEN ord <= c - 6 THEN 'inner_train' ELSE 'purged' END AS part FROM {long} b JOIN s USING (date), c",
    d="date",
)
def purged_inner_split(t):
    return ml.inner_split(t.long_bars().select("symbol", "date"))


def learn_rows(t, features=None):
    """The scored long panel, standardised; written once, since fits and scores read some of its columns again."""
    df = scored(t, "long").drop("close")
    return written(fm.standardised(df, features or fm.names(groups_of(df))))


def groups_of(df):
    return ml.factor_groups(df.columns, GROUPS)


FITTED = {"price": ["f1", "f4"], "activity": ["f2", "f3"]}


def ridge_sql(g, fs, moments):
    """CTEs that end in r_<g>: fold, b_<g> and b_<g>_<feature>, by elimination of the ridge equations, one CTE a step."""
    k, pair = len(fs), lambda a, b: f"zz_{min(a, b)}_{max(a, b)}"
    start = [f"{pair(fs[i], fs[j])} / n - z_{fs[i]} / n * (z_{fs[j]} / n) + {fm.RIDGE if i == j else 0.0} AS a{i}_{j}" for i in range(k) for j in range(k)]
    start += [f"zy_{fs[i]} / n - z_{fs[i]} / n * (y / n) AS a{i}_{k}" for i in range(k)]
    steps = [f"SELECT *, {', '.join(start)} FROM {moments}"]
    for p in range(k - 1):
        steps.append("SELECT * REPLACE (" + ", ".join(f"a{i}_{j} - a{i}_{p} / a{p}_{p} * a{p}_{j} AS a{i}_{j}" for i in range(p + 1, k) for j in range(p, k + 1)) + ") FROM {last}")
    for i in reversed(range(k)):
        known = "".join(f" - a{i}_{j} * b_{g}_{fs[j]}" for j in range(i + 1, k))
        steps.append(f"SELECT *, (a{i}_{k}{known}) / a{i}_{i} AS b_{g}_{fs[i]} FROM {{last}}")
    end = f"SELECT fold, y / n{''.join(f' - b_{g}_{f} * (z_{f} / n)' for f in fs)} AS b_{g}, {', '.join(f'b_{g}_{f}' for f in fs)} FROM {{last}}"
    named = [f"e{n}_{g} AS ({text.replace('{last}', f'e{n - 1}_{g}')})" for n, text in enumerate(steps)]
    return ", ".join([*named, f"r_{g} AS ({end.replace('{last}', f'e{len(steps) - 1}_{g}')})"])


def bin_sql(z):
    return f"least(greatest(floor(({z} + {fm.REACH}) * {fm.BINS / (2 * fm.REACH)}), 0), {fm.BINS - 1})"


def standard_sql(features):
    z = ", ".join(f"""coalesce({snap_sql(f"((CAST({f} AS DOUBLE) - avg({f}) OVER d) / nullif(stddev_samp({f}) OVER d, 0))")}, 0) AS z_{f}""" for f in features)
    return f"{LX}, st AS (SELECT *, dense_rank() OVER (ORDER BY date) AS ord, {z} FROM fx WINDOW d AS (PARTITION BY date))"


def moments_sql(groups, win):
    """CTEs mo and gains over the fit windows of ``win``."""
    features = fm.names(groups)
    pairs = sorted({tuple(sorted((a, b))) for fs in groups.values() for a in fs for b in fs})
    sums = ", ".join([f"sum(z_{f}) AS z_{f}, sum(z_{f} * label) AS zy_{f}" for f in features] + [f"sum(z_{a} * z_{b}) AS zz_{a}_{b}" for a, b in pairs])
    cells = " UNION ALL ".join(f"SELECT ord, label, '{f}' AS feature, {bin_sql(f'z_{f}')} AS bin FROM st WHERE label IS NOT NULL" for f in features)
    return f"""mo AS (SELECT fold, count(*) AS n, sum(label) AS y, {sums} FROM st JOIN {win} ON ord BETWEEN fit_lo AND fit_hi WHERE label IS NOT NULL GROUP BY fold),
    bi AS (SELECT fold, feature, bin, count(*) AS n, sum(label) AS y FROM ({cells}) JOIN {win} ON ord BETWEEN fit_lo AND fit_hi GROUP BY ALL),
    cu AS (SELECT fold, feature, bin, sum(n) OVER e AS nl, sum(y) OVER e AS yl, sum(n) OVER p AS n, sum(y) OVER p AS y FROM bi WINDOW p AS (PARTITION BY fold, feature), e AS (PARTITION BY fold, feature ORDER BY bin)),
    gains AS (SELECT fold, feature, bin, {snap_sql("(yl * yl / nl + (y - yl) * (y - yl) / (n - nl) - y * y / n)")} AS gain, yl / nl AS low, (y - yl) / (n - nl) AS high FROM cu WHERE n > nl)"""


def fits_sql(groups, win, name):
    """CTEs that end in ``name``: a row of coefficients and cuts for each fold."""
    cuts = ", ".join(f"c_{g} AS (SELECT fold, feature AS cf_{g}, bin AS cb_{g}, low AS cl_{g}, high AS ch_{g} FROM gains WHERE feature IN ({', '.join(repr(f) for f in fs)}) QUALIFY row_number() OVER (PARTITION BY fold ORDER BY gain DESC, feature, bin) = 1)" for g, fs in groups.items())
    ridges = ", ".join(ridge_sql(g, fs, "mo") for g, fs in groups.items())
    return f"{moments_sql(groups, win)}, {ridges}, {cuts}, {name} AS (SELECT * FROM {' JOIN '.join(f'r_{g} USING (fold)' if n else f'r_{g}' for n, g in enumerate(groups))} {' '.join(f'LEFT JOIN c_{g} USING (fold)' for g in groups)})"


def predicted_sql(groups, win, fitted, part):
    made = []
    for g, fs in groups.items():
        line = f"(b_{g}{''.join(f' + b_{g}_{f} * z_{f}' for f in fs)})"
        at = "CASE " + " ".join(f"WHEN cf_{g} = '{f}' THEN {bin_sql(f'z_{f}')}" for f in fs) + " END"
        side = f"(CASE WHEN cf_{g} IS NULL THEN b_{g} WHEN {at} <= cb_{g} THEN cl_{g} ELSE ch_{g} END)"
        made += [f"{snap_sql(line)} AS p_{g}_linear", f"{snap_sql(side)} AS p_{g}_split"]
    return f"(SELECT fold, symbol, date, label, {', '.join(made)} FROM st JOIN {win} ON ord BETWEEN {part}_lo AND {part}_hi JOIN {fitted} USING (fold))"


def mixed_sql(groups, frm):
    mixes = ", ".join(f"""{snap_sql("(" + " + ".join(f"p_{g}_{m} * w_{g}_{m}" for m in fm.MODELS) + ")")} AS g_{g}""" for g in groups)
    return f"(SELECT fold, symbol, date, label, {mixes} FROM {frm} JOIN wide USING (fold))"


def ensembles_sql(groups, win):
    """CTEs fitted, weights (with ic), wide and blends, given st and ``win``."""
    each = [(g, m) for g in groups for m in fm.MODELS]
    long = "(" + " UNION ALL ".join(f"SELECT fold, date, label, '{g}' AS factor_group, '{m}' AS model, p_{g}_{m} AS p FROM checked" for g, m in each) + ")"
    mixes = "(" + " UNION ALL ".join(f"SELECT fold, date, label, '{g}' AS factor_group, g_{g} AS p FROM vm" for g in groups) + ")"
    listed = ", ".join(f"('{g}', '{m}')" for g, m in each)
    names = ", ".join(f"('{g}')" for g in groups)
    return f"""{fits_sql(groups, win, "fitted")}, checked AS {predicted_sql(groups, win, "fitted", "val")},
    mi AS (SELECT fold, factor_group, model, avg(ic) AS ic FROM {ic_sql(long, "p", "label", 10, "fold, factor_group, model")} GROUP BY ALL),
    we AS (SELECT fold, factor_group, model, ic, coalesce(greatest(ic, 0), 0) AS good FROM (SELECT fold, factor_group, model FROM {win}, (VALUES {listed}) AS v(factor_group, model)) LEFT JOIN mi USING (fold, factor_group, model)),
    weights AS (SELECT fold, factor_group, model, ic, CASE WHEN sum(good) OVER (PARTITION BY fold, factor_group) > 0 THEN good / sum(good) OVER (PARTITION BY fold, factor_group) ELSE {1 / len(fm.MODELS)} END AS weight FROM we),
    wide AS (SELECT fold, {", ".join(f"max(weight) FILTER (factor_group = '{g}' AND model = '{m}') AS w_{g}_{m}" for g, m in each)} FROM weights GROUP BY fold),
    vm AS {mixed_sql(groups, "checked")},
    gi AS (SELECT fold, factor_group, avg(ic) AS factor_ic FROM {ic_sql(mixes, "p", "label", 10, "fold, factor_group")} GROUP BY ALL),
    ge AS (SELECT fold, factor_group, factor_ic, sqrt(coalesce(greatest(factor_ic, 0), 0)) AS raw FROM (SELECT fold, factor_group FROM {win}, (VALUES {names}) AS v(factor_group)) LEFT JOIN gi USING (fold, factor_group)),
    blends AS (SELECT fold, factor_group, factor_ic, CASE WHEN sum(raw) OVER (PARTITION BY fold) > 0 THEN raw / sum(raw) OVER (PARTITION BY fold) ELSE {1 / len(groups)} END AS blend FROM ge)"""


def blended_sql(groups, frm):
    factors = ", ".join(f"""coalesce({snap_sql(f"((g_{g} - avg(g_{g}) OVER d) / nullif(stddev_samp(g_{g}) OVER d, 0))")}, 0) AS factor_{g}""" for g in groups)
    wide = ", ".join(f"max(blend) FILTER (factor_group = '{g}') AS v_{g}" for g in groups)
    pred = snap_sql("(" + " + ".join(f"factor_{g} * v_{g}" for g in groups) + ")")
    return f"(SELECT *, {pred} AS pred FROM (SELECT *, {factors} FROM {mixed_sql(groups, frm)} WINDOW d AS (PARTITION BY fold, date)) JOIN (SELECT fold, {wide} FROM blends GROUP BY fold) USING (fold))"


def inner_sql(frm):
    cut = "CAST(floor((last - first + 1) * 0.85) AS INTEGER)"
    return f"(SELECT fold, first AS fit_lo, first + greatest({cut} - 6, 0) - 1 AS fit_hi, first + {cut} AS val_lo, last AS val_hi, out_lo, out_hi FROM {frm})"


ONE_SPAN = "(SELECT 0 AS fold, 1 AS first, max(ord) FILTER (label IS NOT NULL) AS last, 1 AS out_lo, max(ord) AS out_hi FROM st)"
LEARNT = f"WITH {standard_sql(fm.names(FITTED))}, win AS {inner_sql(ONE_SPAN)}, {ensembles_sql(FITTED, 'win')}"


def one_span(df):
    """A single fold: everything labelled is fitted and weighed, every session scored."""
    last = F.max(F.when(C("label").isNotNull(), C("ord")))
    return df.agg(last.alias("last"), F.max("ord").alias("out_hi")).select(F.lit(0).alias("fold"), F.lit(1).alias("first"), "last", F.lit(1).alias("out_lo"), "out_hi")


@query(
    "train_factor_ensembles",
    LEARNT + " SELECT factor_group, model, ic, weight, factor_ic, blend FROM weights JOIN blends USING (fold, factor_group)",
    q="ic weight factor_ic blend",
)
def train_factor_ensembles(t):
    df = learn_rows(t)
    _, weights, blend = fm.ensembles(df, fm.inner_windows(one_span(df)), groups_of(df), "label", 10, t.day_rows("lineitem"))
    return weights.join(blend, ["fold", "factor_group"]).select("factor_group", "model", "ic", "weight", "factor_ic", "blend")


# every labelled session is fitted again; the weights stay those of the inner split
REFIT_WIN = "(SELECT fold, first AS fit_lo, last AS fit_hi, out_lo, out_hi FROM " + ONE_SPAN + ")"
REFIT = LEARNT + f", full_win AS {REFIT_WIN}, again AS (WITH {fits_sql(FITTED, 'full_win', 'f')} SELECT * FROM f)"


@query("refit_full", REFIT + f" SELECT symbol, date, pred FROM {blended_sql(FITTED, predicted_sql(FITTED, 'full_win', 'again', 'out'))}", q="pred", d="date")
def refit_full(t):
    df = learn_rows(t)
    groups, span = groups_of(df), one_span(df)
    _, weights, blend = fm.ensembles(df, fm.inner_windows(span), groups, "label", 10, t.day_rows("lineitem"))
    whole = span.select("fold", C("first").alias("fit_lo"), C("last").alias("fit_hi"), "out_lo", "out_hi")
    made = fm.predictions(df, fm.fits(df, whole, groups, "label"), whole, "out", groups)
    return fm.blended(made, weights, blend, groups).select("symbol", "date", "pred")


@query(
    "predict_panel",
    LEARNT + f" SELECT symbol, date, factor_price, factor_activity, pred FROM {blended_sql(FITTED, predicted_sql(FITTED, 'win', 'fitted', 'out'))}",
    q="factor_price factor_activity pred",
    d="date",
)
def predict_panel(t):
    df = learn_rows(t)
    groups, windows = groups_of(df), fm.inner_windows(one_span(df))
    fitted, weights, blend = fm.ensembles(df, windows, groups, "label", 10, t.day_rows("lineitem"))
    made = fm.predictions(df, fitted, windows, "out", groups)
    return fm.blended(made, weights, blend, groups).select("symbol", "date", "factor_price", "factor_activity", "pred")


WALK = f"""WITH {standard_sql(fm.names(FITTED))}, folds AS (WITH {folds_sql(1200, 600, 600, 25)}), od AS (SELECT DISTINCT date, ord FROM st),
    spans AS (SELECT fold, a.ord AS first, b.ord AS last, c.ord AS out_lo, e.ord AS out_hi FROM folds JOIN od a ON a.date = train_start JOIN od b ON b.date = train_end JOIN od c ON c.date = test_start JOIN od e ON e.date = test_end),
    win AS {inner_sql("spans")}, {ensembles_sql(FITTED, "win")}, oos AS {blended_sql(FITTED, predicted_sql(FITTED, "win", "fitted", "out"))}"""


@query("run_walk_forward", WALK + f" SELECT * FROM {nw_sql(ic_sql('oos', 'pred', 'label', 10, 'fold'), 4, by='fold')}", q=STATS)
def run_walk_forward(t):
    df = learn_rows(t)
    groups, order = groups_of(df), session_table(df.select("date"))
    folds = ml.fold_table(df, 1200, 600, 600, 25)
    for mark, name in (("train_start", "first"), ("train_end", "last"), ("test_start", "out_lo"), ("test_end", "out_hi")):
        folds = folds.join(F.broadcast(order.select(C("date").alias(mark), C("ord").alias(name))), mark)
    windows = fm.inner_windows(folds)
    fitted, weights, blend = fm.ensembles(df, windows, groups, "label", 10, t.day_rows("lineitem"))
    oos = fm.blended(fm.predictions(df, fitted, windows, "out", groups), weights, blend, groups)
    return ev.summarize_ic(ev.daily_rank_ic(oos, "pred", "label", 10, t.day_rows("lineitem"), by=["fold"]), 4, by=["fold"])


VOTERS = ["f1", "f2", "f3", "f4"]


@query(
    "feature_voting",
    f"""WITH {standard_sql(VOTERS)}, win AS (SELECT 0 AS fold, 1 AS fit_lo, max(ord) AS fit_hi FROM st), {moments_sql({"all": VOTERS}, "win")}, {ridge_sql("all", VOTERS, "mo")},
    si AS ({" UNION ALL ".join(f"SELECT '{f}' AS feature, {snap_sql(f'abs(b_all_{f})')} AS linear FROM r_all" for f in VOTERS)}),
    be AS (SELECT feature, max(gain) AS gain FROM gains GROUP BY feature), bo AS (SELECT feature, linear, coalesce(gain, 0) AS gain FROM si LEFT JOIN be USING (feature)),
    sh AS (SELECT feature, linear, {snap_sql("(gain / nullif(sum(gain) OVER (), 0))")} AS split FROM bo)
    SELECT *, rank() OVER (ORDER BY linear DESC) + rank() OVER (ORDER BY split DESC) AS votes FROM sh ORDER BY votes, feature LIMIT 3""",
    q="linear split",
)
def feature_voting(t):
    return fm.feature_votes(learn_rows(t, VOTERS), VOTERS, "label", 3)


@query(
    "future_perturbation",
    "SELECT count(*) AS n, CAST(0 AS DOUBLE) AS max_change FROM {long} WHERE date < DATE '2000-01-01'",
)
def future_perturbation(t):
    """Every later row altered: a trailing feature must not move before the cutoff."""

    def feature(df):
        p = Panel(df, t.day_rows("lineitem"))
        value = p.ts_rank(p.close, 10) + p.std(p.close, 20) + p.ema(p.close, 10)
        return p.df.select("symbol", "date", value.alias("value"))

    bars = spread(t.long_bars(), "symbol", t.rows("lineitem"))
    return ml.future_perturbation(bars, feature, F.lit("2000-01-01").cast("date"))


@query(
    "strength_oracle",
    f"WITH {FX} SELECT ic_mean, t_stat, CASE WHEN abs(t_stat) > 6 OR abs(ic_mean) > 0.08 THEN 1 ELSE 0 END AS fired FROM {nw_sql(ic_sql('fx', 'f1', 'label', 20), 0)}",
    q="ic_mean t_stat",
)
def strength_oracle(t):
    """A result too strong to be true is a sign of leakage."""
    s = ev.summarize_ic(ev.daily_rank_ic(scored(t), "f1", "label", 20, t.day_rows("events")), 0)
    fired = (F.abs("t_stat") > 6) | (F.abs("ic_mean") > 0.08)
    return s.select("ic_mean", "t_stat", fired.cast("int").alias("fired"))


@query(
    "membership_oracle",
    f"""WITH {LX}, mm AS (SELECT fx.* FROM fx JOIN {INTERVALS} i ON fx.symbol = i.symbol AND fx.date >= i.start AND fx.date < coalesce(i."end", DATE '2100-01-01'))
    SELECT avg(ic) AS official_ic, avg(ic) AS independent_ic, 0 AS fired FROM {ic_sql("mm", "f4", "label", 8)}""",
    q="official_ic independent_ic",
)
def membership_oracle(t):
    """The IC on the interval join must equal the IC on the independently computed mask."""
    df, iv, rows = scored(t, "long"), intervals(t), t.day_rows("lineitem")
    mean_ic = lambda d: ev.daily_rank_ic(d, "f4", "label", 8, rows).agg(F.avg("ic").alias("ic"))
    a = mean_ic(jn.inside_intervals(df, iv)).select(F.lit(1).alias("k"), C("ic").alias("official_ic"))
    masked = jn.member_mask(df, iv).where(C("member") == 1)
    b = mean_ic(masked).select(F.lit(1).alias("k"), C("ic").alias("independent_ic"))
    fired = (F.abs(C("official_ic") - C("independent_ic")) > 1e-9).cast("int")
    return a.join(b, "k").select("official_ic", "independent_ic", fired.alias("fired"))


_CTRL = " UNION ALL ".join(f"SELECT '{f}' AS control, avg(ic) AS ic, CASE WHEN abs(avg(ic)) > 0.05 THEN 1 ELSE 0 END AS fired FROM {ic_sql('fx', f, 'label', 20)}" for f in ("f2", "f3"))


@query("control_oracle", f"WITH {FX} {_CTRL}", q="ic")
def control_oracle(t):
    """Control fields should have no IC to speak of."""
    df = scored(t)
    long = ev.long_form(df, ["f2", "f3"], ["symbol", "date", "label"], "control")
    ic = ev.daily_rank_ic(long, "score", "label", 20, t.day_rows("events"), by=["control"])
    g = ic.groupBy("control").agg(F.avg("ic").alias("ic"))
    return g.withColumn("fired", (F.abs("ic") > 0.05).cast("int"))


# -- streams -------------------------------------------------------------------------------------------


def sink(t, name):
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "stream_append_only",
    """WITH old AS (SELECT event_id, user_id, ts, value FROM events WHERE ts < TIMESTAMP '2024-01-12' AND user_id % 7 <> 3), m AS (SELECT user_id, max(ts) AS mark FROM old GROUP BY user_id)
    SELECT event_id, user_id, value FROM old UNION ALL SELECT e.event_id, e.user_id, e.value FROM events e LEFT JOIN m USING (user_id) WHERE mark IS NULL OR e.ts > mark""",
)
def stream_append_only(t):
    out = sink(t, "append")
    columns = ["event_id", "user_id", "ts", "value"]
    old = t.events.where((C("ts") < "2024-01-12") & (C("user_id") % 7 != 3)).select(*columns)
    old = old.withColumn("ts", C("ts").cast("timestamp"))
    old.write.parquet(f"{out}/batch=-1")
    jobs.append_only(jobs.event_stream(t.spark, t.folder).select(*columns), out)
    return t.spark.read.parquet(out).select("event_id", "user_id", "value")


@query(
    "stream_daily_loss",
    """WITH l AS (SELECT user_id, avg(value) AS last_equity FROM events GROUP BY user_id)
    SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(min(event_id) FILTER (WHERE value <= last_equity * 0.1) IS NOT NULL AS INTEGER) AS halted FROM events JOIN l USING (user_id)
    GROUP BY user_id, CAST(ts AS DATE) HAVING count(*) FILTER (WHERE value <= last_equity * (1 - 0.9)) > 0""",
)
def stream_daily_loss(t):
    out = sink(t, "loss")
    last = t.events.groupBy("user_id").agg(F.avg("value").alias("last_equity"))
    jobs.daily_loss(jobs.event_stream(t.spark, t.folder).select("user_id", "ts", "value"), last, 0.9, out)
    rows = jobs.latest_batch(t.spark, out, ["user_id", "day"])
    return rows.select("user_id", C("day").cast("date").alias("day"), C("halted_at").isNotNull().alias("halted"))


@query(
    "stream_level_breach",
    """WITH l AS (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'long' ELSE 'short' END AS side, avg(value) AS a FROM events GROUP BY user_id)
    SELECT event_id, user_id, side, value, CASE WHEN side = 'long' THEN CASE WHEN value <= a * 0.2 THEN 'stop' WHEN value >= a * 2.5 THEN 'take' END ELSE CASE WHEN value >= a * 2.5 THEN 'stop' WHEN value <= a * 0.2 THEN 'take' END END AS breach
    FROM events JOIN l USING (user_id) WHERE value <= a * 0.2 OR value >= a * 2.5""",
)
def stream_level_breach(t):
    out = sink(t, "breach")
    long = C("user_id") % 2 == 0
    a = t.events.groupBy("user_id").agg(F.avg("value").alias("a"))
    low, high = C("a") * 0.2, C("a") * 2.5
    levels = a.select(
        "user_id", F.when(long, "long").otherwise("short").alias("side"), F.when(long, low).otherwise(high).alias("stop"),
        F.when(long, high).otherwise(low).alias("take"),
    )
    jobs.level_breach(jobs.event_stream(t.spark, t.folder).select("event_id", "user_id", "value"), levels, out)
    return t.spark.read.parquet(out).select("event_id", "user_id", "side", "value", "breach")


@query(
    "stream_daily_news",
    "SELECT user_id % 10 AS symbol, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, sum(value * (user_id % 4)) / nullif(sum(user_id % 4), 0) AS tone, CAST(sum(user_id % 4) AS BIGINT) AS articles FROM events GROUP BY user_id % 10, CAST(ts AS DATE)",
    q="tone",
)
def stream_daily_news(t):
    out = sink(t, "news")
    jobs.daily_news(jobs.event_stream(t.spark, t.folder), C("user_id") % 10, C("value"), C("user_id") % 4, out)
    rows = jobs.latest_batch(t.spark, out, ["symbol", "day"])
    return rows.select("symbol", C("day").cast("date").alias("day"), "tone", "articles")
