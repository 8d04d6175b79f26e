"""Queries of the point-in-time joins. Events come from ``orders``; the panel keeps weekdays only."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import joins as jn
from quantloom.operators.cleaning import session_table
from quantloom.operators.panel import Panel
from quantloom.plans.registry import query

C = F.col


def weekday_bars(t):
    return t.long_bars().where(F.weekday("date") < 5)


def order_events(t):
    """symbol, day, val, key per order; the symbol with the largest number has no events at all."""
    n = t.rows("supplier")
    return t.orders.select(
        (C("o_custkey") % n).alias("symbol"), F.to_date("o_orderdate").alias("day"), C("o_totalprice").alias("val"),
        C("o_orderkey").alias("key"),
    )


BASE = """WITH b AS (SELECT * FROM {long} WHERE dayofweek(date) BETWEEN 1 AND 5),
 s AS (SELECT date, row_number() OVER (ORDER BY date) AS ord FROM (SELECT DISTINCT date FROM b)),
 p AS (SELECT b.*, s.ord FROM b JOIN s USING (date)),
 ev AS (SELECT o_custkey % (SELECT count(*) FROM supplier) AS symbol, CAST(o_orderdate AS DATE) AS day,
   o_totalprice AS val, o_orderkey AS key FROM orders),
 ge AS (SELECT ev.*, s.date AS session, s.ord FROM ev ASOF JOIN s ON ev.day <= s.date),
 gt AS (SELECT ev.*, s.date AS session, s.ord FROM ev ASOF JOIN s ON ev.day < s.date),
 lim AS (SELECT coalesce((SELECT min(date) FROM s WHERE date > (SELECT max(day) FROM ev)), DATE '2100-01-01') AS lim)"""

FILED = """, fl AS (SELECT symbol, ord + 1 AS eff, arg_max(val * 100, (day, val)) AS shares_out FROM ge GROUP BY ALL),
 f0 AS (SELECT p.*, CASE WHEN p.ord - fl.eff <= 130 THEN fl.shares_out END AS shares_out,
   CASE WHEN p.ord - fl.eff <= 130 THEN CAST(p.ord - fl.eff AS DOUBLE) END AS filing_days
   FROM p ASOF LEFT JOIN fl ON p.symbol = fl.symbol AND p.ord >= fl.eff),
 f AS (SELECT *, close * shares_out / 1e6 AS marketcap, volume / shares_out AS turnover FROM f0)"""


def filings(t):
    return order_events(t).select("symbol", C("day").alias("filed"), (C("val") * 100).alias("shares_out"))


@query("session_ordinal", BASE + " SELECT date, CAST(ord AS INTEGER) AS ord FROM s", d="date")
def session_ordinal(t):
    return session_table(weekday_bars(t))


@query("map_to_session_ge", BASE + " SELECT key, session, CAST(ord + 2 AS INTEGER) AS ord FROM ge", d="session")
def map_to_session_ge(t):
    return jn.to_session(order_events(t), "day", session_table(weekday_bars(t)), False, 2).select("key", "session", "ord")


@query("map_to_session_gt", BASE + " SELECT key, session, CAST(ord AS INTEGER) AS ord FROM gt", d="session")
def map_to_session_gt(t):
    return jn.to_session(order_events(t), "day", session_table(weekday_bars(t)), True).select("key", "session", "ord")


@query(
    "asof_join",
    BASE
    + """, r AS (SELECT symbol, day, arg_max(val, key) AS val FROM ev GROUP BY ALL)
       SELECT b.symbol, b.date, CASE WHEN date_diff('day', r.day, b.date) <= 20 THEN r.val END AS val
       FROM b ASOF LEFT JOIN r ON b.symbol = r.symbol AND b.date >= r.day""",
    d="date",
)
def asof_join(t):
    daily = order_events(t).groupBy("symbol", C("day").alias("date")).agg(F.max_by("val", "key").alias("val"))
    joined = jn.asof_join(weekday_bars(t), daily, "date", ["val"])
    fresh = F.datediff("date", "at_right") <= 20
    return joined.select("symbol", "date", F.when(fresh, C("val")).alias("val"))


@query(
    "attach_filings",
    BASE + FILED + " SELECT symbol, date, marketcap, turnover, filing_days FROM f",
    q="marketcap turnover",
    d="date",
)
def attach_filings(t):
    made = jn.attach_filings(weekday_bars(t), filings(t))
    return made.select("symbol", "date", "marketcap", "turnover", "filing_days")


def news(t):
    return order_events(t).select("symbol", "day", (C("val") / 1000).alias("tone"), (C("key") % 4).cast("double").alias("articles"))


@query(
    "attach_news",
    BASE
    + """, n AS (SELECT symbol, session AS date, sum(val / 1000 * (key % 4)) AS w, sum(key % 4) AS articles FROM gt GROUP BY ALL)
       SELECT p.symbol, p.date, CASE WHEN articles > 0 THEN w / articles END AS news_tone,
         CASE WHEN p.symbol IN (SELECT symbol FROM gt) THEN coalesce(CAST(articles AS DOUBLE), 0) END AS news_articles
       FROM p LEFT JOIN n USING (symbol, date)""",
    q="news_tone",
    d="date",
)
def attach_news(t):
    return jn.attach_news(weekday_bars(t), news(t)).select("symbol", "date", "news_tone", "news_articles")


def insiders(t):
    k = C("key")
    early = order_events(t).where(C("day") < "2000-06-01")
    return early.select(
        "symbol", C("day").alias("filed"), (k % 100).cast("double").alias("buy_shares"),
        (k % 70).cast("double").alias("sell_shares"), (k % 3).cast("double").alias("n_buyers"),
        (k % 2).cast("double").alias("n_sellers"),
    )


INSIDERS = """, ie AS (SELECT * FROM gt WHERE day < DATE '2000-06-01'),
 ia AS (SELECT symbol, session AS date, CAST(sum(key % 100) AS DOUBLE) AS buy, CAST(sum(key % 70) AS DOUBLE) AS sell,
   CAST(sum(key % 3) AS DOUBLE) AS nb, CAST(sum(key % 2) AS DOUBLE) AS ns FROM ie GROUP BY ALL),
 il AS (SELECT min(date) AS lim FROM s WHERE date > (SELECT max(day) FROM ev WHERE day < DATE '2000-06-01')),
 i0 AS (SELECT f.symbol, f.date, f.close, f.marketcap, f.symbol IN (SELECT symbol FROM ev WHERE day < DATE '2000-06-01') AND f.date <= coalesce(lim, DATE '2100-01-01') AS ok,
   coalesce(buy, 0) AS buy, coalesce(sell, 0) AS sell, coalesce(nb, 0) AS nb, coalesce(ns, 0) AS ns
   FROM f LEFT JOIN ia USING (symbol, date), il)"""


@query(
    "attach_form4",
    BASE
    + FILED
    + INSIDERS
    + """ SELECT symbol, date, CASE WHEN ok THEN nb END AS insider_buys, CASE WHEN ok THEN ns END AS insider_sells,
       CASE WHEN ok THEN (buy - sell) / (marketcap * 1e6 / close) * 1e6 END AS insider_net_ppm FROM i0""",
    q="insider_net_ppm",
    d="date",
)
def attach_form4(t):
    rows = jn.attach_all(weekday_bars(t), {"filings": filings(t), "insiders": insiders(t)})
    return rows.select(
        "symbol", "date", "insider_buys", "insider_sells", (C("insider_net_frac") * 1e6).alias("insider_net_ppm")
    )


def short_interest(t):
    return order_events(t).select(
        "symbol", C("day").alias("settled"), (C("val") * 3).alias("short_interest"), (C("val") / 5000).alias("days_to_cover")
    )


@query(
    "attach_short_interest",
    BASE
    + FILED
    + """, si AS (SELECT symbol, ord + 10 AS eff, arg_max(val * 3, (day, val)) AS si, arg_max(val / 5000, (day, val)) AS dtc FROM ge GROUP BY ALL)
       SELECT f.symbol, f.date, CASE WHEN f.ord - si.eff <= 40 THEN si.si / (marketcap * 1e6 / close) END AS short_ratio,
         CASE WHEN f.ord - si.eff <= 40 THEN dtc END AS days_to_cover
       FROM f ASOF LEFT JOIN si ON f.symbol = si.symbol AND f.ord >= si.eff""",
    q="short_ratio days_to_cover",
    d="date",
)
def attach_short_interest(t):
    rows = jn.attach_all(weekday_bars(t), {"filings": filings(t), "short_interest": short_interest(t)})
    return rows.select("symbol", "date", "short_ratio", "days_to_cover")


# name → (Spark expression, SQL text) over val and key
FACTS = {
    "revenue_ttm": "val * 20",
    "gp_ttm": "val * (key % 10)",
    "ni_ttm": "val * (key % 7 - 2)",
    "ocf_ttm": "val * (key % 5 - 1)",
    "capex_ttm": "val * (key % 3)",
    "rd_ttm": "CASE WHEN key % 2 = 0 THEN val * (key % 4) END",
    "opinc_ttm": "val * (key % 6 - 1)",
    "assets": "CASE WHEN key % 11 <> 0 THEN val * 40 END",
    "equity": "val * (key % 9 - 1)",
    "ltdebt": "CASE WHEN key % 3 = 0 THEN val * 7 END",
    "cash": "val * (key % 8)",
    "assets_1y": "CASE WHEN key % 5 <> 0 THEN val * 35 END",
}


def fundamentals(t):
    return order_events(t).select("symbol", C("day").alias("filed"), *[F.expr(e).alias(n) for n, e in FACTS.items()])


_RATIOS = {
    "book_to_market": ("equity", "cap"),
    "earnings_yield": ("ni_ttm", "cap"),
    "sales_to_price": ("revenue_ttm", "cap"),
    "gross_profitability": ("gp_ttm", "assets"),
    "roe": ("ni_ttm", "equity"),
    "accruals": ("(ni_ttm - ocf_ttm)", "assets"),
    "leverage": ("CASE WHEN assets > 0 THEN coalesce(ltdebt, 0) ELSE ltdebt END", "assets"),
    "cash_to_assets": ("cash", "assets"),
    "rd_to_sales": ("CASE WHEN revenue_ttm IS NOT NULL THEN coalesce(rd_ttm, 0) ELSE rd_ttm END", "revenue_ttm"),
    "capex_to_assets": ("capex_ttm", "assets"),
    "op_margin": ("opinc_ttm", "revenue_ttm"),
}
_FUND_SQL = (
    BASE
    + FILED
    + f""", fu AS (SELECT symbol, ord + 1 AS eff, arg_max({{'k': (day, key), {", ".join(f"'{n}': {e}" for n, e in FACTS.items())}}},
     (day, {", ".join(f"coalesce({e}, -1e300)" for e in FACTS.values())})) AS v FROM ge GROUP BY ALL),
   fx AS (SELECT f.symbol, f.date, f.marketcap * 1e6 AS cap, {", ".join(f"CASE WHEN f.ord - fu.eff <= 300 THEN v.{n} END AS {n}" for n in FACTS)}
     FROM f ASOF LEFT JOIN fu ON f.symbol = fu.symbol AND f.ord >= fu.eff)
   SELECT symbol, date, {", ".join(f"CASE WHEN {b} > 0 THEN ({a}) / {b} END AS {n}" for n, (a, b) in _RATIOS.items())},
     CASE WHEN assets_1y > 0 THEN assets / assets_1y END - 1 AS asset_growth FROM fx"""
)


@query("attach_fundamentals", _FUND_SQL, q=" ".join([*_RATIOS, "asset_growth"]), d="date")
def attach_fundamentals(t):
    rows = jn.attach_all(weekday_bars(t), {"filings": filings(t), "fundamentals": fundamentals(t)})
    return rows.select("symbol", "date", *_RATIOS, "asset_growth")


def short_volume(t):
    return order_events(t).select("symbol", "day", ((C("key") % 100) / 100).alias("short_ratio_day"))


@query(
    "attach_short_volume",
    BASE
    + """, v AS (SELECT symbol, session AS date, arg_max((key % 100) / 100, (day, (key % 100) / 100)) AS r FROM gt GROUP BY ALL)
       SELECT p.symbol, p.date, CASE WHEN p.date <= coalesce((SELECT min(date) FROM s WHERE date > (SELECT max(day) FROM gt)), DATE '2100-01-01') THEN r END AS short_vol_ratio
       FROM p LEFT JOIN v USING (symbol, date)""",
    d="date",
)
def attach_short_volume(t):
    return jn.attach_short_volume(weekday_bars(t), short_volume(t)).select("symbol", "date", "short_vol_ratio")


def institutions(t):
    return order_events(t).select(
        "symbol", F.last_day("day").alias("usable_from"), (C("val") * 30).alias("inst_shares"),
        (C("key") % 500).cast("double").alias("inst_holders"), ((C("key") % 90) / 100).alias("inst_top5"),
    )


@query(
    "attach_form13f",
    BASE
    + FILED
    + """, q0 AS (SELECT symbol, last_day(day) AS day, val * 30 AS a, CAST(key % 500 AS DOUBLE) AS h, (key % 90) / 100 AS t5 FROM ev),
       q1 AS (SELECT q0.*, s.ord FROM q0 ASOF JOIN s ON q0.day < s.date),
       q AS (SELECT symbol, ord AS eff, arg_max({'a': a, 'h': h, 't5': t5}, (day, a, h, t5)) AS v FROM q1 GROUP BY ALL)
       SELECT f.symbol, f.date, CASE WHEN f.ord - q.eff <= 70 THEN v.a / (marketcap * 1e6 / close) END AS inst_own,
         CASE WHEN f.ord - q.eff <= 70 THEN v.h END AS inst_holders, CASE WHEN f.ord - q.eff <= 70 THEN v.t5 END AS inst_top5
       FROM f ASOF LEFT JOIN q ON f.symbol = q.symbol AND f.ord >= q.eff""",
    q="inst_own",
    d="date",
)
def attach_form13f(t):
    rows = jn.attach_all(weekday_bars(t), {"filings": filings(t), "institutions": institutions(t)})
    return rows.select("symbol", "date", "inst_own", "inst_holders", "inst_top5")


def page_views(t):
    return order_events(t).select("symbol", "day", (C("key") % 1000).cast("double").alias("views"))


@query(
    "attach_wikipedia",
    BASE
    + """, v AS (SELECT symbol, session AS date, CAST(sum(key % 1000) AS DOUBLE) AS views FROM gt GROUP BY ALL),
       k AS (SELECT symbol, min(session) AS first FROM gt GROUP BY symbol)
       SELECT p.symbol, p.date, CASE WHEN p.date >= k.first AND p.date <= coalesce((SELECT min(date) FROM s WHERE date > (SELECT max(day) FROM gt)), DATE '2100-01-01') THEN views END AS wiki_views
       FROM p LEFT JOIN v USING (symbol, date) LEFT JOIN k USING (symbol)""",
    d="date",
)
def attach_wikipedia(t):
    return jn.attach_page_views(weekday_bars(t), page_views(t)).select("symbol", "date", "wiki_views")


_SECTOR_SQL = """SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.sector, b.sector) AS sector FROM
  (SELECT s_suppkey AS symbol, r_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey
   JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey % 3 <> 0) a
  FULL JOIN (SELECT s_suppkey AS symbol, n_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey
   WHERE s_suppkey % 5 <> 0) b ON a.symbol = b.symbol"""


def two_sectors(t):
    fallback = t.supplier.join(t.nation, C("s_nationkey") == C("n_nationkey")).where(C("s_suppkey") % 5 != 0)
    return jn.sector_table(
        t.sectors().where(C("symbol") % 3 != 0), fallback.select(C("s_suppkey").alias("symbol"), C("n_name").alias("sector"))
    )


@query("sector_table", _SECTOR_SQL)
def sector_table(t):
    return two_sectors(t)


@query(
    "attach_sector",
    f"""SELECT b.symbol, b.date, coalesce(k.sector, 'Unknown') AS sector FROM {{long}} b LEFT JOIN ({_SECTOR_SQL}) k USING (symbol)""",
    d="date",
)
def attach_sector(t):
    return jn.attach_sector(t.long_bars().select("symbol", "date"), two_sectors(t))


@query(
    "attach_all",
    BASE
    + FILED
    + INSIDERS
    + """, v AS (SELECT symbol, session AS date, CAST(sum(key % 1000) AS DOUBLE) AS views FROM gt GROUP BY ALL),
       k AS (SELECT symbol, min(session) AS first FROM gt GROUP BY symbol)
       SELECT f.symbol, f.date, f.marketcap, f.filing_days, CASE WHEN i0.ok THEN i0.nb END AS insider_buys,
         CASE WHEN f.date >= k.first AND f.date <= coalesce((SELECT min(date) FROM s WHERE date > (SELECT max(day) FROM gt)), DATE '2100-01-01') THEN views END AS wiki_views
       FROM f JOIN i0 USING (symbol, date) LEFT JOIN v USING (symbol, date) LEFT JOIN k USING (symbol)""",
    q="marketcap",
    d="date",
)
def attach_all(t):
    sources = {"filings": filings(t), "insiders": insiders(t), "page_views": page_views(t)}
    rows = jn.attach_all(weekday_bars(t), sources)
    return rows.select("symbol", "date", "marketcap", "filing_days", "insider_buys", "wiki_views")


INTERVALS = """(SELECT symbol, min(day) + 100 AS start, CASE WHEN symbol % 4 <> 0 THEN max(day) - 200 END AS "end" FROM
  (SELECT o_custkey % (SELECT count(*) FROM supplier) AS symbol, CAST(o_orderdate AS DATE) AS day FROM orders) GROUP BY symbol)"""


def intervals(t):
    return order_events(t).groupBy("symbol").agg(
        F.date_add(F.min("day"), 100).alias("start"),
        F.when(C("symbol") % 4 != 0, F.date_sub(F.max("day"), 200)).alias("end"),
    )


@query(
    "interval_join",
    f"""SELECT b.symbol, b.date, b.close FROM {{long}} b JOIN {INTERVALS} i ON b.symbol = i.symbol
        AND b.date >= i.start AND b.date < coalesce(i."end", DATE '2100-01-01')""",
    d="date",
)
def interval_join(t):
    return jn.inside_intervals(t.long_bars().select("symbol", "date", "close"), intervals(t))


@query(
    "independent_mask",
    f"""SELECT b.symbol, b.date, CASE WHEN b.date >= i.start AND b.date < coalesce(i."end", DATE '2100-01-01') THEN 1 ELSE 0 END AS member
        FROM {{long}} b LEFT JOIN {INTERVALS} i ON b.symbol = i.symbol""",
    d="date",
)
def independent_mask(t):
    return jn.member_mask(t.long_bars().select("symbol", "date"), intervals(t))


@query(
    "pead_features",
    BASE
    + """, a0 AS (SELECT symbol, day, min(val / 1000 - 150) AS surprise FROM ev GROUP BY ALL),
       a1 AS (SELECT a0.*, s.ord FROM a0 ASOF JOIN s ON a0.day <= s.date),
       a2 AS (SELECT symbol, ord AS a_ord, arg_max(surprise, day) AS surprise FROM a1 GROUP BY ALL),
       a AS (SELECT a2.symbol, a_ord, a_ord + 1 AS eff, greatest(-100, least(surprise, 100)) AS surprise, n.close / c.close - 1 AS react
         FROM a2 LEFT JOIN p c ON c.symbol = a2.symbol AND c.ord = a_ord - 1 LEFT JOIN p n ON n.symbol = a2.symbol AND n.ord = a_ord + 1),
       j AS (SELECT p.symbol, p.date, least(p.ord - a.a_ord, 90) AS since, a.surprise, a.react FROM p ASOF LEFT JOIN a ON p.symbol = a.symbol AND p.ord >= a.eff)
       SELECT symbol, date, coalesce(CAST(since AS DOUBLE), 90) AS days_since_earn, coalesce(surprise, 0) AS last_surprise,
         coalesce(surprise * exp(-since / 20), 0) AS surprise_decay, coalesce(react, 0) AS ear_react,
         coalesce(react * exp(-since / 20), 0) AS react_decay FROM j""",
    q="last_surprise surprise_decay ear_react react_decay",
    d="date",
)
def pead_features(t):
    ann = order_events(t).select("symbol", "day", (C("val") / 1000 - 150).alias("surprise"))
    return jn.pead(weekday_bars(t), ann)


@query(
    "next_open_close",
    """SELECT symbol, date, lead(open) OVER w AS next_open, lead(close) OVER w AS next_close FROM {long}
       WINDOW w AS (PARTITION BY symbol ORDER BY date)""",
    d="date",
)
def next_open_close(t):
    return jn.next_session_prices(t.long_bars()).select("symbol", "date", "next_open", "next_close")


@query(
    "load_live",
    """WITH b AS (SELECT symbol, date, close, ln(lead(close, 5) OVER (PARTITION BY symbol ORDER BY date) / close) AS label FROM {long}),
       sc AS (SELECT o_custkey % (SELECT count(*) FROM supplier) AS symbol, CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS factor FROM orders GROUP BY ALL)
       SELECT symbol, date, factor, label FROM sc JOIN b USING (symbol, date) WHERE label IS NOT NULL AND date > DATE '1997-01-01'""",
    q="label",
    d="date",
)
def load_live(t):
    n = t.rows("supplier")
    scores = t.orders.groupBy((C("o_custkey") % n).alias("symbol"), F.to_date("o_orderdate").alias("date")).agg(
        F.max("o_totalprice").alias("factor")
    )
    p = Panel(t.long_bars())
    label = p.stage(p.ln(p.div(p.lead(p.close, 5), p.close)))
    matured = p.df.select("symbol", "date", label.alias("label"))
    return scores.join(matured, ["symbol", "date"]).dropna().where(C("date") > "1997-01-01")


@query(
    "registry_vs_broker",
    """WITH r AS (SELECT l_suppkey AS symbol, l_returnflag AS side, sum(l_quantity) AS registered FROM lineitem WHERE l_suppkey % 5 <> 0 GROUP BY ALL),
       h AS (SELECT l_suppkey AS symbol, l_returnflag AS side, sum(l_quantity) AS held FROM lineitem WHERE l_suppkey % 7 <> 0 AND (l_linestatus = 'O' OR l_suppkey % 2 = 0) GROUP BY ALL)
       SELECT symbol, side, registered, held, CASE WHEN registered IS NULL THEN 'orphan' WHEN held IS NULL THEN 'never_filled'
         WHEN held < registered THEN 'reduced' ELSE 'ok' END AS difference FROM r FULL JOIN h USING (symbol, side)""",
)
def registry_vs_broker(t):
    rows = t.lineitem.select(C("l_suppkey").alias("symbol"), C("l_returnflag").alias("side"), C("l_quantity").alias("qty"), "l_linestatus")
    held = rows.where((C("symbol") % 7 != 0) & ((C("l_linestatus") == "O") | (C("symbol") % 2 == 0)))
    return jn.registry_differences(rows.where(C("symbol") % 5 != 0), held)


@query(
    "combine_feature_sets",
    """SELECT symbol, date, close - open AS body, high - low AS spread FROM {long}""",
    q="body spread",
    d="date",
)
def combine_feature_sets(t):
    b = t.long_bars()
    return jn.combine_features(
        b.select("symbol", "date", (C("close") - C("open")).alias("body")),
        b.select("symbol", "date", (C("high") - C("low")).alias("spread")),
    )
