"""Queries of signal evaluation. Scores and labels come from the panels of bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions import normal
from quantloom.functions.rounding import snap
from quantloom.operators import evaluation as ev
from quantloom.operators.panel import Panel
from quantloom.plans.oracle import snap_sql
from quantloom.plans.registry import query

C = F.col
SCORES = ["f1", "f2", "f3", "f4"]


def scored(t, source="dense"):
    """symbol, date, close, four scores and the next-row label."""
    p = t.panel(source)
    r = p.snap(p.ln(p.div(p.close, p.lag(p.close, 1))))
    label = p.snap(p.ln(p.div(p.lead(p.close, 1), p.close)))
    return p.df.select(
        "symbol", "date", "close", r.alias("f1"), C("volume").alias("f2"), (C("high") - C("low")).alias("f3"),
        snap(F.try_divide(C("close") - C("open"), C("open"))).alias("f4"), label.alias("label"),
    )


def fx(source):
    return f"""fx AS (SELECT symbol, date, close, {snap_sql("ln(close / lag(close) OVER w)")} AS f1, volume AS f2, high - low AS f3,
      {snap_sql("((close - open) / open)")} AS f4, {snap_sql("ln(lead(close) OVER w / close)")} AS label
      FROM {{{source}}} WINDOW w AS (PARTITION BY symbol ORDER BY date))"""


FX, LX = fx("dense"), fx("long")


def rk(x, part="date"):
    return f"(rank() OVER (PARTITION BY {part} ORDER BY {x}) + (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0)"


def corr_sql(a, b):
    return f"CASE WHEN min({a}) < max({a}) AND min({b}) < max({b}) THEN {snap_sql(f'corr({a}, {b})')} END"


def ic_sql(frm, pred, target, least, by=""):
    part = f"{by}, date" if by else "date"
    return f"""(SELECT * FROM (SELECT {part}, {corr_sql("a", "b")} AS ic, count(*) AS n FROM
      (SELECT *, {rk(pred, part)} AS a, {rk(target, part)} AS b FROM (SELECT * FROM {frm} WHERE {pred} IS NOT NULL AND {target} IS NOT NULL))
      GROUP BY {part}) WHERE n >= {least} AND ic IS NOT NULL)"""


def nw_sql(frm, lags, by="", value="ic"):
    part = f"PARTITION BY {by}" if by else ""
    head = f"{by}, " if by else ""
    tail = f"GROUP BY {by}" if by else ""
    lagged = "".join(f", d * lag(d, {k}) OVER ({part} ORDER BY date) AS l{k}" for k in range(1, lags + 1))
    spread = "avg(d * d)" + "".join(f" + coalesce(avg(l{k}), 0) * {2.0 * (1.0 - k / (lags + 1))}" for k in range(1, lags + 1))
    t = "avg(v) / stddev_samp(v) * sqrt(count(*))" if lags == 0 else f"avg(v) / sqrt(greatest({spread}, 1e-18) / count(*))"
    return f"""(SELECT {head}count(*) AS n_days, avg(v) AS ic_mean, stddev_samp(v) AS ic_std, {t} AS t_stat,
      avg(v) / stddev_samp(v) AS ic_ir, avg(CASE WHEN v > 0 THEN 1.0 ELSE 0 END) AS pct_positive FROM
      (SELECT *{lagged} FROM (SELECT *, {value} AS v, {value} - avg({value}) OVER ({part}) AS d FROM {frm} WHERE {value} IS NOT NULL)) {tail})"""


def unpivot_sql(frm="fx", extra="label"):
    return "(" + " UNION ALL ".join(
        f"SELECT symbol, date, {extra}, '{f}' AS factor, CAST({f} AS DOUBLE) AS score FROM {frm}" for f in SCORES
    ) + ")"


def unpivoted(df):
    return ev.long_form(df, SCORES, ["symbol", "date", "label"])


STATS = "ic_mean ic_std t_stat ic_ir pct_positive"


@query("daily_rank_ic", f"WITH {FX} SELECT * FROM {ic_sql('fx', 'f1', 'label', 20)}", q="ic", d="date")
def daily_rank_ic(t):
    return ev.daily_rank_ic(scored(t), "f1", "label", 20, t.day_rows("events"))


@query("summarize_ic", f"WITH {FX} SELECT * FROM {nw_sql(ic_sql('fx', 'f1', 'label', 20), 4)}", q=STATS)
def summarize_ic(t):
    return ev.summarize_ic(ev.daily_rank_ic(scored(t), "f1", "label", 20, t.day_rows("events")), 4)


@query(
    "flagship_ic",
    "WITH b AS (SELECT *, "
    + snap_sql("ln(close / lag(close) OVER w)")
    + " AS r, ln(lead(close) OVER w / close) AS l FROM {dense} WINDOW w AS (PARTITION BY symbol ORDER BY date)), "
    + "v AS (SELECT symbol, date, "
    + snap_sql("CASE WHEN count(r) OVER f >= 5 THEN stddev_samp(r) OVER f END")
    + " AS score, "
    + snap_sql("l")
    + " AS label FROM b WINDOW f AS (PARTITION BY symbol ORDER BY date ROWS 4 PRECEDING)) "
    + f"SELECT * FROM {nw_sql(ic_sql('v', 'score', 'label', 5), 4)}",
    q=STATS,
)
def flagship_ic(t):
    p = t.panel("dense")
    r = p.stage(p.snap(p.ln(p.div(p.close, p.lag(p.close, 1)))))
    label = p.snap(p.ln(p.div(p.lead(p.close, 1), p.close)))
    score = p.snap(p.std(r, 5))
    df = p.df.select("symbol", "date", score.alias("score"), label.alias("label"))
    return ev.summarize_ic(ev.daily_rank_ic(df, "score", "label", 5, t.day_rows("events")), 4)


DAILY = "(SELECT date, avg(f1) / 100 AS ret FROM fx GROUP BY date)"


def daily_returns(t, source="long"):
    return scored(t, source).groupBy("date").agg((F.avg("f1") / 100).alias("ret"))


METRICS = "total_return ann_return ann_vol sharpe sortino max_drawdown calmar daily_win_rate"


def metrics_sql(frm, by="", value="ret"):
    part = f"PARTITION BY {by}" if by else ""
    head, tail = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""(SELECT {head}count(*) AS n_days, arg_max(e, date) - 1 AS total_return, pow(arg_max(e, date), 252.0 / count(*)) - 1 AS ann_return,
      stddev_samp(v) * sqrt(252) AS ann_vol, avg(v) / stddev_samp(v) * sqrt(252) AS sharpe,
      avg(v) / stddev_samp(v) FILTER (WHERE v < 0) * sqrt(252) AS sortino, min(dd) AS max_drawdown,
      CASE WHEN min(dd) < 0 THEN (pow(arg_max(e, date), 252.0 / count(*)) - 1) / abs(min(dd)) END AS calmar,
      avg(CASE WHEN v > 0 THEN 1.0 ELSE 0 END) AS daily_win_rate FROM (
      SELECT *, e / max(e) OVER ({part} ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM (
      SELECT *, {value} AS v, product(1 + {value}) OVER ({part} ORDER BY date ROWS UNBOUNDED PRECEDING) AS e FROM {frm} WHERE {value} IS NOT NULL)) {tail})"""


@query("portfolio_metrics", f"WITH {LX} SELECT * FROM {metrics_sql(DAILY)}", q=METRICS)
def portfolio_metrics(t):
    return ev.portfolio_metrics(daily_returns(t))


def factor_ic(t, source="dense", least=20):
    rows = t.day_rows("events" if source == "dense" else "lineitem")  # a factor holds a symbol once a date
    return ev.daily_rank_ic(unpivoted(scored(t, source)), "score", "label", least, rows, by=["factor"])


def factor_ic_sql(least=20):
    return ic_sql(unpivot_sql(), "score", "label", least, by="factor")


@query("daily_factor_ic", f"WITH {FX} SELECT * FROM {factor_ic_sql()}", q="ic", d="date")
def daily_factor_ic(t):
    return factor_ic(t)


ROLL = f"""{LX}, ic AS (SELECT * FROM {factor_ic_sql(10)}),
  roll AS (SELECT factor, date, CASE WHEN count(ic) OVER f >= 80 THEN avg(ic) OVER f END AS rolling FROM ic
    WINDOW f AS (PARTITION BY factor ORDER BY date ROWS 119 PRECEDING)),
  base AS (SELECT factor, avg(rolling) AS dev_mean, stddev_samp(rolling) AS dev_std FROM roll
    WHERE date >= DATE '1996-01-01' AND date < DATE '1999-01-01' GROUP BY factor),
  seen AS (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY date) AS o FROM roll WHERE rolling IS NOT NULL),
  runs AS (SELECT factor, max(o) - coalesce(max(o) FILTER (WHERE NOT coalesce(rolling < dev_mean - dev_std, FALSE)), 0) AS below_band,
    max(o) - coalesce(max(o) FILTER (WHERE NOT rolling < 0), 0) AS below_zero FROM seen LEFT JOIN base USING (factor) GROUP BY factor)"""


def rolling(t):
    return ev.rolling_mean_ic(factor_ic(t, "long", 10), ["factor"], 120, 80).select("factor", "date", "rolling")


@query("rolling_ic", f"WITH {ROLL} SELECT * FROM roll", q="rolling", d="date")
def rolling_ic(t):
    return rolling(t)


def baseline(r):
    return ev.dev_baseline(r, ["factor"], "1996-01-01", "1999-01-01")


@query("dev_baseline", f"WITH {ROLL} SELECT * FROM base", q="dev_mean dev_std")
def dev_baseline(t):
    return baseline(rolling(t))


@query("trailing_run", f"WITH {ROLL} SELECT factor, below_zero AS run FROM runs")
def trailing_run(t):
    from pyspark.sql import Window

    seen = rolling(t).where(C("rolling").isNotNull())
    seen = seen.withColumn("o", F.row_number().over(Window.partitionBy("factor").orderBy("date")))
    return seen.groupBy("factor").agg(ev.trailing_run(C("rolling") < 0, C("o")).cast("long").alias("run"))


@query(
    "evaluate_alerts",
    f"""WITH {ROLL}, w AS (SELECT factor, CAST(count(*) AS DOUBLE) AS weight FROM ic WHERE ic > 0 GROUP BY factor)
    SELECT factor, CASE WHEN below_zero IS NULL OR dev_std IS NULL THEN 'NO_DATA' WHEN below_zero >= 20 AND weight > 0 THEN 'ALERT'
      WHEN below_band >= 5 THEN 'WARN' ELSE 'OK' END AS status, below_band, below_zero
    FROM w LEFT JOIN runs USING (factor) LEFT JOIN base USING (factor)""",
)
def evaluate_alerts(t):
    from quantloom.session import cut

    ic = cut(factor_ic(t, "long", 10))  # one row a factor and session, read four times below
    weights = ic.where(C("ic") > 0).groupBy("factor").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    r = ev.rolling_mean_ic(ic, ["factor"], 120, 80)
    made = ev.evaluate_alerts(r, baseline(r), weights, "factor", 5, 20)
    return made.withColumns({c: C(c).cast("long") for c in ("below_band", "below_zero")})


def deciles_sql(f):
    return f"""(SELECT date, dec, avg(label) AS mean FROM (SELECT date, label, n, CAST(least(floor(pos * 10 / n) + 1, 10) AS INTEGER) AS dec FROM (
      SELECT date, label, row_number() OVER (PARTITION BY date ORDER BY {f}, symbol) AS pos, count(*) OVER (PARTITION BY date) AS n
      FROM fx WHERE {f} IS NOT NULL AND label IS NOT NULL) WHERE n >= 20) GROUP BY ALL)"""


def table_sql(f):
    m = deciles_sql(f)
    return f"""(SELECT n_days AS n_dates, ic_mean AS spread_mean, t_stat AS spread_t,
      (SELECT {corr_sql("r", "CAST(dec AS DOUBLE)")} FROM (SELECT dec, CAST(rank() OVER (ORDER BY avg(mean)) AS DOUBLE) AS r FROM {m} GROUP BY dec)) AS monotonicity,
      pct_positive AS share_positive FROM {nw_sql(f"(SELECT date, max(mean) FILTER (WHERE dec = 10) - max(mean) FILTER (WHERE dec = 1) AS spread FROM {m} GROUP BY date)", 4, value="spread")})"""


@query(
    "decile_table", f"WITH {FX} SELECT * FROM {table_sql('f3')}", q="spread_mean spread_t monotonicity share_positive"
)
def decile_table(t):
    return ev.decile_table(ev.decile_means(scored(t), "f3", "label", 20, t.day_rows("events")), 4)


def turnover_sql(f):
    return f"""(SELECT avg(x) AS turnover, (SELECT avg(ac) FROM (SELECT {corr_sql("a", "b")} AS ac, count(s) AS n FROM (
        SELECT symbol, {f} AS s, CASE WHEN lag({f}, 5) OVER w IS NOT NULL THEN {f} END AS a, lag({f}, 5) OVER w AS b FROM fx WHERE {f} IS NOT NULL
        WINDOW w AS (PARTITION BY symbol ORDER BY date)) GROUP BY symbol) WHERE n > 10) AS autocorr FROM (
      WITH s AS (SELECT date, row_number() OVER (ORDER BY date) AS ord FROM (SELECT DISTINCT date FROM fx WHERE {f} IS NOT NULL)),
      k AS (SELECT symbol, ord FROM (SELECT symbol, date, row_number() OVER (PARTITION BY date ORDER BY {f} DESC, symbol) AS pos,
        count(*) OVER (PARTITION BY date) AS n FROM fx WHERE {f} IS NOT NULL) JOIN s USING (date) WHERE pos <= greatest(1, floor(n * 0.1)))
      SELECT k.ord, 1 - count(l.symbol) / count(*) AS x FROM k LEFT JOIN k l ON l.symbol = k.symbol AND l.ord = k.ord + 5
      WHERE k.ord <= (SELECT max(ord) FROM s) - 5 GROUP BY k.ord))"""


@query("turnover", f"WITH {FX} SELECT * FROM {turnover_sql('f3')}", q="turnover autocorr")
def turnover(t):
    return ev.turnover(scored(t), "f3", 5, 0.1, t.day_rows("events"))


RES2 = f"""{FX}, m AS (SELECT date, avg(f4) AS y, avg(f2) AS x1, avg(f3) AS x2, covar_samp(f2, f2) AS a, covar_samp(f2, f3) AS b, covar_samp(f3, f3) AS c,
    covar_samp(f2, f4) AS p, covar_samp(f3, f4) AS q FROM fx WHERE f2 IS NOT NULL AND f3 IS NOT NULL AND f4 IS NOT NULL AND label IS NOT NULL GROUP BY date HAVING count(*) > 2),
  rs AS (SELECT symbol, date, label, {snap_sql("(f4 - y - (c * p - b * q) / (a * c - b * b) * (f2 - x1) - (a * q - b * p) / (a * c - b * b) * (f3 - x2))")} AS res
    FROM fx JOIN m USING (date) WHERE f4 IS NOT NULL AND label IS NOT NULL)"""


@query("residual_ic", f"WITH {RES2} SELECT * FROM {ic_sql('rs', 'res', 'label', 20)}", q="ic", d="date")
def residual_ic(t):
    return ev.residual_ic(scored(t), "f4", ["f2", "f3"], "label", 20, t.day_rows("events"))


@query(
    "factor_card",
    f"WITH {FX} "
    + " UNION ALL ".join(
        f"""SELECT '{f}' AS factor, i.ic_mean, i.t_stat, d.spread_mean, d.monotonicity, u.turnover,
        d.spread_mean - 2 * u.turnover * 0.0015 AS net_spread FROM {nw_sql(ic_sql("fx", f, "label", 20), 4)} i, {table_sql(f)} d, {turnover_sql(f)} u"""
        for f in SCORES
    ),
    q="ic_mean t_stat spread_mean monotonicity turnover net_spread",
)
def factor_card(t):
    from functools import reduce

    from quantloom.session import cut

    df, rows = cut(scored(t)), t.day_rows("events")
    cards = []
    for f in SCORES:
        one = ev.summarize_ic(ev.daily_rank_ic(df, f, "label", 20, rows), 4)
        dec = ev.decile_table(ev.decile_means(df, f, "label", 20, rows), 4)
        turn = ev.turnover(df, f, 5, 0.1, rows).select("turnover").scalar()
        card = one.select(
            F.lit(f).alias("factor"), "ic_mean", "t_stat", dec.select("spread_mean").scalar().alias("spread_mean"),
            dec.select("monotonicity").scalar().alias("monotonicity"), turn.alias("turnover"),
        )
        cards.append(card.withColumn("net_spread", C("spread_mean") - 2 * C("turnover") * 0.0015))
    return reduce(lambda a, b: a.unionByName(b), cards)


@query(
    "factor_corr",
    f"WITH {FX} "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {corr_sql(a, b)} AS corr FROM fx"
        for i, a in enumerate(SCORES)
        for b in SCORES[i + 1 :]
    ),
    q="corr",
)
def factor_corr(t):
    return ev.factor_corr(scored(t), SCORES)


def strided(a, b, stride=5, least=40):
    return ic_sql(
        f"""(SELECT * FROM fx WHERE {a} IS NOT NULL AND {b} IS NOT NULL AND date IN (SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) AS o
          FROM (SELECT DISTINCT date FROM fx WHERE {a} IS NOT NULL AND {b} IS NOT NULL)) WHERE (o - 1) % {stride} = 0))""",
        a, b, least,
    )


@query("mean_rank_corr", f"WITH {FX} SELECT avg(ic) AS corr, count(*) AS dates FROM {strided('f1', 'f4')}", q="corr")
def mean_rank_corr(t):
    daily = ev.rank_correlation(scored(t), "f1", "f4", 5, 40, t.day_rows("events"))
    return daily.agg(F.avg("ic").alias("corr"), F.count(F.lit(1)).alias("dates"))


def residual_rank_sql(cand, ref, frm="fx"):
    return f"""(WITH r0 AS (SELECT symbol, date, label, {rk(cand)} AS rc, {rk(ref)} AS rr FROM (SELECT * FROM {frm} WHERE {cand} IS NOT NULL AND {ref} IS NOT NULL AND label IS NOT NULL)),
      r1 AS (SELECT date, avg(rc) AS mc, avg(rr) AS mr, covar_samp(rc, rr) / covar_samp(rr, rr) AS b FROM r0 GROUP BY date HAVING count(*) > 1),
      r2 AS (SELECT symbol, date, label, {snap_sql("(rc - mc - b * (rr - mr))")} AS res FROM r0 JOIN r1 USING (date))
      SELECT * FROM {ic_sql("r2", "res", "label", 20)})"""


@query("residual_rank_ic", f"WITH {FX} SELECT * FROM {residual_rank_sql('f1', 'f4')}", q="ic", d="date")
def residual_rank_ic(t):
    return ev.residual_rank_ic(scored(t), "f1", "f4", "label", 20, t.day_rows("events"))


def pair_corrs(df, columns, rows):
    """Mean daily rank correlation of every pair of candidate columns: a few columns, never rows against rows."""
    from functools import reduce

    made = []
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            daily = ev.rank_correlation(df, a, b, 5, 40, rows)
            made.append(daily.agg(F.lit(a).alias("a"), F.lit(b).alias("b"), F.avg("ic").alias("corr")))
    return reduce(lambda x, y: x.unionByName(y), made)


_PAIRS = [(a, b) for i, a in enumerate(SCORES) for b in SCORES[i + 1 :]]


@query(
    "redundancy_clusters",
    f"WITH RECURSIVE {FX}, pr AS ("
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, avg(ic) AS corr FROM {strided(a, b)}" for a, b in _PAIRS)
    + "), ts AS ("
    + " UNION ALL ".join(f"SELECT '{f}' AS node, t_stat FROM {nw_sql(ic_sql('fx', f, 'label', 20), 4)}" for f in SCORES)
    + """), e AS (SELECT a, b FROM pr WHERE abs(corr) >= 0.3 UNION SELECT b, a FROM pr WHERE abs(corr) >= 0.3),
    reach AS (SELECT node AS x, node AS y FROM ts UNION SELECT reach.x, e.b FROM reach JOIN e ON e.a = reach.y),
    cl AS (SELECT x AS node, min(y) AS cluster FROM reach GROUP BY x),
    g AS (SELECT node, t_stat, first_value(node) OVER (PARTITION BY cluster ORDER BY abs(t_stat) DESC) AS rep, count(*) OVER (PARTITION BY cluster) AS cluster_size FROM cl JOIN ts USING (node))
    SELECT node, rep AS cluster_id, CASE WHEN node = rep THEN 1 ELSE 0 END AS cluster_rep, CASE WHEN node = rep THEN '' ELSE rep END AS redundant_with, cluster_size FROM g""",
)
def redundancy_clusters(t):
    from quantloom.session import cut

    df, rows = cut(scored(t)), t.day_rows("events")
    stats = ev.summarize_ic(ev.daily_rank_ic(unpivoted(df), "score", "label", 20, rows, by=["factor"]), 4, by=["factor"])
    nodes = cut(stats.select(C("factor").alias("node"), "t_stat"))
    found = ev.clusters(cut(pair_corrs(df, SCORES, rows)), nodes, 0.3).join(nodes, "node")
    reps = found.groupBy("cluster").agg(F.max_by("node", F.abs("t_stat")).alias("rep"), F.count(F.lit(1)).alias("cluster_size"))
    is_rep = C("node") == C("rep")
    return found.join(reps, "cluster").select(
        "node", C("rep").alias("cluster_id"), is_rep.cast("int").alias("cluster_rep"),
        F.when(is_rep, "").otherwise(C("rep")).alias("redundant_with"), "cluster_size",
    )


_MEMBERS = ["s1", "s2", "s3"]
POOL = (
    FX
    + f""", sg AS (SELECT symbol, date, label, CASE WHEN f4 IS NOT NULL THEN ({rk("f4")}) / nullif(count(f4) OVER (PARTITION BY date), 0) - 0.5 END AS cand,
    CASE WHEN f1 IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY f1 NULLS LAST) + (count(*) OVER (PARTITION BY date, f1) - 1) / 2.0) / count(f1) OVER (PARTITION BY date) - 0.5 END AS s1,
    -({rk("f2")} / count(f2) OVER (PARTITION BY date) - 0.5) AS s2, {rk("f3")} / count(f3) OVER (PARTITION BY date) - 0.5 AS s3 FROM fx),
  cp AS (SELECT *, {snap_sql("((coalesce(s1, 0) + coalesce(s2, 0) + coalesce(s3, 0)) / ((s1 IS NOT NULL)::INT + (s2 IS NOT NULL)::INT + (s3 IS NOT NULL)::INT))")} AS comp FROM sg)"""
)


def pool(t):
    p = Panel(scored(t), t.day_rows("events"))
    s = {"s1": p.rank(C("f1")) - 0.5, "s2": -(p.rank(C("f2")) - 0.5), "s3": p.rank(C("f3")) - 0.5, "cand": p.rank(C("f4")) - 0.5}
    df = p.df.select("symbol", "date", "label", *[c.alias(n) for n, c in s.items()])
    return df.withColumn("comp", snap(ev.composite(_MEMBERS)))


@query("composite", f"WITH {POOL} SELECT symbol, date, comp FROM cp", q="comp", d="date")
def composite(t):
    return pool(t).select("symbol", "date", "comp")


@query(
    "assess_vs_pool",
    f"WITH {POOL}, fx2 AS (SELECT * FROM cp) SELECT i.t_stat AS residual_t, i.n_days, c.corr AS pool_corr_max FROM "
    + nw_sql(residual_rank_sql("cand", "comp", "fx2"), 4)
    + " i, (SELECT max(abs(corr)) AS corr FROM ("
    + " UNION ALL ".join(f"SELECT avg(ic) AS corr FROM {strided('cand', m).replace('FROM fx', 'FROM cp')}" for m in _MEMBERS)
    + ")) c",
    q="residual_t pool_corr_max",
)
def assess_vs_pool(t):
    from quantloom.session import cut

    df, rows = cut(pool(t)), t.day_rows("events")
    corr = pair_corrs_with(df, "cand", _MEMBERS, rows).agg(F.max(F.abs("corr"))).scalar()
    stats = ev.summarize_ic(ev.residual_rank_ic(df, "cand", "comp", "label", 20, rows), 4)
    return stats.select(C("t_stat").alias("residual_t"), "n_days", corr.alias("pool_corr_max"))


def pair_corrs_with(df, one, others, rows):
    from functools import reduce

    made = [ev.rank_correlation(df, one, m, 5, 40, rows).agg(F.lit(m).alias("b"), F.avg("ic").alias("corr")) for m in others]
    return reduce(lambda x, y: x.unionByName(y), made)


# candidates: one per supplier, with the t statistic of its own daily returns
CAND = (
    LX
    + """, cd AS (SELECT symbol AS cand, count(f1) AS n_days, avg(f1) AS ic_mean, avg(f1) / stddev_samp(f1) * sqrt(count(f1)) AS t_stat,
    CASE WHEN symbol % 2 = 0 THEN 1 ELSE -1 END AS direction, count(f1) / count(*) AS coverage FROM fx GROUP BY symbol)"""
)


def tail_sql(z):
    """Normal tail by Simpson's rule, good to about 1e-11."""
    return f"""(0.5 - list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
      * exp(-pow(i * ({z}) / 2000.0, 2) / 2))) * (({z}) / 2000.0) / 3 / sqrt(2 * pi()))"""


def candidates(t):
    g = scored(t, "long").groupBy(C("symbol").alias("cand")).agg(
        F.count("f1").alias("n_days"), F.avg("f1").alias("ic_mean"),
        (F.avg("f1") / F.stddev_samp("f1") * F.sqrt(F.count("f1"))).alias("t_stat"),
        (F.count("f1") / F.count(F.lit(1))).alias("coverage"),
    )
    return g.withColumn("direction", F.when(C("cand") % 2 == 0, 1).otherwise(-1))


@query("onesided_p", f"WITH {CAND} SELECT cand, t_stat, {tail_sql('t_stat * direction')} AS p FROM cd", q="t_stat p")
def onesided_p(t):
    return candidates(t).select("cand", "t_stat", normal.onesided_p(C("t_stat"), C("direction")).alias("p"))


@query(
    "sidak_bar",
    f"""WITH n AS (SELECT r_name AS sector, count(*) AS n_tests FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name),
    z AS (SELECT *, (1 - pow(0.95, 1.0 / n_tests)) / 2 AS tail FROM n),
    b AS (SELECT sector, n_tests, list_reduce(list_concat([{{'lo': 0.0::DOUBLE, 'hi': 8.0::DOUBLE, 't': tail}}], list_transform(range(0, 45), lambda i: {{'lo': 0.0::DOUBLE, 'hi': 0.0::DOUBLE, 't': tail}})),
      lambda a, x: {{'lo': CASE WHEN {tail_sql("(a.lo + a.hi) / 2")} > a.t THEN (a.lo + a.hi) / 2 ELSE a.lo END,
        'hi': CASE WHEN {tail_sql("(a.lo + a.hi) / 2")} > a.t THEN a.hi ELSE (a.lo + a.hi) / 2 END, 't': a.t}}) AS r FROM z)
    SELECT sector, n_tests, (r.lo + r.hi) / 2 AS bar FROM b""",
    q="bar",
)
def sidak_bar(t):
    n = t.sectors().groupBy("sector").agg(F.count(F.lit(1)).alias("n_tests"))
    return n.withColumn("bar", normal.sidak_bar("n_tests"))


PV = CAND + f""", pv AS (SELECT cand, {snap_sql(tail_sql("t_stat * direction"))} AS p FROM cd),
  o AS (SELECT *, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS m FROM pv), th AS (SELECT coalesce(max(p), 0) AS threshold FROM o WHERE p <= 0.5 * r / m)"""


def pvalues(t):
    from quantloom.session import cut

    return cut(candidates(t).select("cand", snap(normal.onesided_p(C("t_stat"), C("direction"))).alias("p")))


@query(
    "bh_reject",
    f"WITH {PV} SELECT cand, p, CASE WHEN p <= threshold AND threshold > 0 THEN 1 ELSE 0 END AS rejected FROM pv, th",
    q="p",
)
def bh_reject(t):
    return ev.bh_flags(pvalues(t), "p", 0.5).select("cand", "p", "rejected")


@query("bh_threshold", f"WITH {PV} SELECT threshold FROM th", q="threshold")
def bh_threshold(t):
    return ev.bh_flags(pvalues(t), "p", 0.5).agg(F.max("threshold").alias("threshold"))


@query(
    "family_size",
    """SELECT source, count(*) AS family FROM documents WHERE NOT starts_with(lower(text), 'the') GROUP BY source""",
)
def family_size(t):
    ledger = t.documents.select("source", F.lower("text").alias("verdict"))
    return ledger.where(~C("verdict").startswith("the")).groupBy("source").agg(F.count(F.lit(1)).alias("family"))


@query(
    "family_pvalues",
    f"""WITH {PV} SELECT cand, unnest(CASE WHEN cand % 3 = 0 THEN [p] ELSE [p, p / 2] END) AS p FROM pv""",
    q="p",
)
def family_pvalues(t):
    rows = pvalues(t)
    # older rows carry one p-value, newer ones two; a missing one adds nothing
    second = F.when(C("cand") % 3 != 0, C("p") / 2)
    return rows.select("cand", F.explode(F.array_compact(F.array(C("p"), second))).alias("p"))


@query(
    "screen_candidates",
    f"WITH {FX}, c AS (SELECT factor, avg(CASE WHEN score IS NOT NULL THEN 1.0 ELSE 0 END) AS coverage FROM {unpivot_sql()} GROUP BY factor) "
    f"SELECT factor, coverage, ic_mean, t_stat, CASE WHEN t_stat >= 2 AND coverage >= 0.9 THEN 1 ELSE 0 END AS passes FROM {nw_sql(factor_ic_sql(), 4, by='factor')} JOIN c USING (factor)",
    q="coverage ic_mean t_stat",
)
def screen_candidates(t):
    rows = unpivoted(scored(t))
    cover = rows.groupBy("factor").agg(F.avg(C("score").isNotNull().cast("double")).alias("coverage"))
    stats = ev.summarize_ic(factor_ic(t), 4, by=["factor"]).join(cover, "factor")
    passes = (C("t_stat") >= 2) & (C("coverage") >= 0.9)
    return stats.select("factor", "coverage", "ic_mean", "t_stat", passes.cast("int").alias("passes"))


@query(
    "pool_admissible",
    f"""WITH {CAND}, x AS (SELECT *, t_stat * direction AS st, abs(ic_mean * 100) AS pc FROM cd)
    SELECT cand, CASE WHEN cand % 17 = 0 THEN 'error' WHEN cand % 13 = 0 THEN 'quarantined' WHEN cand % 11 = 0 THEN 'duplicate'
      WHEN st < 0 THEN 'signed dev t below bar' WHEN coverage < 0.998 THEN 'coverage below bar' WHEN pc >= 0.7 THEN 'corr with pool member'
      ELSE 'admitted' END AS reason FROM x""",
)
def pool_admissible(t):
    from quantloom.operators.gates import admissible

    rows = candidates(t).select(
        "cand", (C("cand") % 17 == 0).alias("error"), (C("cand") % 13 == 0).alias("quarantined"),
        (C("cand") % 11 == 0).alias("duplicate"), (C("t_stat") * C("direction")).alias("signed_t"), "coverage",
        F.lit(False).alias("incumbent_hit"), F.lit(None).cast("double").alias("incumbent_corr"),
        F.abs(C("ic_mean") * 100).alias("pool_corr"), F.lit(None).cast("double").alias("residual_t"),
    )
    return rows.select("cand", admissible(0.0, 0.998, 0.7, 1.0).alias("reason"))


TIER = "CASE WHEN date < DATE '1997-01-01' THEN 'seen_dev' WHEN date < DATE '1998-06-01' THEN 'virgin_early' WHEN date < DATE '2000-06-01' THEN 'holdout' ELSE 'fresh' END"


def tier():
    d = C("date")
    return (
        F.when(d < "1997-01-01", "seen_dev").when(d < "1998-06-01", "virgin_early").when(d < "2000-06-01", "holdout").otherwise("fresh")
    )


TIERED = f"""{LX}, ti AS (SELECT symbol AS cand, {TIER} AS tier, count(f1) AS n_days, avg(f1) AS ic_mean, avg(f1) / stddev_samp(f1) * sqrt(count(f1)) AS t_stat
  FROM fx WHERE f1 IS NOT NULL GROUP BY ALL)"""


def tiered(t):
    rows = scored(t, "long").where(C("f1").isNotNull())
    return rows.groupBy(C("symbol").alias("cand"), tier().alias("tier")).agg(
        F.count("f1").alias("n_days"), F.avg("f1").alias("ic_mean"),
        (F.avg("f1") / F.stddev_samp("f1") * F.sqrt(F.count("f1"))).alias("t_stat"),
    )


@query(
    "gate_literature",
    f"""WITH {TIERED} SELECT cand, coalesce(max(t_stat) FILTER (WHERE tier = 'holdout'), 0) AS holdout_t,
      CASE WHEN coalesce(max(t_stat) FILTER (WHERE tier = 'holdout'), 0) >= 0.5
        AND count(*) FILTER (WHERE t_stat <= -0.5 AND (tier <> 'fresh' OR n_days >= 60)) = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM ti GROUP BY cand""",
    q="holdout_t",
)
def gate_literature(t):
    from quantloom.operators.gates import gate_literature as gate

    return gate(tiered(t), "cand", bar=0.5, negative=-0.5, fresh_min=60)


_P = tail_sql
GATE = f"""{TIERED}, w AS (SELECT cand, CASE WHEN cand % 2 = 0 THEN 1 ELSE -1 END AS sg, min(CASE WHEN cand % 3 = 0 THEN -1.0 ELSE 1.0 END) AS gain,
    coalesce(max(n_days) FILTER (WHERE tier = 'holdout'), 0) AS ho_n, max(t_stat) FILTER (WHERE tier = 'holdout') AS ho_t,
    max(ic_mean) FILTER (WHERE tier = 'holdout') AS ho_ic, max(ic_mean) FILTER (WHERE tier = 'fresh' AND n_days >= 60) AS fr_ic,
    max(ic_mean) FILTER (WHERE tier = 'virgin_early') AS ve_ic FROM ti GROUP BY cand),
  ng AS (SELECT ti.cand, count(*) FILTER (WHERE t_stat * sg <= -2 AND (tier <> 'fresh' OR n_days >= 60)) AS neg FROM ti JOIN w USING (cand) GROUP BY ti.cand),
  po AS (SELECT symbol AS cand, avg(f1) / stddev_samp(f1) * sqrt(count(f1)) AS t FROM fx WHERE {TIER} <> 'seen_dev' AND f1 IS NOT NULL GROUP BY symbol),
  re AS (SELECT symbol AS cand, avg(f1) AS ic, avg(f1) / stddev_samp(f1) * sqrt(count(f1)) AS t FROM fx WHERE {TIER} IN ('holdout', 'fresh') AND f1 IS NOT NULL GROUP BY symbol),
  k AS (SELECT w.*, ng.neg, po.t AS pt, re.t AS rt, re.ic AS ric, {snap_sql(_P("po.t * w.sg"))} AS pp, {snap_sql(_P("re.t * w.sg"))} AS rp FROM w JOIN ng USING (cand) LEFT JOIN po USING (cand) LEFT JOIN re USING (cand)),
  fam AS (SELECT p, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS m FROM (SELECT pp AS p FROM k UNION ALL SELECT rp FROM k) WHERE p IS NOT NULL),
  th AS (SELECT coalesce(max(p), -1) AS th FROM fam WHERE p <= 0.5 * r / m),
  z AS (SELECT *, (ho_ic IS NOT NULL)::INT + (fr_ic IS NOT NULL)::INT + (ve_ic IS NOT NULL)::INT AS avail,
    coalesce((sg * ho_ic > 0)::INT, 0) + coalesce((sg * fr_ic > 0)::INT, 0) + coalesce((sg * ve_ic > 0)::INT, 0) AS pos FROM k, th)"""


@query(
    "gate_mined",
    f"""WITH {GATE} SELECT cand, pp AS pooled_p, rp AS recent_p, CASE WHEN ho_n < 20 OR gain <= 0 OR neg > 0 THEN ''
      WHEN pp <= th AND sg * pt >= 0.5 AND pos >= least(2, avail) AND sg * ric >= 0 THEN 'structural'
      WHEN rp <= th AND NOT coalesce(sg * ho_ic <= 0, FALSE) AND NOT coalesce(sg * fr_ic <= 0, FALSE) THEN 'probation' ELSE '' END AS adoption FROM z""",
    q="pooled_p recent_p",
)
def gate_mined(t):
    from quantloom.operators.gates import gate_mined as gate

    rows = scored(t, "long").where(C("f1").isNotNull()).withColumn("tier", tier())
    return gate(
        rows.select(C("symbol").alias("cand"), "date", "tier", C("f1").alias("ic")),
        direction=F.when(C("cand") % 2 == 0, 1).otherwise(-1),
        gain=F.when(C("cand") % 3 == 0, -1.0).otherwise(1.0),
        q=0.5, holdout_min=20, fresh_min=60, negative=-2.0, structural_min=0.5,
    )


@query(
    "review_family",
    f"""WITH {LX}, rv AS (SELECT max(date) - INTERVAL 90 DAY AS review FROM fx),
    ti AS (SELECT symbol AS cand, avg(f1) / stddev_samp(f1) * sqrt(count(f1)) AS t FROM fx, rv WHERE date >= review - INTERVAL 12 MONTH AND date < review AND f1 IS NOT NULL GROUP BY symbol),
    pv AS (SELECT cand, {snap_sql(tail_sql("t * CASE WHEN cand % 2 = 0 THEN 1 ELSE -1 END"))} AS p FROM ti),
    o AS (SELECT *, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS m FROM pv), th AS (SELECT coalesce(max(p), -1) AS th FROM o WHERE p <= 0.5 * r / m)
    SELECT cand, p, CASE WHEN p <= th THEN 1 ELSE 0 END AS rejected FROM pv, th""",
    q="p",
)
def review_family(t):
    from quantloom.operators.cleaning import tier_of
    from quantloom.session import cut

    rows = scored(t, "long").where(C("f1").isNotNull())
    review = F.date_sub(t.lineitem.agg(F.to_date(F.max("l_shipdate"))).scalar(), 90)
    held = rows.withColumn("tier", tier_of(C("date"), review)).where(C("tier") == "holdout")
    stats = ev.summarize_ic(held.select(C("symbol").alias("cand"), "date", C("f1").alias("ic")), 0, by=["cand"])
    p = snap(normal.onesided_p(C("t_stat"), F.when(C("cand") % 2 == 0, 1).otherwise(-1)))
    return ev.bh_flags(cut(stats.where(C("t_stat").isNotNull()).select("cand", p.alias("p"))), "p", 0.5).select("cand", "p", "rejected")
