"""Queries of sources, sinks, cleaning and text operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quantloom.functions.elementwise import finite
from quantloom.operators import cleaning as cl
from quantloom.operators import text as tx
from quantloom.plans.registry import query
from quantloom.session import shared_dir
from quantloom.sources import files, incremental

C = F.col


def scratch(t, name: str) -> str:
    """A fresh folder for files a query writes and reads back."""
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def _bars_file(t):
    path = scratch(t, "bars")
    t.long_bars().write.parquet(path)
    return path


@query("load_panel", "SELECT date, symbol, open, high, low, close, volume FROM {long}", d="date")
def load_panel(t):
    return files.load_panel(t.spark, _bars_file(t))


@query(
    "scan_columns",
    """SELECT b.symbol, b.date, b.close FROM {long} b WHERE b.symbol IN (SELECT s_suppkey FROM supplier
       JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')""",
    d="date",
)
def scan_columns(t):
    rows = files.load_panel(t.spark, _bars_file(t), ["symbol", "date", "close"])
    return rows.join(t.sectors().where(C("sector") == "ASIA"), "symbol", "left_semi")


@query("save_panel", "SELECT symbol, date, close FROM {long}", d="date")
def save_panel(t):
    path = scratch(t, "panel")
    files.save_panel(t.long_bars(), path)
    return t.spark.read.parquet(path).select("symbol", "date", "close")


@query(
    "scan_delimited",
    """SELECT CAST(o_orderdate AS DATE) AS date, o_custkey AS symbol, sum(o_totalprice) AS volume,
       CAST(count(*) AS DOUBLE) AS trades FROM orders GROUP BY ALL""",
    q="volume trades",
    d="date",
)
def scan_delimited(t):
    path = scratch(t, "pipe")
    raw = t.orders.select(
        F.date_format("o_orderdate", "yyyyMMdd").alias("date"), C("o_custkey").alias("symbol"),
        C("o_totalprice").alias("volume"), F.lit(1.0).alias("trades"),
    )
    raw.write.csv(path, sep="|", header=True)
    schema = "date string, symbol long, volume double, trades double"
    return files.scan_delimited(t.spark, path, schema, "date", "yyyyMMdd", ["date", "symbol"], ["volume", "trades"])


@query(
    "scan_tsv",
    "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier",
)
def scan_tsv(t):
    path = scratch(t, "tsv")
    t.supplier.select("s_suppkey", "s_name", "s_nationkey").write.csv(path, sep="\t", header=True, quote="")
    return files.scan_tsv(t.spark, path, ["s_suppkey", "s_name", "s_nationkey"])


@query(
    "scan_json_facts",
    """SELECT o_orderkey AS filing, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS filed,
       CAST(last_day(CAST(o_orderdate AS DATE)) AS VARCHAR) AS "end",
       CASE WHEN o_orderstatus = 'P' THEN o_totalprice * 2 ELSE o_totalprice END AS val,
       CASE WHEN o_orderstatus = 'P' THEN 'SharesIssued' ELSE 'SharesOutstanding' END AS tag FROM orders""",
    q="val",
)
def scan_json_facts(t):
    def fact(value):
        row = F.struct(
            F.date_format(F.last_day("o_orderdate"), "yyyy-MM-dd").alias("end"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("filed"),
            value.alias("val"),
        )
        return F.struct(F.create_map(F.lit("shares"), F.array(row)).alias("units"))

    fallback = F.create_map(F.lit("SharesIssued"), fact(C("o_totalprice") * 2))
    both = F.map_concat(fallback, F.create_map(F.lit("SharesOutstanding"), fact(C("o_totalprice"))))
    tags = F.when(C("o_orderstatus") == "P", fallback).otherwise(both)
    docs = t.orders.select(C("o_orderkey").alias("filing"), F.to_json(F.create_map(F.lit("dei"), tags)).alias("doc"))
    return files.json_facts(docs, "filing", "doc", "dei", ["SharesOutstanding", "SharesIssued"], "shares")


@query(
    "scan_json_events",
    """SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'UNKNOWN' ELSE CAST(user_id AS VARCHAR) END AS symbol,
       CASE WHEN event_type = 'click' THEN 'long' ELSE event_type END AS side,
       CASE WHEN event_type = 'view' THEN 0.0 ELSE value END AS value,
       coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) AS pnl FROM events""",
)
def scan_json_events(t):
    path = scratch(t, "json")
    t.events.select(
        C("event_id").alias("id"),
        F.when(C("event_type") != "error", C("user_id").cast("string")).alias("symbol"),
        F.when(C("event_type") != "click", C("event_type")).alias("side"),
        F.when(C("event_type") == "view", "n/a").otherwise(C("value").cast("string")).alias("value"),
        F.get_json_object("props", "$.k").alias("pnl"),
    ).write.json(path)
    return files.event_rows(t.spark, path)


@query(
    "append_only_merge",
    """WITH b AS (SELECT * FROM {long}), old AS (SELECT symbol, date, close FROM b WHERE date < DATE '1998-06-01' AND symbol % 7 <> 3),
       marks AS (SELECT symbol, max(date) AS mark FROM old GROUP BY symbol)
       SELECT * FROM old UNION ALL
       SELECT b.symbol, b.date, b.close * 2 FROM b LEFT JOIN marks USING (symbol)
       WHERE (mark IS NULL OR b.date > mark) AND b.date >= DATE '1998-01-01' AND b.date <= DATE '2000-12-31'""",
    q="close",
    d="date",
)
def append_only_merge(t):
    b = t.long_bars().select("symbol", "date", "close")
    old = b.where((C("date") < "1998-06-01") & (C("symbol") % 7 != 3))
    new = b.where(C("date") >= "1998-01-01").withColumn("close", C("close") * 2)
    return incremental.append_only_merge(old, new, F.lit("2000-12-31").cast("date"), C("close"))


@query(
    "incremental_union",
    """SELECT symbol, date, CASE WHEN date >= DATE '1998-01-01' THEN close + 1 ELSE close END AS close,
       CASE WHEN date >= DATE '1998-01-01' THEN 2 ELSE 1 END AS load FROM {long}""",
    q="close",
    d="date",
)
def incremental_union(t):
    b = t.long_bars().select("symbol", "date", "close")
    old = b.withColumn("load", F.lit(1))
    new = b.where(C("date") >= "1998-01-01").withColumn("close", C("close") + 1).withColumn("load", F.lit(2))
    return incremental.incremental_union(old, new, ["symbol", "date"], "load")


@query(
    "history_upsert",
    """SELECT date, CASE WHEN date >= DATE '2000-01-01' THEN sum(close) ELSE sum(volume) END AS total FROM {long} GROUP BY date""",
    q="total",
    d="date",
)
def history_upsert(t):
    b = t.long_bars()
    history = b.groupBy("date").agg(F.sum("volume").alias("total"))
    update = b.where(C("date") >= "2000-01-01").groupBy("date").agg(F.sum("close").alias("total"))
    return incremental.history_upsert(history, update)


@query(
    "feature_manifest",
    """WITH b AS (SELECT * FROM {long}), f AS (SELECT
         close - lag(close, 1) OVER w AS delta_1, close - lag(close, 5) OVER w AS delta_5,
         close - lag(close, 20) OVER w AS delta_20 FROM b WINDOW w AS (PARTITION BY symbol ORDER BY date))
       SELECT 'delta_1' AS feature, 1 AS lookback, count(delta_1) AS filled, 'forward_fill' AS missing FROM f
       UNION ALL SELECT 'delta_20', 20, count(delta_20), 'forward_fill' FROM f
       UNION ALL SELECT 'delta_5', 5, count(delta_5), 'forward_fill' FROM f""",
)
def feature_manifest(t):
    p = t.panel("long")
    made = p.df.select(*[(p.close - F.lag("close", k).over(cl.by_symbol())).alias(f"delta_{k}") for k in (1, 5, 20)])
    counts = made.agg(*[F.count(c).alias(c) for c in made.columns])
    return counts.unpivot([], made.columns, "feature", "filled").select(
        "feature", F.substring_index("feature", "_", -1).cast("int").alias("lookback"), "filled",
        F.lit("forward_fill").alias("missing"),
    )


# -- cleaning --------------------------------------------------------------------------------------

DIRTY = """(SELECT symbol, date, open, CASE WHEN volume = 10 THEN low - 1 ELSE high END AS high, low,
  CASE WHEN volume = 7 THEN NULL WHEN volume = 11 THEN high * 3 ELSE close END AS close,
  CASE WHEN volume = 20 THEN NULL ELSE volume END AS volume FROM {long})"""


def dirty(t):
    v = C("volume")
    return t.long_bars().select(
        "symbol", "date", "open",
        F.when(v == 10, C("low") - 1).otherwise(C("high")).alias("high"), "low",
        F.when(v == 7, None).when(v == 11, C("high") * 3).otherwise(C("close")).alias("close"),
        F.when(v == 20, None).otherwise(v).alias("volume"),
    )


@query(
    "clean_ohlcv",
    f"""WITH d AS (SELECT symbol, date, open, high, low, close, coalesce(volume, 0) AS volume FROM {DIRTY}
         WHERE open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL),
       k AS (SELECT * FROM d WHERE high >= low AND open BETWEEN low AND high AND close BETWEEN low AND high)
       SELECT *, CASE WHEN abs(close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1) > 0.5 THEN 1 ELSE 0 END AS jump
       FROM k""",
    d="date",
)
def clean_ohlcv(t):
    return cl.clean_ohlcv(dirty(t))


@query(
    "total_return_index",
    """WITH b AS (SELECT symbol, date, close, CASE WHEN volume % 10 = 0 THEN close / 100 ELSE 0 END AS dividends,
         CASE WHEN volume = 33 THEN 2.0 ELSE 0.0 END AS splits FROM {long}),
       g AS (SELECT *, (close * CASE WHEN splits = 0 THEN 1 ELSE splits END + dividends)
         / lag(close) OVER (PARTITION BY symbol ORDER BY date) AS g FROM b)
       SELECT symbol, date, first_value(close) OVER w * product(coalesce(g, 1)) OVER w AS adj_close FROM g
       WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)""",
    q="adj_close",
    d="date",
)
def total_return_index(t):
    v = C("volume")
    acts = t.long_bars().select(
        "symbol", "date", "close",
        F.when(v % 10 == 0, C("close") / 100).otherwise(0.0).alias("dividends"),
        F.when(v == 33, 2.0).otherwise(0.0).alias("splits"),
    )
    return cl.total_return_index(acts).select("symbol", "date", "adj_close")


@query(
    "adjust_ohlc_by_factor",
    """SELECT symbol, date, open * f AS open, high * f AS high, low * f AS low, close * f AS close FROM (
       SELECT *, CASE WHEN volume % 9 = 0 THEN 1 ELSE (close - volume / 1000) / close END AS f FROM {long})""",
    q="open high low close",
    d="date",
)
def adjust_ohlc_by_factor(t):
    b = t.long_bars().withColumn("adj", F.when(C("volume") % 9 != 0, C("close") - C("volume") / 1000))
    return cl.adjust_ohlc(b, "adj").select("symbol", "date", "open", "high", "low", "close")


@query(
    "extend_panel",
    """SELECT symbol, date, close FROM {long} WHERE symbol % 3 <> 0 OR symbol % 2 = 0""",
    d="date",
)
def extend_panel(t):
    b = t.long_bars().select("symbol", "date", "close")
    return cl.extend_panel(b.where(C("symbol") % 3 != 0), b.where(C("symbol") % 2 == 0))


@query(
    "build_adjusted_panel",
    """SELECT symbol, date, close FROM {long_sector} WHERE sector = 'EUROPE'""",
    d="date",
)
def build_adjusted_panel(t):
    members = t.sectors().where(C("sector") == "EUROPE")
    b = t.long_bars().select("symbol", "date", "close")
    doubled = b.unionByName(b)
    return doubled.join(members, "symbol", "left_semi").dropDuplicates(["date", "symbol"])


LABELLED = """(SELECT symbol, date, close, ln(lead(close, 5) OVER (PARTITION BY symbol ORDER BY date) / close) AS future_return FROM {long})"""


@query(
    "generate_labels",
    f"SELECT symbol, date, future_return, CASE WHEN future_return > 0.001 THEN 1 ELSE 0 END AS label "
    f"FROM {LABELLED} WHERE future_return IS NOT NULL",
    q="future_return",
    d="date",
)
def generate_labels(t):
    return cl.generate_labels(t.long_bars(), 5, 0.001).select("symbol", "date", "future_return", "label")


FEATURED = """(SELECT symbol, date, CASE WHEN volume % 5 = 0 THEN NULL ELSE close END AS f1,
  CASE WHEN volume % 50 = 1 THEN open END AS f2, CASE WHEN volume % 4 = 0 THEN NULL ELSE high - low END AS f3,
  ln(lead(close, 1) OVER (PARTITION BY symbol ORDER BY date) / close) AS label FROM {long})"""


def featured(t):
    v = C("volume")
    return t.long_bars().select(
        "symbol", "date",
        F.when(v % 5 != 0, C("close")).alias("f1"),
        F.when(v % 50 == 1, C("open")).alias("f2"),
        F.when(v % 4 != 0, C("high") - C("low")).alias("f3"),
        F.ln(F.lead("close", 1).over(cl.by_symbol()) / C("close")).alias("label"),
    )


@query(
    "clean_dataset",
    f"""WITH f AS (SELECT symbol, date, f1, f3, label FROM {FEATURED} WHERE label IS NOT NULL AND (f1 IS NOT NULL OR f3 IS NOT NULL)),
       g AS (SELECT symbol, date, label, last_value(f1 IGNORE NULLS) OVER w AS f1, last_value(f3 IGNORE NULLS) OVER w AS f3,
         row_number() OVER (PARTITION BY symbol ORDER BY date) AS n FROM f
         WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING))
       SELECT symbol, date, coalesce(f1, 0) AS f1, coalesce(f3, 0) AS f3, label FROM g WHERE n > 60""",
    q="label",
    d="date",
)
def clean_dataset(t):
    return cl.clean_dataset(featured(t), ["f1", "f2", "f3"], "label", 60)


@query(
    "split_train_test",
    """WITH b AS (SELECT * FROM {long}), s AS (SELECT date, row_number() OVER (ORDER BY date) AS ord FROM (SELECT DISTINCT date FROM b)),
       c AS (SELECT date AS cut FROM s WHERE ord = (SELECT CAST(floor(count(*) * 0.8) AS BIGINT) + 1 FROM s))
       SELECT symbol, date, CASE WHEN date < cut THEN 'train' ELSE 'test' END AS part FROM b, c""",
    d="date",
)
def split_train_test(t):
    return cl.split_train_test(t.long_bars().select("symbol", "date"))


@query(
    "restore_prediction_day",
    f"""SELECT symbol, date, f1, f3, label AS future_return FROM {FEATURED} WHERE label IS NOT NULL
        AND date < (SELECT max(date) FROM {{long}})
        UNION ALL SELECT symbol, date, coalesce(f1, 0), coalesce(f3, 0), NULL FROM {FEATURED}
        WHERE date = (SELECT max(date) FROM {{long}})""",
    q="future_return",
    d="date",
)
def restore_prediction_day(t):
    f = featured(t).drop("f2")
    labelled = f.where(C("label").isNotNull()).withColumnRenamed("label", "future_return")
    return cl.restore_prediction_day(labelled, f.drop("label"), ["f1", "f3"])


@query(
    "liquidity_filter",
    """WITH b AS (SELECT * FROM {long}),
       r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS r FROM b),
       f AS (SELECT symbol, count(*) AS history, arg_max(close, date) AS last_close,
         avg(close * volume) FILTER (WHERE r <= 20) AS adv_20d FROM r GROUP BY symbol)
       SELECT *, CASE WHEN history < 400 THEN 'insufficient_history' WHEN last_close < 1200 THEN 'below_min_price'
         WHEN adv_20d < 40000 THEN 'below_min_dollar_volume' ELSE 'ok' END AS reason FROM f""",
    q="adv_20d",
)
def liquidity_filter(t):
    return cl.liquidity_reasons(t.long_bars(), 400, 1200.0, 40000.0)


@query(
    "segment",
    """SELECT CASE WHEN date >= DATE '1995-01-01' AND date < DATE '1998-01-01' THEN 'dev'
         WHEN date >= DATE '1998-01-01' AND date < DATE '2000-01-01' THEN 'holdout'
         WHEN date >= DATE '2000-01-01' AND date < DATE '2001-01-01' THEN 'fresh'
         WHEN date >= DATE '2001-01-01' AND date < DATE '2100-01-01' THEN 'live' END AS tier,
       count(*) AS n, min(date) AS first, max(date) AS last FROM {long} GROUP BY 1""",
    d="first last",
)
def segment(t):
    bounds = [
        ("dev", "1995-01-01", "1998-01-01"), ("holdout", "1998-01-01", "2000-01-01"),
        ("fresh", "2000-01-01", "2001-01-01"), ("live", "2001-01-01", "2100-01-01"),
    ]
    tiers = t.long_bars().withColumn("tier", cl.segment(C("date"), bounds))
    return tiers.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


@query(
    "segments_for",
    """WITH r AS (SELECT CAST(max(l_shipdate) AS DATE) - INTERVAL 90 DAY AS review FROM lineitem),
       x AS (SELECT b.*, r.review FROM {long} b, r)
       SELECT CASE WHEN date < review - INTERVAL 12 MONTH THEN 'dev' WHEN date < review THEN 'holdout' ELSE 'fresh' END AS tier,
       count(*) AS n, min(date) AS first, max(date) AS last FROM x GROUP BY 1""",
    d="first last",
)
def segments_for(t):
    review = t.lineitem.agg(F.date_sub(F.to_date(F.max("l_shipdate")), 90)).scalar()
    tiers = t.long_bars().withColumn("tier", cl.tier_of(C("date"), review))
    return tiers.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


@query(
    "clamp_levels",
    """WITH b AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS prev FROM {long}),
       a AS (SELECT *, CASE WHEN count(*) OVER w >= 14 THEN avg(greatest(high - low, abs(high - prev), abs(low - prev))) OVER w END AS atr FROM b
         WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 13 PRECEDING)),
       s AS (SELECT *, CASE WHEN close >= open THEN 'long' ELSE 'short' END AS side,
         CASE WHEN atr IS NULL THEN 0.05 ELSE greatest(0.015, least(atr * 3.0 / close, 0.12)) END AS sp,
         CASE WHEN atr IS NULL THEN 0.10 ELSE greatest(0.025, least(atr * 6.0 / close, 0.25)) END AS tp FROM a)
       SELECT symbol, date, side, CASE WHEN side = 'long' THEN close * (1 - sp) ELSE close * (1 + sp) END AS stop_price,
         CASE WHEN side = 'long' THEN close * (1 + tp) ELSE close * (1 - tp) END AS take_price,
         CASE WHEN atr IS NULL THEN 'fixed_pct_fallback' ELSE 'atr' END AS basis FROM s""",
    q="stop_price take_price",
    d="date",
)
def clamp_levels(t):
    from quantloom.operators.indicators import atr

    p = t.panel("long")
    a = p.stage(atr(p, 14))
    side = F.when(p.close >= p.open, "long").otherwise("short")
    made = cl.risk_levels(p.df.withColumn("side", side), C("close"), C("side"), a)
    return made.select("symbol", "date", "side", "stop_price", "take_price", "basis")


@query(
    "inf_to_null",
    "SELECT symbol, date, CASE WHEN close <> open THEN volume / (close - open) END AS value FROM {long}",
    q="value",
    d="date",
)
def inf_to_null(t):
    """A source that writes ±inf for a division by zero and NaN for zero over zero."""
    body = C("close") - C("open")
    raw = F.when(body != 0, C("volume") / F.nullif(body, F.lit(0.0))).when(C("volume") > 10, float("inf")).otherwise(float("nan"))
    return t.long_bars().select("symbol", "date", finite(raw).alias("value"))


# -- text --------------------------------------------------------------------------------------------


def _hits_sql(words):
    return "(" + " + ".join(f"CAST(contains(x, '{w}') AS INTEGER)" for w in words) + ")"


@query(
    "keyword_sentiment",
    f"""WITH h AS (SELECT doc_id, {_hits_sql(tx.POSITIVE)} AS p, {_hits_sql(tx.NEGATIVE)} AS n
         FROM (SELECT doc_id, lower(text) AS x FROM documents))
       SELECT doc_id, (p - n) / greatest(p + n, 1) AS sentiment_score, p / greatest(p + n, 1) AS positive_prob,
         n / greatest(p + n, 1) AS negative_prob, 1 - (p + n) / greatest(p + n, 1) AS neutral_prob FROM h""",
    q="sentiment_score positive_prob negative_prob neutral_prob",
)
def keyword_sentiment(t):
    return t.documents.select("doc_id", *[c.alias(n) for n, c in tx.keyword_sentiment(C("text")).items()])


@query(
    "keyword_sentiment_sign",
    f"""WITH h AS (SELECT doc_id, {_hits_sql(tx.POSITIVE_SHORT)} AS p, {_hits_sql(tx.NEGATIVE_SHORT)} AS n
         FROM (SELECT doc_id, lower(text) AS x FROM documents))
       SELECT doc_id, CAST(CASE WHEN p > n THEN 0.5 WHEN n > p THEN -0.5 ELSE 0 END AS DOUBLE) AS score FROM h""",
)
def keyword_sentiment_sign(t):
    return t.documents.select("doc_id", tx.keyword_sentiment_sign(C("text")).alias("score"))


def company_names(t):
    """Company-like names, one per part: share classes, possessives, hyphens, ampersands and suffixes."""
    k, n = C("p_partkey") % 6, C("p_name")
    made = (
        F.when(k == 0, F.concat(F.lit("The "), n, F.lit(" Company Class A")))
        .when(k == 1, F.concat(F.replace(n, F.lit(" "), F.lit("'s ")), F.lit(" Inc.")))
        .when(k == 2, F.concat(F.replace(n, F.lit(" "), F.lit("-")), F.lit(" Corp")))
        .when(k == 3, F.concat(F.replace(n, F.lit(" "), F.lit(" & ")), F.lit(" Co")))
        .when(k == 4, F.concat(F.replace(n, F.lit(" "), F.lit(" and ")), F.lit(" Holdings Ltd")))
        .otherwise(F.concat(n, F.lit(" Group")))
    )
    return t.part.select(C("p_partkey").alias("symbol"), made.alias("name"))


_NAMES_SQL = """(SELECT p_partkey AS symbol, CASE p_partkey % 6
  WHEN 0 THEN 'The ' || p_name || ' Company Class A' WHEN 1 THEN replace(p_name, ' ', '''s ') || ' Inc.'
  WHEN 2 THEN replace(p_name, ' ', '-') || ' Corp' WHEN 3 THEN replace(p_name, ' ', ' & ') || ' Co'
  WHEN 4 THEN replace(p_name, ' ', ' and ') || ' Holdings Ltd' ELSE p_name || ' Group' END AS name FROM part)"""
_TOKENS = "|".join(tx.SUFFIXES)
_WORDS = ", ".join(f"'{w}'" for w in [*tx.SUFFIXES, "the"])
_STOPS = ", ".join(f"'{w}'" for w in tx.BARE_STOP)
_CLASS = tx.SHARE_CLASS


@query(
    "normalize_names",
    rf"""WITH b AS (SELECT symbol, regexp_replace(regexp_replace(lower(trim(name)), '{_CLASS}', ''), '^the\s+', '') AS b FROM {_NAMES_SQL}),
       f AS (SELECT symbol, unnest(CASE WHEN contains(b, '''') THEN
         [replace(replace(b, '''s', 's'), '''', ''), replace(regexp_replace(b, '''s\b', '', 'g'), '''', '')] ELSE [b] END) AS f FROM b),
       g AS (SELECT symbol, regexp_replace(f, '[.'']', '', 'g') AS f FROM f),
       h AS (SELECT symbol, unnest([f, CASE WHEN contains(f, '-') THEN replace(f, '-', ' ') END, CASE WHEN contains(f, '-') THEN replace(f, '-', '') END,
         CASE WHEN contains(f, '&') THEN replace(f, '&', ' and ') END, CASE WHEN contains(f, '&') THEN replace(f, '&', ' ') END,
         CASE WHEN contains(f, ' and ') THEN replace(f, ' and ', ' ') END]) AS f FROM g),
       c AS (SELECT symbol, trim(regexp_replace(regexp_replace(f, '[^a-z0-9&\-\s]', ' ', 'g'), '\s+', ' ', 'g')) AS f FROM h WHERE f IS NOT NULL),
       k AS (SELECT symbol, f, regexp_replace(regexp_replace(f, '( ({_TOKENS}))+$', ''), '^({_TOKENS})$', '') AS c1,
         array_to_string(list_filter(string_split(f, ' '), lambda w: w NOT IN ({_WORDS})), ' ') AS c2 FROM c)
       SELECT DISTINCT symbol, v AS variant FROM (
         SELECT symbol, f AS v FROM k WHERE length(f) >= 4 OR regexp_matches(f, '[0-9]')
         UNION ALL SELECT symbol, c1 FROM k WHERE c1 <> '' AND c1 <> f AND c1 NOT IN ({_STOPS}) AND (length(c1) >= 4 OR regexp_matches(c1, '[0-9]'))
         UNION ALL SELECT symbol, c2 FROM k WHERE c2 <> '' AND c2 <> f AND c2 NOT IN ({_STOPS}) AND (length(c2) >= 4 OR regexp_matches(c2, '[0-9]')))""",
)
def normalize_names(t):
    return tx.normalize_names(company_names(t), "symbol", "name")


@query(
    "filter_relevant_articles",
    """SELECT doc_id, source FROM documents WHERE contains(' ' || lower(text) || ' ', ' ' || lower(lang) || ' ')
       OR contains(lower(text), '$' || lower(lang)) OR contains(lower(text), 'license') OR contains(lower(text), source)""",
)
def filter_relevant_articles(t):
    names = F.array(F.lit("License"), C("source"))
    return t.documents.where(tx.relevant(C("text"), C("lang"), names)).select("doc_id", "source")


@query(
    "dedupe_articles",
    """WITH u AS (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS r FROM documents),
       v AS (SELECT *, row_number() OVER (PARTITION BY n_chars, lang ORDER BY doc_id) AS s FROM u WHERE r = 1)
       SELECT doc_id, source FROM v WHERE s = 1""",
)
def dedupe_articles(t):
    articles = t.documents.select("doc_id", "source", F.md5("text").alias("url"), F.concat_ws("-", "n_chars", "lang").alias("title"))
    return tx.dedupe_articles(articles, "doc_id", "url", "title").select("doc_id", "source")


@query(
    "news_daily_tone",
    """WITH a AS (SELECT CAST(ts AS DATE) AS date, event_id AS id, value AS tone, [event_type, 'group ' || CAST(user_id % 10 AS VARCHAR)] AS orgs FROM events),
       h AS (SELECT DISTINCT date, id, tone, symbol FROM (SELECT date, id, tone, unnest(orgs) AS org FROM a) JOIN
         (SELECT CAST(k AS BIGINT) AS symbol, 'group ' || CAST(k AS VARCHAR) AS org FROM range(10) r(k)
          UNION ALL SELECT 100, 'click' UNION ALL SELECT 101, 'view' UNION ALL SELECT 100, 'purchase') USING (org))
       SELECT date, symbol, avg(tone) AS tone, count(*) AS articles FROM h GROUP BY ALL""",
    q="tone",
    d="date",
)
def news_daily_tone(t):
    orgs = F.concat(F.lit("The "), F.initcap("event_type"), F.lit(" Inc,12;Group "), C("user_id") % 10, F.lit(" & Co,40"))
    articles = t.events.select(F.to_date("ts").alias("date"), C("event_id").alias("id"), C("value").alias("tone"), orgs.alias("orgs"))
    groups = t.events.select((C("user_id") % 10).alias("symbol")).distinct()
    groups = groups.withColumn("org", F.concat(F.lit("group "), C("symbol")))
    kinds = t.events.select("event_type").distinct().select(
        F.when(C("event_type") == "view", 101).otherwise(100).cast("long").alias("symbol"), C("event_type").alias("org")
    ).where(C("org").isin("click", "view", "purchase"))
    return tx.daily_tone(articles, groups.unionByName(kinds))


@query(
    "daily_sentiment",
    f"""WITH h AS (SELECT source, lang, {_hits_sql(tx.POSITIVE)} AS p, {_hits_sql(tx.NEGATIVE)} AS n
         FROM (SELECT source, lang, lower(text) AS x FROM documents)),
       s AS (SELECT source AS symbol, lang AS date, (p - n) / greatest(p + n, 1) AS score FROM h)
       SELECT symbol, date, avg(score) AS sentiment_mean, coalesce(stddev_samp(score), 0) AS sentiment_std, count(*) AS articles
       FROM s GROUP BY ALL""",
    q="sentiment_mean sentiment_std",
)
def daily_sentiment(t):
    score = tx.keyword_sentiment(C("text"))["sentiment_score"]
    return tx.daily_sentiment(t.documents.select(C("source").alias("symbol"), C("lang").alias("date"), score.alias("score")))
