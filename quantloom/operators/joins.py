"""Point-in-time joins of irregular sources onto the session grid.

Event sources may hold any number of rows per symbol, so they are first aggregated to one row per
(symbol, session), with map-side combine. After that a symbol holds at most one row per session on
either side, and the as-of step, a union and one window per symbol, is bounded by the calendar.
``attach_all`` unions all its sources with the panel, so the panel moves once, however many there are.
Tables with one row per session or calendar day are broadcast: they do not grow with the data.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.elementwise import div
from quantloom.operators.cleaning import FAR, session_table
from quantloom.sources.incremental import pick

C = F.col

# fixed values: lags and lifetimes, in sessions
SHARES_MAX_AGE = 130
FUNDAMENTALS_MAX_AGE = 300
SHORT_INTEREST_LAG = 10
SHORT_MAX_AGE = 40
INST_MAX_AGE = 70

#: Ordinals before the first and after the last session.
BEFORE_ALL, AFTER_ALL = -1, 2**31 - 1


def to_session(events: DataFrame, day: str, sessions: DataFrame, strict: bool, shift: int = 0, late: bool = False) -> DataFrame:
    """Add ``ord`` (and ``session``) of the first session on or after ``day``, or strictly after it.

    Events after the last session are dropped, or with ``late`` kept behind it. ``shift`` moves the ordinal by further sessions.
    """
    days = events.select(C(day).alias("_day")).distinct()
    marks = days.select("_day", F.lit(None).cast("date").alias("date"), F.lit(None).cast("int").alias("ord"))
    grid = marks.unionByName(sessions.select(C("date").alias("_day"), "date", "ord"))
    by_day = grid.groupBy("_day").agg(F.max("date").alias("date"), F.max("ord").alias("ord"))
    ahead = Window.orderBy("_day").rowsBetween(1 if strict else 0, Window.unboundedFollowing)
    mapped = by_day.select(
        "_day",
        F.first("date", ignorenulls=True).over(ahead).alias("session"),
        F.first("ord", ignorenulls=True).over(ahead).alias("ord"),
    ).where(C("ord").isNotNull())
    joined = events.join(F.broadcast(mapped), C(day) == C("_day"), "left" if late else "inner").drop("_day")
    if late:
        joined = joined.withColumn("ord", F.coalesce("ord", F.lit(AFTER_ALL)))
    return joined.withColumn("ord", C("ord") + shift) if shift else joined


def latest_per_session(events: DataFrame, order: Column) -> DataFrame:
    return pick(events, ["symbol", "ord"], order, last=True)


def asof_join(left: DataFrame, right: DataFrame, at: str, cols: list[str], by: str = "symbol") -> DataFrame:
    """Backward as-of join: each left row takes the last right row of its symbol with ``at`` not after it.

    ``right`` must be unique per (by, at). Adds ``cols`` and ``at_right``, the matched position.
    """
    kind = right.select(F.struct(C(at).alias("_at"), *cols).alias("_v")).schema["_v"].dataType
    events = right.select(by, at, F.struct(C(at).alias("_at"), *cols).alias("_v"), F.lit(0).alias("_side"))
    rows = left.withColumns({"_v": F.lit(None).cast(kind), "_side": F.lit(1)})
    both = rows.unionByName(events, allowMissingColumns=True)
    upto = Window.partitionBy(by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("_v", F.last("_v", ignorenulls=True).over(upto)).where(C("_side") == 1)
    return filled.select(*left.columns, C("_v._at").alias("at_right"), *[C(f"_v.{c}").alias(c) for c in cols])


def known_until(sessions: DataFrame, source: DataFrame, day: str) -> Column:
    """The last session the source speaks for: the first one strictly after its last day, else no bound."""
    last = source.agg(F.max(day)).scalar()
    after = sessions.where(C("date") > last).agg(F.min("date")).scalar()
    return F.coalesce(after, F.lit(FAR).cast("date"))


def shares(panel: DataFrame) -> Column:
    """Shares outstanding implied by the market cap, null when that is absent, stale or not positive."""
    if "marketcap" not in panel.columns:
        return F.lit(None).cast("double")
    implied = div(C("marketcap") * 1e6, C("close"))
    return F.when(implied > 0, implied)


class Carried(NamedTuple):
    """What a panel row knows of one source: its symbol's last event so far, and whether the source has the symbol at all."""

    event: Column
    age: Column
    covered: Column

    def within(self, name: str, max_age: int) -> Column:
        """A column of the event, null once older than ``max_age`` sessions."""
        return F.when(self.age <= max_age, self.event[name])

    def today(self, name: str) -> Column:
        """A column of the event if it landed on the row's own session."""
        return self.within(name, 0)


class Feed(NamedTuple):
    """How a source joins: ``events`` reduces it to one row per (symbol, ord), ``columns`` reads the carried event.

    ``day`` names the column that says how far the source reaches, if its columns end there.
    """

    events: Callable[[DataFrame, DataFrame], DataFrame]
    columns: Callable[[DataFrame, Carried], dict[str, Column]]
    day: str | None = None


def _filing_events(filings: DataFrame, sessions: DataFrame) -> DataFrame:
    landed = to_session(filings, "filed", sessions, strict=False, shift=1)
    return latest_per_session(landed.select("symbol", "ord", "filed", "shares_out"), F.struct("filed", "shares_out"))


def _filing_columns(rows: DataFrame, known: Carried) -> dict[str, Column]:
    out = known.within("shares_out", SHARES_MAX_AGE)
    return {
        "marketcap": C("close") * out / 1e6,
        "turnover": div(C("volume"), out),
        "filing_days": F.when(known.age <= SHARES_MAX_AGE, known.age).cast("double"),
    }


def _news_events(news: DataFrame, sessions: DataFrame) -> DataFrame:
    weighted = F.sum(C("tone") * C("articles")).alias("weighted")
    return to_session(news, "day", sessions, strict=True).groupBy("symbol", "ord").agg(weighted, F.sum("articles").alias("articles"))


def _news_columns(rows: DataFrame, known: Carried) -> dict[str, Column]:
    articles = known.today("articles")
    return {
        "news_tone": F.when(articles > 0, known.today("weighted") / articles),
        "news_articles": F.when(known.covered, F.coalesce(articles, F.lit(0.0))),
    }


_TRADES = ("buy_shares", "sell_shares", "n_buyers", "n_sellers")


def _insider_events(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Trades after the last session have no row to land on, but their symbols are covered."""
    landed = to_session(events, "filed", sessions, strict=True, late=True)
    return landed.groupBy("symbol", "ord").agg(*[F.sum(c).alias(c) for c in _TRADES])


def _insider_columns(rows: DataFrame, known: Carried) -> dict[str, Column]:
    value = lambda c: F.when(known.covered, F.coalesce(known.today(c), F.lit(0.0)))
    return {
        "insider_buys": value("n_buyers"),
        "insider_sells": value("n_sellers"),
        "insider_net_frac": div(value("buy_shares") - value("sell_shares"), shares(rows)),
    }


def _short_interest_events(source: DataFrame, sessions: DataFrame) -> DataFrame:
    landed = to_session(source, "settled", sessions, strict=False, shift=SHORT_INTEREST_LAG)
    return latest_per_session(landed, F.struct("settled", "short_interest"))


def _short_interest_columns(rows: DataFrame, known: Carried) -> dict[str, Column]:
    return {
        "days_to_cover": known.within("days_to_cover", SHORT_MAX_AGE),
        "short_ratio": div(known.within("short_interest", SHORT_MAX_AGE), shares(rows)),
    }


def _fundamental_events(source: DataFrame, sessions: DataFrame) -> DataFrame:
    cols = [c for c in source.columns if c not in ("symbol", "filed")]
    return latest_per_session(to_session(source, "filed", sessions, strict=False, shift=1), F.struct("filed", *cols))


def _fundamental_columns(rows: DataFrame, known: Carried) -> dict[str, Column]:
    v = lambda c: known.within(c, FUNDAMENTALS_MAX_AGE)
    cap = C("marketcap") * 1e6 if "marketcap" in rows.columns else F.lit(None).cast("double")
    ratio = lambda a, b: F.when(b > 0, a / b)
    debt = F.when(v("assets") > 0, F.coalesce(v("ltdebt"), F.lit(0.0))).otherwise(v("ltdebt"))
    research = F.when(v("revenue_ttm").isNotNull(), F.coalesce(v("rd_ttm"), F.lit(0.0))).otherwise(v("rd_ttm"))
    return {
        "book_to_market": ratio(v("equity"), cap),
        "earnings_yield": ratio(v("ni_ttm"), cap),
        "sales_to_price": ratio(v("revenue_ttm"), cap),
        "gross_profitability": ratio(v("gp_ttm"), v("assets")),
        "roe": ratio(v("ni_ttm"), v("equity")),
        "asset_growth": ratio(v("assets"), v("assets_1y")) - 1,
        "accruals": ratio(v("ni_ttm") - v("ocf_ttm"), v("assets")),
        "leverage": ratio(debt, v("assets")),
        "cash_to_assets": ratio(v("cash"), v("assets")),
        "rd_to_sales": ratio(research, v("revenue_ttm")),
        "capex_to_assets": ratio(v("capex_ttm"), v("assets")),
        "op_margin": ratio(v("opinc_ttm"), v("revenue_ttm")),
    }


def _short_volume_events(source: DataFrame, sessions: DataFrame) -> DataFrame:
    return latest_per_session(to_session(source, "day", sessions, strict=True), F.struct("day", "short_ratio_day"))


def _institution_events(source: DataFrame, sessions: DataFrame) -> DataFrame:
    landed = to_session(source, "usable_from", sessions, strict=True)
    return latest_per_session(landed, F.struct("usable_from", "inst_shares", "inst_holders", "inst_top5"))


def _institution_columns(rows: DataFrame, known: Carried) -> dict[str, Column]:
    return {
        "inst_holders": known.within("inst_holders", INST_MAX_AGE),
        "inst_top5": known.within("inst_top5", INST_MAX_AGE),
        "inst_own": div(known.within("inst_shares", INST_MAX_AGE), shares(rows)),
    }


def _page_view_events(source: DataFrame, sessions: DataFrame) -> DataFrame:
    return to_session(source, "day", sessions, strict=True).groupBy("symbol", "ord").agg(F.sum("views").alias("views"))


def _sector_events(table: DataFrame, sessions: DataFrame) -> DataFrame:
    return table.groupBy("symbol").agg(F.min("sector").alias("sector")).withColumn("ord", F.lit(BEFORE_ALL))


#: Sources in the order in which their columns are made: those that need shares outstanding come after the filings.
FEEDS = {
    "filings": Feed(_filing_events, _filing_columns),
    "news": Feed(_news_events, _news_columns),
    "insiders": Feed(_insider_events, _insider_columns, "filed"),
    "short_interest": Feed(_short_interest_events, _short_interest_columns),
    "fundamentals": Feed(_fundamental_events, _fundamental_columns),
    "short_volume": Feed(_short_volume_events, lambda rows, known: {"short_vol_ratio": known.today("short_ratio_day")}, "day"),
    "institutions": Feed(_institution_events, _institution_columns),
    "page_views": Feed(_page_view_events, lambda rows, known: {"wiki_views": known.today("views")}, "day"),
    "sector": Feed(_sector_events, lambda rows, known: {"sector": F.coalesce(known.event["sector"], F.lit("Unknown"))}),
}


def attach_all(panel: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """Apply every source that is present, in a fixed order; an absent source leaves its columns out.

    Each source is reduced to one event per (symbol, session); the union of all of them with the panel is dealt by symbol
    and sorted once, and one carry per source fills the rows. A source with ``day`` says nothing past its last day: its
    columns are null there. Events without a symbol are nobody's; rows without a date know none.
    """
    feeds = {name: feed for name, feed in FEEDS.items() if name in sources}
    sessions = session_table(panel.where(C("date").isNotNull()))
    rows = panel.join(F.broadcast(sessions.withColumnRenamed("ord", "_ord")), "date", "left").withColumn("_side", F.lit(1))
    parts = [rows]
    for name, feed in feeds.items():
        events = feed.events(sources[name].where(C("symbol").isNotNull()), sessions)
        held = [c for c in events.columns if c not in ("symbol", "ord")]
        parts.append(events.select("symbol", C("ord").alias("_ord"), F.lit(0).alias("_side"), F.struct(C("ord").alias("at"), *held).alias(f"_{name}")))
    both = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    whole = Window.partitionBy("symbol")
    upto = whole.orderBy("_ord", "_side").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumns(
        {f"_{n}": F.last(f"_{n}", ignorenulls=True).over(upto) for n in feeds}
        | {f"_has_{n}": (F.count(f"_{n}").over(whole) > 0) for n in feeds}
    ).where(C("_side") == 1)
    out = filled.withColumns({f"_end_{n}": known_until(sessions, sources[n], f.day) for n, f in feeds.items() if f.day})
    for name, feed in feeds.items():
        made = feed.columns(out, Carried(C(f"_{name}"), C("_ord") - C(f"_{name}.at"), C(f"_has_{name}")))
        if feed.day:
            made = {c: F.when(C("date") <= C(f"_end_{name}"), v) for c, v in made.items()}
        out = out.withColumns(made)
    hidden = {"_ord", "_side"} | {f"{p}{n}" for n in feeds for p in ("_", "_has_", "_end_")}
    return out.select(*[c for c in out.columns if c not in hidden])


def attach_filings(panel: DataFrame, filings: DataFrame) -> DataFrame:
    """Shares outstanding known since the session after the filing → market cap, turnover and filing age."""
    return attach_all(panel, {"filings": filings})


def attach_news(panel: DataFrame, news: DataFrame) -> DataFrame:
    """News of calendar days on the next session: article-weighted tone; quiet is 0, unknown symbols are null."""
    return attach_all(panel, {"news": news})


def attach_insiders(panel: DataFrame, events: DataFrame) -> DataFrame:
    """Insider trades on the next session; zero while covered and quiet, null past the source's last day."""
    return attach_all(panel, {"insiders": events})


def attach_short_interest(panel: DataFrame, source: DataFrame) -> DataFrame:
    """Short interest is public ten sessions after settlement and lives forty."""
    return attach_all(panel, {"short_interest": source})


def attach_fundamentals(panel: DataFrame, source: DataFrame) -> DataFrame:
    """Twelve accounting ratios from the last filing, null unless the denominator is positive."""
    return attach_all(panel, {"fundamentals": source})


def attach_short_volume(panel: DataFrame, source: DataFrame) -> DataFrame:
    """The short-volume ratio of the last session; the latest day wins when several land on one."""
    return attach_all(panel, {"short_volume": source})


def attach_institutions(panel: DataFrame, source: DataFrame) -> DataFrame:
    """Quarterly holdings, usable strictly after the filing deadline, carried seventy sessions."""
    return attach_all(panel, {"institutions": source})


def attach_page_views(panel: DataFrame, source: DataFrame) -> DataFrame:
    """Views summed onto the next session, null before the first observation and past the last day."""
    return attach_all(panel, {"page_views": source})


def sector_table(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """symbol → sector from two sources; the primary one wins."""
    f = fallback.select("symbol", C("sector").alias("_f"))
    return primary.join(f, "symbol", "full_outer").select("symbol", F.coalesce("sector", "_f").alias("sector"))


def attach_sector(panel: DataFrame, table: DataFrame) -> DataFrame:
    return panel.join(table, "symbol", "left").withColumn("sector", F.coalesce("sector", F.lit("Unknown")))


def inside_intervals(panel: DataFrame, intervals: DataFrame) -> DataFrame:
    """Rows whose date lies in a half-open [start, end) interval of their symbol; a null end is open."""
    ends = intervals.select(
        C("symbol").alias("_s"), C("start").alias("_start"), F.coalesce("end", F.lit(FAR).cast("date")).alias("_end")
    )
    on = (C("symbol") == C("_s")) & (C("date") >= C("_start")) & (C("date") < C("_end"))
    return panel.join(ends, on, "left_semi")


def member_mask(panel: DataFrame, intervals: DataFrame) -> DataFrame:
    """Membership by another route, for cross-checks: a running sum of +1 at starts and −1 at ends."""
    steps = intervals.select("symbol", C("start").alias("date"), F.lit(1).alias("_step")).unionByName(
        intervals.where(C("end").isNotNull()).select("symbol", C("end").alias("date"), F.lit(-1).alias("_step"))
    )
    net = steps.groupBy("symbol", "date").agg(F.sum("_step").alias("_step"), F.lit(0).alias("_row"))
    rows = panel.withColumns({"_step": F.lit(0).cast("long"), "_row": F.lit(1)})
    both = rows.unionByName(net, allowMissingColumns=True)
    past = Window.partitionBy("symbol").orderBy("date", "_row").rowsBetween(Window.unboundedPreceding, 0)
    counted = both.withColumn("_n", F.sum("_step").over(past)).where(C("_row") == 1)
    return counted.withColumn("member", (C("_n") > 0).cast("int")).drop("_step", "_row", "_n")


def pead(panel: DataFrame, announcements: DataFrame) -> DataFrame:
    """Days since the last announcement, its surprise and price reaction, both decaying over 20 sessions."""
    sessions = session_table(panel)
    rows = panel.join(F.broadcast(sessions), "date")
    announcements = announcements.where(C("symbol").isNotNull())
    once = pick(announcements.select("symbol", "day", "surprise"), ["symbol", "day"], C("surprise"), last=False)
    at = to_session(once, "day", sessions, strict=False).select("symbol", "ord", "day", "surprise")
    at = latest_per_session(at, C("day")).withColumnRenamed("ord", "a_ord")
    close = rows.select("symbol", "ord", "close")
    before = close.select("symbol", (C("ord") + 1).alias("a_ord"), C("close").alias("_before"))
    after = close.select("symbol", (C("ord") - 1).alias("a_ord"), C("close").alias("_after"))
    reacted = at.join(before, ["symbol", "a_ord"], "left").join(after, ["symbol", "a_ord"], "left")
    events = reacted.select(
        "symbol",
        (C("a_ord") + 1).alias("ord"),
        "a_ord",
        F.when(C("surprise").isNotNull(), F.greatest(F.lit(-100.0), F.least("surprise", F.lit(100.0)))).alias("surprise"),
        F.when(C("_before") > 0, C("_after") / C("_before") - 1).alias("react"),
    )
    joined = asof_join(rows, events, "ord", ["a_ord", "surprise", "react"])
    since = F.least(C("ord") - C("a_ord"), F.lit(90)).cast("double")
    decay = F.exp(-since / 20)
    zero = F.lit(0.0)
    return joined.select(
        "symbol",
        "date",
        F.coalesce(since, F.lit(90.0)).alias("days_since_earn"),
        F.coalesce("surprise", zero).alias("last_surprise"),
        F.coalesce(C("surprise") * decay, zero).alias("surprise_decay"),
        F.coalesce("react", zero).alias("ear_react"),
        F.coalesce(C("react") * decay, zero).alias("react_decay"),
    )


def next_session_prices(panel: DataFrame, horizon: int = 1) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("date")
    return panel.withColumns({"next_open": F.lead("open", horizon).over(w), "next_close": F.lead("close", horizon).over(w)})


def registry_differences(registry: DataFrame, broker: DataFrame) -> DataFrame:
    """Positions on either side by (symbol, side): orphan, never filled, reduced, or in agreement."""
    r = registry.groupBy("symbol", "side").agg(F.sum("qty").alias("registered"))
    b = broker.groupBy("symbol", "side").agg(F.sum("qty").alias("held"))
    both = r.join(b, ["symbol", "side"], "full_outer")
    return both.withColumn(
        "difference",
        F.when(C("registered").isNull(), "orphan")
        .when(C("held").isNull(), "never_filled")
        .when(C("held") < C("registered"), "reduced")
        .otherwise("ok"),
    )


def combine_features(left: DataFrame, right: DataFrame) -> DataFrame:
    """Put two feature sets side by side by key; a name in both is an error."""
    shared = (set(left.columns) & set(right.columns)) - {"symbol", "date"}
    if shared:
        raise ValueError(f"columns in both sets: {sorted(shared)}")
    return left.join(right, ["symbol", "date"])
