"""The registered queries: a Spark plan per key and, where one exists, the DuckDB text of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.rounding import settle
from quantloom.operators.panel import Panel
from quantloom.plans.oracle import SOURCES, SqlPanel, settle_sql
from quantloom.session import compiled_methods, spread, window_group_limit
from quantloom.sources.bars import event_bars, trade_bars

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_ROWS: dict[str, int] = {}

#: The column that holds the symbol of a panel's source.
SYMBOLS = {"lineitem": "l_suppkey", "events": "user_id"}


class Tables:
    """The given tables of one folder, and the panels derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        compiled_methods(spark)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def rows(self, name: str) -> int:
        """Row count from the parquet footers: the proven bound on every group derived from the table."""
        path = f"{self.folder}/{name}.parquet"
        if path not in _ROWS:
            _ROWS[path] = self.spark.read.parquet(path).count()
        return _ROWS[path]

    def day_rows(self, name: str) -> int:
        """A proven bound on the rows of a date in panels of ``name``, which hold a symbol once a date: its rows, or its symbols where those are too many."""
        rows = self.rows(name)
        if rows <= window_group_limit(self.spark):
            return rows
        path = f"{self.folder}/{name}.parquet#symbols"
        if path not in _ROWS:
            _ROWS[path] = getattr(self, name).select(SYMBOLS[name]).distinct().count()
        return _ROWS[path]

    def sectors(self) -> DataFrame:
        """symbol → sector: the region of the supplier's nation."""
        nation = self.nation.join(F.broadcast(self.region), F.col("n_regionkey") == F.col("r_regionkey"))
        return self.supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
            F.col("s_suppkey").alias("symbol"), F.col("r_name").alias("sector")
        )

    def long_bars(self) -> DataFrame:
        return trade_bars(self.lineitem)

    def dense_bars(self) -> DataFrame:
        return event_bars(self.events)

    def panel(self, source: str) -> Panel:
        if source.startswith("long"):
            df = self.long_bars()
            if source.endswith("sector"):
                df = df.join(self.sectors(), "symbol", "left")
            return Panel(spread(df, "symbol", self.rows("lineitem")), self.day_rows("lineitem"))
        df = self.dense_bars()
        if source.endswith("sector"):
            df = df.withColumn("sector", (F.col("symbol") % 5).cast("string"))
        return Panel(spread(df, "symbol", self.rows("events")), self.day_rows("events"))


def panel_query(name: str, formula: Callable, source: str = "long") -> None:
    """Register a formula over a panel; it returns a Column or a dict of named ones."""

    def columns(p):
        made = formula(p)
        return made if isinstance(made, dict) else {"value": made}

    def run(spark: SparkSession, folder: str) -> DataFrame:
        p = Tables(spark, folder).panel(source)
        return p.out(**columns(p))

    q = SqlPanel(source)
    _add(name, run, q.out(**columns(q)))


def tidy(df: DataFrame, q: str) -> DataFrame:
    """Settle the columns named in ``q``; dates and timestamps become text, flags become integers."""
    settled = q.split()
    picks = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if name in settled:
            c = settle(c.cast("double"))
        elif kind in ("date", "timestamp"):
            c = c.cast("string")
        elif kind == "boolean":
            c = c.cast("int")
        picks.append(c.alias(name))
    return df.select(*picks)


def query(name: str, sql: str | None = None, q: str = "", d: str = ""):
    """Register ``fn(tables)``.

    ``sql`` may name {long}, {dense} and their sector forms as derived tables; ``q`` lists the computed
    doubles to settle on both sides, ``d`` the dates to give as text.
    """

    def keep(fn):
        text = None
        if sql is not None:
            text = sql
            for key, body in SOURCES.items():
                text = text.replace("{" + key + "}", f"({body})")
            swaps = [f"{settle_sql(f'CAST({c} AS DOUBLE)')} AS {c}" for c in q.split()]
            swaps += [f"CAST({c} AS VARCHAR) AS {c}" for c in d.split()]
            if swaps:
                text = f"SELECT * REPLACE ({', '.join(swaps)}) FROM ({text})"
        _add(name, lambda spark, folder: tidy(fn(Tables(spark, folder)), q), text)
        return fn

    return keep


def _add(name, run, sql):
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = sql
