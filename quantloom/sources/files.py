"""File sources and sinks. Schemas are explicit; NaN and infinities become null on the way in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.functions.elementwise import finite

BAR_COLUMNS = ["date", "symbol", "open", "high", "low", "close", "volume"]

FACTS = T.MapType(
    T.StringType(),
    T.MapType(
        T.StringType(),
        T.StructType(
            [
                T.StructField(
                    "units",
                    T.MapType(
                        T.StringType(),
                        T.ArrayType(
                            T.StructType(
                                [
                                    T.StructField("end", T.StringType()),
                                    T.StructField("filed", T.StringType()),
                                    T.StructField("val", T.DoubleType()),
                                ]
                            )
                        ),
                    ),
                )
            ]
        ),
    ),
)


def load_panel(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet panel; only the named columns are read, doubles are made finite, ``date`` becomes a date."""
    df = spark.read.parquet(path).select(*(columns or BAR_COLUMNS))
    picks = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if name == "date":
            c = F.to_date(c)
        elif kind in ("double", "float"):
            c = finite(c.cast("double"))
        picks.append(c.alias(name))
    return df.select(*picks)


def save_panel(df: DataFrame, path: str) -> None:
    """Parquet sink, one directory per year, so that a date range prunes partitions."""
    df.withColumn("year", F.year("date")).repartition("year", "symbol").write.mode("append").partitionBy("year").parquet(path)


def scan_delimited(spark: SparkSession, path: str, schema: str, date: str, pattern: str, keys: list[str], sums: list[str]):
    """Pipe-delimited daily files as one table, re-aggregated on ``keys``; empty files add no rows."""
    raw = spark.read.csv(path, sep="|", header=True, schema=schema)
    dated = raw.withColumn(date, F.to_date(F.col(date), pattern))
    return dated.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def scan_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Tab-delimited text: all strings, no quoting, lines of another width dropped."""
    schema = ", ".join(f"{c} string" for c in columns)
    return spark.read.csv(path, sep="\t", quote="", header=True, schema=schema, mode="DROPMALFORMED")


def json_facts(df: DataFrame, key: str, doc: str, taxonomy: str, tags: list[str], unit: str) -> DataFrame:
    """Nested fact documents to rows; per filing the first tag of ``tags`` that is present wins."""
    tree = df.select(key, F.from_json(doc, FACTS)[taxonomy].alias("_tags"))
    facts = (
        tree.select(key, F.explode("_tags").alias("tag", "_fact"))
        .where(F.col("tag").isin(tags))
        .select(key, "tag", F.explode(F.col("_fact.units")[unit]).alias("_row"))
    )
    order = F.array_position(F.array(*[F.lit(t) for t in tags]), F.col("tag"))
    rows = facts.select(key, "tag", "_row.end", "_row.filed", "_row.val", order.alias("_pref"))
    best = F.min("_pref").over(Window.partitionBy(key, "filed"))
    return rows.withColumn("_best", best).where("_pref = _best").groupBy(key, "filed", "end").agg(F.min_by("val", "_pref").alias("val"), F.min_by("tag", "_pref").alias("tag"))


def event_rows(spark: SparkSession, path: str) -> DataFrame:
    """A folder of JSON events as flat rows: text numbers are coerced, missing values take the defaults."""
    raw = spark.read.schema("id long, symbol string, side string, value string, pnl string").json(path)

    def number(c: str) -> Column:
        return F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))

    return raw.select(
        "id",
        F.coalesce("symbol", F.lit("UNKNOWN")).alias("symbol"),
        F.coalesce("side", F.lit("long")).alias("side"),
        number("value").alias("value"),
        number("pnl").alias("pnl"),
    )
