"""Structured Streaming jobs over an event stream.

Each sink writes one folder per micro-batch and overwrites it on a retry, so a replayed batch adds nothing twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

C = F.col


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """The ``events*.parquet`` files of a folder as a stream."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # a watermark needs a zoned timestamp
    return reader.parquet(folder).withColumn("ts", C("ts").cast("timestamp"))


def run(stream: DataFrame, out: str, mode: str, each=None) -> None:
    """Drain the stream into ``out/batch=<id>``; ``each`` may transform a batch first."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = each(batch, batch_id) if each else batch
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{out}-checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()


def latest_batch(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The newest version of every key of a sink in update mode."""
    from quantloom.sources.incremental import pick

    return pick(spark.read.parquet(out), keys, C("batch"), last=True).drop("batch")


def append_only(stream: DataFrame, out: str) -> None:
    """Append events newer than the last stored one of their key; stored rows are never rewritten.

    ``out`` must hold a first batch, with a negative number. Its marks, one row a key, are written once beside it; from then on each key's
    mark is kept in the state store, so a batch reads neither the sink nor its history. Duplicate deliveries inside the
    watermark are dropped by the stream.
    """
    spark, columns, marks = stream.sparkSession, stream.columns, f"{out}-marks"
    first = spark.read.parquet(out).where(C("batch") < 0)
    first.groupBy("user_id").agg(F.max(F.unix_micros("ts")).alias("_start")).write.mode("ignore").parquet(marks)
    rows = stream.withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["event_id"])
    rows = rows.join(spark.read.parquet(marks), "user_id", "left").withColumn("_at", F.unix_micros("ts"))

    def newer(key, frames, state: GroupState):
        mark = last = state.get[0] if state.exists else None
        for frame in frames:
            if mark is None and frame["_start"].notna().any():
                mark = last = int(frame["_start"].dropna().iloc[0])
            kept = frame if mark is None else frame[frame["_at"] > mark]
            if len(kept):
                last = max(int(kept["_at"].max()), -(1 << 63) if last is None else last)
                yield kept[columns]
        if last is not None:
            state.update((last,))

    kinds = ", ".join(f"`{c}` {k}" for c, k in stream.dtypes)
    fresh = rows.groupBy("user_id").applyInPandasWithState(newer, kinds, "mark long", "append", GroupStateTimeout.NoTimeout)
    run(fresh, out, "append")


def daily_loss(stream: DataFrame, last_equity: DataFrame, max_loss: float, out: str) -> None:
    """First time per (account, day) that equity is at or below last equity · (1 − max_loss): raised once, then latched.

    The latch is an aggregate, the earliest breach, so state is one row per account and day.
    """
    joined = stream.join(last_equity, "user_id")
    breach = F.when(C("value") <= C("last_equity") * (1 - max_loss), C("ts"))
    halts = (
        joined.withWatermark("ts", "2 days")
        .groupBy("user_id", F.window("ts", "1 day").start.alias("day"))
        .agg(F.min(breach).alias("halted_at"))
    )
    run(halts.where(C("halted_at").isNotNull()), out, "update")


def level_breach(stream: DataFrame, levels: DataFrame, out: str) -> None:
    """Ticks beyond the stop or take level of a leg, by its side: a stream–static join."""
    joined = stream.join(levels, "user_id")
    long = C("side") == "long"
    stop = F.when(long, C("value") <= C("stop")).otherwise(C("value") >= C("stop"))
    take = F.when(long, C("value") >= C("take")).otherwise(C("value") <= C("take"))
    kind = F.when(stop, "stop").when(take, "take")
    hits = joined.select("event_id", "user_id", "side", "value", kind.alias("breach")).where(C("breach").isNotNull())
    run(hits, out, "append")


def daily_news(stream: DataFrame, symbol: Column, tone: Column, articles: Column, out: str) -> None:
    """Article-weighted tone per symbol and day, in tumbling one-day windows."""
    rows = stream.select("ts", symbol.alias("symbol"), tone.alias("tone"), articles.alias("articles"))
    daily = (
        rows.withWatermark("ts", "1 day")
        .groupBy("symbol", F.window("ts", "1 day").start.alias("day"))
        .agg(F.sum(C("tone") * C("articles")).alias("_w"), F.sum("articles").alias("articles"))
    )
    weighted = F.when(C("articles") > 0, C("_w") / C("articles"))
    run(daily.select("symbol", "day", weighted.alias("tone"), "articles"), out, "update")
