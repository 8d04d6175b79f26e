"""Incremental loads. "Latest per key" is an aggregate of the row as a struct, never a window over the key,
so a key with many copies is combined on the map side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pick(df: DataFrame, keys: list[str], order: Column, last: bool) -> DataFrame:
    """One row per key, the first or last by ``order``, which should be total."""
    rest = [c for c in df.columns if c not in keys]
    choose = F.max_by if last else F.min_by
    chosen = df.groupBy(*keys).agg(choose(F.struct(*rest), order).alias("_row"))
    return chosen.select(*[c if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def distinct_keep_last(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    return pick(df, keys, order, last=True)


def append_only_merge(stored: DataFrame, new: DataFrame, last_session: Column, order: Column) -> DataFrame:
    """Stored rows never change; of the new ones only those after a symbol's last stored date are added."""
    marks = stored.groupBy("symbol").agg(F.max("date").alias("_mark"))
    fresh = (
        new.join(marks, "symbol", "left")
        .where((F.col("_mark").isNull() | (F.col("date") > F.col("_mark"))) & (F.col("date") <= last_session))
        .drop("_mark")
    )
    fresh = pick(fresh, ["symbol", "date"], order, last=False)
    return stored.unionByName(fresh.select(*stored.columns))


def incremental_union(old: DataFrame, new: DataFrame, keys: list[str], loaded: str) -> DataFrame:
    """Union in which the row loaded last wins."""
    return pick(old.unionByName(new), keys, F.col(loaded), last=True)


def history_upsert(history: DataFrame, update: DataFrame, key: str = "date") -> DataFrame:
    """Replace the rows of the dates in ``update``, append the others."""
    return history.join(update.select(key).distinct(), key, "left_anti").unionByName(update)
