"""Folds, purged splits and leakage checks of walk-forward learning; ``operators.moments`` fits and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.operators.cleaning import session_table

C = F.col


def factor_groups(columns: list[str], groups: dict[str, list[str]]) -> dict[str, list[str]]:
    """The features of each group that the panel has; empty groups are left out."""
    found = {g: [f for f in names if f in columns] for g, names in groups.items()}
    return {g: names for g, names in found.items() if names}


def fold_table(panel: DataFrame, train: int, test: int, step: int, purge: int, min_tail: int = 0) -> DataFrame:
    """(fold, train_start, train_end, test_start, test_end) as dates, ends included.

    The last ``purge`` sessions before the test are left out of training. A tail shorter than ``test`` makes
    a fold of its own when it has at least ``min_tail`` sessions (0 leaves it out).
    """
    sessions = session_table(panel.select("date"))
    one = sessions.agg(F.max("ord").cast("int").alias("n"))
    starts = one.where(C("n") > train).select("n", F.explode(F.sequence(F.lit(train), C("n") - 1, F.lit(step))).alias("i"))
    full = C("i") + test <= C("n")
    # only the first short window is the tail
    first_short = (C("i") + test > C("n")) & ((C("i") - step + test <= C("n")) | (C("i") == train))
    kept = starts.where(full | (first_short & (F.lit(min_tail) > 0) & (C("n") - C("i") >= min_tail)))
    cuts = kept.select(
        ((C("i") - train) / step).cast("int").alias("fold"), (C("i") - train + 1).alias("a"), (C("i") - purge).alias("b"),
        (C("i") + 1).alias("c"), F.least(C("i") + test, C("n")).alias("d"),
    )
    for mark, name in (("a", "train_start"), ("b", "train_end"), ("c", "test_start"), ("d", "test_end")):
        cuts = cuts.join(F.broadcast(sessions.select(C("ord").alias(mark), C("date").alias(name))), mark)
    return cuts.select("fold", "train_start", "train_end", "test_start", "test_end")


def inner_split(panel: DataFrame, share: float = 0.85, purge: int = 6) -> DataFrame:
    """Mark rows inner_train, inner_val or purged by the ordinal of their session."""
    sessions = session_table(panel.select("date"))
    cut = F.floor(sessions.agg(F.max("ord")).scalar() * share)
    part = F.when(C("ord") > cut, "inner_val").when(C("ord") <= cut - purge, "inner_train").otherwise("purged")
    return panel.join(F.broadcast(sessions), "date").withColumn("part", part).drop("ord")


def future_perturbation(panel: DataFrame, feature, cutoff, factor: float = 3.0) -> DataFrame:
    """Largest change of a feature before ``cutoff`` when every later row is altered: zero for a causal one."""
    late = C("date") >= cutoff
    bent = panel.withColumns({c: F.when(late, C(c) * factor).otherwise(C(c)) for c in ("open", "high", "low", "close", "volume")})
    a = feature(panel).select("symbol", "date", C("value").alias("_a"))
    b = feature(bent).select("symbol", "date", C("value").alias("_b"))
    both = a.join(b, ["symbol", "date"]).where(~late)
    moved = F.when(C("_a").isNull() != C("_b").isNull(), float("inf")).otherwise(F.abs(C("_a") - C("_b")))
    return both.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(moved), F.lit(0.0)).alias("max_change"))
