"""Exact ranks and percentiles of groups of any size.

A window over a whole group sorts that group in one task. These forms never do: equal values are
first counted together, the distinct values are dealt in ranges of (group, value) to so many
partitions that each holds about ``BUCKET_ROWS`` of them, the part of a group in one partition is
ranked on its own, and the totals of the parts before it, one row a part, give the offset. The
ranges decide only how even the parts are, never the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.session import cut, written

#: Distinct values that one task ranks, on average; the number of parts grows with the data, their size does not.
BUCKET_ROWS = 1_000_000

#: Tables of so many rows or fewer are sent to every task.
SMALL_TABLE = 500_000


def value_ranks(df: DataFrame, keys: list[str], value: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per (keys, value), nulls left out: ``n`` copies, ``less`` smaller values, ``total`` in the group."""
    dealt = in_ranges(df, keys, value, bucket_rows)
    totals = dealt.groupBy(*keys, "_b").agg(F.sum("n").alias("_t"))
    over = Window.partitionBy(*keys).orderBy("_b")
    offsets = totals.select(
        *keys,
        "_b",
        (F.sum("_t").over(over) - F.col("_t")).alias("_before"),
        F.sum("_t").over(Window.partitionBy(*keys)).alias("total"),
    )
    inside = Window.partitionBy(*keys, "_b").orderBy(value)
    ranked = dealt.withColumn("_in", F.sum("n").over(inside) - F.col("n"))
    return null_safe(ranked, offsets, [*keys, "_b"], "inner").select(
        *keys, value, "n", (F.col("_before") + F.col("_in")).alias("less"), "total"
    )


def in_ranges(df: DataFrame, keys: list[str], value: str, bucket_rows: int) -> DataFrame:
    """The different (keys, value) with ``n``, their copies, and ``_b``, the range that each is in."""
    counted = cut(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n")))
    parts = -(-counted.count() // bucket_rows) or 1
    # stored, as ranges come from a sample and all that is built on them must see the same ones
    return cut(counted.repartitionByRange(parts, *keys, value).withColumn("_b", F.spark_partition_id()))


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on ``keys`` with null equal to null, as a window over the keys groups them; the keys come once."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"_right_{k}" for k in keys])


def _match(df: DataFrame, ranks: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Attach ranks to rows; the right side is unique per key, so a hot value only skews the left, which AQE splits."""
    right = ranks.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col(value).alias("_kv"),
        F.col("n").alias("_n"),
        F.col("less").alias("_less"),
        F.col("total").alias("_total"),
    )
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col(value) == F.col("_kv")]
    return df.join(right, reduce(lambda a, b: a & b, on), "left").drop("_kv", *[f"_k{i}" for i in range(len(keys))])


def with_pct_rank(df: DataFrame, keys: list[str], value: str, out: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Average-tie percentile rank of ``value`` within ``keys`` among its non-null values.

    Rows are stored once and dealt once: quantiles of the values cut each group into open intervals, whose rows are ranked by a
    window, and the cuts themselves, whose rows are all alike and need none, however many they are. The quantiles decide only
    how even the intervals are.
    """
    if df.schema[value].dataType.typeName() not in ("double", "float", "integer", "short", "byte"):
        matched = _match(df, value_ranks(df, keys, value), keys, value)
        rank = (F.col("_less") + (F.col("_n") + 1) / 2) / F.col("_total")
        return matched.withColumn(out, rank).drop("_n", "_less", "_total")
    df = written(df)
    dealt = _intervals(df, value, bucket_rows)
    totals = dealt.where(F.col("_part").isNotNull()).groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_t"))
    over = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_t").over(over.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = cut(totals.withColumns({"_before": before, "_total": F.sum("_t").over(over)}))
    offsets = F.broadcast(offsets) if offsets.count() <= SMALL_TABLE else offsets
    w = Window.partitionBy(*keys, "_part").orderBy(value)
    ties = F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow))
    inside = F.col("_part") % 2 == 1
    ranked = dealt.where(inside).withColumns({"_in": F.rank().over(w) - 1, "_n": ties})
    made = [null_safe(ranked, offsets.drop("_t"), [*keys, "_part"], "inner")]
    alike = dealt.where(~F.coalesce(inside, F.lit(False))).withColumn("_in", F.lit(0))
    made.append(null_safe(alike, offsets.withColumnRenamed("_t", "_n"), [*keys, "_part"], "left"))
    rank = (F.col("_before") + F.col("_in") + (F.col("_n") + 1) / 2) / F.col("_total")
    return reduce(DataFrame.union, (d.select(*df.columns, rank.alias(out)) for d in made))


def _intervals(df: DataFrame, value: str, bucket_rows: int) -> DataFrame:
    """``df`` with ``_part``: 2k at the k-th cut, 2k + 1 between it and the next one, null where ``value`` is null."""
    number = df.withColumn("_number", F.col(value).cast("double"))
    parts = -(-df.count() // bucket_rows) or 1
    cuts = [float("-inf")]
    if parts > 1:
        cuts += sorted(set(number.approxQuantile("_number", [i / parts for i in range(1, parts)], 0.1 / parts)) - {float("-inf"), float("inf")})
    placed = F.lit(0.0)
    if len(cuts) > 1:
        # finds the interval by bisection; nan is beyond the last one, as in an order by value
        bins = Bucketizer(splits=[*cuts, float("inf")], inputCol="_number", outputCol="_at", handleInvalid="keep")
        number, placed = bins.transform(number), F.least(F.col("_at"), F.lit(len(cuts) - 1.0))
    at = placed.cast("int")
    on_cut = F.get(F.array(*[F.lit(c) for c in cuts]), at) == F.col("_number")
    part = F.when(F.col("_number").isNotNull(), 2 * at + F.when(on_cut, 0).otherwise(1))
    return number.withColumn("_part", part).drop("_number", "_at")


def with_ordinal(df: DataFrame, keys: list[str], value: str, tiebreak: str, out: str, out_total: str) -> DataFrame:
    """1-based position by (value, tiebreak) within ``keys`` and the group size; null where value is null."""
    first = _match(df, value_ranks(df, keys, value), keys, value)
    first = first.withColumnRenamed("_less", "_less0").withColumnRenamed("_total", out_total).drop("_n")
    ties = _match(first, value_ranks(df.where(F.col(value).isNotNull()), [*keys, value], tiebreak), [*keys, value], tiebreak)
    place = F.when(F.col(value).isNotNull(), F.col("_less0") + F.col("_less") + 1)
    return ties.withColumn(out, place).drop("_n", "_less", "_total", "_less0")


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """One row per group with linear-interpolated percentiles, named by ``shares``; exact for any group size."""
    ranks = value_ranks(df, keys, value)
    less, upto = F.col("less"), F.col("less") + F.col("n")
    picks = []
    for name, q in shares.items():
        at = F.lit(float(q)) * (F.col("total") - 1)
        for side, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picks.append(F.max(F.when((less <= place) & (place < upto), F.col(value))).alias(f"_{name}_{side}"))
        picks.append(F.max(at - F.floor(at)).alias(f"_{name}_f"))
    edges = ranks.groupBy(*keys).agg(*picks)
    return edges.select(
        *keys,
        *[
            (F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_f")).alias(n)
            for n in shares
        ],
    )
