"""Connected components by alternating stars: every round rewires edges towards the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.store import keep

#: Edges of a partition, both directions counted. Fewer in all are one partition, and a round over them needs no exchange.
ROWS = 1 << 17


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free digest of a set of edges."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", "u"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges(u, v)`` but the roots; the root is the smallest node of its component.

    Self-loops, nulls and repeated edges are allowed and add nothing. A node of any degree is safe: its smallest
    neighbour is a partial aggregate, and the join that spreads it has one row a node on the other side.
    """
    pairs = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    pairs = keep(pairs)
    mark = _mark(pairs)
    while mark[0]:
        parts = 1 + 2 * mark[0] // ROWS
        joined_to = F.broadcast if parts == 1 else lambda table: table
        both = pairs.union(pairs.select("v", "u").toDF("u", "v")).coalesce(parts)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(joined_to(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(joined_to(lowest), "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", F.col("m").alias("v"))).coalesce(parts).distinct()
        pairs = keep(small)
        last, mark = mark, _mark(pairs)
        if mark == last:
            break
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
