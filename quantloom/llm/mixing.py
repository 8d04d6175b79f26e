"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

The weight of a source is its token share to the power of one exponent, normalised. The exponent is bisected between 0
(equal weights) and 1 (natural shares) to the largest entropy wanted, and raised further where a source would repeat more
often than allowed. Several bisection steps are answered by one aggregate over the table of sources, which itself never
leaves Spark. A source whose target is q times its tokens is read floor(q) times in whole; the rest comes from one more
pass over its blocks in permuted order, until the budget is used up: running sums over blocks first, then inside each.

Null texts have no tokens; rows without tokens belong to no budget and are not drawn. A null source is a source of its own.
Repeated rows and ids are drawn each on their own. An empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.store import keep

TOKEN = r"[^\x20\x09-\x0D]+"
#: Entropy wanted as a share of the greatest, times a token is read at most, rows of a block, bisection steps a pass and passes.
EVEN, REPEATS, BLOCK, STEPS, PASSES = 0.97, 4.0, 1024, 4, 10
SEED = 11


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id, source, key (never null) and n_tokens of every row that has tokens."""
    n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(TOKEN)).cast("long")
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))
    return docs.select("doc_id", "source", key.alias("key"), F.xxhash64("doc_id", "text", F.lit(SEED)).alias("draw"), n.alias("n_tokens")).where("n_tokens > 0")


def _bisect(sources: DataFrame, low: float, high: float, measure, wanted) -> float:
    """The exponent at which ``wanted`` turns from true (towards 0) to false; every pass answers STEPS halvings."""
    for _ in range(PASSES):
        n = 1 << STEPS
        grid = [low + (high - low) * i / n for i in range(1, n)]
        got = sources.agg(*[measure(F.lit(x)).alias(f"m{i}") for i, x in enumerate(grid)]).first()
        holds = [wanted(v) for v in got]
        last = max([i for i, ok in enumerate(holds) if ok], default=-1)
        low, high = ([low, *grid][last + 1], [*grid, high][last + 1])
    return (low + high) / 2


def exponent(sources: DataFrame, even: float = EVEN, repeats: float = REPEATS, ratio: float = 1.0) -> float:
    """Exponent for a table of (key, tokens); ``ratio``: budget as a multiple of all tokens."""
    total = sources.agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.min("tokens").alias("least")).first()
    if not total["n"] or total["n"] == 1:
        return 1.0
    share = F.col("tokens") / F.lit(float(total["t"]))
    power = lambda a: F.exp(a * F.ln(share))

    def entropy(a):
        """ln of the sum of p^a less a times the mean log under the weights, over the greatest entropy."""
        return (F.ln(F.sum(power(a))) - a * F.sum(power(a) * F.ln(share)) / F.sum(power(a))) / F.ln(F.lit(float(total["n"])))

    def most(a):
        return F.lit(ratio) * F.max(power(a) / share) / F.sum(power(a))

    by_entropy = 1.0 if sources.agg(entropy(F.lit(1.0))).first()[0] >= even else _bisect(sources, 0.0, 1.0, entropy, lambda v: v >= even)
    if ratio > repeats or sources.agg(most(F.lit(by_entropy))).first()[0] <= repeats:
        return by_entropy
    return _bisect(sources, by_entropy, 1.0, most, lambda v: v > repeats)


def mix(docs: DataFrame, even: float = EVEN, repeats: float = REPEATS, ratio: float = 1.0) -> DataFrame:
    """One row for every time a row of ``docs`` is drawn: doc_id, source, epoch, block, n_tokens.

    Whole passes are epochs 0, 1, ...; ``block`` is the place of the row's block in the order of that epoch.
    """
    rows = keep(tokens(docs))
    sources = keep(rows.groupBy("key").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")))
    a = F.lit(exponent(sources, even, repeats, ratio))
    total = sources.agg(F.sum("tokens").cast("double").alias("t"), F.sum(F.exp(a * F.ln(F.col("tokens").cast("double")))).alias("z")).first()
    budget = F.floor(F.lit(ratio * (total["t"] or 0)) * F.exp(a * F.ln(F.col("tokens").cast("double"))) / F.lit(total["z"]) + 1e-6)
    plan = sources.select("key", F.floor(budget / F.col("tokens")).cast("int").alias("whole"), (budget % F.col("tokens")).cast("long").alias("rest"), F.ceil(F.col("rows") / BLOCK).alias("blocks"))
    placed = rows.join(plan, "key").withColumn("own", F.pmod("draw", "blocks"))
    # dealt by block, or the windows below would stay with the join's dealing, by source alone
    placed = placed.select("doc_id", "source", "key", "draw", "n_tokens", "whole", "rest", "own").repartition("key", "own")
    # the last, partial pass: blocks in permuted order, then rows in permuted order inside each block
    order = Window.partitionBy("key").orderBy(F.xxhash64("own", "whole", F.lit(SEED)), "own")
    sums = placed.groupBy("key", "own", "whole").agg(F.sum("n_tokens").alias("held"))
    sums = sums.select("key", "own", "held", (F.sum("held").over(order) - F.col("held")).alias("before"), F.row_number().over(order).alias("turn"))
    inside = Window.partitionBy("key", "own").orderBy(F.xxhash64("draw", "whole"), "draw", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    used = placed.join(sums, ["key", "own"]).withColumn("reach", F.col("before") + F.sum("n_tokens").over(inside))
    last = F.when(F.col("reach") <= F.col("rest"), F.lit(1)).otherwise(0)
    drawn = used.withColumn("times", F.col("whole") + last).where("times > 0")
    return drawn.select("doc_id", "source", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("epoch"), F.col("turn").alias("block"), "n_tokens")
