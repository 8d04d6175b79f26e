"""Hidden columns are computed as late as their readers allow, and a total of the whole column does not hurry the others."""

import re

import pandas as pd
from pyspark.sql import functions as F

from quantloom.operators.alphas import compute_alphas
from quantloom.operators.panel import Panel


def bars(spark):
    rows = [(s, f"2024-01-{d:02d}", *[float(s * 7 + d * k % 11 + k) for k in range(1, 6)]) for s in range(3) for d in range(1, 29)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["symbol", "date", "open", "high", "low", "close", "volume"]))


def by_day(df):
    return len(re.findall(r"Exchange hashpartitioning\(date", df._jdf.queryExecution().executedPlan().toString()))


def test_rows_change_sides_as_seldom_as_the_alphas_allow(spark):
    p = Panel(bars(spark), 84)
    # ranks, their correlations, ranks of these; the sum of alpha_015 follows by symbol
    assert by_day(p.out(**compute_alphas(p))) == 2


def test_levels_are_late(spark):
    p = Panel(bars(spark), 84)
    idle = p.mean(p.close, 3)
    read = p.rank(p.stage(p.close - p.lag(p.close, 1)))
    p.corr(read, p.volume, 3)
    levels = p._levels(p._pending)
    assert str(idle) in {f"Column<'{n}'>" for n in levels[-1]}
    assert not {f"Column<'{n}'>" for n in levels[0]} & {str(idle), str(read)}


def test_total_leaves_the_others_waiting(spark):
    p = Panel(bars(spark), 84)
    slow, move = p.mean(p.close, 3), p.stage(p.close - p.lag(p.close, 1))
    total = p.total(p.abs(move))
    assert len(p._pending) == 4  # the mean, the lag, the difference and the total
    got = p.df.select("symbol", "date", slow.alias("slow"), move.alias("move"), total.alias("total")).toPandas()
    assert (got.total == got.move.abs().sum()).all() and got.slow.notna().sum() == 3 * 26


def test_products_replace_their_factors_at_once(spark):
    p = Panel(bars(spark), 84)
    both = p.stage(p.rank(p.close) * p.rank(p.volume))
    later = p.lag(p.rank(p.open), 1)
    levels = p._levels(p._pending)
    place = {n: i for i, names in enumerate(levels) for n in names}
    name = lambda c: re.findall(r"_c\d+", str(c))[0]
    assert place[name(both)] < place[name(later)]
    assert p.df.select(F.sum(both)).first()[0] > 0
