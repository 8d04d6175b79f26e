"""The long panel: one row per (symbol, date), and the window operators on it.

Each operator stages its result as a hidden column and returns a reference to it, so operators nest
freely although Spark does not nest window functions. Trailing operators share one window spec,
hence one Exchange and one Sort. Because (symbol, date) is unique, a symbol holds at most one row
per session, and a trailing window never sees more rows than there are sessions.

A date, however, holds one row per symbol and grows with the data. Cross-sectional operators use a
window over the date only while the source's rows or symbols prove that no date is larger than
``window_group_limit``; beyond it they aggregate and join, and rank through ``operators.ranking``.

Spark sums a sliding frame anew at each row. Moments of long frames are therefore merged from two running
ones, of the tail of one block of rows and the head of the next, so their cost does not depend on the frame.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.rounding import settle, snap
from quantloom.operators import ranking
from quantloom.session import cut, window_group_limit

_HIDDEN = re.compile(r"\b_c\d+\b")

#: Moments of frames of so many rows or more are merged from blocks.
LONG_FRAME = 32


class Panel:
    """A staged long panel. ``max_rows`` is a proven bound on the rows of a date; None means unknown."""

    def __init__(self, df: DataFrame, max_rows: int | None = None, symbol: str = "symbol", date: str = "date"):
        self._df = df
        self._pending: dict[str, tuple[Column, set[str], str | None]] = {}
        self.symbol, self.date = symbol, date
        self.bounded = max_rows is not None and max_rows <= window_group_limit(df.sparkSession)
        self._staged: dict[tuple, str] = {}

    # -- staging ---------------------------------------------------------------------------

    def col(self, name: str) -> Column:
        return F.col(name)

    open = property(lambda self: F.col("open"))
    high = property(lambda self: F.col("high"))
    low = property(lambda self: F.col("low"))
    close = property(lambda self: F.col("close"))
    volume = property(lambda self: F.col("volume"))

    def stage(self, expr: Column, *key) -> Column:
        """Name ``expr`` as a hidden column and return a reference to it; see ``_levels`` for when it is computed."""
        name = f"_c{len(self._staged)}"
        self._staged[key or (name,)] = name
        text = str(expr)
        side = "day" if f"PARTITION BY {self.date}" in text else "symbol" if " OVER (" in text else None
        self._pending[name] = expr, set(_HIDDEN.findall(text)), side
        return F.col(name)

    @staticmethod
    def _levels(pending: dict) -> list[list[str]]:
        """The names of hidden columns by projection: each as late as the formulas that read it allow, so that rows stay narrow.

        From the end, all that can be computed by one side comes before what is left by the other, and in turn; windows of equal
        spec anywhere in a set of formulas share their Exchange, and rows change sides as seldom as the formulas allow.
        What is no window but ends the use of a hidden column follows its inputs at once.
        """

        def backwards(side):
            left, levels = set(pending), []
            while left:
                needed = set().union(*(pending[n][1] for n in left))
                ready = [n for n in pending if n in left and n not in needed and pending[n][2] in (None, side)]
                if ready:
                    levels.append((side, ready))
                    left -= set(ready)
                else:
                    side = "day" if side == "symbol" else "symbol"
            levels.reverse()
            sides = ["symbol", *(s for s, ns in levels if any(pending[n][2] for n in ns))]
            return sum(x != y for x, y in zip(sides, sides[1:])), levels

        # rows come dealt by symbol
        made = [ns for _, ns in min((backwards(s) for s in ("symbol", "day")), key=lambda x: x[0])[1]]
        at = {n: i for i, ns in enumerate(made) for n in ns}
        last = {r: 0 for r in at}
        for n, i in at.items():
            for r in pending[n][1] & at.keys():
                last[r] = max(last[r], i)
        for n in [n for ns in made for n in ns]:
            reads = pending[n][1] & at.keys()
            if pending[n][2] is None and any(last[r] <= at[n] for r in reads):
                latest = max(at[r] for r in reads)
                at[n] = (latest + math.floor(latest) + 1) / 2  # before the next windows, whose rows may be dealt anew
        return [[n for n in at if at[n] == i] for i in sorted(set(at.values()))]

    def _with(self, pending: dict) -> DataFrame:
        df = self._df
        for names in self._levels(pending):
            df = df.withColumns({n: pending[n][0] for n in names})
        return df

    @property
    def df(self) -> DataFrame:
        pending, self._pending = self._pending, {}
        self._df = self._with(pending)
        return self._df

    @df.setter
    def df(self, value: DataFrame) -> None:
        self._df = value

    def _once(self, build, *key) -> Column:
        """Stage ``build()`` unless an operator with the same arguments is staged already."""
        key = tuple(str(k) for k in key)
        if key in self._staged:
            return F.col(self._staged[key])
        return self.stage(build(), *key)

    def out(self, **columns: Column) -> DataFrame:
        """symbol, date and the named results, rounded to the grid both engines agree on."""
        made = {n: self.stage(settle(c.cast("double"))) for n, c in columns.items()}
        return self.df.select(
            F.col(self.symbol), F.col(self.date).cast("string").alias(self.date), *[c.alias(n) for n, c in made.items()]
        )

    # -- element-wise ------------------------------------------------------------------------

    def lit(self, v) -> Column:
        return F.lit(v)

    def abs(self, x):
        return F.abs(x)

    def sign(self, x):
        return F.signum(x)

    def ln(self, x):
        return F.when(x > 0, F.ln(x))

    def log1p(self, x):
        return F.log1p(x)

    def exp(self, x):
        return F.exp(x)

    def sqrt(self, x):
        return F.sqrt(x)

    def power(self, x, c):
        return F.pow(x, F.lit(float(c)))

    def snap(self, x):
        return snap(x)

    def floor(self, x):
        return F.floor(x).cast("double")

    def greatest(self, *xs):
        return F.greatest(*xs)

    def least(self, *xs):
        return F.least(*xs)

    def div(self, a, b):
        return F.try_divide(a, b)

    def iff(self, cond, a, b):
        """a where cond holds, else b; an unknown condition counts as false."""
        return F.when(cond, a).otherwise(b)

    def flag(self, cond):
        return F.coalesce(cond, F.lit(False)).cast("int")

    def coalesce(self, *xs):
        return F.coalesce(*xs)

    def isnull(self, x):
        return x.isNull()

    def notnull(self, x):
        return x.isNotNull()

    def null(self):
        return F.lit(None).cast("double")

    # -- trailing windows --------------------------------------------------------------------

    def _w(self):
        return Window.partitionBy(self.symbol).orderBy(self.date)

    def _frame(self, w: int):
        return self._w().rowsBetween(-(w - 1), 0)

    def _past(self):
        return self._w().rowsBetween(Window.unboundedPreceding, 0)

    def lag(self, x, n: int):
        return self._once(lambda: F.lag(x, n).over(self._w()), "lag", x, n)

    def lead(self, x, n: int):
        """A label reads forward; features never do."""
        return self._once(lambda: F.lead(x, n).over(self._w()), "lead", x, n)

    def rownum(self):
        return self._once(lambda: F.row_number().over(self._w()), "rownum")

    def rows_left(self):
        """Rows of the symbol after this one."""
        back = Window.partitionBy(self.symbol).orderBy(F.col(self.date).desc())
        return self._once(lambda: F.row_number().over(back) - 1, "rows_left")

    def _roll(self, name, fn, x, w, minp=None, shift=0):
        minp = w if minp is None else minp
        frame = self._w().rowsBetween(-(w - 1) - shift, -shift)
        return self._once(
            lambda: F.when(F.count(x).over(frame) >= minp, fn(x).over(frame)), name, x, w, minp, shift
        )

    def mean(self, x, w, minp=None, shift=0):
        return self._roll("mean", F.avg, x, w, minp, shift)

    def sum(self, x, w, minp=None):
        return self._roll("sum", F.sum, x, w, minp)

    def min(self, x, w, minp=None):
        return self._roll("min", F.min, x, w, minp)

    def max(self, x, w, minp=None):
        return self._roll("max", F.max, x, w, minp)

    def std(self, x, w, minp=None, ddof=1, shift=0):
        """Standard deviation; a flat frame gives exactly zero."""
        if w >= LONG_FRAME and not shift:
            return self._once(lambda: self._long_std(x, w, minp, ddof), f"std{ddof}", x, w, minp, shift)
        fn = F.stddev_samp if ddof == 1 else F.stddev_pop
        return self._roll(f"std{ddof}", fn, x, w, minp, shift)

    def _long(self, agg, name: str, x, w: int) -> tuple[Column, Column]:
        """``agg`` over the part of the frame in the row's block of ``w`` rows, and over its part in the block before."""
        t = self.rownum()
        at = (t - 1) % w
        block = self._once(lambda: F.floor((t - 1) / w), "block", w)
        # by row number, so that both directions agree where dates repeat
        head = Window.partitionBy(self.symbol, block).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
        tail = Window.partitionBy(self.symbol, block).orderBy(t.desc()).rowsBetween(Window.unboundedPreceding, 0)
        new = self._once(lambda: agg.over(head), "head", name, x, w)
        rest = self._once(lambda: agg.over(tail), "tail", name, x, w)
        back = Window.partitionBy(self.symbol).orderBy(t)
        old = self._once(lambda: F.when(at < w - 1, F.lag(rest, w - 1).over(back)), "old", name, x, w)
        return new, old

    def _long_flat(self, x, w):
        """Whether all values of the frame are equal."""
        lo, hi = F.least(*self._long(F.min(x), "min", x, w)), F.greatest(*self._long(F.max(x), "max", x, w))
        return lo == hi

    def _long_sum(self, new, old):
        return F.coalesce(new, F.lit(0.0)) + F.coalesce(old, F.lit(0.0))

    def _long_moment(self, x, y, w):
        """Count and sum of products of deviations from the frame's means; ``x`` and ``y`` are null on the same rows."""
        n, m = self._long(F.count(x), "count", x, w)
        m = F.coalesce(m, F.lit(0))
        agg = F.var_pop(x) if str(x) == str(y) else F.covar_pop(x, y)
        new, old = self._long(agg, f"co {y}", x, w)
        gaps = [F.coalesce(a - b, F.lit(0.0)) for a, b in (self._long(F.avg(c), "avg", c, w) for c in (x, y))]
        between = gaps[0] * gaps[1] * F.coalesce(F.try_divide(n * m, n + m), F.lit(0.0))
        return n + m, self._long_sum(new * n, old * m) + between

    def _long_std(self, x, w, minp, ddof):
        x = self.stage(x.cast("double"))
        n, squares = self._long_moment(x, x, w)
        spread = F.when(self._long_flat(x, w), 0.0).otherwise(F.sqrt(F.try_divide(squares, n - ddof)))
        return F.when((n >= (w if minp is None else minp)) & (n > ddof), spread)

    def _seen(self, x, w):
        """Values of the frame, as a difference of running counts."""
        n = self.cumcount(x)
        return self._once(lambda: n - F.coalesce(F.lag(n, w).over(self._w()), F.lit(0)), "seen", x, w)

    def _latest(self, x, w):
        """The values of the frame, latest first, as columns."""
        return [x.cast("double"), *[self.lag(x, k).cast("double") for k in range(1, w)]]

    def _flat(self, x, w):
        if w >= LONG_FRAME:
            fr = self._frame(w)
            return self._once(lambda: F.min(x).over(fr) == F.max(x).over(fr), "flat", x, w)
        values = self._latest(x, w) * (2 if w == 1 else 1)
        return self._once(lambda: F.least(*values) == F.greatest(*values), "flat", x, w)

    def _central(self, x, w, power: int):
        """Sum of that power of the deviations from the frame's mean, in two passes over the frame's values."""
        zero, values = F.lit(0.0), self._latest(x, w)
        total = lambda terms: sum((F.coalesce(c, zero) for c in terms), zero)
        mean = self._once(lambda: F.try_divide(total(values), self._seen(x, w)), "frame mean", x, w)

        def build():
            gaps = [v - mean for v in values]
            return total(reduce(lambda a, b: a * b, [gap] * power) for gap in gaps)

        return self._once(build, "central", x, w, power)

    def _skewness(self, x, w):
        """``F.skewness`` over the frame. Spark updates its moments anew for every row of a frame at every row, so short frames are summed as columns."""
        if w >= LONG_FRAME:
            return F.skewness(x).over(self._frame(w))
        m2, n = self._central(x, w, 2), self._seen(x, w)
        return F.try_divide(F.sqrt(n.cast("double")) * self._central(x, w, 3), F.sqrt(m2 * m2 * m2))

    def _kurtosis(self, x, w):
        """``F.kurtosis`` over the frame, in the same way."""
        if w >= LONG_FRAME:
            return F.kurtosis(x).over(self._frame(w))
        m2 = self._central(x, w, 2)
        return F.try_divide(self._seen(x, w) * self._central(x, w, 4), m2 * m2) - 3

    def skew(self, x, w, minp=None):
        """Bias-corrected skewness, 0 on a flat frame."""

        def build():
            n = self._seen(x, w).cast("double")
            fix = F.sqrt(n * (n - 1)) / (n - 2)
            value = F.when(self._flat(x, w), F.lit(0.0)).otherwise(fix * self._skewness(x, w))
            return F.when(n >= (w if minp is None else minp), value)

        return self._once(build, "skew", x, w, minp)

    def kurt(self, x, w, minp=None, corrected=True):
        """Excess kurtosis, bias-corrected or of the population."""

        def build():
            n = self._seen(x, w).cast("double")
            k = self._kurtosis(x, w)
            flat = self._flat(x, w)
            if corrected:
                value = F.when(flat, -3.0).otherwise((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * k + 6))
            else:
                value = F.when(~flat, k)
            return F.when(n >= (w if minp is None else minp), value)

        return self._once(build, "kurt", x, w, minp, corrected)

    def pctile(self, x, q, w, minp=None):
        """Linear-interpolated percentile of the frame; short frames are sorted as arrays of lags, not counted in a map at each row."""
        if w >= LONG_FRAME:
            return self._roll(f"pct{q}", lambda c: F.percentile(c, F.lit(q)), x, w, minp)

        def build():
            n = self._seen(x, w)
            # missing values come first
            a = self._once(lambda: F.sort_array(F.array(*self._latest(x, w))), "sorted", x, w)
            at = (n - 1) * F.lit(float(q))
            low, high = F.floor(at), F.ceil(at)
            lo, hi = (F.get(a, (w - n + k).cast("int")) for k in (low, high))
            value = F.when(lo == hi, lo).otherwise((high - at) * lo + (at - low) * hi)
            return F.when(n >= (w if minp is None else minp), value)

        return self._once(build, f"pct{q}", x, w, minp)

    def _list(self, x, w):
        return F.collect_list(x).over(self._frame(w))

    def ts_rank(self, x, w):
        """Average-tie percentile rank of the current value in its frame."""

        def build():
            a = self.stage(self._list(x, w))
            lower = F.size(F.filter(a, lambda y: y < x))
            same = F.size(F.filter(a, lambda y: y == x))
            return F.when(F.size(a) == w, (lower + (same + 1) / 2) / F.lit(float(w)))

        return self._once(build, "ts_rank", x, w)

    def _since(self, x, w, pick, name):
        def build():
            a = self.stage(self._list(x, w))
            return F.when(F.size(a) == w, (F.size(a) - F.array_position(a, pick(a))).cast("double"))

        return self._once(build, name, x, w)

    def argmax(self, x, w):
        """Rows since the maximum; the oldest one counts on ties."""
        return self._since(x, w, F.array_max, "argmax")

    def argmin(self, x, w):
        return self._since(x, w, F.array_min, "argmin")

    def weighted(self, x, weights: list[float]):
        """Sum of frame values times ``weights``, oldest first; null until the frame is full."""
        w = len(weights)

        def build():
            a = self.stage(self._list(x, w))
            pairs = F.zip_with(a, F.array(*[F.lit(float(v)) for v in weights]), lambda p, q: p * q)
            return F.when(F.size(a) == w, F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v))

        return self._once(build, "weighted", x, weights)

    def decay_linear(self, x, w):
        total = w * (w + 1) / 2
        return self.weighted(x, [(i + 1) / total for i in range(w)])

    def mad(self, x, w):
        """Mean absolute deviation from the frame mean."""

        def build():
            a = self.stage(self._list(x, w))
            m = self.mean(x, w)
            dev = F.aggregate(F.transform(a, lambda v: F.abs(v - m)), F.lit(0.0), lambda s, v: s + v)
            return F.when(F.size(a) == w, dev / F.lit(float(w)))

        return self._once(build, "mad", x, w)

    def corr(self, x, y, w, minp=None):
        """Pearson correlation over the pairs of the frame, null when either side is flat."""

        def build():
            a = self.stage(F.when(x.isNotNull() & y.isNotNull(), x.cast("double")))
            b = self.stage(F.when(x.isNotNull() & y.isNotNull(), y.cast("double")))
            if w >= LONG_FRAME:
                n, both = self._long_moment(a, b, w)
                spread = F.sqrt(self._long_moment(a, a, w)[1]) * F.sqrt(self._long_moment(b, b, w)[1])
                flat = self._long_flat(a, w) | self._long_flat(b, w)
                return F.when((n >= (minp or w)) & ~flat, snap(F.try_divide(both, spread)))
            fr = self._frame(w)
            flat = (F.min(a).over(fr) == F.max(a).over(fr)) | (F.min(b).over(fr) == F.max(b).over(fr))
            spread = F.stddev_samp(a).over(fr) * F.stddev_samp(b).over(fr)
            value = F.try_divide(F.covar_samp(a, b).over(fr), spread)
            return F.when((F.count(a).over(fr) >= (minp or w)) & ~flat, snap(value))

        return self._once(build, "corr", x, y, w, minp)

    def cov(self, x, y, w, minp=None):
        def build():
            a = self.stage(F.when(x.isNotNull() & y.isNotNull(), x.cast("double")))
            b = self.stage(F.when(x.isNotNull() & y.isNotNull(), y.cast("double")))
            if w >= LONG_FRAME:
                n, both = self._long_moment(a, b, w)
                return F.when(n >= (minp or w), snap(F.try_divide(both, n - 1)))
            fr = self._frame(w)
            return F.when(F.count(a).over(fr) >= (minp or w), snap(F.covar_samp(a, b).over(fr)))

        return self._once(build, "cov", x, y, w, minp)

    def slope(self, y, x, w, minp=None):
        """Least-squares slope of y on x over the frame."""

        def build():
            if w >= LONG_FRAME:
                a, b = (self.stage(F.when(x.isNotNull() & y.isNotNull(), c.cast("double"))) for c in (x, y))
                seen = self._long_sum(*self._long(F.count(y), "count", y, w))
                value = F.try_divide(self._long_moment(a, b, w)[1], self._long_moment(a, a, w)[1])
                return F.when((seen >= (minp or w)) & ~self._long_flat(x, w), value)
            fr = self._frame(w)
            flat = F.min(x).over(fr) == F.max(x).over(fr)
            return F.when((F.count(y).over(fr) >= (minp or w)) & ~flat, F.regr_slope(y, x).over(fr))

        return self._once(build, "slope", y, x, w, minp)

    # -- cumulative ----------------------------------------------------------------------------

    def cumsum(self, x):
        return self._once(lambda: F.sum(x).over(self._past()), "cumsum", x)

    def cummax(self, x):
        return self._once(lambda: F.max(x).over(self._past()), "cummax", x)

    def cumcount(self, x):
        return self._once(lambda: F.count(x).over(self._past()), "cumcount", x)

    def cumprod(self, x):
        return self._once(lambda: F.product(x).over(self._past()), "cumprod", x)

    def first(self, x):
        return self._once(lambda: F.first(x).over(self._past()), "first", x)

    def ffill(self, x):
        """Last non-null value so far."""
        return self._once(lambda: F.last(x, ignorenulls=True).over(self._past()), "ffill", x)

    def run_length(self, cond):
        """Length of the run of true ``cond`` ending at this row."""
        t = self.rownum()
        broken = self.ffill(self.stage(F.when(~F.coalesce(cond, F.lit(False)), t)))
        return t - F.coalesce(broken, F.lit(0))

    def ewm(self, x, alpha: float, adjust: bool, minp: int = 0):
        """Exponentially weighted mean, without a recursion.

        The decayed sum up to a row is the part inside the row's block of rows plus the decayed total of the last
        earlier block that holds values; blocks are so long that whatever stands before weighs under 1e-19 of that.
        Until a block has a value of its own the mean is that of the earlier block, however long ago it was.
        """

        def build():
            keep = 1.0 - alpha
            if keep == 0.0:
                return F.when(F.count(x).over(self._past()) >= minp, self.ffill(x))
            need = max(4, math.ceil(-46.0 / math.log(keep)))
            # a few common sizes, so that averages of many spans share their blocks and sorts
            size = 64
            while size < need:
                size *= 4
            t = self.rownum()
            began = self._once(lambda: F.min(F.when(x.isNotNull(), t)).over(self._past()), "began", x)
            block = self._once(lambda: F.floor((t - 1) / size), "block", size)
            at = (t - 1) - block * size
            weight = F.lit(1.0) if adjust else F.when(t == began, 1.0).otherwise(alpha)
            grown = F.pow(F.lit(keep), -at.cast("double"))
            num = self.stage(F.when(x.isNotNull(), weight * x * grown))
            den = self.stage(F.when(x.isNotNull(), weight * grown))
            whole = Window.partitionBy(self.symbol, block)
            inside = whole.orderBy(self.date).rowsBetween(Window.unboundedPreceding, 0)
            earlier = Window.partitionBy(self.symbol).orderBy(block).rangeBetween(Window.unboundedPreceding, -1)
            total = [self.stage(F.sum(c).over(whole)) for c in (num, den)]
            old_top, old_bottom = (self.stage(F.last(c, ignorenulls=True).over(earlier)) for c in total)
            gap = block - self.stage(F.last(F.when(total[1].isNotNull(), block), ignorenulls=True).over(earlier))
            carry = F.pow(F.lit(keep**size), gap.cast("double"))
            zero = F.lit(0.0)
            new_top, new_bottom = (self.stage(F.sum(c).over(inside)) for c in (num, den))
            top = new_top + F.coalesce(carry * old_top, zero)
            bottom = new_bottom + F.coalesce(carry * old_bottom, zero)
            value = F.when(new_bottom.isNull(), F.try_divide(old_top, old_bottom)).otherwise(F.try_divide(top, bottom))
            return F.when((t >= began) & (F.count(x).over(self._past()) >= minp), value)

        return self._once(build, "ewm", x, alpha, adjust, minp)

    def ema(self, x, span: int, adjust: bool = False, minp: int = 0):
        return self.ewm(x, 2.0 / (span + 1.0), adjust, minp)

    # -- cross-section ---------------------------------------------------------------------------

    def _day(self, by=()):
        return Window.partitionBy(self.date, *by)

    def _cs(self, name, aggs: dict, x, by=()):
        """Group aggregates of ``x`` per (date, *by), as columns."""
        key = ("cs", name, x, tuple(by))
        key = tuple(str(k) for k in key)
        names = list(aggs)
        if key + (names[0],) not in self._staged:
            if self.bounded:
                for n, fn in aggs.items():
                    self.stage(fn(x).over(self._day(by)), *key, n)
            else:
                self.df = cut(self.df.withColumn("_x", x))
                keys = [self.date, *by]
                hidden = [f"_c{len(self._staged) + i}" for i in range(len(names))]
                groups = self.df.groupBy(*keys).agg(*[aggs[n](F.col("_x")).alias(h) for n, h in zip(names, hidden)])
                # one row per session and label: bounded by the calendar, broadcast when by is empty
                groups = F.broadcast(groups) if not by else groups
                self.df = ranking.null_safe(self.df, groups, keys, "left").drop("_x")
                for n, h in zip(names, hidden):
                    self._staged[key + (n,)] = h
        return [F.col(self._staged[key + (n,)]) for n in names]

    def cs_count(self, x, by=()):
        return self._cs("count", {"n": F.count}, x, by)[0]

    def cs_sum(self, x, by=()):
        return self._cs("sum", {"s": F.sum}, x, by)[0]

    def cs_mean(self, x, by=()):
        return self._cs("mean", {"m": F.avg}, x, by)[0]

    def cs_std(self, x, ddof=1, by=()):
        """Standard deviation per date, exactly 0 when all values are equal."""
        fn = F.stddev_samp if ddof == 1 else F.stddev_pop
        sd, lo, hi = self._cs(f"std{ddof}", {"sd": fn, "lo": F.min, "hi": F.max}, x, by)
        return F.when(lo == hi, sd * 0.0).otherwise(sd)

    def cs_pctile(self, x, q, by=()):
        """Linear-interpolated percentile per date."""
        if self.bounded:
            return self._once(lambda: F.percentile(x, F.lit(q)).over(self._day(by)), "cs_pct", x, q, by)
        name = f"_c{len(self._staged)}"
        self._staged[("cs_pct", str(x), str(q), str(by))] = name
        self.df = cut(self.df.withColumn("_x", x))
        keys = [self.date, *by]
        table = ranking.percentiles(self.df, keys, "_x", {name: q})
        self.df = ranking.null_safe(self.df, table, keys, "left").drop("_x")
        return F.col(name)

    def rank(self, x, by=()):
        """Average-tie percentile rank within the date (and ``by``), nulls left out."""
        if self.bounded:

            def build():
                v = self.stage(x)
                # one window spec for position, ties and size: one sort
                w = self._day(by).orderBy(v.asc_nulls_last())
                ties = F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow))
                n = F.count(v).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
                return F.when(v.isNotNull(), (F.rank().over(w) + (ties - 1) / 2) / n)

            return self._once(build, "rank", x, tuple(by))
        key = tuple(str(k) for k in ("rank", x, tuple(by)))
        if key not in self._staged:
            name = f"_c{len(self._staged)}"
            self._staged[key] = name
            self.df = ranking.with_pct_rank(self.df.withColumn("_x", x), [self.date, *by], "_x", name).drop("_x")
        return F.col(self._staged[key])

    def place(self, x, descending=False):
        """1-based position within the date by (x, symbol), null where x is null."""
        if self.bounded:

            def build():
                v = self.stage(x)
                first = v.desc_nulls_last() if descending else v.asc_nulls_last()
                return F.when(v.isNotNull(), F.row_number().over(self._day().orderBy(first, self.symbol)))

            return self._once(build, "place", x, descending)
        name = f"_c{len(self._staged)}"
        self._staged[(name,)] = name
        self.df = cut(self.df.withColumn("_x", -x if descending else x))
        self.df = ranking.with_ordinal(self.df, [self.date], "_x", self.symbol, name, "_total").drop("_x", "_total")
        return F.col(name)

    def total(self, x):
        """Sum over the whole column."""
        key = ("total", str(x))
        if key not in self._staged:
            name = f"_c{len(self._staged)}"
            self._staged[key] = name
            # only what the sum reads is computed for it, and what waits goes on waiting
            reads, needed = set(_HIDDEN.findall(str(x))), {}
            while reads & self._pending.keys() - needed.keys():
                needed |= {n: self._pending[n] for n in reads & self._pending.keys()}
                reads |= set().union(*(of for _, of, _ in needed.values()))
            sums = self._with({n: v for n, v in self._pending.items() if n in needed}).agg(F.sum(x))
            self._pending[name] = sums.scalar(), set(), None
        return F.col(self._staged[key])
