"""Row-wise operators: Column in, Column out. A missing value is always null, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def add(a: Column, b: Column) -> Column:
    return a + b


def sub(a: Column, b: Column) -> Column:
    return a - b


def mul(a: Column, b: Column) -> Column:
    return a * b


def div(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a, b)


def _both(a: Column, b: Column, value: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), value)


def max_(a: Column, b: Column) -> Column:
    """Larger of two, null when either is null (``greatest`` alone skips nulls)."""
    return _both(a, b, F.greatest(a, b))


def min_(a: Column, b: Column) -> Column:
    return _both(a, b, F.least(a, b))


def gt(a: Column, b: Column) -> Column:
    return (a > b).cast("double")


def lt(a: Column, b: Column) -> Column:
    return (a < b).cast("double")


def where(cond: Column, a: Column, b: Column) -> Column:
    """a where cond > 0, else b; null where cond is null."""
    return F.when(cond.isNull(), None).when(cond > 0, a).otherwise(b)


def neg(x: Column) -> Column:
    return -x


def abs_(x: Column) -> Column:
    return F.abs(x)


def sign(x: Column) -> Column:
    return F.signum(x)


def log_sym(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def sqrt_sym(x: Column) -> Column:
    return F.signum(x) * F.sqrt(F.abs(x))


def pow_sym(x: Column, c: float) -> Column:
    return F.signum(x) * F.pow(F.abs(x), F.lit(float(c)))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(float(lo)), F.least(x, F.lit(float(hi)))))


def finite(x: Column) -> Column:
    """NaN and both infinities become null: the rule every source applies at ingest."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def typical_price(high: Column, low: Column, close: Column) -> Column:
    return (high + low + close) / 3


def above_flag(x: Column, threshold: float) -> Column:
    """1 when x exceeds the threshold, else 0, also on null."""
    return F.coalesce(x > threshold, F.lit(False)).cast("int")
