"""Normal distribution helpers; Spark has no erf, so the tail is a vectorised Arrow function."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


_STEP = 0.5
#: Nodes of the trapezoidal rule; the next one weighs under 1e-19.
_NODES = (_STEP * np.arange(1, 14)) ** 2
_WEIGHTS = np.exp(-_NODES)


def erfc(x: np.ndarray) -> np.ndarray:
    """Complementary error function of a whole array: a power series near 0, elsewhere the trapezoidal rule.

    The rule is applied to exp(-x²) x/π ∫ exp(-t²) / (t² + x²) dt, less the residue of the pole it steps over.
    """
    x = np.asarray(x, dtype=float)
    near = np.where(np.abs(x) < 0.5, x, 0.0)
    term, series = near.copy(), near.copy()
    for n in range(1, 14):
        term = term * -near * near / n
        series = series + term / (2 * n + 1)
    far = np.clip(np.abs(x), 0.5, 40.0)
    square = far * far
    total = 1.0 / square
    for node, weight in zip(_NODES, _WEIGHTS):
        total = total + 2.0 * weight / (node + square)
    pole = np.where(far < np.pi / _STEP, 2.0 / np.expm1(2.0 * np.pi / _STEP * far), 0.0)
    tail = _STEP * far * np.exp(-square) / np.pi * total - pole
    out = np.where(np.abs(x) < 0.5, 1.0 - 2.0 / math.sqrt(math.pi) * series, np.where(x > 0, tail, 2.0 - tail))
    return np.where(np.isnan(x), np.nan, out)


def upper_tail(z: np.ndarray) -> np.ndarray:
    """P(Z > z) of a whole array."""
    return 0.5 * erfc(np.asarray(z, dtype=float) / math.sqrt(2.0))


def upper_point(p: np.ndarray) -> np.ndarray:
    """z with P(Z > z) = p, for 0 < p <= 0.5, by Newton's rule on the logarithm from a bound above."""
    p = np.asarray(p, dtype=float)
    z = np.sqrt(np.maximum(-2.0 * np.log(2.0 * p), 0.0))
    for _ in range(30):
        tail = upper_tail(z)
        z = z + tail * np.log(tail / p) * math.sqrt(2.0 * math.pi) * np.exp(z * z / 2.0)
    return z


@F.pandas_udf(T.DoubleType())
def normal_tail(z: pd.Series) -> pd.Series:
    """P(Z > z)."""
    return pd.Series(upper_tail(z.to_numpy(dtype=float)), index=z.index).where(z.notna())


def onesided_p(t: Column, direction: Column | int) -> Column:
    """p-value of t in the declared direction (+1 or −1)."""
    return normal_tail((t * direction).cast("double"))


def sidak_level(n_tests: int, alpha: float = 0.05) -> float:
    """Two-sided z that keeps the family-wise error of ``n_tests`` tests at ``alpha``."""
    each = 1.0 - (1.0 - alpha) ** (1.0 / n_tests)
    return NormalDist().inv_cdf(1.0 - each / 2.0)


@F.pandas_udf(T.DoubleType())
def sidak_bar(n_tests: pd.Series) -> pd.Series:
    """``sidak_level`` at 0.05 of a whole batch."""
    each = -np.expm1(math.log1p(-0.05) / n_tests.to_numpy(dtype=float))
    return pd.Series(upper_point(each / 2.0), index=n_tests.index).where(n_tests.notna())
