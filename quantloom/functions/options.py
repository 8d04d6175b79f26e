"""Option arithmetic as Arrow functions over whole batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.functions.normal import upper_tail


def price(spot, strike, years, rate, sigma, call):
    """Black-Scholes price of European options, element by element."""
    root = sigma * np.sqrt(years)
    d1 = (np.log(spot / strike) + (rate + sigma * sigma / 2) * years) / root
    d2 = d1 - root
    paid = strike * np.exp(-rate * years)
    side = np.where(call, 1.0, -1.0)
    return side * (spot * upper_tail(-side * d1) - paid * upper_tail(-side * d2))


@F.pandas_udf(T.DoubleType())
def implied_vol(
    quote: pd.Series, spot: pd.Series, strike: pd.Series, years: pd.Series, rate: pd.Series, call: pd.Series
) -> pd.Series:
    """Volatility in [1%, 500%] by 60 halvings; null at or below the no-arbitrage bound."""
    q, s, k, t, r = (x.to_numpy(dtype=float) for x in (quote, spot, strike, years, rate))
    is_call = call.to_numpy(dtype=bool)
    paid = k * np.exp(-r * t)
    bound = np.maximum(0.0, np.where(is_call, s - paid, paid - s))
    valid = (q > bound + 1e-6) & (t > 0)
    low, high = np.full(len(q), 0.01), np.full(len(q), 5.0)
    t = np.where(valid, t, 1.0)
    for _ in range(60):
        mid = (low + high) / 2
        above = price(s, k, t, r, mid, is_call) > q
        low, high = np.where(above, low, mid), np.where(above, mid, high)
    return pd.Series(np.where(valid, (low + high) / 2, np.nan), index=quote.index).where(valid)
