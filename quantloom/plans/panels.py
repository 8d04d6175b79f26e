"""Queries over the two panels: element-wise, trailing, indicator, cross-sectional and alpha operators."""

from __future__ import annotations

from quantloom.operators import indicators as ind
from quantloom.operators.alphas import ALPHAS, compute_alphas, scale
from quantloom.plans.registry import panel_query

# -- element-wise ------------------------------------------------------------------------------

BODY = lambda p: p.close - p.open


def _both(p, a, b, value):
    return p.iff(p.notnull(a) & p.notnull(b), value, p.null())


def _signed(p, x, value):
    return p.sign(x) * value


ELEMENTWISE = {
    "add": lambda p: p.high + p.low,
    "sub": lambda p: p.high - p.low,
    "mul": lambda p: p.close * p.volume,
    "div": lambda p: p.div(p.volume, BODY(p)),
    "max": lambda p: _both(p, p.open, p.lag(p.close, 1), p.greatest(p.open, p.lag(p.close, 1))),
    "min": lambda p: _both(p, p.open, p.lag(p.close, 1), p.least(p.open, p.lag(p.close, 1))),
    "gt": lambda p: (p.close > p.lag(p.close, 1)).cast("int"),
    "lt": lambda p: (p.close < p.lag(p.close, 1)).cast("int"),
    "where": lambda p: p.iff(
        p.isnull(p.lag(p.close, 1)), p.null(), p.iff(p.close - p.lag(p.close, 1) > 0, p.high, p.low)
    ),
    "neg": lambda p: -p.close,
    "abs": lambda p: p.abs(BODY(p)),
    "sign": lambda p: p.sign(BODY(p)),
    "log_sym": lambda p: _signed(p, BODY(p), p.log1p(p.abs(BODY(p)))),
    "sqrt_sym": lambda p: _signed(p, BODY(p), p.sqrt(p.abs(BODY(p)))),
    "pow_sym": lambda p: _signed(p, BODY(p), p.power(p.abs(BODY(p)), 1.5)),
    "clip": lambda p: _both(p, p.lag(BODY(p), 1), p.close, p.greatest(p.lit(-5.0), p.least(p.lag(BODY(p), 1), p.lit(5.0)))),
    "fillna_seen": lambda p: _fill_seen(p, p.stage(p.iff(p.volume > 25, p.volume, p.null())), 0.0),
    "field_returns": lambda p: p.ln(p.close) - p.lag(p.stage(p.ln(p.close)), 1),
    "field_dollar_volume": lambda p: p.close * p.volume,
    "field_typical": lambda p: (p.high + p.low + p.close) / 3,
    "log": lambda p: p.ln(BODY(p)),
    "sign_op": lambda p: p.sign(p.lag(p.volume, 1) - p.volume),
    "abs_op": lambda p: p.abs(p.lag(p.volume, 1) - p.volume),
    "nonlinear_transforms": lambda p: {
        "squared": BODY(p) * BODY(p),
        "root": p.sqrt(p.abs(BODY(p))),
        "log": p.log1p(p.abs(BODY(p))),
    },
    "feature_interactions": lambda p: _interactions(p),
}


def _fill_seen(p, x, value):
    """null → value, but only from the symbol's first observation on."""
    return p.iff(p.cumcount(x) > 0, p.coalesce(x, p.lit(value)), p.null())


def _interactions(p):
    r = p.stage(ind.log_returns(p))
    features = {
        "ret": r,
        "vol": p.std(r, 20),
        "rel": p.stage(p.div(p.volume, p.mean(p.volume, 20))),
        "rng": p.stage(p.div(p.high - p.low, p.close)),
    }
    names = list(features)
    return {
        f"{a}_x_{b}": features[a] * features[b] for i, a in enumerate(names) for b in names[i + 1 :]
    }


for _name, _fn in ELEMENTWISE.items():
    panel_query(_name, _fn)


def _breadth(p):
    up = p.stage(p.iff(p.isnull(p.lag(p.close, 1)), p.null(), p.flag(p.close > p.lag(p.close, 1))))
    return p.cs_mean(up)


panel_query("market_breadth_strong", lambda p: p.flag(_breadth(p) > 0.6), "dense")
panel_query(
    "vix_spike",
    lambda p: p.flag(ind.pct_change(p, p.cs_std(p.stage(ind.log_returns(p)))) > 0.15),
    "dense",
)

# -- trailing windows ----------------------------------------------------------------------------


def _zscore(p, w):
    sd = p.std(p.close, w)
    return p.div(p.close - p.mean(p.close, w), p.iff(sd > 0, sd, p.null()))


TRAILING = {
    "delay": lambda p: p.lag(p.close, 3),
    "delta": lambda p: p.close - p.lag(p.close, 3),
    "pct_change": lambda p: ind.pct_change(p, p.close, 5),
    "ts_mean": lambda p: p.mean(p.close, 10),
    "ts_std": lambda p: p.std(p.close, 10),
    "ts_sum": lambda p: p.sum(p.volume, 10),
    "ts_min": lambda p: p.min(p.low, 10),
    "ts_max": lambda p: p.max(p.high, 10),
    "ts_rank": lambda p: p.ts_rank(p.close, 10),
    "ts_argmax": lambda p: p.argmax(p.volume, 10),
    "ts_argmin": lambda p: p.argmin(p.volume, 10),
    "ts_zscore": lambda p: _zscore(p, 20),
    "decay_linear": lambda p: p.decay_linear(p.close, 10),
    "ema": lambda p: p.ema(p.close, 20, adjust=True, minp=20),
    "ts_corr": lambda p: p.corr(p.close, p.volume, 10),
    "ts_cov": lambda p: p.cov(p.close, p.volume, 10),
    "op_delay": lambda p: p.lag(p.open, 1),
    "op_delta": lambda p: p.open - p.lag(p.open, 1),
    "op_correlation": lambda p: p.corr(p.open, p.close, 20),
    "op_covariance": lambda p: p.cov(p.open, p.close, 20),
    "op_ts_rank": lambda p: p.ts_rank(p.volume, 20),
    "op_ts_min": lambda p: p.min(p.close, 20),
    "op_ts_max": lambda p: p.max(p.close, 20),
    "op_ts_argmax": lambda p: p.argmax(p.close, 20),
    "op_ts_argmin": lambda p: p.argmin(p.close, 20),
    "op_ts_sum": lambda p: p.sum(p.close, 20),
    "op_ts_mean": lambda p: p.mean(p.volume, 20),
    "op_ts_stddev": lambda p: p.std(p.volume, 20),
    "op_decay_linear": lambda p: p.decay_linear(p.volume, 5),
    "adv": lambda p: ind.adv(p, 20),
    "log_returns": lambda p: ind.log_returns(p),
    "volatility": lambda p: ind.volatility(p, 20),
    "sma": lambda p: p.mean(p.close, 20),
    "momentum": lambda p: ind.pct_change(p, p.close, 10),
    "roc": lambda p: p.lit(100.0) * (p.close - p.lag(p.close, 10)) / (p.lag(p.close, 10) + 1e-10),
    "volume_std": lambda p: p.std(p.volume, 20),
    "returns_skewness": lambda p: p.skew(p.stage(ind.log_returns(p)), 20),
    "returns_kurtosis": lambda p: p.kurt(p.stage(ind.log_returns(p)), 20),
    "time_window_features": ind.time_window_features,
    "momentum_features": ind.momentum_features,
    "market_time_windows": lambda p: _market_windows(p),
    "higher_order_stats": ind.higher_order_stats,
    "trend_features": ind.trend_features,
    "fft_components": ind.fft_components,
    "simple_critical": ind.simple_critical,
    "trend_metrics": ind.trend_metrics,
    "pct_52w_high": ind.pct_52w_high,
    "amihud": ind.amihud,
    "reversal": lambda p: {
        "reversal_5": -ind.pct_change(p, p.close, 5),
        "reversal_21": -ind.pct_change(p, p.close, 21),
    },
    "vol_estimators": ind.vol_estimators,
    "label_variants": ind.label_variants,
    "vol20": lambda p: p.std(p.stage(ind.pct_change(p, p.close)), 20, 10) * 252**0.5,
}


def _market_windows(p, windows=(5, 20)):
    """Market return over a window, under the window's name."""
    return {f"market_returns_{w}d": p.cs_mean(p.stage(ind.log_returns(p, periods=w))) for w in windows}


for _name, _fn in TRAILING.items():
    panel_query(_name, _fn)

# -- indicators ------------------------------------------------------------------------------------

INDICATORS = {
    "op_ema": lambda p: p.ema(p.close, 20),
    "bollinger_bands": ind.bollinger_bands,
    "bb_width": ind.bb_width,
    "macd": ind.macd,
    "rsi": ind.rsi,
    "atr": ind.atr,
    "adx": ind.adx,
    "stochastic": ind.stochastic,
    "cci": ind.cci,
    "williams_r": ind.williams_r,
    "obv": ind.obv,
    "cmf": ind.cmf,
    "mfi": ind.mfi,
    "trix": ind.trix,
    "dpo": ind.dpo,
    "keltner": ind.keltner,
    "ichimoku": ind.ichimoku,
    "supertrend": ind.supertrend,
    "vwap_ratio": ind.vwap_ratio,
    "price_above_sma": lambda p: p.flag(p.close > p.mean(p.close, 20)),
    "price_above_ema": lambda p: p.flag(p.close > p.ema(p.close, 50)),
    "golden_cross": lambda p: p.flag(p.mean(p.close, 10) > p.mean(p.close, 50)),
    "adx_strong_trend": lambda p: p.flag(ind.adx(p) > 25.0),
    "macd_positive": lambda p: p.flag(ind.macd(p)["macd"] > 0),
    "consecutive_up_days": lambda p: ind.streak(p, up=True),
    "consecutive_down_days": lambda p: ind.streak(p, up=False),
    "returns_1d_positive": lambda p: p.flag(ind.log_returns(p) > 0),
    "volume_increasing": lambda p: p.flag(p.volume > p.mean(p.volume, 5)),
    "rsi_oversold": lambda p: p.flag(ind.rsi(p) < 30.0),
    "bb_squeeze": lambda p: p.flag(ind.bb_width(p) < 0.01),
    "spy_direction_aligned": lambda p: _aligned(p),
    "technical_dispatch": lambda p: ind.dispatch(p),
    "market_features": lambda p: _market_features(p),
    "atr_panel": lambda p: ind.atr(p, 14),
}


def _aligned(p):
    """1 when the symbol and the equal-weight market moved to the same side."""
    r = p.stage(ind.pct_change(p, p.close))
    return p.flag(p.sign(r) == p.sign(p.cs_mean(r)))


def _market_features(p):
    """Market return, level and dispersion series of the date, and breadth over one and five rows."""
    r1, r5, r20 = (p.stage(ind.log_returns(p, periods=k)) for k in (1, 5, 20))
    up = lambda k: p.stage(
        p.iff(p.isnull(p.lag(p.close, k)), p.null(), p.flag(p.close > p.lag(p.close, k)))
    )
    return {
        "market_return_1d": p.cs_mean(r1),
        "market_return_5d": p.cs_mean(r5),
        "market_return_20d": p.cs_mean(r20),
        "market_dispersion": p.cs_std(r1),
        "market_volatility": p.cs_mean(p.std(r1, 20)),
        "breadth_1d": p.cs_mean(up(1)),
        "breadth_5d": p.cs_mean(up(5)),
    }


for _name, _fn in INDICATORS.items():
    panel_query(_name, _fn)

# -- cross-section -----------------------------------------------------------------------------------


def _xs_zscore(p, x, share=0.01, floor=20):
    """(raw − winsorised mean) / winsorised population std; null below ``floor`` names, 0 when flat."""
    lo, hi = p.cs_pctile(x, share), p.cs_pctile(x, 1 - share)
    tame = p.stage(p.iff(p.notnull(x), p.greatest(lo, p.least(x, hi)), p.null()))
    m, sd, n = p.cs_mean(tame), p.cs_std(tame, ddof=0), p.cs_count(x)
    z = p.iff(sd > 0, p.div(x - m, sd), p.iff(p.notnull(x), p.lit(0.0), p.null()))
    return p.iff(n >= floor, z, p.null())


def _plain_z(p, x, ddof=1):
    sd = p.cs_std(x, ddof=ddof)
    return p.iff(sd > 0, p.div(x - p.cs_mean(x), sd), p.null())


def _ret(p):
    return p.stage(ind.log_returns(p))


CROSS = {
    "rank": lambda p: p.rank(p.close),
    "zscore": lambda p: _plain_z(p, _ret(p)),
    "demean": lambda p: p.close - p.cs_mean(p.close),
    "op_rank": lambda p: p.rank(p.volume),
    "op_scale": lambda p: scale(p, BODY(p), 1000.0),
    "xs_zscore": lambda p: _xs_zscore(p, _ret(p)),
    "winsorize": lambda p: p.greatest(
        p.cs_pctile(p.close, 0.05), p.least(p.close, p.cs_pctile(p.close, 0.95))
    ),
    "xs_rank": lambda p: p.iff(p.cs_count(_ret(p)) >= 30, p.rank(_ret(p)), p.null()),
    "per_date_zscore": lambda p: p.coalesce(_plain_z(p, _ret(p)), p.lit(0.0)),
    "per_date_zscore_pop": lambda p: p.coalesce(_plain_z(p, _ret(p), ddof=0), p.lit(0.0)),
    "signed_rank": lambda p: (p.rank(p.volume) - 0.5) * -1.0,
    "decile": lambda p: _decile(p, p.close),
    "signals_to_weights": lambda p: _weights(p),
}


def _decile(p, x):
    """min(int(pct·10)+1, 10) with pct by position, the symbol breaking ties."""
    return p.least(p.floor(p.div(p.place(x) * 10, p.cs_count(x))) + 1, p.lit(10.0))


def _weights(p, cap=0.35):
    """Names above the median rank, equal weight capped and normalised to one."""
    top = p.stage(p.iff(p.rank(p.close) > 0.5, p.lit(1.0), p.null()))
    n = p.cs_count(top)
    raw = p.stage(p.iff(p.notnull(top), p.least(p.div(p.lit(1.0), n), p.lit(cap)), p.lit(0.0)))
    return p.div(raw, p.cs_sum(raw))


for _name, _fn in CROSS.items():
    panel_query(_name, _fn, "dense")

panel_query("sector_rank", lambda p: p.rank(p.close, by=("sector",)), "dense_sector")
panel_query("sector_demean", lambda p: p.close - p.cs_mean(p.close, by=("sector",)), "dense_sector")

# -- alphas --------------------------------------------------------------------------------------------

for _name, _fn in ALPHAS.items():
    panel_query(_name, _fn)

panel_query("compute_all_alphas", lambda p: compute_alphas(p))
