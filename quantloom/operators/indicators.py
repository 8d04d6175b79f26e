"""Technical indicators as panel formulas: each takes a panel and returns staged columns.

They use only the operator names of ``Panel``, so the same text also writes the DuckDB check.
"""

from __future__ import annotations

EPS = 1e-10


def log_returns(p, x=None, periods=1):
    x = p.close if x is None else x
    return p.ln(p.div(x, p.lag(x, periods)))


def pct_change(p, x, n=1):
    return p.div(x, p.lag(x, n)) - 1


def volatility(p, window=20):
    return p.std(p.stage(log_returns(p)), window)


def adv(p, d=20):
    return p.mean(p.stage(p.volume * p.close), d)


def true_range(p):
    """Widest of the bar and its gaps to the previous close; the first bar has only the first term."""
    prev = p.lag(p.close, 1)
    return p.stage(p.greatest(p.high - p.low, p.abs(p.high - prev), p.abs(p.low - prev)))


def bollinger_bands(p, window=20, k=2.0):
    ma, sd = p.mean(p.close, window), p.std(p.close, window)
    upper, lower = p.stage(ma + sd * k), p.stage(ma - sd * k)
    return {"upper": upper, "lower": lower, "position": (p.close - lower) / (upper - lower + EPS)}


def bb_width(p, window=20, k=2.0):
    ma, sd = p.mean(p.close, window), p.std(p.close, window)
    return ((ma + sd * k) - (ma - sd * k)) / (ma + EPS)


def macd(p, fast=12, slow=26, signal=9):
    line = p.stage(p.ema(p.close, fast) - p.ema(p.close, slow))
    sig = p.ema(line, signal)
    return {"macd": line, "signal": sig, "histogram": line - sig}


def rsi(p, window=14):
    change = p.stage(p.close - p.lag(p.close, 1))
    gain = p.ema(p.stage(p.iff(change > 0, change, p.lit(0.0))), window)
    loss = p.ema(p.stage(p.iff(change < 0, -change, p.lit(0.0))), window)
    return p.lit(100.0) - p.lit(100.0) / (p.lit(1.0) + gain / (loss + EPS))


def atr(p, window=14):
    return p.mean(true_range(p), window)


def adx(p, window=14):
    up = p.stage(p.high - p.lag(p.high, 1))
    down = p.stage(p.lag(p.low, 1) - p.low)
    zero = p.lit(0.0)
    plus = p.stage(p.iff((up > down) & (up > 0), up, zero))
    minus = p.stage(p.iff((down > up) & (down > 0), down, zero))
    smooth = p.ema(true_range(p), window) + EPS
    di_plus = p.stage(p.lit(100.0) * p.ema(plus, window) / smooth)
    di_minus = p.stage(p.lit(100.0) * p.ema(minus, window) / smooth)
    dx = p.stage(p.lit(100.0) * p.abs(di_plus - di_minus) / (di_plus + di_minus + EPS))
    return p.ema(dx, window)


def stochastic(p, window=14, smooth_k=3, smooth_d=3):
    low, high = p.min(p.low, window), p.max(p.high, window)
    raw = p.stage(p.lit(100.0) * (p.close - low) / (high - low + EPS))
    k = p.mean(raw, smooth_k)
    return {"k": k, "d": p.mean(k, smooth_d)}


def cci(p, window=20):
    tp = p.stage((p.high + p.low + p.close) / 3)
    return (tp - p.mean(tp, window)) / (p.lit(0.015) * p.mad(tp, window) + EPS)


def williams_r(p, window=14):
    high, low = p.max(p.high, window), p.min(p.low, window)
    return p.lit(-100.0) * (high - p.close) / (high - low + EPS)


def obv(p):
    step = p.sign(p.close - p.lag(p.close, 1)) * p.volume
    return p.cumsum(p.stage(p.coalesce(step, p.lit(0.0))))


def cmf(p, window=20):
    mult = ((p.close - p.low) - (p.high - p.close)) / (p.high - p.low + EPS)
    return p.sum(p.stage(mult * p.volume), window) / (p.sum(p.volume, window) + EPS)


def mfi(p, window=14):
    tp = p.stage((p.high + p.low + p.close) / 3)
    flow, step = p.stage(tp * p.volume), p.stage(tp - p.lag(tp, 1))
    up = p.sum(p.stage(p.iff(step > 0, flow, p.lit(0.0))), window)
    down = p.sum(p.stage(p.iff(step < 0, flow, p.lit(0.0))), window)
    return p.lit(100.0) - p.lit(100.0) / (p.lit(1.0) + up / (down + EPS))


def trix(p, window=14):
    third = p.ema(p.ema(p.ema(p.close, window), window), window)
    return p.lit(100.0) * pct_change(p, third)


def dpo(p, window=20):
    """The shift goes into the past, so nothing ahead of the row is read."""
    return p.lag(p.close, window // 2 + 1) - p.mean(p.close, window)


def keltner(p, window=20, multiplier=2.0):
    mid, width = p.ema(p.close, window), p.stage(atr(p, window) * multiplier)
    upper, lower = p.stage(mid + width), p.stage(mid - width)
    return {"upper": upper, "lower": lower, "position": (p.close - lower) / (upper - lower + EPS)}


def ichimoku(p, conversion=9, base=26, span_b=52):
    def middle(w):
        return p.stage((p.max(p.high, w) + p.min(p.low, w)) / 2)

    conv, mid = middle(conversion), middle(base)
    return {
        "conversion": conv,
        "base": mid,
        "span_a": p.lag(p.stage((conv + mid) / 2), base),
        "span_b": p.lag(middle(span_b), base),
    }


def supertrend(p, period=10, multiplier=3.0):
    """The flip test reads only the previous bands, so the direction is the last flip so far."""
    width = p.stage(atr(p, period) * multiplier)
    mid = p.stage((p.high + p.low) / 2)
    upper, lower = p.stage(mid + width), p.stage(mid - width)
    flip = p.iff(p.close > p.lag(upper, 1), p.lit(1.0), p.iff(p.close < p.lag(lower, 1), p.lit(-1.0), p.null()))
    direction = p.stage(p.coalesce(p.ffill(p.stage(flip)), p.lit(1.0)))
    band = p.iff(direction > 0, lower, upper)
    return {"supertrend": p.iff(p.rownum() > 1, band, p.lit(0.0)), "direction": direction}


def vwap_ratio(p, window=20):
    return p.div(p.close, p.div(p.sum(p.stage(p.close * p.volume), window), p.sum(p.volume, window)))


def streak(p, up=True, window=10):
    """Length of the run of up (or down) days ending today, at most ``window``; 0 on the first ``window`` rows."""
    step = p.stage(p.close - p.lag(p.close, 1))
    run = p.stage(p.run_length(step > 0 if up else step < 0))
    return p.iff(p.rownum() > window, p.least(run, p.lit(window)), p.lit(0))


def pct_52w_high(p, window=252, minp=126):
    share = p.stage(p.div(p.close, p.max(p.close, window, minp)))
    return {"pct_52w_high": share, "days_from_high": p.lit(1.0) - share}


def amihud(p):
    illiq = p.stage(p.div(p.abs(pct_change(p, p.close)), p.close * p.volume) * 1e9)
    return {"amihud_20": p.mean(illiq, 20, 10), "amihud_60": p.mean(illiq, 60, 30)}


def simple_critical(p):
    """Gap, relative volume, range, close position, and signed streak inside the last ten returns."""
    prev = p.lag(p.close, 1)
    width = p.high - p.low
    up, down = p.stage(p.run_length(p.close > prev)), p.stage(p.run_length(p.close < prev))
    ten = p.lit(10)
    return {
        "overnight_gap": p.div(p.open - prev, prev),
        "relative_volume": p.div(p.volume, p.mean(p.volume, 20, 10)),
        "intraday_range": p.div(width, p.close),
        "close_position": p.coalesce(p.div(p.close - p.low, width), p.lit(0.5)),
        "streak": p.iff(p.rownum() > 2, p.iff(up > 0, p.least(up, ten), -p.least(down, ten)), p.null()),
    }


def trend_metrics(p):
    n = p.rownum()
    full = n >= 30

    def ret(k):
        return p.iff(full, pct_change(p, p.close, k) * 100, p.null())

    ma7, ma14, ma30 = p.mean(p.close, 7), p.mean(p.close, 14), p.mean(p.close, 30)
    keep = lambda x: p.iff(full, x, p.null())
    return {
        "return_7d": ret(6),
        "return_14d": ret(13),
        "return_30d": ret(29),
        "ma_7": keep(ma7),
        "ma_14": keep(ma14),
        "ma_30": keep(ma30),
        "trend_strength": keep(p.div(ma7 - ma30, ma30) * 100),
        "above_ma7": p.flag(full & (p.close > ma7)),
        "above_ma14": p.flag(full & (p.close > ma14)),
        "above_ma30": p.flag(full & (p.close > ma30)),
    }


def time_window_features(p, windows=(3, 7, 15, 30)):
    r = p.stage(pct_change(p, p.close))
    made = {}
    for w in windows:
        minp = max(2, w // 2)
        made[f"returns_{w}d"] = pct_change(p, p.close, w)
        made[f"volatility_{w}d"] = p.std(r, w, minp)
        made[f"volume_ratio_{w}d"] = p.div(p.volume, p.mean(p.volume, w, minp))
    return made


def momentum_features(p, windows=(3, 7, 15, 30)):
    made = {}
    for w in windows:
        ma = p.mean(p.close, w, max(2, w // 2))
        made[f"roc_{w}d"] = pct_change(p, p.close, w) * 100
        made[f"price_vs_ma_{w}d"] = p.div(p.close - ma, ma)
    return made


def higher_order_stats(p, windows=(5, 10, 20)):
    r = p.stage(pct_change(p, p.close))
    made = {}
    for w in windows:
        minp = max(3, w // 2)
        made[f"skew_{w}d"] = p.skew(r, w, minp)
        made[f"kurt_{w}d"] = p.kurt(r, w, minp, corrected=False)
        made[f"iqr_{w}d"] = p.pctile(r, 0.75, w, minp) - p.pctile(r, 0.25, w, minp)
    return made


def trend_features(p, windows=(10, 20, 50)):
    t = p.stage(p.rownum().cast("double"))
    made = {}
    for w in windows:
        b, sd, sdt = p.slope(p.close, t, w), p.std(p.close, w), p.std(t, w)
        root = p.div(b * sdt, sd)
        flat = sd == 0
        made[f"trend_r2_{w}d"] = p.iff(flat, p.lit(0.0), root * root)
        made[f"trend_slope_{w}d"] = p.iff(flat, p.lit(0.0), p.div(b, p.mean(p.close, w)))
    return made


def fft_components(p, n=20, bins=3):
    """Magnitudes of the first Fourier bins of the frame less the line through its end points."""
    import math

    made = {}
    for k in range(1, bins + 1):
        parts = []
        for fn in (math.cos, math.sin):
            base = [fn(2 * math.pi * k * i / n) for i in range(n)]
            # removing the end-to-end line is linear in the frame, so it folds into the weights
            first = sum(b * (1 - i / (n - 1)) for i, b in enumerate(base))
            last = sum(b * i / (n - 1) for i, b in enumerate(base))
            w = list(base)
            w[0] -= first
            w[-1] -= last
            parts.append(p.weighted(p.close, w))
        made[f"fft_{k}"] = p.sqrt(parts[0] * parts[0] + parts[1] * parts[1])
    return made


def vol_estimators(p):
    """Annualised range and return volatilities over 20 rows, at least 10 of them."""
    import math

    year = math.sqrt(252)
    hl = p.ln(p.div(p.high, p.low))
    co = p.ln(p.div(p.close, p.open))
    r = p.stage(pct_change(p, p.close))
    gk = p.stage(p.lit(0.5) * hl * hl - p.lit(2 * math.log(2) - 1) * co * co)
    pk = p.stage(hl * hl / (4 * math.log(2)))
    idio = p.stage(r - p.cs_mean(r))
    v5, v20, v60 = p.std(r, 5, 3), p.std(r, 20, 10), p.std(r, 60, 30)
    down = p.stage(p.iff(p.notnull(r), p.least(r, p.lit(0.0)) * p.least(r, p.lit(0.0)), p.null()))
    garman = p.stage(p.sqrt(p.greatest(p.mean(gk, 20, 10), p.lit(0.0))) * year)
    return {
        "gk_vol_20": garman,
        "parkinson_vol_20": p.sqrt(p.mean(pk, 20, 10)) * year,
        "idio_vol_20": p.std(idio, 20, 10) * year,
        "vol_term_structure": p.div(v5, v60),
        "vol_of_vol_20": p.std(v5, 20, 10),
        "downside_semivol_20": p.sqrt(p.mean(down, 20, 10)) * year,
        "ewma_vol": p.sqrt(p.ewm(p.stage(r * r), 0.06, adjust=True, minp=10)) * year,
        "vol_premium_20": garman - v20 * year,
    }


def label_variants(p, horizon=20):
    """Forward return less the market, less beta times the market, and scaled by trailing volatility."""
    fwd = p.stage(p.ln(p.div(p.lead(p.close, horizon), p.close)))
    market = p.cs_mean(fwd)
    r = p.stage(pct_change(p, p.close))
    daily = p.cs_mean(r)
    paired = p.stage(p.iff(p.notnull(r), daily, p.null()))
    spread = p.std(daily, 120, 60)
    raw = p.stage(p.div(p.cov(r, paired, 120, 60), spread * spread))
    beta = p.iff(p.notnull(raw), p.greatest(p.lit(-1.0), p.least(raw, p.lit(3.0))), p.null())
    plain = p.stage(fwd - market)
    vol = p.std(r, 20, 10)
    scaled = p.iff(p.notnull(vol), p.greatest(vol * horizon**0.5, p.lit(0.01)), p.null())
    return {
        "resid_unit": plain,
        "resid_beta": p.coalesce(fwd - beta * market, plain),
        "vol_scaled": p.div(fwd, scaled),
    }


def dispatch(p, names=None):
    """The configured technical features by name; asking for some builds only those."""
    bands, lines, sto = bollinger_bands, macd, stochastic
    table = {
        **{f"returns_{k}d": (lambda k=k: log_returns(p, periods=k)) for k in (1, 2, 5, 10, 20, 60)},
        **{f"volatility_{k}d": (lambda k=k: volatility(p, k)) for k in (5, 10, 20, 60)},
        **{f"volume_ratio_{k}d": (lambda k=k: p.div(p.volume, p.mean(p.volume, k))) for k in (5, 20)},
        **{f"rsi_{k}": (lambda k=k: rsi(p, k)) for k in (7, 14, 21, 50)},
        **{f"ema_{k}": (lambda k=k: p.ema(p.close, k)) for k in (5, 10, 20, 50, 200)},
        **{f"sma_{k}": (lambda k=k: p.mean(p.close, k)) for k in (10, 20, 50, 200)},
        **{f"momentum_{k}d": (lambda k=k: pct_change(p, p.close, k)) for k in (10, 20, 50)},
        **{
            f"roc_{k}": (lambda k=k: p.lit(100.0) * (p.close - p.lag(p.close, k)) / (p.lag(p.close, k) + EPS))
            for k in (10, 20)
        },
        **{f"bb_{k}": (lambda k=k: bands(p)[k]) for k in ("upper", "lower", "position")},
        **{n: (lambda k=k: lines(p)[k]) for n, k in (("macd", "macd"), ("macd_signal", "signal"), ("macd_hist", "histogram"))},
        **{f"stochastic_{k}": (lambda k=k: sto(p)[k]) for k in ("k", "d")},
        **{f"kc_{k}": (lambda k=k: keltner(p)[k]) for k in ("upper", "lower", "position")},
        **{f"ichimoku_{k}": (lambda k=k: ichimoku(p)[k]) for k in ("conversion", "base", "span_a", "span_b")},
        "supertrend": lambda: supertrend(p)["supertrend"],
        "supertrend_direction": lambda: supertrend(p)["direction"],
        "price_to_ema20": lambda: p.div(p.close, p.ema(p.close, 20)),
        "atr_14": lambda: atr(p, 14),
        "adx_14": lambda: adx(p, 14),
        "volume_std_20d": lambda: p.std(p.volume, 20),
        "bb_width": lambda: bb_width(p),
        "cci_20": lambda: cci(p),
        "williams_r_14": lambda: williams_r(p),
        "obv": lambda: obv(p),
        "obv_ema_20": lambda: p.ema(obv(p), 20),
        "cmf_20": lambda: cmf(p),
        "mfi_14": lambda: mfi(p),
        "trix_14": lambda: trix(p),
        "dpo_20": lambda: dpo(p),
        "vwap_ratio": lambda: vwap_ratio(p),
        "returns_std_20d": lambda: volatility(p, 20),
        "returns_skew_20d": lambda: p.skew(p.stage(log_returns(p)), 20),
        "returns_kurt_20d": lambda: p.kurt(p.stage(log_returns(p)), 20),
        "price_above_sma_20": lambda: p.flag(p.close > p.mean(p.close, 20)),
        "price_above_ema_50": lambda: p.flag(p.close > p.ema(p.close, 50)),
        "golden_cross": lambda: p.flag(p.mean(p.close, 10) > p.mean(p.close, 50)),
        "adx_strong_trend": lambda: p.flag(adx(p) > 25.0),
        "macd_positive": lambda: p.flag(lines(p)["macd"] > 0),
        "consecutive_up_days": lambda: streak(p, up=True),
        "consecutive_down_days": lambda: streak(p, up=False),
        "returns_1d_positive": lambda: p.flag(log_returns(p) > 0),
        "volume_increasing": lambda: p.flag(p.volume > p.mean(p.volume, 5)),
        "rsi_oversold": lambda: p.flag(rsi(p) < 30.0),
        "bb_squeeze": lambda: p.flag(bb_width(p) < 0.01),
        **{k: (lambda k=k: pct_52w_high(p)[k]) for k in ("pct_52w_high", "days_from_high")},
    }
    return {n: table[n]() for n in (names or table)}
