"""Formulaic alphas, as compositions of the panel operators."""

from __future__ import annotations

from quantloom.operators.indicators import adv, log_returns, pct_change, volatility  # noqa: F401


def _delta(p, x, n):
    return x - p.lag(x, n)


def _rank_of(p, x):
    """Rank of a computed value; snapped, so that equal values tie whatever the last bit says."""
    return p.rank(p.stage(p.snap(x)))


def alpha_001(p):
    return p.ts_rank(p.close, 5) - 0.5


def alpha_002(p):
    volume_move = _delta(p, p.stage(p.ln(p.volume)), 2)
    return -p.corr(_rank_of(p, volume_move), _rank_of(p, p.div(p.close - p.open, p.open)), 6)


def alpha_003(p):
    return -p.corr(p.rank(p.open), p.rank(p.volume), 10)


def alpha_004(p):
    return -p.ts_rank(p.rank(p.low), 9)


def alpha_006(p):
    return -p.corr(p.open, p.volume, 10)


def alpha_007(p):
    """The 20-day dollar volume is compared with share volume, as the published formula is used."""
    move = p.stage(_delta(p, p.close, 7))
    signal = -p.ts_rank(p.stage(p.abs(move)), 60) * p.sign(move)
    return p.iff(p.volume > adv(p, 20), signal, p.lit(-1.0))


def alpha_009(p):
    move = p.stage(_delta(p, p.close, 1))
    steady = (p.min(move, 5) > 0) | (p.max(move, 5) < 0)
    return p.iff(steady, move, -move)


def alpha_012(p):
    return p.sign(_delta(p, p.volume, 1)) * -_delta(p, p.close, 1)


def alpha_013(p):
    return -p.rank(p.cov(p.rank(p.close), p.rank(p.volume), 5))


def alpha_014(p):
    move = _delta(p, p.stage(log_returns(p)), 3)
    return -_rank_of(p, move) * p.corr(p.open, p.volume, 10)


def alpha_015(p):
    return -p.sum(p.rank(p.corr(p.rank(p.high), p.rank(p.volume), 3)), 3)


def alpha_016(p):
    return -p.rank(p.cov(p.rank(p.high), p.rank(p.volume), 5))


def alpha_017(p):
    turn = _delta(p, p.stage(_delta(p, p.close, 1)), 1)
    busy = p.ts_rank(p.stage(p.div(p.volume, adv(p, 20))), 5)
    return -p.rank(p.ts_rank(p.close, 10)) * _rank_of(p, turn) * p.rank(busy)


def alpha_018(p):
    body = p.close - p.open
    return -_rank_of(p, p.std(p.stage(p.abs(body)), 5) + body + p.corr(p.close, p.open, 10))


def alpha_019(p):
    move = p.close - p.lag(p.close, 7)
    year = p.sum(p.stage(log_returns(p)), 250)
    return -p.sign(move + _delta(p, p.close, 7)) * (p.lit(1.0) + _rank_of(p, year + 1))


def alpha_020(p):
    gaps = [_rank_of(p, p.open - p.lag(x, 1)) for x in (p.high, p.close, p.low)]
    return -gaps[0] * gaps[1] * gaps[2]


def alpha_021(p):
    low = p.mean(p.close, 2) < p.mean(p.close, 8) - p.std(p.close, 8)
    return p.iff((p.div(p.volume, adv(p, 20)) > 1) | low, p.lit(1.0), p.lit(-1.0))


def alpha_022(p):
    return -_delta(p, p.corr(p.high, p.volume, 5), 5) * p.rank(p.std(p.close, 20))


def alpha_023(p):
    return p.iff(p.high > p.mean(p.high, 20), -_delta(p, p.high, 2), p.lit(0.0))


def alpha_024(p):
    slow = p.abs(p.div(_delta(p, p.mean(p.close, 100), 100), p.lag(p.close, 100))) <= 0.05
    return p.iff(slow, -(p.close - p.min(p.close, 100)), -_delta(p, p.close, 3))


def alpha_026(p):
    return -p.max(p.corr(p.ts_rank(p.volume, 5), p.ts_rank(p.high, 5), 5), 3)


def alpha_028(p):
    return scale(p, p.stage(p.corr(adv(p, 20), p.low, 5) + (p.high + p.low) / 2 - p.close))


def alpha_030(p):
    steps = [p.sign(p.lag(p.close, k) - p.lag(p.close, k + 1)) for k in (1, 2)]
    signs = p.sign(p.close - p.lag(p.close, 1)) + steps[0] + steps[1]
    return (p.lit(1.0) - _rank_of(p, signs)) * p.div(p.sum(p.volume, 5), p.sum(p.volume, 20))


def alpha_033(p):
    return _rank_of(p, -(p.lit(1.0) - p.div(p.open, p.close)))


def alpha_034(p):
    r = p.stage(log_returns(p))
    ratio = p.div(p.std(r, 2), p.std(r, 5))
    left, right = _rank_of(p, ratio), _rank_of(p, _delta(p, p.close, 1))
    return _rank_of(p, (p.lit(1.0) - left) + (p.lit(1.0) - right))


def alpha_037(p):
    gap = p.stage(p.open - p.close)
    return p.rank(p.corr(p.lag(gap, 1), p.close, 200)) + p.rank(gap)


def alpha_038(p):
    return -p.rank(p.ts_rank(p.close, 10)) * _rank_of(p, p.div(p.close, p.open))


def alpha_040(p):
    return -p.rank(p.std(p.high, 10)) * p.corr(p.high, p.volume, 10)


def alpha_041(p):
    return p.sqrt(p.high * p.low) - (p.high + p.low + p.close) / 3


def alpha_042(p):
    typical = p.stage((p.high + p.low + p.close) / 3)
    return p.div(_rank_of(p, typical - p.close), _rank_of(p, typical + p.close))


def alpha_053(p):
    inside = p.div((p.close - p.low) - (p.high - p.close), p.close - p.low)
    return -_delta(p, p.stage(inside), 9)


def alpha_momentum(p, window=20):
    gain = log_returns(p, periods=window)
    return _rank_of(p, gain * p.div(p.volume, p.mean(p.volume, window)))


def alpha_reversal(p, window=5):
    return -p.ts_rank(p.stage(log_returns(p, periods=window)), window)


def alpha_volatility(p, window=20):
    return -p.rank(volatility(p, window))


def scale(p, x, a=1.0):
    """x over the sum of |x| of the whole column, times ``a``; unchanged when that sum is zero."""
    total = p.total(p.abs(x))
    return p.iff(total > 0, p.div(x * a, total), x)


ALPHAS = {name: fn for name, fn in list(globals().items()) if name.startswith("alpha_")}


def compute_alphas(p, names=None):
    """Named alphas as columns of one plan; unknown names are left out."""
    return {n: ALPHAS[n](p) for n in (names or ALPHAS) if n in ALPHAS}
