"""DuckDB text for panel formulas: the second engine that results are compared with.

``SqlPanel`` answers to the operator names of ``Panel`` and writes each as one more common table
expression in DuckDB's own terms (closed-form decayed sums, plain date windows, list functions).
"""

from __future__ import annotations

SHIFT = 0.5137


def settle_sql(x: str) -> str:
    return (
        f"CASE WHEN abs({x}) < 1e3 THEN floor(({x}) * 1e6 + {SHIFT}) / 1e6 "
        f"WHEN abs({x}) < 1e6 THEN floor(({x}) * 1e3 + {SHIFT}) / 1e3 "
        f"WHEN abs({x}) < 1e9 THEN floor(({x}) + {SHIFT}) "
        f"WHEN abs({x}) < 1e15 THEN floor(({x}) / 1e3 + {SHIFT}) * 1e3 ELSE {x} END"
    )


def snap_sql(x: str) -> str:
    return f"CASE WHEN abs({x}) < 1e5 THEN floor(({x}) * 1e10 + {SHIFT}) / 1e10 ELSE {x} END"


LONG = """SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date,
  first(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS open,
  max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
  last(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS close,
  sum(l_quantity) AS volume
FROM lineitem GROUP BY ALL"""

DENSE = """SELECT user_id AS symbol, CAST(ts AS DATE) AS date, arg_min(value, ts) AS open, max(value) AS high,
  min(value) AS low, arg_max(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume
FROM events GROUP BY ALL"""

SECTORS = """SELECT s_suppkey AS symbol, r_name AS sector FROM supplier
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

LONG_SECTOR = f"SELECT b.*, k.sector FROM ({LONG}) b LEFT JOIN ({SECTORS}) k USING (symbol)"
DENSE_SECTOR = f"SELECT b.*, CAST(b.symbol % 5 AS VARCHAR) AS sector FROM ({DENSE}) b"

SOURCES = {"long": LONG, "dense": DENSE, "long_sector": LONG_SECTOR, "dense_sector": DENSE_SECTOR}


class E:
    """A piece of SQL that composes with Python operators."""

    def __init__(self, text):
        self.text = f"{text}" if isinstance(text, str) else _lit(text)

    def __str__(self):
        return self.text

    def _bin(self, op, other, swap=False):
        a, b = self.text, _text(other)
        if swap:
            a, b = b, a
        return E(f"({a} {op} {b})")

    __add__ = lambda s, o: s._bin("+", o)
    __radd__ = lambda s, o: s._bin("+", o, True)
    __sub__ = lambda s, o: s._bin("-", o)
    __rsub__ = lambda s, o: s._bin("-", o, True)
    __mul__ = lambda s, o: s._bin("*", o)
    __rmul__ = lambda s, o: s._bin("*", o, True)
    __truediv__ = lambda s, o: s._bin("/", o)
    __rtruediv__ = lambda s, o: s._bin("/", o, True)
    __gt__ = lambda s, o: s._bin(">", o)
    __lt__ = lambda s, o: s._bin("<", o)
    __ge__ = lambda s, o: s._bin(">=", o)
    __le__ = lambda s, o: s._bin("<=", o)
    __eq__ = lambda s, o: s._bin("=", o)
    __and__ = lambda s, o: s._bin("AND", o)
    __or__ = lambda s, o: s._bin("OR", o)
    __neg__ = lambda s: E(f"(-{s.text})")
    __invert__ = lambda s: E(f"(NOT {s.text})")
    __hash__ = None

    def cast(self, kind):
        return E(f"CAST({self.text} AS {kind.upper()})")

    def isNull(self):
        return E(f"({self.text} IS NULL)")

    def isNotNull(self):
        return E(f"({self.text} IS NOT NULL)")


def _lit(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    return f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else str(v)


def _text(v):
    return v.text if isinstance(v, E) else _lit(v)


class SqlPanel:
    def __init__(self, source: str):
        self.ctes = [("b0", SOURCES[source])]
        self._seen: dict[tuple, str] = {}

    open = property(lambda self: E("open"))
    high = property(lambda self: E("high"))
    low = property(lambda self: E("low"))
    close = property(lambda self: E("close"))
    volume = property(lambda self: E("volume"))

    def col(self, name):
        return E(name)

    def stage(self, expr, *key):
        last = self.ctes[-1][0]
        name = f"c{len(self.ctes)}"
        self.ctes.append((f"b{len(self.ctes)}", f"SELECT *, {_text(expr)} AS {name} FROM {last}"))
        self._seen[key or (name,)] = name
        return E(name)

    def _once(self, build, *key):
        key = tuple(str(k) for k in key)
        if key in self._seen:
            return E(self._seen[key])
        return self.stage(build(), *key)

    def out(self, **columns):
        picks = ["symbol", "CAST(date AS VARCHAR) AS date"]
        for n, c in columns.items():
            staged = self.stage(c)
            picks.append(f"{settle_sql(staged.text)} AS {n}")
        body = ",\n".join(f"{n} AS ({q})" for n, q in self.ctes)
        return f"WITH {body}\nSELECT {', '.join(picks)} FROM {self.ctes[-1][0]}"

    # element-wise
    def lit(self, v):
        return E(_lit(v))

    def _f(self, fn, *xs):
        return E(f"{fn}({', '.join(_text(x) for x in xs)})")

    def abs(self, x):
        return self._f("abs", x)

    def sign(self, x):
        return E(f"CAST(sign({_text(x)}) AS DOUBLE)")

    def ln(self, x):
        return E(f"CASE WHEN {_text(x)} > 0 THEN ln({_text(x)}) END")

    def log1p(self, x):
        return E(f"ln(1 + {_text(x)})")

    def exp(self, x):
        return self._f("exp", x)

    def sqrt(self, x):
        return self._f("sqrt", x)

    def power(self, x, c):
        return self._f("pow", x, float(c))

    def snap(self, x):
        v = self.stage(x)
        return E(snap_sql(v.text))

    def floor(self, x):
        return self._f("floor", x)

    def greatest(self, *xs):
        return self._f("greatest", *xs)

    def least(self, *xs):
        return self._f("least", *xs)

    def div(self, a, b):
        return E(f"(CAST({_text(a)} AS DOUBLE) / nullif({_text(b)}, 0))")

    def iff(self, cond, a, b):
        return E(f"CASE WHEN {_text(cond)} THEN {_text(a)} ELSE {_text(b)} END")

    def flag(self, cond):
        return E(f"CASE WHEN {_text(cond)} THEN 1 ELSE 0 END")

    def coalesce(self, *xs):
        return self._f("coalesce", *xs)

    def isnull(self, x):
        return E(f"({_text(x)} IS NULL)")

    def notnull(self, x):
        return E(f"({_text(x)} IS NOT NULL)")

    def null(self):
        return E("CAST(NULL AS DOUBLE)")

    # trailing windows
    W = "PARTITION BY symbol ORDER BY date"

    def _fr(self, w, shift=0):
        end = "CURRENT ROW" if not shift else f"{shift} PRECEDING"
        return f"({self.W} ROWS BETWEEN {w - 1 + shift} PRECEDING AND {end})"

    PAST = f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

    def lag(self, x, n):
        return self._once(lambda: E(f"lag({_text(x)}, {n}) OVER ({self.W})"), "lag", x, n)

    def lead(self, x, n):
        return self._once(lambda: E(f"lead({_text(x)}, {n}) OVER ({self.W})"), "lead", x, n)

    def rownum(self):
        return self._once(lambda: E(f"row_number() OVER ({self.W})"), "rownum")

    def rows_left(self):
        return self._once(
            lambda: E("row_number() OVER (PARTITION BY symbol ORDER BY date DESC) - 1"), "rows_left"
        )

    def _roll(self, fn, x, w, minp=None, shift=0):
        fr = self._fr(w, shift)
        v = self.stage(x)
        return E(f"CASE WHEN count({v}) OVER {fr} >= {w if minp is None else minp} THEN {fn.format(v)} OVER {fr} END")

    def mean(self, x, w, minp=None, shift=0):
        return self._once(lambda: self._roll("avg({})", x, w, minp, shift), "mean", x, w, minp, shift)

    def sum(self, x, w, minp=None):
        return self._once(lambda: self._roll("sum({})", x, w, minp), "sum", x, w, minp)

    def min(self, x, w, minp=None):
        return self._once(lambda: self._roll("min({})", x, w, minp), "min", x, w, minp)

    def max(self, x, w, minp=None):
        return self._once(lambda: self._roll("max({})", x, w, minp), "max", x, w, minp)

    def std(self, x, w, minp=None, ddof=1, shift=0):
        fn = "stddev_samp({})" if ddof == 1 else "stddev_pop({})"

        def build():
            v = self.stage(x)
            fr = self._fr(w, shift)
            sd = self._roll(fn, v, w, minp, shift)
            return E(
                f"CASE WHEN count({v}) OVER {fr} > 1 AND min({v}) OVER {fr} = max({v}) OVER {fr} "
                f"THEN 0 * ({sd}) ELSE ({sd}) END"
            )

        return self._once(build, "std", x, w, minp, ddof, shift)

    def _moments(self, x, w):
        v = self.stage(x)
        fr = self._fr(w)
        m = self.stage(E(f"avg({v}) OVER {fr}"))
        a = self.stage(E(f"list({v}) FILTER (WHERE {v} IS NOT NULL) OVER {fr}"))
        n = self.stage(E(f"count({v}) OVER {fr}"))
        flat = self.stage(E(f"min({v}) OVER {fr} = max({v}) OVER {fr}"))
        mk = lambda k: self.stage(E(f"list_sum(list_transform({a}, lambda y: pow(y - {m}, {k}))) / {n}"))
        return n, flat, mk

    def skew(self, x, w, minp=None):
        def build():
            n, flat, mk = self._moments(x, w)
            m2, m3 = mk(2), mk(3)
            return E(
                f"CASE WHEN {n} >= {minp or w} THEN CASE WHEN {flat} THEN 0 "
                f"ELSE sqrt({n} * ({n} - 1.0)) / ({n} - 2) * {m3} / pow({m2}, 1.5) END END"
            )

        return self._once(build, "skew", x, w, minp)

    def kurt(self, x, w, minp=None, corrected=True):
        def build():
            n, flat, mk = self._moments(x, w)
            m2, m4 = mk(2), mk(4)
            k = f"({m4} / pow({m2}, 2) - 3)"
            if corrected:
                v = (
                    f"CASE WHEN {flat} THEN -3 ELSE ({n} - 1.0) / (({n} - 2) * ({n} - 3)) * "
                    f"(({n} + 1) * {k} + 6) END"
                )
            else:
                v = f"CASE WHEN NOT {flat} THEN {k} END"
            return E(f"CASE WHEN {n} >= {minp or w} THEN {v} END")

        return self._once(build, "kurt", x, w, minp, corrected)

    def pctile(self, x, q, w, minp=None):
        return self._once(
            lambda: self._roll("quantile_cont({}, %s)" % q, x, w, minp), "pctile", x, q, w, minp
        )

    def _list(self, x, w):
        v = self.stage(x)
        return v, self.stage(E(f"list({v}) FILTER (WHERE {v} IS NOT NULL) OVER {self._fr(w)}"))

    def ts_rank(self, x, w):
        def build():
            v, a = self._list(x, w)
            lower = f"len(list_filter({a}, lambda y: y < {v}))"
            same = f"len(list_filter({a}, lambda y: y = {v}))"
            return E(f"CASE WHEN len({a}) = {w} THEN ({lower} + ({same} + 1) / 2.0) / {float(w)}::DOUBLE END")

        return self._once(build, "ts_rank", x, w)

    def argmax(self, x, w):
        def build():
            _, a = self._list(x, w)
            return E(f"CASE WHEN len({a}) = {w} THEN len({a}) - list_position({a}, list_max({a})) END")

        return self._once(build, "argmax", x, w)

    def argmin(self, x, w):
        def build():
            _, a = self._list(x, w)
            return E(f"CASE WHEN len({a}) = {w} THEN len({a}) - list_position({a}, list_min({a})) END")

        return self._once(build, "argmin", x, w)

    def weighted(self, x, weights):
        def build():
            v = self.stage(x)
            n = len(weights)
            lags = [self.stage(E(f"lag({v}, {k}) OVER ({self.W})")) if k else v for k in range(n)]
            return E(" + ".join(f"{lags[n - 1 - i]} * {_lit(float(q))}" for i, q in enumerate(weights)))

        return self._once(build, "weighted", x, weights)

    def decay_linear(self, x, w):
        total = w * (w + 1) / 2
        return self.weighted(x, [(i + 1) / total for i in range(w)])

    def mad(self, x, w):
        def build():
            m = self.mean(x, w)
            _, a = self._list(x, w)
            return E(f"CASE WHEN len({a}) = {w} THEN list_sum(list_transform({a}, lambda y: abs(y - {m}))) / {w} END")

        return self._once(build, "mad", x, w)

    def _pairs(self, x, y):
        both = f"{_text(x)} IS NOT NULL AND {_text(y)} IS NOT NULL"
        a = self.stage(E(f"CASE WHEN {both} THEN CAST({_text(x)} AS DOUBLE) END"))
        b = self.stage(E(f"CASE WHEN {both} THEN CAST({_text(y)} AS DOUBLE) END"))
        return a, b

    def _center(self, a, b, w):
        """Two-pass sums of squares: no cancellation, no engine aggregate shared with the other side."""
        fr = self._fr(w)
        la = self.stage(E(f"list({a}) FILTER (WHERE {a} IS NOT NULL) OVER {fr}"))
        lb = self.stage(E(f"list({b}) FILTER (WHERE {b} IS NOT NULL) OVER {fr}"))
        ma = self.stage(E(f"list_avg({la})"))
        mb = self.stage(E(f"list_avg({lb})"))
        dot = lambda u, mu, v, mv: self.stage(
            E(f"list_sum(list_transform(list_zip({u}, {v}), lambda p: (p[1] - {mu}) * (p[2] - {mv})))")
        )
        return la, lb, dot(la, ma, lb, mb), dot(la, ma, la, ma), dot(lb, mb, lb, mb)

    def corr(self, x, y, w, minp=None):
        def build():
            a, b = self._pairs(x, y)
            la, lb, sab, saa, sbb = self._center(a, b, w)
            flat = f"list_min({la}) = list_max({la}) OR list_min({lb}) = list_max({lb})"
            return E(
                f"CASE WHEN len({la}) >= {minp or w} AND NOT ({flat}) "
                f"THEN {snap_sql(f'({sab} / nullif(sqrt({saa}) * sqrt({sbb}), 0))')} END"
            )

        return self._once(build, "corr", x, y, w, minp)

    def cov(self, x, y, w, minp=None):
        def build():
            a, b = self._pairs(x, y)
            la, _, sab, _, _ = self._center(a, b, w)
            return E(
                f"CASE WHEN len({la}) >= {minp or w} AND len({la}) > 1 "
                f"THEN {snap_sql(f'({sab} / (len({la}) - 1))')} END"
            )

        return self._once(build, "cov", x, y, w, minp)

    def slope(self, y, x, w, minp=None):
        def build():
            fr = self._fr(w)
            b, a = self._pairs(y, x)
            flat = f"min({a}) OVER {fr} = max({a}) OVER {fr}"
            return E(
                f"CASE WHEN count({b}) OVER {fr} >= {minp or w} AND NOT ({flat}) THEN regr_slope({b}, {a}) OVER {fr} END"
            )

        return self._once(build, "slope", y, x, w, minp)

    # cumulative
    def cumsum(self, x):
        return self._once(lambda: E(f"sum({_text(x)}) OVER {self.PAST}"), "cumsum", x)

    def cummax(self, x):
        return self._once(lambda: E(f"max({_text(x)}) OVER {self.PAST}"), "cummax", x)

    def cumcount(self, x):
        return self._once(lambda: E(f"count({_text(x)}) OVER {self.PAST}"), "cumcount", x)

    def cumprod(self, x):
        return self._once(lambda: E(f"product({_text(x)}) OVER {self.PAST}"), "cumprod", x)

    def first(self, x):
        return self._once(lambda: E(f"first_value({_text(x)}) OVER {self.PAST}"), "first", x)

    def ffill(self, x):
        return self._once(lambda: E(f"last_value({_text(x)} IGNORE NULLS) OVER {self.PAST}"), "ffill", x)

    def run_length(self, cond):
        t = self.rownum()
        broken = self.stage(E(f"CASE WHEN NOT coalesce({_text(cond)}, FALSE) THEN {t} END"))
        return t - E(f"coalesce({self.ffill(broken)}, 0)")

    def ewm(self, x, alpha, adjust, minp=0):
        def build():
            keep = _lit(1.0 - alpha)
            v = self.stage(x)
            t = self.rownum()
            began = self.stage(E(f"min({t}) FILTER (WHERE {v} IS NOT NULL) OVER (PARTITION BY symbol)"))
            weight = "1.0" if adjust else f"CASE WHEN {t} = {began} THEN 1.0 ELSE {_lit(float(alpha))} END"
            grown = f"CAST({weight} AS DOUBLE) * pow({keep}, ({began} - {t}))"
            num = self.stage(E(f"CASE WHEN {v} IS NOT NULL THEN {v} * {grown} END"))
            den = self.stage(E(f"CASE WHEN {v} IS NOT NULL THEN {grown} END"))
            return E(
                f"CASE WHEN {t} >= {began} AND count({v}) OVER {self.PAST} >= {minp} "
                f"THEN sum({num}) OVER {self.PAST} / sum({den}) OVER {self.PAST} END"
            )

        return self._once(build, "ewm", x, alpha, adjust, minp)

    def ema(self, x, span, adjust=False, minp=0):
        return self.ewm(x, 2.0 / (span + 1.0), adjust, minp)

    # cross-section
    def _day(self, by=()):
        return "PARTITION BY " + ", ".join(["date", *by])

    def _cs(self, fn, x, by):
        return self._once(lambda: E(f"{fn}({_text(x)}) OVER ({self._day(by)})"), fn, x, tuple(by))

    def cs_count(self, x, by=()):
        return self._cs("count", x, by)

    def cs_sum(self, x, by=()):
        return self._cs("sum", x, by)

    def cs_mean(self, x, by=()):
        return self._cs("avg", x, by)

    def cs_std(self, x, ddof=1, by=()):
        v = self.stage(x)
        sd = self._cs("stddev_samp" if ddof == 1 else "stddev_pop", v, by)
        lo, hi = self._cs("min", v, by), self._cs("max", v, by)
        return E(f"CASE WHEN {lo} = {hi} THEN {sd} * 0.0 ELSE {sd} END")

    def cs_pctile(self, x, q, by=()):
        return self._once(
            lambda: E(f"quantile_cont({_text(x)}, {q}) OVER ({self._day(by)})"), "cs_pct", x, q, tuple(by)
        )

    def rank(self, x, by=()):
        def build():
            v = self.stage(x)
            d = self._day(by)
            return E(
                f"CASE WHEN {v} IS NOT NULL THEN (rank() OVER ({d} ORDER BY {v} NULLS LAST) + "
                f"(count(*) OVER ({d}, {v}) - 1) / 2.0) / CAST(count({v}) OVER ({d}) AS DOUBLE) END"
            )

        return self._once(build, "rank", x, tuple(by))

    def place(self, x, descending=False):
        def build():
            v = self.stage(x)
            way = "DESC" if descending else "ASC"
            return E(
                f"CASE WHEN {v} IS NOT NULL THEN row_number() OVER "
                f"({self._day()} ORDER BY {v} {way} NULLS LAST, symbol) END"
            )

        return self._once(build, "place", x, descending)

    def total(self, x):
        return self._once(lambda: E(f"sum({_text(x)}) OVER ()"), "total", x)
