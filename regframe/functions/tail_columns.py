"""Distribution tails as Column expressions.

Spark SQL has neither ``erfc`` nor an incomplete beta function. Here they are
series and continued fractions of fixed length, written with ``aggregate`` over
a ``sequence``; an intermediate value is bound once by a one-element
``transform``. Everything runs in the executors, on result tables of any
length. Relative errors are below 1e-10 also far out in the tails.

* normal: ``erfc`` by its positive series below 2 and by Laplace's continued
  fraction above.
* Student t and F: the regularised incomplete beta function I_x(a, b), by
  Lentz's continued fraction; for many denominator degrees of freedom and x
  near 1, where that converges slowly, by an expansion in incomplete gamma
  functions about a + (b - 1)/2, whose terms all come from one recurrence.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .special import lgamma

_SERIES, _FRACTION, _LENTZ = 70, 130, 400
_EXPAND_FROM = 30.0            # a from which the expansion is used
_TINY = 1e-300
# ln(sinh(s/2) / (s/2)) = s^2/24 - s^4/2880 + ...: factors of s^2, s^4, ... (fixed values)
_LOG_SINH = [1 / 24, -1 / 2880, 1 / 181440, -1 / 9676800, 1 / 479001600]


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _steps(first: int | Column, last: int | Column) -> Column:
    first, last = (F.lit(v) if isinstance(v, int) else v for v in (first, last))
    return F.sequence(first.cast("int"), last.cast("int"))


def erfc(x: Column) -> Column:
    """``erfc`` of a number of at least 0; NULL and NaN stay."""
    def of(v: Column) -> Column:
        square = v * v
        series = F.aggregate(
            _steps(1, _SERIES), F.struct(v.alias("t"), v.alias("s")),
            lambda acc, k: _bound(acc["t"] * 2.0 * square / (2.0 * k + 1.0),
                                  lambda t: F.struct(t.alias("t"), (acc["s"] + t).alias("s"))), lambda acc: acc["s"])
        fraction = F.aggregate(_steps(1, _FRACTION), v, lambda acc, k: v + (_FRACTION + 1.0 - k) / 2.0 / acc)
        near = 1.0 - 2.0 / math.sqrt(math.pi) * F.exp(-square) * series
        far = F.exp(-square) / (math.sqrt(math.pi) * fraction)
        return F.when(F.isnan(v), v).when(v < 2.0, near).when(v < 40.0, far).when(v.isNotNull(), F.lit(0.0))

    return _bound(x.cast("double"), of)


def normal_p(z: Column) -> Column:
    """Two-sided normal tail ``2 (1 - Phi(|z|))``."""
    return erfc(F.abs(z) / math.sqrt(2.0))


def chi2_2_p(x: Column) -> Column:
    """Upper tail of chi-square with 2 degrees of freedom."""
    return F.exp(-x / 2.0)


def _stirling(x: Column) -> Column:
    """ln Gamma(x) - ((x - 1/2) ln x - x + ln(2 pi)/2), for x of at least 10."""
    y = 1.0 / (x * x)
    return (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y * (1 / 1680 - y * (1 / 1188 - y * 691 / 360360))))) / x


def _log_beta(a: Column, b: Column) -> Column:
    """ln B(a, b); the large logarithms of a large a cancel before they are computed."""
    large = (lgamma(b) - (a + b - 0.5) * F.log1p(b / a) - b * F.ln(a) + b + _stirling(a) - _stirling(a + b))
    return F.when(a >= 10.0, large).otherwise(lgamma(a) + lgamma(b) - lgamma(a + b))


def _lentz(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of I_x(a, b), for x below (a + 1) / (a + b + 2)."""
    def away(v: Column) -> Column:
        return F.when(F.abs(v) > _TINY, v).otherwise(_TINY)

    def half(state: Column, term: Column) -> Column:
        return _bound(F.struct((1.0 / away(1.0 + term * state["d"])).alias("d"), away(1.0 + term / state["c"]).alias("c")),
                      lambda n: F.struct(n["c"].alias("c"), n["d"].alias("d"), (state["h"] * n["c"] * n["d"]).alias("h")))

    def step(state: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2.0 * m - 1.0) * (a + 2.0 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2.0 * m) * (a + 2.0 * m + 1.0))
        return _bound(half(state, even), lambda s: half(s, odd))

    first = 1.0 / away(1.0 - (a + b) * x / (a + 1.0))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
    return F.aggregate(_steps(1, _LENTZ), start, step, lambda s: s["h"])


def _expansion(a: Column, b: Column, u: Column, whole_b: Column) -> Column:
    """I_x(a, b), x = 1 / (1 + u), as a ratio of series in incomplete gamma functions.

    With x = exp(-L): I_x(a, b) is the integral over s > L of exp(-T s) s^(b-1)
    (sinh(s/2) / (s/2))^(b-1), divided by the one over s > 0, T = a + (b-1)/2.
    """
    c = b - 1.0
    powers = [F.lit(1.0)]          # of s^2 in (sinh(s/2) / (s/2))^c
    for n in range(1, len(_LOG_SINH) + 1):
        powers.append(sum((j * _LOG_SINH[j - 1]) * c * powers[n - j] for j in range(1, n + 1)) / n)

    def of(v: Column) -> Column:   # T, and T L
        t, w = v["t"], v["w"]
        start = F.when(whole_b, F.struct(F.lit(1.0).alias("s"), F.exp(-w).alias("q"), (w * F.exp(-w)).alias("g"))).otherwise(
            F.struct(F.lit(0.5).alias("s"), erfc(F.sqrt(w)).alias("q"), (F.sqrt(w / math.pi) * 2.0 * F.exp(-w)).alias("g")))
        # q = Q(s, w); g = w^s exp(-w) / Gamma(s + 1), the step to Q(s + 1, w)
        def up(state: Column, _: Column) -> Column:
            return F.struct((state["s"] + 1.0).alias("s"), (state["q"] + state["g"]).alias("q"),
                            (state["g"] * w / (state["s"] + 1.0)).alias("g"))

        def ratio(state: Column) -> Column:
            rising, num, den = F.lit(1.0), F.lit(0.0), F.lit(0.0)
            q, g = state["q"], state["g"]
            for n, power in enumerate(powers):
                num, den = num + power * rising * q, den + power * rising
                s = b + 2.0 * n
                rising = rising * s * (s + 1.0) / (t * t)
                q = q + g + g * w / (s + 1.0)
                g = g * w * w / ((s + 1.0) * (s + 2.0))
            return num / den

        rises = F.round(b - F.when(whole_b, 1.0).otherwise(0.5)).cast("int")
        steps = F.when(rises > 0, F.sequence(F.lit(1), rises)).otherwise(F.array().cast("array<int>"))
        return _bound(F.aggregate(steps, start, up), ratio)

    top = a + c / 2.0
    return _bound(F.struct(top.alias("t"), (top * F.log1p(u)).alias("w")), of)


def _beta_tail(a: Column, b: Column, u: Column) -> Column:
    """I_x(a, b) at x = 1 / (1 + u), for whole or half a and b and u of at least 0."""
    def of(v: Column) -> Column:
        a, b, u = v["a"], v["b"], v["u"]
        x = 1.0 / (1.0 + u)
        front = F.exp(-a * F.log1p(u) + b * F.ln(u / (1.0 + u)) - _log_beta(a, b))
        fraction = F.when(x < (a + 1.0) / (a + b + 2.0), front * _lentz(a, b, x) / a).otherwise(
            1.0 - front * _lentz(b, a, u / (1.0 + u)) / b)
        reach = F.greatest(F.log1p(u), b / a)
        spread = F.abs(b - 1.0) * reach * reach / 24.0
        close = (a >= _EXPAND_FROM) & (F.log1p(u) <= 0.5) & (spread <= 0.02)
        whole = F.abs(b - F.round(b)) < 0.25
        return (F.when(F.isnan(u), u).when(u == 0.0, F.lit(1.0)).when(u == float("inf"), F.lit(0.0))
                .when(close, _expansion(a, b, u, whole)).otherwise(fraction))

    return _bound(F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"), u.cast("double").alias("u")), of)


def t_p(t: Column, df: Column) -> Column:
    """Two-sided Student-t tail for a whole number of degrees of freedom; NULL unless ``df`` is positive."""
    return F.when(df > 0, _beta_tail(df / 2.0, F.lit(0.5), t * t / df))


def f_p(f: Column, d1: Column, d2: Column) -> Column:
    """Upper tail of F(d1, d2) for whole degrees of freedom; NULL unless both are positive."""
    return F.when((d1 > 0) & (d2 > 0), F.when(f <= 0, F.lit(1.0)).otherwise(_beta_tail(d2 / 2.0, d1 / 2.0, d1 * f / d2)))
