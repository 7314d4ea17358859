"""Special functions as Spark Column expressions (no Python per row).

Spark SQL has no ``lgamma``; GLM log-likelihoods need it per row. Here:
shift the argument up by 8 with the recurrence
``lgamma(x) = lgamma(x + 8) - ln(x (x+1) ... (x+7))`` and apply the Stirling
series there (absolute error below 1e-12 for x > 0).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_HALF_LN_2PI = 0.5 * math.log(2.0 * math.pi)
# Stirling series coefficients B_2k / (2k (2k-1)), k = 1..5
_STIRLING = [1.0 / 12.0, -1.0 / 360.0, 1.0 / 1260.0, -1.0 / 1680.0, 1.0 / 1188.0]


def lgamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0."""
    prod = x
    for k in range(1, 8):
        prod = prod * (x + F.lit(float(k)))
    z = x + F.lit(8.0)
    zinv = F.lit(1.0) / z
    z2 = zinv * zinv
    series = F.lit(_STIRLING[-1])
    for c in reversed(_STIRLING[:-1]):
        series = F.lit(c) + z2 * series
    st = (z - F.lit(0.5)) * F.ln(z) - z + F.lit(_HALF_LN_2PI) + zinv * series
    return st - F.ln(prod)


def lgamma_py(x: float) -> float:
    """Driver-side scalar (for constants such as lgamma(1/scale))."""
    return math.lgamma(x)


def lgamma_sql(x: str) -> str:
    """SQL text of :func:`lgamma` for an argument given as SQL text."""
    from .sqltext import lit
    prod = "(" + " * ".join([x] + [f"({x} + {lit(float(k))})" for k in range(1, 8)]) + ")"
    z = f"({x} + 8D)"
    series = lit(_STIRLING[-1])
    for c in reversed(_STIRLING[:-1]):
        series = f"({lit(c)} + (1D / ({z} * {z})) * {series})"
    return (f"(({z} - 0.5D) * ln({z}) - {z} + {lit(_HALF_LN_2PI)} + (1D / {z}) * {series} - ln({prod}))")
