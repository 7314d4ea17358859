"""Tails as Column expressions against ``math.erfc``, closed forms and quadrature."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from regframe.functions.tail_columns import chi2_2_p, erfc, f_p, normal_p, t_p

TOL = 1e-10


def _column(spark, rows, names, expression):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "at int, " + ", ".join(f"{n} double" for n in names))
    return [r.p for r in df.select("at", expression(*[F.col(n) for n in names]).alias("p")).orderBy("at").collect()]


def _near(got, want):
    return [(g, w) for g, w in zip(got, want) if abs(g - w) > TOL * abs(w) + 1e-300]


def quadrature(power, lo, panels=4000):
    """Integral of cos(theta)^power from theta to pi/2, summed from logarithms."""
    x, w = np.polynomial.legendre.leggauss(16)
    # the integrand falls by exp(-power * tan(lo) * width): panels where it lives
    width = min(math.pi / 2 - lo, 60 / max(1.0, power * math.tan(lo), math.sqrt(power)))
    edges = lo + width * np.linspace(0, 1, panels + 1)
    mid, half = (edges[1:] + edges[:-1]) / 2, (edges[1:] - edges[:-1]) / 2
    theta = mid[:, None] + half[:, None] * x
    # relative to cos(lo), so that nothing underflows
    drop = 0.5 * math.log1p(math.tan(lo) ** 2)
    value = np.exp(power * (drop - 0.5 * np.log1p(np.tan(theta) ** 2)))
    return float((value * w * half[:, None]).sum()), -power * drop


def plain_t(t, df):
    """From the density of theta = atan(t / sqrt(df)), which is cos^(df-1), over its integral from 0."""
    top, log_top = quadrature(df - 1, math.atan(abs(t) / math.sqrt(df)))
    whole, _ = quadrature(df - 1, 0.0)
    return math.exp(log_top) * top / whole


def test_normal_tail_to_thirty_deviations(spark):
    z = [0.0, 1e-9, 0.3, 1.0, 1.959963984540054, 2.82, 2.83, 3.7, 5.0, 7.0, -7.0, 12.0, 20.0, 30.0, 37.0]
    got = _column(spark, [(v,) for v in z], ["z"], normal_p)
    assert not _near(got, [math.erfc(abs(v) / math.sqrt(2)) for v in z])
    dense = [i / 20 for i in range(521)]
    assert not _near(_column(spark, [(v,) for v in dense], ["x"], erfc), [math.erfc(v) for v in dense])
    odd = _column(spark, [(None,), (float("nan"),), (1e9,), (float("inf"),)], ["z"], normal_p)
    assert odd[0] is None and math.isnan(odd[1]) and odd[2:] == [0.0, 0.0]
    assert not _near(_column(spark, [(v,) for v in z], ["x"], chi2_2_p), [math.exp(-v / 2) for v in z])


def test_t_tail_closed_forms(spark):
    """1, 2 and 4 degrees of freedom have closed forms."""
    t = [1e-6, 0.1, 1.0, 2.5, 12.706204736, 300.0, 1e5]
    one = _column(spark, [(v, 1.0) for v in t], ["t", "df"], t_p)
    assert not _near(one, [2 / math.pi * math.atan(1 / v) for v in t])
    two = _column(spark, [(v, 2.0) for v in t], ["t", "df"], t_p)
    assert not _near(two, [2 / (math.sqrt(2 + v * v) * (math.sqrt(2 + v * v) + v)) for v in t])
    assert abs(_column(spark, [(2.7764451051977987, 4.0)], ["t", "df"], t_p)[0] - 0.05) < 1e-12


@pytest.mark.parametrize("df", [3, 7, 59, 60, 61, 200, 999, 3362, 50_000, 4_000_000, 1_000_000_000])
def test_t_tail_equals_quadrature(spark, df):
    t = [0.01, 0.5, 1.3, 1.96, 3.0, 6.5, 15.0, 33.0]
    got = _column(spark, [(v, float(df)) for v in t], ["t", "df"], t_p)
    want = [plain_t(v, df) for v in t]
    assert not _near(got, want) or max(abs(g / w - 1) for g, w in _near(got, want)) < 3e-10


def plain_f(f, d1, d2):
    """Even ``d1``: a finite sum. I_x(d2/2, m) = x^a sum_j (a)_j (1-x)^j / j!."""
    a, rest, total, term = d2 / 2, d1 * f / (d2 + d1 * f), 0.0, 1.0
    for j in range(d1 // 2):
        total += term
        term *= (a + j) * rest / (j + 1)
    return math.exp(-a * math.log1p(d1 * f / d2)) * total


@pytest.mark.parametrize("d1", [2, 4, 10, 30, 200])
def test_f_tail_equals_finite_sums(spark, d1):
    rows = [(f, float(d1), float(d2)) for f in (0.2, 0.9, 1.0, 1.7, 4.0, 11.0, 40.0) for d2 in (5, 60, 61, 508, 3364, 100_000, 10_000_000)]
    got = _column(spark, rows, ["f", "d1", "d2"], f_p)
    want = [plain_f(f, int(a), d2) for f, a, d2 in rows]
    assert not [(r, g, w) for r, g, w in zip(rows, got, want) if w > 1e-280 and abs(g - w) > TOL * w]


def test_f_of_one_is_the_square_of_t(spark):
    rows = [(t, float(df)) for t in (0.3, 1.7, 5.0, 14.0) for df in (6, 77, 5000, 10 ** 7)]
    t = _column(spark, rows, ["t", "df"], t_p)
    f = _column(spark, [(a * a, 1.0, b) for a, b in rows], ["f", "d1", "d2"], f_p)
    assert not _near(t, f)


def test_tails_of_missing_and_extreme_values(spark):
    nan = float("nan")
    got = _column(spark, [(None, 5.0), (nan, 5.0), (0.0, 5.0), (2.0, 0.0), (2.0, None), (float("inf"), 5.0)], ["t", "df"], t_p)
    assert got[0] is None and math.isnan(got[1]) and got[2] == 1.0 and got[3] is None and got[4] is None and got[5] == 0.0
    got = _column(spark, [(-1.0, 3.0, 4.0), (0.0, 3.0, 4.0), (1.0, 0.0, 4.0), (None, 3.0, 4.0)], ["f", "d1", "d2"], f_p)
    assert got == [1.0, 1.0, None, None]
