"""Wide models and wide correlation tables against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import regframe.operators.linear as linear
import regframe.operators.moments as moments
from regframe.operators.describe import corr_pairwise
from regframe.operators.linear import ModelSpec, fit_ols, ols


def _data(n, k, seed=1, missing=0.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, k)) * rng.uniform(0.1, 10, k) + rng.uniform(-50, 50, k)
    y = x @ rng.normal(size=k) + rng.normal(size=n) * (1 + np.abs(x[:, 0]) / 50) + 3
    pdf = pd.DataFrame(x, columns=[f"x{j}" for j in range(k)]).assign(y=y, g=[f"g{v}" for v in rng.integers(0, 40, n)])
    if missing:
        for c in pdf.columns[:5]:
            pdf.loc[rng.random(n) < missing, c] = np.nan
    return pdf


def plain_ols(pdf, y, x, cov, groups=None, log_y=False):
    d = pdf.dropna(subset=[y, *x])
    yy = np.log(d[y].to_numpy()) if log_y else d[y].to_numpy()
    X = np.column_stack([np.ones(len(d)), d[x].to_numpy()])
    q, r = np.linalg.qr(X)
    b = np.linalg.solve(r, q.T @ yy)
    e, h = yy - X @ b, (q * q).sum(axis=1)
    bread = np.linalg.inv(r) @ np.linalg.inv(r).T
    n, p = X.shape
    if cov == "classical":
        v = bread * (e @ e) / (n - p)
    elif cov == "cluster":
        u = pd.DataFrame(X * e[:, None]).groupby(d[groups].to_numpy()).sum().to_numpy()
        g = len(u)
        v = bread @ (u.T @ u) @ bread * g / (g - 1) * (n - 1) / (n - p)
    else:
        w = e ** 2 / (1 - h) ** {"HC0": 0, "HC1": 0, "HC2": 1, "HC3": 2}[cov]
        v = bread @ (X.T @ (X * w[:, None])) @ bread * (n / (n - p) if cov == "HC1" else 1)
    return b, np.sqrt(np.diag(v)), e, h, n


def _close(got, want, tol=1e-9):
    return np.max(np.abs(np.asarray(got) - want) / (1e-12 + np.abs(want))) < tol


def _coefs(fit, model_id, x):
    rows = {r.term: r for r in fit.coef.filter(F.col("model_id") == model_id).collect()}
    return [rows[t].coef for t in ["const", *x]], [rows[t].se for t in ["const", *x]]


def test_two_hundred_predictors_equal_numpy(spark):
    pdf = _data(3000, 200)
    x = [f"x{j}" for j in range(200)]
    fit = ols(spark.createDataFrame(pdf).repartition(7), "y", x, model_id="w")
    b, se, e, _, n = plain_ols(pdf, "y", x, "HC3")
    got = _coefs(fit, "w", x)
    assert _close(got[0], b) and _close(got[1], se)
    row = fit.fit.first()
    assert row.n_used == n and row.status == "ok" and abs(row.ssr / (e @ e) - 1) < 1e-9


@pytest.mark.parametrize("cov", ["HC0", "HC1", "HC2", "HC3", "classical", "cluster"])
def test_wide_battery_with_gaps_equals_numpy(spark, cov):
    pdf = _data(900, 12, missing=0.05)
    pdf["pos"] = np.exp(pdf.y / pdf.y.std() / 5)
    x = [f"x{j}" for j in range(12)]
    specs = [ModelSpec("all", "y", x, cov, "g" if cov == "cluster" else None),
             ModelSpec("some", "pos", x[2:], cov, "g" if cov == "cluster" else None, log_y=True),
             ModelSpec("narrow", "y", x[:2], cov, "g" if cov == "cluster" else None)]
    df = spark.createDataFrame(pdf).repartition(5)
    df = df.withColumn("x1", F.when(~F.isnan("x1"), F.col("x1")))          # NULL and NaN are both missing
    fit = fit_ols(df, specs)
    assert list(fit.models) == ["all", "some", "narrow"]
    for s in specs:
        b, se, _, _, n = plain_ols(pdf, s.y, s.x, cov, "g", s.log_y)
        got = _coefs(fit, s.model_id, s.x)
        assert _close(got[0], b) and _close(got[1], se) and fit[s.model_id].n == n


def test_wide_equals_narrow_path(spark, monkeypatch):
    pdf = _data(400, 6, missing=0.1)
    x = [f"x{j}" for j in range(6)]
    df = spark.createDataFrame(pdf).repartition(3)
    specs = [ModelSpec(c, "y", x, c, "g" if c == "cluster" else None) for c in ("HC3", "classical", "cluster")]
    narrow = fit_ols(df, specs).coef.toPandas()
    monkeypatch.setattr(linear, "SQL_WIDTH", 2)
    wide = fit_ols(df, specs).coef.toPandas()
    assert list(narrow.term) == list(wide.term) and _close(wide[["coef", "se"]], narrow[["coef", "se"]].to_numpy())


def test_wide_statuses(spark):
    pdf = _data(40, 10)
    x = [f"x{j}" for j in range(10)]
    pdf["const"], pdf["sum"] = 7.3, pdf.x0 + pdf.x1
    df = spark.createDataFrame(pdf)
    null_group = df.withColumn("g", F.when(F.col("x0") > F.lit(float(pdf.x0.median())), F.col("g")))
    fit = fit_ols(df, [ModelSpec("const", "y", [*x[:9], "const"]), ModelSpec("sum", "y", [*x, "sum"]),
                       ModelSpec("domain", "y", x, log_y=True), ModelSpec("good", "y", x)])
    assert [m.status for m in fit.models.values()] == ["singular", "singular", "domain", "ok"]
    assert ols(df.limit(5), "y", x)["m"].status == "insufficient"
    assert ols(df.limit(0), "y", x)["m"].status == "insufficient"
    assert ols(null_group, "y", x, "cluster", "g")["m"].status == "null group"
    lone = df.withColumn("x9", F.when(F.col("x0") == F.lit(float(pdf.x0.max())), 1.0).otherwise(0.0))
    assert ols(lone, "y", x)["m"].status == "leverage one"


def test_wide_leverage_and_cooks_distance(spark):
    pdf = _data(200, 10, missing=0.03)
    x = [f"x{j}" for j in range(10)]
    df = spark.createDataFrame(pdf)
    m = ols(df, "y", x, "classical")["m"]
    rows = df.na.drop(subset=["y", *x]).select(m.leverage().alias("h"), m.cooks_distance().alias("d"), m.resid().alias("e")).toPandas()
    _, _, e, h, n = plain_ols(pdf, "y", x, "classical")
    s2 = e @ e / (n - 11)
    assert np.allclose(np.sort(rows.h), np.sort(h), rtol=1e-8)
    assert np.allclose(np.sort(rows.d), np.sort(e ** 2 * h / (11 * s2 * (1 - h) ** 2)), rtol=1e-7)
    assert df.select(m.leverage().alias("h")).filter("h IS NULL").count() == len(pdf) - n


def test_bands_of_a_matrix_join(spark, monkeypatch):
    monkeypatch.setattr(moments, "BAND", 4)
    pdf = _data(300, 15)
    x = [f"x{j}" for j in range(15)]
    fit = ols(spark.createDataFrame(pdf).repartition(6), "y", x, model_id="w")
    b, se, *_ = plain_ols(pdf, "y", x, "HC3")
    got = _coefs(fit, "w", x)
    assert _close(got[0], b) and _close(got[1], se)


def _plain_corr(pdf, cols):
    out = {}
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            d = pdf[[a, b]].dropna().to_numpy()
            n = len(d)
            ok = n > 1 and np.ptp(d[:, 0]) > 0 and np.ptp(d[:, 1]) > 0
            out[a, b] = n, np.corrcoef(d.T)[0, 1] if ok else None
    return out


@pytest.mark.parametrize("k, tile, pairs", [(500, 128, 64), (30, 7, 3)])
def test_wide_correlations_with_gaps_equal_a_plain_version(spark, monkeypatch, k, tile, pairs):
    monkeypatch.setattr(moments, "TILE", tile)
    monkeypatch.setattr(moments, "TILE_PAIRS", pairs)
    rng = np.random.default_rng(5)
    n = 60
    x = rng.normal(size=(n, 3)) @ rng.normal(size=(3, k)) + rng.normal(size=(n, k)) + rng.uniform(-1e4, 1e4, k)
    x[rng.random((n, k)) < 0.2] = np.nan
    x[:, 4], x[:, 5] = 2.5, np.nan                        # a constant, and a column without a value
    cols = [f"v{j}" for j in range(k)]
    pdf = pd.DataFrame(x, columns=cols)
    df = spark.createDataFrame(pdf).repartition(4)
    got = {(r.var_i, r.var_j): (r.n, r.r, r.t) for r in corr_pairwise(df, cols).collect()}
    want = _plain_corr(pdf, cols)
    assert set(got) == set(want)
    for pair, (m, r) in want.items():
        assert got[pair][0] == m and (got[pair][1] is None) == (r is None)
        assert r is None or abs(got[pair][1] - r) < 1e-9


def test_wide_correlations_of_an_empty_table(spark):
    cols = [f"v{j}" for j in range(30)]
    df = spark.createDataFrame([], ", ".join(f"{c} double" for c in cols))
    got = corr_pairwise(df, cols).collect()
    assert len(got) == 30 * 29 // 2 and all(r.n == 0 and r.r is None and r.t is None for r in got)
