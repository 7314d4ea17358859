import numpy as np
import pytest

from regframe.operators.linear import ModelSpec, fit_ols


def _se(res, mid):
    return np.sqrt(np.diag(res[mid].cov))


def test_f3_y_on_x_all_covariances(f3):
    specs = [ModelSpec("hc3", "y", ["x"]), ModelSpec("cl", "y", ["x"], cov="classical"),
             ModelSpec("grp", "y", ["x"], cov="cluster", groups="g")]
    r = fit_ols(f3, specs)
    np.testing.assert_allclose(r["hc3"].beta, [0.9047619, 1.1714286], atol=1e-7)
    np.testing.assert_allclose(_se(r, "hc3"), [0.8082336, 0.4371746], atol=1e-7)
    np.testing.assert_allclose(_se(r, "cl"), [0.9449712, 0.3121137], atol=1e-7)
    np.testing.assert_allclose(_se(r, "grp"), [0.6784823, 0.1560239], atol=1e-7)
    fit = {row["model_id"]: row for row in r.fit.collect()}
    assert fit["hc3"]["r2"] == pytest.approx(0.7788417, abs=1e-7)
    assert fit["hc3"]["adj_r2"] == pytest.approx(0.7235521, abs=1e-7)
    assert fit["hc3"]["ll"] == pytest.approx(-8.8975122, abs=1e-7)
    assert fit["hc3"]["aic"] == pytest.approx(21.7950245, abs=1e-7)
    assert fit["hc3"]["bic"] == pytest.approx(21.3785434, abs=1e-7)
    assert fit["hc3"]["f"] == pytest.approx(7.1799558, abs=1e-6)


def test_f3_two_predictors(f3):
    specs = [ModelSpec("hc3", "y", ["x", "m"]), ModelSpec("cl", "y", ["x", "m"], cov="classical"),
             ModelSpec("grp", "y", ["x", "m"], cov="cluster", groups="g"),
             ModelSpec("a", "m", ["x"])]
    r = fit_ols(f3, specs)
    np.testing.assert_allclose(r["hc3"].beta, [1.6666667, 1.6666667, -1.3333333], atol=1e-7)
    np.testing.assert_allclose(_se(r, "hc3"), [0.8842239, 0.4480410, 0.4929127], atol=1e-7)
    np.testing.assert_allclose(_se(r, "cl"), [0.5289947, 0.2127616, 0.3795167], atol=1e-7)
    np.testing.assert_allclose(_se(r, "grp"), [0.2484520, 0.3105650, 0.4347910], atol=1e-7)
    np.testing.assert_allclose(_se(r, "a"), [0.7493524, 0.2459773], atol=1e-7)
    fit = {row["model_id"]: row for row in r.fit.collect()}
    assert fit["hc3"]["f"] == pytest.approx(6.9190601, abs=1e-6)
    assert fit["a"]["f"] == pytest.approx(2.2801349, abs=1e-6)


def test_cooks_distance_and_leverage(f3):
    from pyspark.sql import functions as F
    r = fit_ols(f3, [ModelSpec("c", "y", ["x"], cov="classical")])
    m = r["c"]
    got = f3.select("x", m.leverage().alias("h"), m.cooks_distance().alias("d")).orderBy("x").collect()
    np.testing.assert_allclose([g["d"] for g in got],
                               [0.0061453, 0.1487848, 0.1231449, 0.0267014, 0.4410097, 1.0385475], atol=1e-7)
    np.testing.assert_allclose([g["h"] for g in got][:3], [0.5238095, 0.2952381, 0.1809524], atol=1e-7)


def test_matches_numpy_on_random_data(spark):
    rng = np.random.default_rng(1)
    n = 200
    X = rng.normal(size=(n, 3))
    y = 1 + X @ np.array([0.5, -1.0, 2.0]) + rng.normal(size=n) * (1 + np.abs(X[:, 0]))
    rows = [tuple(map(float, (*X[i], y[i]))) for i in range(n)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double").repartition(5)
    r = fit_ols(df, [ModelSpec("m", "y", ["a", "b", "c"])])
    Xc = np.column_stack([np.ones(n), X])
    bhat, *_ = np.linalg.lstsq(Xc, y, rcond=None)
    XtXi = np.linalg.inv(Xc.T @ Xc)
    e = y - Xc @ bhat
    h = np.einsum("ij,jk,ik->i", Xc, XtXi, Xc)
    meat = (Xc * ((e / (1 - h)) ** 2)[:, None]).T @ Xc
    V = XtXi @ meat @ XtXi
    np.testing.assert_allclose(r["m"].beta, bhat, rtol=1e-10)
    np.testing.assert_allclose(r["m"].cov, V, rtol=1e-9)


def test_null_nan_constant_and_small(spark):
    rows = [(1.0, 1.0, 2.0), (2.0, float("nan"), 2.0), (None, 3.0, 2.0), (4.0, 4.0, 2.0),
            (5.0, 5.0, 2.0), (6.0, 7.0, 2.0)]
    df = spark.createDataFrame(rows, "x double, y double, k double")
    r = fit_ols(df, [ModelSpec("ok", "y", ["x"]), ModelSpec("const", "y", ["k"]),
                     ModelSpec("tiny", "y", ["x", "k"])])
    fit = {row["model_id"]: row for row in r.fit.collect()}
    assert fit["ok"]["n_used"] == 4 and fit["ok"]["n_dropped"] == 2
    assert fit["const"]["status"] == "singular"
    assert fit["tiny"]["status"] == "singular"


def test_partition_invariance(f3):
    a = fit_ols(f3.repartition(1), [ModelSpec("m", "y", ["x", "m"])])
    b = fit_ols(f3.repartition(6), [ModelSpec("m", "y", ["x", "m"])])
    np.testing.assert_allclose(a["m"].cov, b["m"].cov, rtol=1e-12)
