"""Properties of SURVEY §5.3-5.4: planted truth, cluster/HC1 identity,
nesting, trimming identity, cross-check against Spark ML."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from regframe.operators.glm import GLMSpec, fit_glm
from regframe.operators.linear import ModelSpec, fit_ols


@pytest.fixture(scope="module")
def planted(spark):
    # y = 2 + 0.5 a - 1.5 b + noise, generated by Spark itself
    df = (spark.range(20000).select(F.col("id"), F.randn(1).alias("a"), F.randn(2).alias("b"),
                                    F.randn(3).alias("u"))
          .withColumn("y", F.lit(2.0) + F.lit(0.5) * F.col("a") - F.lit(1.5) * F.col("b") + F.col("u"))
          .withColumn("g", (F.col("id") % 997).cast("string")))
    return df.persist()


def test_planted_coefficients_within_5_se(planted):
    r = fit_ols(planted, [ModelSpec("m", "y", ["a", "b"])])["m"]
    se = np.sqrt(np.diag(r.cov))
    assert np.all(np.abs(r.beta - np.array([2.0, 0.5, -1.5])) < 5 * se)


def test_cluster_with_singleton_groups_equals_hc1(planted):
    d = planted.withColumn("single", F.col("id").cast("string"))
    r = fit_ols(d, [ModelSpec("cl", "y", ["a", "b"], cov="cluster", groups="single"),
                    ModelSpec("h1", "y", ["a", "b"], cov="HC1")])
    np.testing.assert_allclose(r["cl"].cov, r["h1"].cov, rtol=1e-10)


def test_r2_nesting_and_zero_trim_identity(planted):
    r = fit_ols(planted, [ModelSpec("s", "y", ["a"]), ModelSpec("l", "y", ["a", "b"])])
    f = {x["model_id"]: x["r2"] for x in r.fit.collect()}
    assert f["s"] <= f["l"]
    trimmed = planted.filter(F.col("y") <= F.lit(1e9))          # excludes nothing
    r2 = fit_ols(trimmed, [ModelSpec("l", "y", ["a", "b"])])
    np.testing.assert_allclose(r2["l"].beta, r["l"].beta, rtol=1e-12)


def test_glm_matches_spark_ml(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 2, 500)
    y = np.exp(0.3 + 0.8 * x) * rng.gamma(5.0, 0.2, 500)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    vec = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    for fam in ("gamma", "poisson"):
        ml = GeneralizedLinearRegression(family=fam, link="log", labelCol="y", maxIter=100, tol=1e-12).fit(vec)
        ours = fit_glm(df, [GLMSpec("m", "y", ["x"], fam)])["m"]
        np.testing.assert_allclose(ours.beta, [ml.intercept, ml.coefficients[0]], rtol=1e-6)


def test_hc3_invariant_to_row_order(planted):
    a = fit_ols(planted, [ModelSpec("m", "y", ["a", "b"])])["m"].cov
    b = fit_ols(planted.orderBy(F.rand(9)).repartition(3), [ModelSpec("m", "y", ["a", "b"])])["m"].cov
    np.testing.assert_allclose(a, b, rtol=1e-9)


def test_moderation_model_a_raw_vs_centred(planted):
    from regframe.operators.mediation import moderation
    d = planted.withColumn("w", F.col("b") * 0.5 + F.sin(F.col("id")))
    raw = moderation(d, "a", "w", "y")
    cen = moderation(d, "a", "w", "y", centered_a=True)
    # same slopes and R^2, other intercept
    np.testing.assert_allclose(raw["a"].beta[1:], cen["a"].beta[1:], rtol=1e-10)
    np.testing.assert_allclose(raw["b"].beta[1:], cen["b"].beta[1:], rtol=1e-10)
    fr = {x["model_id"]: x["r2"] for x in raw.fit.collect()}
    fc = {x["model_id"]: x["r2"] for x in cen.fit.collect()}
    assert fr["a"] == pytest.approx(fc["a"], rel=1e-10) and fr["b"] == pytest.approx(fc["b"], rel=1e-10)
    assert fr["a"] <= fr["b"] <= fr["c"] + 1e-12
