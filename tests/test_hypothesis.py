"""Property tests with generated inputs (hypothesis)."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from regframe.functions.columns import normalize_key
from regframe.operators.linear import ModelSpec, fit_ols

WS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2005\u200a\u2028\u2029\u202f\u205f\u3000"
ALPHABET = st.sampled_from(list("abcXYZ-_#0189éÅß") + list(WS))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=ALPHABET, max_size=12), min_size=1, max_size=40))
def test_normalize_key_matches_python_strip(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r[0] for r in df.select(normalize_key("s")).collect()]
    assert got == [t.lower().strip() for t in texts]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(8, 60), k=st.integers(1, 3), parts=st.integers(1, 5), seed=st.integers(0, 10_000))
def test_hc3_matches_numpy(spark, n, k, parts, seed):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, k)) * rng.uniform(0.1, 100, size=k) + rng.uniform(-50, 50, size=k)
    y = 3 + X @ rng.normal(size=k) + rng.normal(size=n) * (1 + np.abs(X[:, 0]) / 100)
    cols = [f"x{j}" for j in range(k)]
    df = spark.createDataFrame([tuple(map(float, (*X[i], y[i]))) for i in range(n)],
                               ", ".join(f"{c} double" for c in cols) + ", y double").repartition(parts)
    r = fit_ols(df, [ModelSpec("m", "y", cols)])["m"]
    Xc = np.column_stack([np.ones(n), X])
    b = np.linalg.lstsq(Xc, y, rcond=None)[0]
    XtXi = np.linalg.inv(Xc.T @ Xc)
    e = y - Xc @ b
    h = np.einsum("ij,jk,ik->i", Xc, XtXi, Xc)
    V = XtXi @ ((Xc * ((e / (1 - h)) ** 2)[:, None]).T @ Xc) @ XtXi
    np.testing.assert_allclose(r.beta, b, rtol=1e-8, atol=1e-10)
    np.testing.assert_allclose(r.cov, V, rtol=1e-6, atol=1e-14)


def test_normalize_key_strips_what_python_strips_without_a_pattern(spark):
    blanks = [chr(i) for i in range(1, 0x10000) if chr(i).isspace()]
    near = ["\u200b", "\u180e", "\ufeff", "\u2060", "\x1b", "\x21"]
    texts = [f"{c}a{c} b{c}{c}" for c in blanks + near] + ["".join(blanks), "", "a\n b \n"]
    df = spark.createDataFrame([(t,) for t in texts], "s string").select("s", normalize_key("s").alias("n"))
    assert [(r.s, r.n) for r in df.collect()] == [(t, t.strip()) for t in texts]
    assert "regexp" not in df._jdf.queryExecution().optimizedPlan().toString()
