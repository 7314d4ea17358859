import numpy as np
import pytest

from regframe.operators.bootstrap import boot_ci, boot_replicates, draw_uniforms, with_uniform
from regframe.operators.glm import GLMSpec, fit_glm


def _irls(X, y, fam, iters=100):
    Xc = np.column_stack([np.ones(len(y)), X])
    b = np.zeros(Xc.shape[1])
    mu0 = y.mean()
    b[0] = np.log(mu0 / (1 - mu0)) if fam == "binomial" else np.log(mu0)
    for _ in range(iters):
        eta = Xc @ b
        if fam == "binomial":
            mu = 1 / (1 + np.exp(-eta)); w = mu * (1 - mu); z = eta + (y - mu) / w
        elif fam == "poisson":
            mu = np.exp(eta); w = mu; z = eta + (y - mu) / mu
        else:
            mu = np.exp(eta); w = np.ones_like(mu); z = eta + (y - mu) / mu
        b = np.linalg.solve(Xc.T @ (w[:, None] * Xc), Xc.T @ (w * z))
    eta = Xc @ b
    mu = 1 / (1 + np.exp(-eta)) if fam == "binomial" else np.exp(eta)
    if fam == "binomial":
        bw, sf = mu * (1 - mu), y - mu
    elif fam == "poisson":
        bw, sf = mu, y - mu
    else:
        bw, sf = y / mu, (y - mu) / mu
    A = Xc.T @ (bw[:, None] * Xc)
    B = Xc.T @ ((sf ** 2)[:, None] * Xc)
    Ai = np.linalg.inv(A)
    return b, Ai @ B @ Ai


@pytest.mark.parametrize("fam", ["binomial", "poisson", "gamma"])
def test_glm_matches_numpy(spark, fam):
    rng = np.random.default_rng(11)
    n = 400
    x = rng.uniform(0, 1, n)
    if fam == "binomial":
        y = 1 / (1 + np.exp(-(-3 + 2 * x + rng.normal(0, 0.3, n))))
    else:
        y = np.exp(0.5 + 1.5 * x) * rng.gamma(4.0, 0.25, n)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double").repartition(4)
    r = fit_glm(df, [GLMSpec("m", "y", ["x"], fam)])["m"]
    b, V = _irls(x, y, fam)
    np.testing.assert_allclose(r.beta, b, rtol=1e-9, atol=1e-12)
    np.testing.assert_allclose(r.cov, V, rtol=1e-8)
    assert r.stats["pseudo_r2"] > 0


def test_glm_domain_check(spark):
    df = spark.createDataFrame([(0.0, 1.5), (1.0, 0.5), (2.0, 0.2)], "x double, y double")
    with pytest.raises(ValueError):
        fit_glm(df, [GLMSpec("m", "y", ["x"], "binomial")], check_domain=True)
    r = fit_glm(df, [GLMSpec("m", "y", ["x"], "binomial"), GLMSpec("g", "y", ["x"], "gamma")])
    assert (r["m"].status, r["g"].status) == ("domain", "ok")


def test_glm_survives_overshooting_steps_and_large_predictors(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_cauchy(500) * 30
    y = np.clip(1 / (1 + np.exp(-(0.3 * np.clip(x, -40, 40) + rng.normal(size=500)))), 1e-6, 1 - 1e-6)
    big = 5e6 + 1e5 * rng.normal(size=500)
    c = rng.poisson(np.exp(1 + 2e-6 * (big - 5e6))).astype(float)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(x, y, big, c)],
                               "x double, y double, big double, c double")
    r = fit_glm(df, [GLMSpec("wild", "y", ["x"], "binomial"), GLMSpec("big", "c", ["big"], "poisson")])
    assert r["wild"].status == "ok" and r["big"].status == "ok"
    mu = np.exp(r["big"].beta[0] + r["big"].beta[1] * big)
    assert abs(((c - mu) * (big - big.mean())).sum()) < 1e-3 * (np.abs(c - mu) * np.abs(big - big.mean())).sum() / 1e3
    assert abs((c - mu).sum()) < 1e-6


@pytest.fixture(scope="module")
def med_df(spark):
    rng = np.random.default_rng(2)
    n = 600
    g = rng.integers(0, 120, n)
    x = rng.normal(size=n)
    m = 0.5 * x + rng.normal(size=n)
    y = 0.3 * m + 0.2 * x + rng.normal(size=n)
    rows = [(f"r{i}", f"g{g[i]}", float(x[i]), float(m[i]), float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id string, grp string, x double, m double, y double").repartition(6)


def test_bootstrap_deterministic_and_partition_invariant(med_df):
    a = boot_replicates(med_df, "x", "m", "y", B=200, seed=7, scheme="iid", key="id").orderBy("rep").collect()
    b = boot_replicates(med_df.repartition(2), "x", "m", "y", B=200, seed=7, scheme="iid",
                        key="id").orderBy("rep").collect()
    assert [r["indirect"] for r in a] == pytest.approx([r["indirect"] for r in b], rel=1e-9)
    c = boot_replicates(med_df, "x", "m", "y", B=200, seed=8, scheme="iid", key="id").orderBy("rep").collect()
    assert [r["indirect"] for r in a] != pytest.approx([r["indirect"] for r in c], rel=1e-9)


def test_bootstrap_centres_on_point_estimate(med_df):
    d = med_df.toPandas()
    xa = np.column_stack([np.ones(len(d)), d.x])
    a = np.linalg.lstsq(xa, d.m, rcond=None)[0][1]
    b = np.linalg.lstsq(np.column_stack([xa, d.m]), d.y, rcond=None)[0][2]
    for scheme, kw in (("iid", {"key": "id"}), ("cluster", {"group": "grp"})):
        reps = boot_replicates(med_df, "x", "m", "y", B=400, seed=42, scheme=scheme, **kw)
        ci = boot_ci(reps).first()
        assert ci["n_valid"] == 400
        assert abs(ci["boot_mean"] - a * b) < 3 * ci["boot_sd"] / np.sqrt(400) + 0.02
        assert ci["ci_lo"] < a * b < ci["ci_hi"]
        w = reps.agg({"n_w": "avg"}).first()[0]
        expect = len(d) if scheme == "iid" else len(d)
        assert abs(w - expect) / expect < 0.05      # Poisson(1) weights: mean total weight ~ n


def test_multinomial_draws_exactly_n(med_df):
    reps = boot_replicates(med_df, "x", "m", "y", B=100, seed=3, scheme="iid", key="id", draw="multinomial")
    ws = {r["n_w"] for r in reps.collect()}
    assert ws == {600.0}
    ci = boot_ci(boot_replicates(med_df, "x", "m", "y", B=200, seed=3, scheme="cluster", group="grp",
                                 draw="multinomial")).first()
    assert ci["n_valid"] == 200 and ci["ci_lo"] < ci["ci_hi"]


def test_bootstrap_refuses_no_size_and_needs_a_row_key(med_df):
    reps = boot_replicates(med_df.limit(3), "x", "m", "y", B=1_000_001, seed=3, scheme="iid", key="id")
    assert reps.columns == ["rep", "n_w", "a", "b", "indirect"]
    with pytest.raises(ValueError, match="identify"):
        boot_replicates(med_df, "x", "m", "y", B=10, scheme="iid", key="grp")


def test_draws_of_replicates_are_uncorrelated():
    u_n, picked = 1_000_000, [0, 1, 2, 3, 50, 777, 1510, 1511, 1512, 1999]
    counts = [np.bincount((draw_uniforms(u_n, r, 0, 42) * u_n).astype(int), minlength=u_n) for r in picked]
    c = np.corrcoef(counts) - np.eye(len(picked))
    assert np.abs(c).max() < 6 / np.sqrt(u_n)
    assert abs(np.var(counts[0]) - 1) < 0.01                      # Poisson-like counts
    few = 2_000
    small = np.array([np.bincount((draw_uniforms(few, r, 0, 42) * few).astype(int), minlength=few)
                      for r in range(2_000)], float)
    c = np.corrcoef(small) - np.eye(len(small))
    assert np.abs(c).max() < 7 / np.sqrt(few) and abs(c.mean()) < 1e-3


def test_numpy_and_column_uniforms_agree(spark):
    rows = [(int(a), int(b)) for a, b in np.random.default_rng(0).integers(0, 2**32, (50, 2))]
    d = spark.createDataFrame([(a, b, 5, 9) for a, b in rows], "__k1 long, __k2 long, __r1 long, __r2 long")
    got = sorted(r["__u"] for r in with_uniform(d).collect())

    def mix(v):
        return ((v ^ (v >> 16)) * 73244475) % 2**32

    want = []
    for k1, k2 in rows:
        a, b = mix(k1 ^ 5), k2 ^ 9
        b = mix(b ^ a)
        a = mix(a ^ b)
        b = mix(b ^ a)
        want.append(((a ^ (a >> 16)) * 2**20 + ((b ^ (b >> 16)) >> 12)) / 2**52)
    assert got == sorted(want)


def test_multinomial_over_many_blocks(med_df):
    from regframe.operators import bootstrap as T
    base = med_df.selectExpr("id AS __g", *[f"1.0D AS {n}" for n in T._STATS])
    sums = T._multinomial(base, 40, 5, block=64).collect()
    assert len(sums) == 40 and {r["w"] for r in sums} == {600.0}


def test_numpy_poisson_weights_equal_the_columns(spark):
    from pyspark.sql import functions as F
    from regframe.operators import bootstrap as T
    words = np.random.default_rng(3).integers(0, 2**32, (2, 400), dtype=np.uint32)
    d = spark.createDataFrame([(int(a), int(b), 0, 0) for a, b in words.T], "__k1 long, __k2 long, __r1 long, __r2 long")
    want = d.withColumn("a", F.col("__k1")).withColumn("b", F.col("__k2"))
    rows = with_uniform(want).withColumn("w", T.poisson1_weight(F.col("__u"))).collect()
    got = dict(zip(zip(*words.tolist()), T.poisson1_counts(*words.copy()).tolist()))
    assert got == {(r.a, r.b): r.w for r in rows} and max(got.values()) > 3

    def unmixed(x):
        x = x * np.uint32(pow(T.MIX, -1, 2**32))
        return x ^ (x >> np.uint32(16))

    # words whose upper 32 bits are those of a threshold, so that the other 20 decide
    first = np.random.default_rng(4).integers(0, 2**32, 300, dtype=np.uint32)
    exact = np.array(T.poisson1_thresholds())
    for t in exact[np.ceil(exact * 2.0**52) < 2.0**52]:
        top = np.uint32(int(np.ceil(t * 2.0**52)) >> 20)
        second = unmixed(np.full(300, top ^ (top >> np.uint32(16)))) ^ first
        a, b = unmixed(first), unmixed(second) ^ first
        hi, low = a.copy(), b.copy()
        T._high_words(hi, low)
        assert (hi == top).all()
        u = T._exact(hi, low) / 2.0**52
        assert T.poisson1_counts(a, b).tolist() == np.searchsorted(exact, u, side="right").tolist()


def test_draw_counts_take_all_bits_near_whole_numbers():
    from regframe.operators import bootstrap as T
    n, seed = 400_000, 42
    words, (r1, r2) = T.draw_words(n, 7, seed), T.replicate_words(seed, [11])
    for size in (1, 997, 65_536):
        unit = np.minimum((draw_uniforms(n, 11, 7, seed) * size).astype(int), size - 1)
        assert T.draw_counts(n, words, r1[0], r2[0], size).tolist() == np.bincount(unit, minlength=size).tolist()


def test_poisson_weights_never_become_rows(med_df):
    reps = boot_replicates(med_df, "x", "m", "y", B=300, seed=7, scheme="iid", key="id")
    plan = reps._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan
    assert reps.count() == 300


@pytest.mark.parametrize("fam", ["binomial", "gamma"])
def test_glm_hc3_option_matches_numpy(spark, fam):
    rng = np.random.default_rng(12)
    n = 300
    x = rng.uniform(0, 1, n)
    y = (1 / (1 + np.exp(-(-2 + x + rng.normal(0, 0.4, n))))) if fam == "binomial" else \
        np.exp(0.2 + x) * rng.gamma(3.0, 1 / 3.0, n)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    r = fit_glm(df, [GLMSpec("m", "y", ["x"], fam, cov="HC3"), GLMSpec("h1", "y", ["x"], fam, cov="HC1")])
    b, V0 = _irls(x, y, fam)
    Xc = np.column_stack([np.ones(n), x])
    eta = Xc @ b
    mu = 1 / (1 + np.exp(-eta)) if fam == "binomial" else np.exp(eta)
    w = mu * (1 - mu) if fam == "binomial" else np.ones(n)
    bw = w if fam == "binomial" else y / mu
    sf = (y - mu) if fam == "binomial" else (y - mu) / mu
    h = w * np.einsum("ij,jk,ik->i", Xc, np.linalg.inv(Xc.T @ (w[:, None] * Xc)), Xc)
    Ai = np.linalg.inv(Xc.T @ (bw[:, None] * Xc))
    V3 = Ai @ (Xc.T @ (((sf / (1 - h)) ** 2)[:, None] * Xc)) @ Ai
    np.testing.assert_allclose(r["m"].cov, V3, rtol=1e-8)
    np.testing.assert_allclose(r["h1"].cov, V0 * n / (n - 2), rtol=1e-8)
