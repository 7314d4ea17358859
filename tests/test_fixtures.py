"""Hand-checked fixtures of FIXTURES.md §4."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from regframe.functions.columns import TECH_KEYWORDS, composite, concat_names, keyword_flag, normalize_key
from regframe.functions.tails import f_sf, norm_sf2, t_sf2
from regframe.operators import assemble as A
from regframe.operators import describe as D
from regframe.operators.mediation import mediation


def test_f1_key_normalisation_and_indicator(spark):
    left = spark.createDataFrame([("  Foo Bar\t", 1.0), ("BAZ", 2.0), ("x", 3.0)], "task_name string, a double")
    right = spark.createDataFrame([("foo bar", 1.0), ("baz ", 2.0), ("y", 3.0)], "task_name string, b double")
    l2 = left.withColumn("task_name", normalize_key("task_name"))
    r2 = right.withColumn("task_name", normalize_key("task_name"))
    j = A.outer_join_indicator(l2, r2)
    got = {r["task_name"]: r["_merge"] for r in j.collect()}
    assert got == {"foo bar": "both", "baz": "both", "x": "left_only", "y": "right_only"}
    bd = {r["_merge"]: r["n_rows"] for r in A.merge_breakdown(j).collect()}
    assert bd == {"both": 2, "left_only": 1, "right_only": 1}
    gaps = {r["side"]: (r["n_keys"], r["sample"]) for r in A.key_gaps(l2, r2).collect()}
    assert gaps == {"left_only": (1, "x"), "right_only": (1, "y")}


def test_f2_shape_statistics(spark):
    rows = [(v,) for v in [1.0, 2.0, 2.0, 3.0, 10.0, None, float("nan")]]
    df = spark.createDataFrame(rows, "v double")
    r = D.descriptives(df, ["v"]).first()
    assert r["n"] == 5
    assert r["mean"] == pytest.approx(3.6)
    assert r["sd"] == pytest.approx(3.6469165, abs=1e-7)
    assert r["skewness"] == pytest.approx(2.0286991, abs=1e-7)
    assert r["kurtosis"] == pytest.approx(4.2721465, abs=1e-7)
    q = D.percentiles(df.where("NOT isnan(v)"), "v", [0.025, 0.975]).first()["q"]
    assert q == pytest.approx([1.1, 9.3])


def test_f4_mediation(f3):
    r = mediation(f3, "x", "m", "y").first()
    assert r["c"] == pytest.approx(1.1714286, abs=1e-7)
    assert r["a"] == pytest.approx(0.3714286, abs=1e-7)
    assert r["b"] == pytest.approx(-1.3333333, abs=1e-7)
    assert r["c_prime"] == pytest.approx(1.6666667, abs=1e-7)
    assert r["indirect"] == pytest.approx(-0.4952381, abs=1e-7)
    assert r["c"] == pytest.approx(r["c_prime"] + r["indirect"], abs=1e-12)   # c = c' + ab
    assert r["sobel_z"] == pytest.approx(-1.3184890, abs=1e-6)
    assert r["sobel_p"] == pytest.approx(0.1873400, abs=1e-6)
    assert r["conclusion"] == "not established"


def test_f5_null_strict_composite(spark):
    df = spark.createDataFrame([(0.2, 0.3), (0.2, None), (float("nan"), 0.3)], "a double, b double")
    from regframe.functions.columns import nan_to_null
    out = df.select(composite([nan_to_null("a"), nan_to_null("b")]).alias("s")).collect()
    assert out[0]["s"] == pytest.approx(0.5) and out[1]["s"] is None and out[2]["s"] is None


def test_f6_keywords(spark):
    df = spark.createDataFrame([("Build a Web page", None, None), ("Apply for jobs", None, None),
                                ("Cook dinner", None, None), (None, None, None)],
                               "cluster_name_0 string, cluster_name_1 string, cluster_name_2 string")
    got = [r["f"] for r in df.select(keyword_flag(concat_names(
        ["cluster_name_0", "cluster_name_1", "cluster_name_2"]), TECH_KEYWORDS).alias("f")).collect()]
    assert got == [1, 1, 0, 0]
    txt = df.select(concat_names(["cluster_name_0", "cluster_name_1", "cluster_name_2"]).alias("t")).first()["t"]
    assert txt == "build a web page  "


def test_f7_tails():
    assert norm_sf2(6.943181818) == pytest.approx(3.8336549e-12, rel=1e-6)
    assert norm_sf2(4.7) == pytest.approx(2.6016149e-06, rel=1e-6)
    # t with many df approaches the normal; F(1, d) = t^2
    assert t_sf2(2.0, 1e7) == pytest.approx(norm_sf2(2.0), rel=1e-5)
    assert f_sf(4.0, 1, 30) == pytest.approx(t_sf2(2.0, 30), rel=1e-10)
    # t with 1 df is Cauchy: P(|T| > 1) = 0.5
    assert t_sf2(1.0, 1) == pytest.approx(0.5, rel=1e-12)


def test_first_per_key_and_dense_codes(spark):
    df = spark.createDataFrame([("b", "z", 1), ("b", "a", 2), ("a", "m", 3), ("c", "k", 4)],
                               "k string, o string, v int")
    got = {r["k"]: (r["o"], r["v"]) for r in A.first_per_key(df, "k", ["o"]).collect()}
    assert got == {"a": ("m", 3), "b": ("a", 2), "c": ("k", 4)}
    from regframe.operators.bootstrap import dense_codes
    codes = {r["k"]: r["code"] for r in dense_codes(df, "k", n_partitions=2).collect()}
    assert codes == {"a": 0, "b": 1, "c": 2}


def test_integration_row_count_law(spark):
    tb = spark.createDataFrame([("t1", 1.0), ("t2", 2.0), ("t3", 3.0)], "task_name string, v double")
    cl = spark.createDataFrame([("t1", "c1"), ("t1", "c2"), ("t2", "c3"), ("t9", "c4")],
                               "task_name string, cluster_name_0 string")
    integ = A.integrate_levels(tb, cl)
    # n = n_task - matched_tasks + cluster rows of matched tasks = 3 - 2 + 3
    assert integ.count() == 4
    d = A.integration_diagnostics(integ).first()
    assert (d["rows_with_cluster"], d["unique_tasks"], d["multi_cluster_tasks"]) == (3, 3, 1)
    assert A.task_sample(integ).count() == 3 and A.cluster_sample(integ).count() == 3


def test_corr_pairwise_matches_numpy(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(300, 3)) + [5.0, -2.0, 100.0]
    rows = [tuple(float(v) if (i * 7 + j) % 11 else None for j, v in enumerate(r)) for i, r in enumerate(X)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {(r["var_i"], r["var_j"]): r for r in D.corr_pairwise(df, ["a", "b", "c"]).collect()}
    for (i, a), (j, b) in [((0, "a"), (1, "b")), ((0, "a"), (2, "c")), ((1, "b"), (2, "c"))]:
        m = np.array([(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None])
        assert got[(a, b)]["n"] == len(m)
        assert got[(a, b)]["r"] == pytest.approx(np.corrcoef(m[:, 0], m[:, 1])[0, 1], abs=1e-12)


def test_durbin_watson_matches_numpy(spark):
    from regframe.operators.describe import durbin_watson
    rng = np.random.default_rng(5)
    e = rng.normal(size=500)
    df = spark.createDataFrame([(f"k{i:04d}", float(v)) for i, v in enumerate(e)], "k string, e double")
    dw = durbin_watson(df, F.col("e"), "k", n_ranges=4)
    assert dw == pytest.approx(np.sum(np.diff(e) ** 2) / np.sum(e ** 2), rel=1e-12)


def test_lgamma_column(spark):
    from regframe.functions.special import lgamma, lgamma_sql
    xs = [1e-3, 0.2, 0.5, 1.0, 1.5, 2.0, 3.7, 10.0, 123.4]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = df.select(lgamma(F.col("x")).alias("a"), F.expr(lgamma_sql("x")).alias("b")).collect()
    for x, r in zip(xs, got):
        assert r["a"] == pytest.approx(math.lgamma(x), abs=1e-11)
        assert r["b"] == pytest.approx(math.lgamma(x), abs=1e-11)


def test_constant_and_empty_inputs_do_not_raise(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 2.0, None), (3.0, 2.0, None)], "a double, k double, z double")
    r = {(x["var_i"], x["var_j"]): x for x in D.corr_pairwise(df, ["a", "k", "z"]).collect()}
    assert r[("a", "k")]["r"] is None and r[("a", "k")]["n"] == 3
    assert r[("a", "z")]["n"] == 1 and r[("a", "z")]["r"] is None
    d = {x["variable"]: x for x in D.descriptives(df, ["a", "k", "z"]).collect()}
    assert d["k"]["sd"] == 0.0 and d["z"]["n"] == 1
    empty = df.where("a > 100")
    cov = D.coverage(empty, ["a"]).first()
    assert cov["n_rows"] == 0 and cov["pct_present"] is None


def test_bootstrap_degenerate_replicates_are_invalid_not_errors(spark):
    from regframe.operators.bootstrap import boot_ci, boot_replicates
    rows = [("g1", 1.0, 2.0, 3.0), ("g1", 2.0, 1.0, 1.0), ("g2", 3.0, 5.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, x double, m double, y double")
    ci = boot_ci(boot_replicates(df, "x", "m", "y", B=50, seed=1, scheme="cluster", group="g")).first()
    assert ci["n_reps"] <= 50 and ci["n_valid"] <= ci["n_reps"]


def test_distributed_percentiles_match_numpy(spark):
    rng = np.random.default_rng(8)
    vals = np.round(rng.normal(size=3001), 1)          # many ties
    df = spark.createDataFrame([(float(v),) for v in vals], "v double").repartition(5)
    probs = [0.0, 0.025, 0.5, 0.975, 1.0]
    got = D.percentiles(df, "v", probs, n_ranges=7).first()["q"]
    assert got == pytest.approx(list(np.percentile(vals, [100 * p for p in probs])), abs=1e-12)


def test_approx_percentiles_close(spark):
    df = spark.range(10001).selectExpr("CAST(id AS DOUBLE) AS v")
    q = D.percentiles(df, "v", [0.025, 0.5, 0.975], method="approx").first()["q"]
    assert q == pytest.approx([250.0, 5000.0, 9750.0], abs=5.0)


def test_distinct_counts_exact_and_sketch(spark):
    df = spark.range(20000).selectExpr("id % 1000 AS k", "CAST(id % 7 AS STRING) AS s")
    ex = D.distinct_counts(df, ["k", "s"]).first()
    assert (ex["n_k"], ex["n_s"]) == (1000, 7)
    ap = D.distinct_counts(df, ["k"], approx=True).first()
    assert abs(ap["n_k"] - 1000) < 50


def test_qc_columns_and_coefficients(spark):
    from regframe.operators.quality import qc_coefficients, qc_columns
    a = spark.createDataFrame([(1, 2.0)], "x int, y double")
    assert {r["table_name"]: r["n_cols"] for r in qc_columns({"a": a}).collect()} == {"a": 2}
    coef = spark.createDataFrame([("1a", "x", 0.0597), ("1c", "x", 2.9)], "model_id string, term string, coef double")
    exp = spark.createDataFrame([("1a", "x", 0.0596, 0.003), ("1c", "x", 2.8144, 0.02)],
                                "model_id string, term string, value double, tol double")
    st = {r["model_id"]: r["status"] for r in qc_coefficients(coef, exp).collect()}
    assert st == {"1a": "PASS", "1c": "CHECK"}
