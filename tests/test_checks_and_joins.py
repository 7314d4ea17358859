"""Constancy check, splittable outer join, ordered statistics, published values."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from regframe.operators.assemble import merge_breakdown, one_row_per_key, outer_join_indicator
from regframe.operators.bootstrap import boot_ci, boot_replicates
from regframe.operators.describe import corr_pairwise, durbin_watson, with_corr_pvalues
from regframe.operators.linear import ols
from regframe.operators.quality import expected_values, qc_statistics


def test_constant_and_changing_keys(spark):
    rows = [("a", 1.0, "x"), ("a", 1.0, "x"), ("b", 1.0, "x"), ("b", 2.0, "x"), ("c", None, "x"), ("c", None, "x"),
            ("d", None, "x"), ("d", 0.0, "x"), (None, 5.0, "y"), (None, 5.0, "z"), ("e", 3.0, None)]
    df = spark.createDataFrame(rows, "task_name string, `a.b` double, c string").repartition(4)
    kept, bad = one_row_per_key(df)
    assert kept.columns == df.columns and sorted(str(r[0]) for r in kept.collect()) == ["None", "a", "b", "c", "d", "e"]
    found = {r.task_name: (r.n_rows, r["columns"]) for r in bad.collect()}
    assert found == {"b": (2, ["a.b"]), "d": (2, ["a.b"]), None: (2, ["c"])}
    again = one_row_per_key(df.repartition(1))[0]
    assert kept.exceptAll(again).isEmpty()                     # whatever the partitioning
    only = one_row_per_key(df.select("task_name"))
    assert only[0].count() == 6 and only[1].isEmpty()
    none = one_row_per_key(df.limit(0))
    assert none[0].isEmpty() and none[1].isEmpty()


def _plain_outer(left, right):
    out, matched = [], set()
    for k, v in left:
        hits = [j for j, (r, _) in enumerate(right) if k is not None and r == k]
        matched |= set(hits)
        out += [(k, v, right[j][1], "both") for j in hits] or [(k, v, None, "left_only")]
    return sorted(out + [(k, None, w, "right_only") for j, (k, w) in enumerate(right) if j not in matched], key=str)


def test_outer_join_equals_a_nested_loop(spark):
    rng = random.Random(4)
    left = [(rng.choice(["a", "b", "c", None, "e"]), i) for i in range(25)]
    right = [(rng.choice(["a", "b", "d", None]), i) for i in range(15)]
    for a, b in ((left, right), (left, []), ([], right), ([], [])):
        got = outer_join_indicator(spark.createDataFrame(a, "task_name string, v long"),
                                   spark.createDataFrame(b, "task_name string, w long"))
        assert got.columns == ["task_name", "v", "w", "_merge"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == _plain_outer(a, b)
    count = {r["_merge"]: r.n_rows for r in merge_breakdown(outer_join_indicator(
        spark.createDataFrame(left, "task_name string, v long"), spark.createDataFrame(right, "task_name string, w long"))).collect()}
    assert sum(count.values()) == len(_plain_outer(left, right))


def test_a_hot_key_of_the_outer_join_is_split(spark):
    """A third of the left rows hold one key, which the right side lacks or has once: several tasks share them."""
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
             "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        hot = spark.range(0, 60_000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id").cast("string"))
            .alias("task_name"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
        for key in ("hot", "other"):
            right = spark.range(2000).select(F.when(F.col("id") == 0, F.lit(key)).otherwise(F.col("id").cast("string")).alias("task_name"),
                                             F.col("id").alias("w"))
            got = outer_join_indicator(hot, right)
            assert got.count() == 60_000 + got.filter("_merge = 'right_only'").count()
            made = got.withColumn("task", F.spark_partition_id()).persist()     # the task that made each row
            made.count()
            rows = made.filter("task_name = 'hot'").groupBy("task").count().collect()
            made.unpersist()
            assert len(rows) > 2 and sum(r["count"] for r in rows) == 20_000
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_repeated_or_missing_order_values_raise(spark):
    rows = [(i, float(i % 5)) for i in range(40)]
    df = spark.createDataFrame(rows, "o long, e double").repartition(5)
    e = [r[1] for r in rows]
    want = sum((b - a) ** 2 for a, b in zip(e, e[1:])) / sum(v * v for v in e)
    assert durbin_watson(df, F.col("e"), "o", 4) == pytest.approx(want, rel=1e-12)
    for bad in ((7, 1.0), (None, 1.0)):
        with pytest.raises(ValueError, match="orders no rows"):
            durbin_watson(df.union(spark.createDataFrame([bad], "o long, e double")), F.col("e"), "o")


def test_published_statistics_are_compared(spark):
    found = spark.createDataFrame([("m", 1.0, 2.0, 0.5, None, 10)], "model_id string, b0 double, b1 double, r2 double, r double, n long")
    want = expected_values(spark, [("m", "b1", 2.05, 0.1), ("m", "r2", 0.7, 0.1), ("m", "n", 10.0, 0.5), ("m", "r", 0.1, 0.1),
                                   ("gone", "n", 1.0, 0.5)])
    got = {(r.model_id, r.statistic): r.status for r in qc_statistics(found, want).collect()}
    assert got == {("m", "b1"): "PASS", ("m", "r2"): "CHECK", ("m", "n"): "PASS", ("m", "r"): "CHECK", ("gone", "n"): "CHECK"}


def test_eight_rows_and_five_thousand_replicates(spark):
    """Some replicates draw no row at all: NULL, counted as invalid."""
    rng = random.Random(2)
    rows = [(i, rng.random(), rng.random(), rng.random(), f"g{i % 2}") for i in range(8)]
    df = spark.createDataFrame(rows, "k long, x double, m double, y double, g string")
    for some, kw in ((df.limit(4), {"scheme": "iid", "key": "k"}), (df, {"scheme": "cluster", "group": "g"})):
        reps = boot_replicates(some, "x", "m", "y", B=5000, **kw)
        row = reps.agg(F.count("*").alias("n"), F.count_if(F.col("n_w") == 0).alias("empty"),
                       F.count_if(F.col("n_w").eqNullSafe(F.lit(0.0)) & F.col("indirect").isNotNull()).alias("wrong")).first()
        assert row.n == 5000 and row.empty > 0 and row.wrong == 0
        assert 0 < boot_ci(reps).first().n_valid < 5000
    assert boot_ci(boot_replicates(df, "x", "m", "y", B=5000, scheme="iid", key="k")).first().n_reps == 5000


def test_p_values_stay_in_spark(spark, f3):
    corr = with_corr_pvalues(corr_pairwise(f3, ["x", "m", "y"]))
    rows = {(r.var_i, r.var_j): r for r in corr.collect()}
    r = rows["x", "y"]
    assert r.n == 6 and 0 < r.p < 1 and corr.columns == ["var_i", "var_j", "n", "r", "t", "p"]
    # four degrees of freedom: p = 1 - (3/2) s + s^3/2 with s = t / sqrt(t^2 + 4)
    s = abs(r.t) / (r.t ** 2 + 4) ** 0.5
    assert r.p == pytest.approx(1 - 1.5 * s + 0.5 * s ** 3, rel=1e-10)
    fit = ols(f3, "y", ["x"], "classical")
    row = fit.fit.first()
    assert row.f == pytest.approx(r.t ** 2, rel=1e-9) and row.f_p == pytest.approx(r.p, rel=1e-9)
    assert pd.isna(ols(f3.limit(2), "y", ["x"]).fit.first().f_p)
