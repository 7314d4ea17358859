"""Data-quality tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import status_label

# The counts the reference's build checks against (full
# release data). Expectations are a parameter; these are the defaults.
REFERENCE_EXPECTATIONS = {
    "integrated_rows": 3612,
    "task_level_rows": 3365,
    "cluster_level_rows": 593,
    "unique_tasks": 3365,
    "tasks_with_clusters": 346,
    "multi_cluster_tasks": 94,
}


def qc_actuals(integrated: DataFrame, task_level: DataFrame, cluster_level: DataFrame) -> DataFrame:
    """The six structural counts, as one row per check. Three aggregations
    (one per table); the per-task counts come from one groupBy on the key."""
    per_task = integrated.groupBy("task_name").agg(
        F.count(F.lit(1)).alias("n"), F.count("cluster_name_0").alias("n_cl"))
    a = per_task.agg(F.sum("n").alias("integrated_rows"),
                     F.count(F.lit(1)).alias("unique_tasks"),
                     F.count_if(F.col("n_cl") > 0).alias("tasks_with_clusters"),
                     F.count_if(F.col("n_cl") > 1).alias("multi_cluster_tasks"))
    b = task_level.agg(F.count(F.lit(1)).alias("task_level_rows"))
    c = cluster_level.agg(F.count(F.lit(1)).alias("cluster_level_rows"))
    wide = a.crossJoin(b).crossJoin(c)
    names = ["integrated_rows", "task_level_rows", "cluster_level_rows", "unique_tasks",
             "tasks_with_clusters", "multi_cluster_tasks"]
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(n).alias("check_name"), F.col(n).cast("bigint").alias("actual"))
        for i, n in enumerate(names)])))


def qc_expectations(integrated: DataFrame, task_level: DataFrame, cluster_level: DataFrame,
                    expected: dict[str, int] = REFERENCE_EXPECTATIONS) -> DataFrame:
    """Actual vs expected, PASS or 'CHECK - expected n'."""
    spark = integrated.sparkSession
    exp = spark.createDataFrame([(k, int(v)) for k, v in expected.items()], "check_name string, expected bigint")
    act = qc_actuals(integrated, task_level, cluster_level)
    j = act.join(exp, "check_name", "left")
    return j.select("check_name", "actual", "expected",
                    status_label(F.col("actual"), F.col("expected")).alias("status"))


def qc_columns(tables: dict[str, DataFrame]) -> DataFrame:
    """Q2: column counts per table (schema only, no job)."""
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame([(k, len(v.columns)) for k, v in tables.items()],
                                 "table_name string, n_cols int")


def qc_fingerprint(task_level: DataFrame) -> DataFrame:
    """Q4: mean / sd / min / max of the key columns, one aggregation."""
    out = []
    for c in ("task_conversation_share", "augmentation_index", "automation_index"):
        out += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_sd"),
                F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    out.append(F.count("thinking_fraction").alias("tasks_with_thinking"))
    out.append(F.count(F.lit(1)).alias("tasks"))
    return task_level.agg(*out)


# Coefficients the reference's figure script asserts, with
# its tolerances (model, term, value, tolerance).
PUBLISHED_COEFS = [("1a", "augmentation_index", 0.0596, 0.003),
                   ("1c", "augmentation_index", 2.8144, 0.02),
                   ("2a", "risk_management_index", 0.6649, 0.01)]

# What the reference's figure script asserts of each figure's
# regression (model, statistic, value, tolerance; counts are exact).
PUBLISHED_FIGURES = [
    ("fig1_linear", "b1", 0.0596, 0.003),
    ("fig1_log", "b1", 2.8144, 0.02),
    ("fig1_linear", "r2", 0.011, 0.004),
    ("fig1_log", "r2", 0.399, 0.01),
    ("fig2_h2a", "b1", 0.6649, 0.01),
    ("fig2_h2a", "n", 3364.0, 0.5),
    ("fig3_h3", "b1", -0.0611, 0.003),
    ("fig3_h3", "n", 508.0, 0.5),
    ("fig3_h3", "r", -0.327, 0.01),
]


def expected_values(spark, rows: list[tuple] = PUBLISHED_FIGURES) -> DataFrame:
    return spark.createDataFrame(rows, "model_id string, statistic string, value double, tol double")


def qc_coefficients(coef: DataFrame, expected: DataFrame) -> DataFrame:
    """Q5: join a coef table with (model_id, term, value, tol) -> PASS/CHECK."""
    j = coef.join(expected, ["model_id", "term"])
    ok = F.abs(F.col("coef") - F.col("value")) < F.col("tol")
    return j.select("model_id", "term", "coef", "value", "tol",
                    F.when(ok, F.lit("PASS")).otherwise(F.lit("CHECK")).alias("status"))


def qc_statistics(regressions: DataFrame, expected: DataFrame) -> DataFrame:
    """Q5: slopes, R^2, r and n of simple regressions (``model_id, b0, b1, r2,
    r, n``) against ``model_id, statistic, value, tol`` -> PASS/CHECK; CHECK
    also where the statistic is missing."""
    long = regressions.select("model_id", F.inline(F.array(*[
        F.struct(F.lit(c).alias("statistic"), F.col(c).cast("double").alias("actual")) for c in ("b0", "b1", "r2", "r", "n")])))
    j = expected.join(long, ["model_id", "statistic"], "left")
    ok = F.abs(F.col("actual") - F.col("value")) < F.col("tol")
    return j.select("model_id", "statistic", "actual", "value", "tol",
                    F.when(ok, F.lit("PASS")).otherwise(F.lit("CHECK")).alias("status"))
