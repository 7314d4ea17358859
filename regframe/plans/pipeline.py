"""End-to-end runs matching the reference's four scripts.

    python -m regframe build     --sources DIR|--testdata SFDIR --out OUT
    python -m regframe analyze   --out OUT
    python -m regframe reviewer  --out OUT
    python -m regframe batch-b   --out OUT

``build`` writes the integrated dataset, both analytical samples (and the
compatibility alias) plus the QC table; the other commands read the built
samples back and write result tables -- ``coef``, ``fit``, ``glm_fit``,
``descriptives``, ``correlations``, ``correlation_matrix_*``, ``delta_r2``,
``resid_diagnostics``, ``mediation``, ``bootstrap``, ``comparison``, ``qc_coefficients``, ``qc_statistics`` -- as
parquet partitioned by ``analysis_id``, each row stamped with the run's id and
time. A run replaces the partitions of its own analyses, so running a command
twice leaves the same rows, and is logged in ``results/runs``. Everything stays in Spark; the driver only handles the
p x p numbers of each fit.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assemble as A
from ..operators import describe as D
from ..operators.linear import ModelSpec, fit_ols, resid_diagnostics
from ..operators.mediation import delta_r2
from ..operators.quality import (PUBLISHED_COEFS, REFERENCE_EXPECTATIONS, expected_values, qc_coefficients, qc_columns,
                                 qc_expectations, qc_fingerprint, qc_statistics)
from ..sources.files import Run, default_manifest, file_checksums, load_sources, quarantined, write_outputs
from . import analyses as P


def _tag(df: DataFrame, analysis_id: str) -> tuple[str, DataFrame]:
    return analysis_id, df


def build(spark: SparkSession, frames: dict[str, DataFrame], out: str,
          expected: dict[str, int] = REFERENCE_EXPECTATIONS,
          manifest: dict | None = None) -> dict[str, DataFrame]:
    """01: sources -> integrated dataset and samples, written with a QC log:
    expectations, column counts, table checksums, fingerprint, tasks whose task
    columns differ between rows and, with a ``manifest`` of source files, their
    SHA-256 and the records that did not parse."""
    lv = A.build_levels(frames)
    lv["integrated"] = lv["integrated"].persist()
    lv["cluster_level"] = A.cluster_sample(lv["integrated"])
    with Run(spark, out, "build") as run:
        write_outputs(lv, f"{out.rstrip('/')}/data")
        tables = {k: lv[k] for k in ("integrated", "task_level", "cluster_level")}
        run.replace("qc", [_tag(qc_expectations(*tables.values(), expected), "build")])
        run.replace("qc_columns", [_tag(qc_columns(tables), "build")])
        run.replace("qc_checksums", [_tag(D.table_checksum(t).withColumn("table_name", F.lit(k)), "build") for k, t in tables.items()])
        run.replace("qc_fingerprint", [_tag(qc_fingerprint(lv["task_level"]), "build")])
        task_columns = A.drop_present(lv["integrated"], A.cluster_columns(lv["integrated"]))
        run.replace("qc_constancy", [_tag(A.one_row_per_key(task_columns)[1], "build")])
        if manifest:
            sums = [file_checksums(spark, [m.path]).withColumn("source", F.lit(k)) for k, m in manifest.items()]
            run.replace("qc_sources", [_tag(d, "build") for d in sums])
            run.replace("qc_quarantine", [_tag(quarantined(spark, manifest), "build")])
    return lv


def load_built(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    root = f"{out.rstrip('/')}/data"
    return {"task_level": spark.read.parquet(f"{root}/task_level_dataset").persist(),
            "cluster_level": spark.read.parquet(f"{root}/cluster_level_dataset").persist()}


def analyze(spark: SparkSession, lv: dict[str, DataFrame], out: str) -> None:
    """02: descriptives, correlations, H1-H6, robustness checks."""
    with Run(spark, out, "analyze") as run:
        tl, cl = lv["task_level"], lv["cluster_level"]
        run.replace("descriptives", [_tag(D.descriptives(tl, P.TASK_VARS), "task"),
                                     _tag(D.descriptives(cl, P.CLUSTER_VARS), "cluster")])
        run.replace("correlations", [
            _tag(D.with_corr_pvalues(D.corr_pairwise(tl, P.TASK_CORR_VARS)), "task"),
            _tag(D.with_corr_pvalues(D.corr_pairwise(cl, P.CLUSTER_CORR_VARS)), "cluster")])
        for name, df, names in (("task", tl, P.TASK_CORR_VARS), ("cluster", cl, P.CLUSTER_CORR_VARS)):
            run.replace(f"correlation_matrix_{name}", [_tag(D.corr_matrix_wide(D.corr_pairwise(df, names), names), name)])
        coef, fit, steps = [], [], []
        for aid, r in (("H1_H2", P.plan_task_models(tl)), ("H3", P.plan_h3(cl)), ("H4", P.plan_h4(cl)),
                       ("H6", P.plan_h6(cl)), ("robustness", P.robustness_ols(cl))):
            coef.append(_tag(r.coef, aid))
            fit.append(_tag(r.fit, aid))
            steps.append(_tag(resid_diagnostics(r), aid))
            if aid == "H6":
                run.replace("delta_r2", [_tag(delta_r2(r.fit, list(r.models)), aid)])
        run.replace("resid_diagnostics", steps)
        full, refit, n_ex, thr = P.cooks_trim(cl)
        if refit is not None:
            coef.append(_tag(refit.coef, "robustness_cooks"))
            fit.append(_tag(refit.fit.withColumn("n_excluded", F.lit(n_ex)), "robustness_cooks"))
        g = P.glm_battery(tl)
        coef.append(_tag(g.coef.filter(F.col("model_id").endswith("frac_logit")), "robustness_glm"))
        run.replace("coef", coef)
        run.replace("fit", fit)
        run.replace("mediation", [_tag(P.plan_h5(cl), "H5")])
        models = P.plan_task_models(tl).coef
        expected = spark.createDataFrame(PUBLISHED_COEFS, "model_id string, term string, value double, tol double")
        run.replace("qc_coefficients", [_tag(qc_coefficients(models, expected), "published")])
        run.replace("qc_statistics", [_tag(qc_statistics(P.figure_regressions(tl, cl), expected_values(spark)), "published")])


def reviewer(spark: SparkSession, lv: dict[str, DataFrame], out: str, trim_threshold: float = 1.0) -> None:
    """03: estimator comparison for the skewed outcome, second-predictor
    suite, high-share trimming."""
    with Run(spark, out, "reviewer") as run:
        tl = lv["task_level"]
        g = P.glm_battery(tl)
        run.replace("comparison", [_tag(P.model_comparison(tl, glm=g, glm_prefix="aug_"), "batch_a")])
        risk = fit_ols(P.task_complete_case(tl), [ModelSpec("risk_log_linear", P.SHARE, ["risk_management_index"], log_y=True)])
        run.replace("glm_fit", [_tag(g.fit, "batch_a")])
        o, tg, thr, n_ex = P.trimmed_battery(tl, threshold=trim_threshold)
        run.replace("coef", [_tag(g.coef, "batch_a_glm"), _tag(risk.coef, "batch_a_risk"), _tag(o.coef, "batch_a_trimmed"),
                             _tag(tg.coef, "batch_a_trimmed")])
        run.replace("fit", [_tag(risk.fit, "batch_a_risk"), _tag(o.fit.withColumn("n_excluded", F.lit(n_ex)), "batch_a_trimmed")])


def batch_b(spark: SparkSession, lv: dict[str, DataFrame], out: str, B: int = P.N_BOOT, seed: int = P.SEED,
            draw: str = "multinomial") -> None:
    """04: clustered errors, bootstrap of the indirect effect, proxy controls."""
    with Run(spark, out, "batch-b") as run:
        cl = lv["cluster_level"]
        rs = [("batch_b_clustered", P.clustered_battery(cl)), ("batch_b_h6", P.h6_clustered(cl)),
              ("batch_b_proxies", P.proxies_battery(cl))]
        run.replace("coef", [_tag(r.coef, a) for a, r in rs])
        run.replace("fit", [_tag(r.fit, a) for a, r in rs])
        from ..operators.bootstrap import boot_ci, boot_replicates
        d = P.h5_sample(cl)
        run.replace("mediation", [_tag(P.plan_h5(cl), "batch_b_h5")])     # the point estimates
        parts = []
        for scheme, kw in (("iid", {"key": "cluster_name_0"}), ("cluster", {"group": "task_name"})):
            reps = boot_replicates(d, "augmentation_index", P.THINK, P.SHARE, B, seed, scheme, draw=draw, **kw)
            parts.append(_tag(boot_ci(reps).withColumn("scheme", F.lit(scheme)), "H5"))
        run.replace("bootstrap", parts)


def main(argv: list[str] | None = None) -> None:
    from ..session import get_session
    ap = argparse.ArgumentParser(prog="regframe")
    ap.add_argument("command", choices=["build", "analyze", "reviewer", "batch-b", "all"])
    ap.add_argument("--sources", help="folder with the four release files")
    ap.add_argument("--testdata", help="test-table folder (TPC-H-style parquet) instead of --sources")
    ap.add_argument("--out", required=True)
    ap.add_argument("--master", default=None)
    a = ap.parse_args(argv)
    spark = get_session(a.master, shuffle_partitions=None)
    from ..session import checkpoint_dir
    checkpoint_dir(spark)
    if a.command in ("build", "all"):
        manifest = None
        if a.testdata:
            from ..sources.testdata import testdata_sources
            frames = testdata_sources(spark, a.testdata)
        else:
            manifest = default_manifest(a.sources)
            frames = load_sources(spark, manifest)
        lv = build(spark, frames, a.out, manifest=manifest)
        if a.command == "build":
            return
    lv = load_built(spark, a.out)
    if a.command in ("analyze", "all"):
        analyze(spark, lv, a.out)
    if a.command in ("reviewer", "all"):
        reviewer(spark, lv, a.out)
    if a.command in ("batch-b", "all"):
        batch_b(spark, lv, a.out)
