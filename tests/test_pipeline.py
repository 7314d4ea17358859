"""File-based release folder -> CLI pipeline -> same numbers as the
in-memory route."""

import os
import tempfile

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="test tables not present")

ORIGINAL = {"collab_directive_ratio": "collaboration:directive_ratio",
            "collab_feedback_loop_ratio": "collaboration:feedback loop_ratio",
            "collab_task_iteration_ratio": "collaboration:task iteration_ratio",
            "collab_learning_ratio": "collaboration:learning_ratio",
            "collab_validation_ratio": "collaboration:validation_ratio",
            "collab_none_ratio": "collaboration:none_ratio"}


def test_release_files_through_cli(spark):
    from regframe.operators.assemble import build_levels
    from regframe.plans import analyses as P
    from regframe.plans.pipeline import analyze, build, load_built
    from regframe.sources.files import default_manifest, load_sources
    from regframe.sources.testdata import testdata_sources

    src = testdata_sources(spark, SF, persist=False)
    root = tempfile.mkdtemp(prefix="regframe-release-")
    os.makedirs(os.path.join(root, "cluster_level_data"))
    src["task_pct"].toPandas().to_csv(os.path.join(root, "task_pct_v2.csv"), index=False)
    src["interaction"].toPandas().to_csv(os.path.join(root, "automation_vs_augmentation_by_task.csv"), index=False)
    src["thinking"].toPandas().to_csv(os.path.join(root, "task_thinking_fractions.csv"), index=False)
    cl = src["clusters"].toPandas().rename(columns=ORIGINAL)
    for i in range(3):
        cl[f"cluster_description_{i}"] = "desc, with \"quotes\""
    cols = ["onet_task"] + [f"cluster_name_{i}" for i in range(3)] + [f"cluster_description_{i}" for i in range(3)] \
        + list(ORIGINAL.values()) + ["has_thinking_ratio", "percent_records", "percent_users"]
    cl[cols].to_csv(os.path.join(root, "cluster_level_data", "cluster_level_dataset.tsv"), sep="\t", index=False)

    out = tempfile.mkdtemp(prefix="regframe-out-")
    manifest = default_manifest(root)
    build(spark, load_sources(spark, manifest), out, manifest=manifest)
    lv = load_built(spark, out)
    for _ in range(2):                                   # a second run leaves the same rows
        analyze(spark, lv, out)

    from_files = P.plan_h1(lv["task_level"])
    in_memory = P.plan_h1(build_levels(src)["task_level"])
    for mid in ("1a", "1b", "1c"):
        np.testing.assert_allclose(from_files[mid].beta, in_memory[mid].beta, rtol=1e-9)
    coef = spark.read.parquet(os.path.join(out, "results", "coef"))
    assert coef.where("analysis_id = 'H1_H2'").count() == 13
    qc = spark.read.parquet(os.path.join(out, "results", "qc")).collect()
    assert len(qc) == 6

    def rows(name):
        return spark.read.parquet(os.path.join(out, "results", name)).collect()

    assert {r["table_name"] for r in rows("qc_columns")} == {"integrated", "task_level", "cluster_level"}
    assert {r["table_name"] for r in rows("qc_checksums")} == {"integrated", "task_level", "cluster_level"}
    assert {r["source"] for r in rows("qc_sources")} == set(manifest)
    assert rows("qc_fingerprint")[0]["tasks"] == lv["task_level"].count()
    assert len(rows("correlation_matrix_task")) == len(P.TASK_CORR_VARS)
    assert len(rows("correlation_matrix_cluster")) == len(P.CLUSTER_CORR_VARS)
    assert len(rows("delta_r2")) == 3 and len(rows("resid_diagnostics")) > 8

    import hashlib
    digests = {r["source"]: r["sha256"] for r in rows("qc_sources")}
    for name, spec in manifest.items():
        with open(spec.path, "rb") as f:
            assert digests[name] == hashlib.sha256(f.read()).hexdigest()
    assert len(rows("qc_coefficients")) == 3 and len(rows("qc_statistics")) == 9
    assert len(rows("correlations")) == len(P.TASK_CORR_VARS) * (len(P.TASK_CORR_VARS) - 1) // 2 \
        + len(P.CLUSTER_CORR_VARS) * (len(P.CLUSTER_CORR_VARS) - 1) // 2
    runs = [r for r in rows("runs") if r["command"] == "analyze"]
    assert len({r["run_id"] for r in runs}) == 2 and all(r["status"] == "done" for r in runs)
    assert {(r["table_name"], r["analysis_id"]) for r in runs} >= {("coef", "H1_H2"), ("fit", "H6"), ("mediation", "H5")}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_growing_tables_are_never_broadcast(spark):
    from regframe.sources.testdata import testdata_sources
    for name, frame in testdata_sources(spark, SF, persist=False).items():
        broadcast = [part.split("Scan parquet")[1:] for part in _plan(frame).split("BroadcastExchange")[1:]]
        first = [scans[0].split("[")[1] for scans in broadcast if scans]          # columns below each broadcast
        assert not any(k in c.split("]")[0] for c in first for k in ("c_custkey", "p_partkey")), name


def test_line_sized_shuffles_follow_the_number_of_lines(spark, monkeypatch):
    from regframe.sources import testdata as T
    want = sorted(map(tuple, T.cluster_source(spark, SF, persist=False).collect()))
    monkeypatch.setattr(T, "LINES_PER_TASK", 250)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert T._lines(spark, SF).rdd.getNumPartitions() == -(-lines // 250)
    assert sorted(map(tuple, T.cluster_source(spark, SF, persist=False).collect())) == want


def test_task_base_and_customers_are_kept_once(spark):
    from regframe.operators.assemble import build_levels
    from regframe.sources.testdata import testdata_sources
    src = testdata_sources(spark, SF)
    lv = build_levels(src)
    assert lv["task_base"].storageLevel.useMemory
    plan = _plan(lv["integrated"])
    assert "InMemoryTableScan" in plan and "SortMergeJoin [o_orderkey" not in plan
    assert "InMemoryTableScan" in _plan(src["clusters"])
    lv["task_base"].unpersist()
