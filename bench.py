"""Headline-query benchmark.

``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with ``local[$BENCH_CPUS]``
and prints ONE JSON line:

    {"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

``integrate_levels`` is timed end to end from the parquet tables (scan,
lineitem x orders join, (customer, part) aggregation, normalisation, full
outer + left + fan-out joins, all columns materialised and persisted). The
other queries then run on the built levels, as the reference's analysis
scripts run on its built CSV files. Each runs twice: ``queries`` and ``value``
hold the first (cold) run, ``warm`` the second; nothing fitted is kept between
them. ``small`` holds the same at sf0.01, for growth, where that folder is.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from regframe.plans import registry as R  # noqa: E402
from regframe.session import checkpoint_dir, get_session  # noqa: E402

HEADLINE = ["corr_pairwise", "ols_hc3_2x", "ols_cluster_se", "glm_fractional_logit", "boot_cluster",
            "boot_iid", "plan_h1", "model_comparison", "descriptives"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session(f"local[{cpus}]", shuffle_partitions=cpus,
                        extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEM", "16g")})
    checkpoint_dir(spark)
    # warm the JVM / parquet footers with a tiny query (not timed)
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    times, warm = run(spark, sf_dir)
    line = {"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
            "sf": os.path.basename(sf_dir).replace("sf", ""), "warm": warm}
    small = os.path.join(os.path.dirname(sf_dir), "sf0.01")
    if os.path.isdir(small) and small != sf_dir:
        cold, again = run(spark, small)
        line["small"] = {"sf": "0.01", "queries": cold, "warm": again}
    print(json.dumps(line))


def run(spark, sf_dir: str) -> tuple[dict[str, float], dict[str, float]]:
    """Seconds of each headline query, first and second run."""
    def timed(f) -> float:
        t0 = time.perf_counter()
        f()
        return round(time.perf_counter() - t0, 3)

    def build() -> None:
        # parquet -> sources -> task base, clusters, integrated dataset and the
        # task-level sample, materialised (persisted) for the queries below
        R.release_levels()
        built = R.levels(spark, sf_dir)
        built["integrated"].write.format("noop").mode("overwrite").save()
        built["task_level"].count()

    times, warm = {"integrate_levels": timed(build)}, {"integrate_levels": timed(build)}
    for k in HEADLINE:
        times[k], warm[k] = (timed(lambda: R.REGISTRY[k](spark, sf_dir).collect()) for _ in range(2))
    return times, warm


if __name__ == "__main__":
    main()
