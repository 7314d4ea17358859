"""Session helpers: a configured SparkSession and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Settings every job in the library relies on. AQE re-plans joins and
# coalesces small shuffles at runtime; ANSI stays on (Spark default), so the
# library uses try_cast / try_divide where bad input must become NULL.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # statistical batteries aggregate dozens of moment buffers in one pass;
    # keep those operators inside whole-stage codegen (default cap: 100)
    "spark.sql.codegen.maxFields": "1000",
}


def get_session(master: str | None = "local[*]", shuffle_partitions: int | None = None,
                app_name: str = "regframe", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session. Under spark-submit pass ``master=None``
    (the cluster decides; without any master configured, local mode is
    used) and ``shuffle_partitions=None`` to keep the cluster's setting --
    size it so a shuffle partition holds ~128-256 MB; AQE coalesces small
    ones."""
    from pyspark import SparkConf
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    elif not SparkConf().contains("spark.master"):
        b = b.master("local[*]")
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints / intermediate tables.

    Uses ``spark.checkpoint.dir`` from the session (the cluster names a shared
    folder there). Only when it is unset under a ``local`` master -- tests -- a
    fresh temporary folder is created and registered; on a cluster executors
    would not share it, so that is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d and not spark.sparkContext.master.startswith("local["):
        if spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not d:
        d = tempfile.mkdtemp(prefix="regframe-ckpt-")
    spark.sparkContext.setCheckpointDir(d)
    return d


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per
    application: functions that run there are looked up by module name."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(here):                       # else it runs from a zip that was shipped already
        path = os.path.join(tempfile.mkdtemp(prefix="regframe-"), "regframe_library.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(here):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, os.path.dirname(here)))
        sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
