"""Helpers the operators share: cutting lineage, typed columns, sketch merging."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regframe.session import checkpoint_dir

SEED = 20240917

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(top):  # else it runs from a zip that was shipped already
        path = os.path.join(tempfile.mkdtemp(prefix="regframe-"), "regframe_package.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(top):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, os.path.dirname(top)))
        sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder of ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back.

    Later jobs start from that copy, so a lost executor costs the tasks it ran
    and not the chain of jobs before them.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small_batches(spark: SparkSession, rows: int):
    """Jobs started here hand at most ``rows`` rows at once to Python.

    A batch is held several times over: as Arrow buffers outside the JVM's heap,
    as the worker's copy and as Python objects.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(key))
    return _setting(spark, key, str(min(rows, before) if before > 0 else rows))


def short_shuffles(spark: SparkSession):
    """The shuffle files of a query started here go when it ends, not when the driver's JVM collects its plan.

    For loops of many queries that each end in a written table.
    """
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def first_by_hash(df: DataFrame, k: int, total: int, seed: int, *cols: str) -> DataFrame:
    """The ``k`` rows whose columns hash lowest, of a table of ``total`` rows.

    Only rows below a hash that about ``2 k`` of them stay under are sorted, so
    each task hands on its part of those and not ``k`` rows of its own.
    """
    h = F.shiftrightunsigned(F.xxhash64(*cols, F.lit(seed)), 11) / F.lit(float(1 << 53))
    share = min(1.0, (2 * k + 100) / max(1, total))
    return df.filter(h < share).orderBy(h, *cols).limit(k)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def partition_sketches(df: DataFrame, build: Callable[[Iterator[pa.RecordBatch]], bytes],
                       merge: Callable[[list[bytes]], bytes], fan_in: int = 128,
                       levels: int = 3) -> bytes:
    """One bounded summary per partition, merged in a tree of ``fan_in``.

    ``build`` folds a partition's batches into one blob of bounded size and
    ``merge`` folds several blobs into one, so no task ever holds more than
    ``fan_in`` blobs and the driver receives a single one.
    """
    def local(batches):
        from pyspark import TaskContext
        blob = build(batches)
        yield pa.RecordBatch.from_pydict({
            "node": pa.array([TaskContext.get().partitionId()], pa.int64()),
            "blob": pa.array([blob], pa.binary())})

    def fold(table: pa.Table) -> pa.Table:
        blobs = table.column("blob").to_pylist()
        return pa.table({"node": table.column("node").slice(0, 1),
                         "blob": pa.array([merge(blobs)], pa.binary())})

    out = df.mapInArrow(local, "node long, blob binary")
    for _ in range(levels):
        out = (out.withColumn("node", F.floor(F.col("node") / fan_in).cast("long"))
               .groupBy("node").applyInArrow(fold, "node long, blob binary"))
    rows = out.select("blob").collect()
    return merge([bytes(r[0]) for r in rows])
