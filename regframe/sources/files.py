"""File sources and sinks.

Sources are declared, not inferred: every delimited file is read against an
explicit ``StructType`` (no ``inferSchema`` pass over the data), and its columns
are found by the names in its own header, so files of one source may order
their columns differently, lack some or have more. NaN in a numeric column
means "suppressed" and becomes NULL at ingest, once. Rows that do not parse go
to a quarantine table instead of into the data.

Results are written so that they can be written again: a run replaces the
partitions of its own analyses and nothing else.
"""

from __future__ import annotations

import csv
import hashlib
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timezone
from itertools import groupby
from urllib.parse import unquote, urlparse

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import nan_to_null

D = T.DoubleType()
Sg = T.StringType()

# Declared schemas of the four source files (column names as released).
TASK_PCT_SCHEMA = T.StructType([T.StructField("task_name", Sg), T.StructField("pct", D)])
INTERACTION_SCHEMA = T.StructType([T.StructField("task_name", Sg)] + [
    T.StructField(c, D) for c in ("directive", "feedback_loop", "task_iteration", "learning",
                                  "validation", "filtered")])
THINKING_SCHEMA = T.StructType([T.StructField("task_name", Sg), T.StructField("thinking_fraction", D)])
CLUSTERS_SCHEMA = T.StructType(
    [T.StructField("onet_task", Sg)]
    + [T.StructField(f"cluster_name_{i}", Sg) for i in range(3)]
    + [T.StructField(f"cluster_description_{i}", Sg) for i in range(3)]
    + [T.StructField(c, Sg) for c in (
        "collaboration:directive_ratio", "collaboration:feedback loop_ratio",
        "collaboration:task iteration_ratio", "collaboration:learning_ratio",
        "collaboration:validation_ratio", "collaboration:none_ratio", "has_thinking_ratio",
        "percent_records", "percent_users")])


@dataclass
class SourceSpec:
    path: str
    format: str = "csv"                 # csv | tsv | parquet
    schema: T.StructType | None = None
    line_breaks: str = "auto"           # quoted line breaks in fields: "auto" looks for them, "yes", "no"


def default_manifest(root: str) -> dict[str, SourceSpec]:
    """A3: the four sources of a release folder (local or lake path)."""
    r = root.rstrip("/")
    return {
        "task_pct": SourceSpec(f"{r}/task_pct_v2.csv", "csv", TASK_PCT_SCHEMA),
        "interaction": SourceSpec(f"{r}/automation_vs_augmentation_by_task.csv", "csv", INTERACTION_SCHEMA),
        "thinking": SourceSpec(f"{r}/task_thinking_fractions.csv", "csv", THINKING_SCHEMA),
        "clusters": SourceSpec(f"{r}/cluster_level_data/cluster_level_dataset.tsv", "tsv", CLUSTERS_SCHEMA),
    }


def _file_system(spark: SparkSession, path: str):
    """Hadoop's FileSystem and Path of a path (local, HDFS and object-store paths alike)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    """A4: existence through Hadoop's FileSystem API."""
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def list_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """``(path, length)`` of a file, or of the data files below a folder, in order."""
    fs, p = _file_system(spark, path)
    found, open_ = [], [fs.getFileStatus(p)]
    while open_:
        status = open_.pop()
        if status.isDirectory():
            open_ += [s for s in fs.listStatus(status.getPath()) if s.getPath().getName()[0] not in "_."]
        else:
            found.append((status.getPath().toString(), status.getLen()))
    return sorted(found)


def read_header(spark: SparkSession, path: str, sep: str) -> list[str]:
    """The column names of a delimited file: its first record, which may span lines. Only those lines are read."""
    fs, p = _file_system(spark, path)
    jvm = spark.sparkContext._jvm
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark.sparkContext._jsc.hadoopConfiguration()).getCodec(p)
    stream = fs.open(p)
    try:
        text = jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8")
        reader, lines = jvm.java.io.BufferedReader(text), []
        while (line := reader.readLine()) is not None:
            lines.append(line)
            if "\n".join(lines).count('"') % 2 == 0:
                break
    finally:
        stream.close()
    if not lines:
        return []
    names = next(csv.reader(["\n".join(lines).removeprefix("\ufeff")], delimiter=sep), [])
    if len(set(names)) < len(names):
        raise ValueError(f"{path}: column names repeat: {names}")
    return names


def check_sources(spark: SparkSession, manifest: dict[str, SourceSpec]) -> None:
    """A4: fail before planning if any input is missing."""
    missing = [f"{k}: {s.path}" for k, s in manifest.items() if not path_exists(spark, s.path)]
    if missing:
        raise FileNotFoundError("missing source files: " + "; ".join(missing))


# The texts that the usual data-frame reader takes for a missing number.
MISSING_NUMBERS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
                   "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def _name_of(path: str) -> str:
    return unquote(urlparse(path).path)


def _files_with_line_breaks(spark: SparkSession, paths: list[str]) -> set[str]:
    """Files in which some physical line holds an odd number of quotes, as one does that ends inside a field."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    odd = (spark.read.text(paths).select(quotes.alias("quotes"), F.col("_metadata.file_path").alias("file"))
           .filter("quotes % 2 = 1").select("file").distinct())
    return {_name_of(r["file"]) for r in odd.collect()}          # file names only


def _read_group(spark: SparkSession, spec: SourceSpec, header: tuple[str, ...], multi: bool, paths: list[str]) -> DataFrame:
    """Rows of files that share a header: the declared columns by name, with ``__file, __columns, __record``."""
    places = {name: f"c{i}" for i, name in enumerate(header)}
    schema = T.StructType([T.StructField(c, Sg) for c in places.values()] + [T.StructField("__bad", Sg)])
    raw = (spark.read.schema(schema).option("header", True).option("escape", '"').option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "__bad").option("multiLine", multi).option("columnPruning", False)
           .option("sep", "\t" if spec.format == "tsv" else ",").csv(paths))
    values, wrong = [], []
    for f in spec.schema.fields:
        if f.name not in places:
            values.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        text = F.col(places[f.name])
        if isinstance(f.dataType, T.StringType):
            values.append(F.nullif(text, F.lit("")).alias(f.name))
            continue
        given, number = ~F.trim(text).isin(MISSING_NUMBERS), F.trim(text).try_cast(f.dataType)
        wrong.append(F.when(given & number.isNull(), F.lit(f.name)))
        number = F.when(given, number)
        values.append((nan_to_null(number) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else number).alias(f.name))
    # there is a corrupt record; Spark refuses plans that need that column alone, as a count of rows would
    first = F.col(next(iter(places.values())))
    broken = F.length(F.concat_ws("", first, "__bad")) > F.length(F.coalesce(first, F.lit("")))
    whole = F.to_json(F.map_from_arrays(F.lit(list(header)), F.array(*[F.col(c) for c in places.values()])))
    return raw.select(
        *values, F.col("_metadata.file_path").alias("__file"),
        F.array_compact(F.array(*(wrong or [F.lit(None).cast("string")]))).alias("__columns"),
        broken.alias("__broken"), F.coalesce("__bad", whole).alias("__record"))


def scan_parts(spark: SparkSession, spec: SourceSpec) -> tuple[DataFrame, DataFrame]:
    """A1/A2: ``(rows, quarantine)`` of header CSV or TSV files with a declared schema.

    Columns are found by name in each file's header (quotes are doubled inside
    fields); one that a file lacks is NULL, others are ignored. A file whose
    quotes span lines is read whole by one task, because only then a record can
    be told from a line; all other files are split. ``quarantine`` holds
    ``file, reason, columns, record`` of records with another number of fields
    than the header (``fields``) or a text where a number belongs (``number``)."""
    if spec.schema is None:
        raise ValueError("a delimited source needs a declared schema")
    sep = "\t" if spec.format == "tsv" else ","
    paths = [p for p, length in list_files(spark, spec.path) if length]
    with ThreadPoolExecutor(16) as pool:
        headers = list(pool.map(lambda p: tuple(read_header(spark, p, sep)), paths))
    declared = set(spec.schema.names)
    for p, header in zip(paths, headers):
        if header and not declared & set(header):
            raise ValueError(f"{p}: no declared column among {list(header)}")
    broken: set[str] = set()
    if spec.line_breaks == "auto" and paths:
        broken = _files_with_line_breaks(spark, paths)
    groups: dict[tuple, list[str]] = {}
    for p, header in zip(paths, headers):
        if header:
            multi = spec.line_breaks == "yes" or _name_of(p) in broken
            groups.setdefault((header, multi), []).append(p)
    found = None
    for (header, multi), files in sorted(groups.items()):
        part = _read_group(spark, spec, header, multi, files)
        found = part if found is None else found.unionByName(part)
    if found is None:
        empty = spark.createDataFrame([], spec.schema)
        return empty, spark.createDataFrame([], QUARANTINE)
    good = ~F.col("__broken") & (F.size("__columns") == 0)
    reason = F.when(F.col("__broken"), F.lit("fields")).otherwise(F.lit("number"))
    bad = found.filter(~good).select(F.col("__file").alias("file"), reason.alias("reason"),
                                     F.when(~F.col("__broken"), F.col("__columns")).alias("columns"), F.col("__record").alias("record"))
    return found.filter(good).select(*[F.col(f"`{n}`") for n in spec.schema.names]), bad


QUARANTINE = "file string, reason string, columns array<string>, record string"


def scan(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    """A1/A2: the rows of a source that parse; double columns get NaN -> NULL."""
    if spec.format != "parquet":
        return scan_parts(spark, spec)[0]
    df = spark.read.parquet(spec.path)
    dbl = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: nan_to_null(F.col(f"`{c}`")) for c in dbl}) if dbl else df


def quarantined(spark: SparkSession, manifest: dict[str, SourceSpec]) -> DataFrame:
    """``source`` beside the quarantined records of every delimited source."""
    out = spark.createDataFrame([], "source string, " + QUARANTINE)
    for name, spec in manifest.items():
        if spec.format != "parquet":
            out = out.unionByName(scan_parts(spark, spec)[1].select(F.lit(name).alias("source"), "*"))
    return out


def load_sources(spark: SparkSession, manifest: dict[str, SourceSpec], check: bool = True) -> dict[str, DataFrame]:
    """A3: manifest -> DataFrames (lazy; nothing is read until used)."""
    if check:
        check_sources(spark, manifest)
    return {k: scan(spark, s) for k, s in manifest.items()}


def source_profile(frames: dict[str, DataFrame]) -> DataFrame:
    """A5: rows and columns per source, one row each."""
    out = None
    for name, df in frames.items():
        r = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("source"), "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_cols"))
        out = r if out is None else out.unionByName(r)
    return out


_SPLIT = 1 << 50              # no file is split at this size


class _Digest:
    """SHA-256 of a file that arrives line by line, in constant memory.

    Line feeds stand between lines; whether one stands at the end, and whether
    the reader took off a byte order mark, the file's length tells when all
    lines have come. A digest is kept for either beginning."""

    def __init__(self):
        self.seen, self.lines = 0, 0
        self.states = hashlib.sha256(), hashlib.sha256(b"\xef\xbb\xbf")

    def add(self, lines: list[bytes]) -> None:
        text = (b"\n" if self.lines else b"") + b"\n".join(lines)
        self.lines += len(lines)
        self.seen += len(text)
        for state in self.states:
            state.update(text)

    def hex(self, length: int) -> str | None:
        mark, end = divmod(length - self.seen, 3)
        if mark not in (0, 1) or end not in (0, 1):
            return None
        state = self.states[mark]
        state.update(b"\n" * end)
        return state.hexdigest()


def file_checksums(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path, length, sha256`` of each file, computed in the executors.

    A file is one task (the digest is sequential) and passes through it in
    Arrow batches of lines, so its size has no limit; a single line must be
    below 2 GiB. Spark's readers fetch the bytes, so any path they open will
    do. Files that they would decompress are read as one binary value, below
    2 GiB."""
    files = [f for p in paths for f in list_files(spark, p)]
    codecs = spark.sparkContext._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(
        spark.sparkContext._jsc.hadoopConfiguration())
    packed = {p for p, _ in files if codecs.getCodec(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)) is not None}
    found = {p: hashlib.sha256().hexdigest() for p, length in files if not length}
    plain = [p for p, length in files if length and p not in packed]
    if plain:
        own = spark.newSession()              # its settings are not the caller's
        own.conf.set("spark.sql.files.maxPartitionBytes", str(_SPLIT))
        own.conf.set("spark.sql.files.openCostInBytes", str(_SPLIT - 1))     # a partition a file

        def digest(batches):
            state = path = length = None
            for batch in batches:
                names, sizes = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                for name, rows in groupby(range(batch.num_rows), names.__getitem__):
                    rows = list(rows)
                    if name != path:
                        if state is not None:
                            yield _digest_row(path, length, state)
                        state, path, length = _Digest(), name, sizes[rows[0]]
                    state.add(batch.column(0).slice(rows[0], len(rows)).to_pylist())
            if state is not None:
                yield _digest_row(path, length, state)

        from ..session import ship_package
        ship_package(spark)
        lines = own.read.option("lineSep", "\n").text(plain).select(
            F.col("value").cast("binary"), F.col("_metadata.file_path"), F.col("_metadata.file_size"))
        rows = lines.mapInArrow(digest, "path string, sha256 string").collect()        # one row a file
        found |= {p: _Digest().hex(length) for p, length in files if p in plain}       # of a file without a line
        found |= {_name_of(r["path"]): r["sha256"] for r in rows}
    if packed:
        rows = (spark.read.format("binaryFile").load(sorted(packed))
                .select("path", F.sha2("content", 256).alias("sha256")).collect())     # one row a file
        found |= {_name_of(r["path"]): r["sha256"] for r in rows}
    return spark.createDataFrame([(p, length, found.get(_name_of(p), found.get(p))) for p, length in files],
                                 "path string, length long, sha256 string")


def _digest_row(path: str, length: int, state: _Digest) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"path": pa.array([path]), "sha256": pa.array([state.hex(length)], pa.string())})


def line_checksum(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The order-free checksum of the lines of files (not of their bytes; for
    those see :func:`file_checksums`). Files are read in splits, so one large
    file uses many tasks."""
    from ..operators.describe import table_checksum
    return table_checksum(spark.read.text(paths))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None,
                mode: str = "overwrite") -> None:
    """Write a result or dataset. Parquet by default; ``csv``
    writes a header. Partitioned writes (e.g. by ``model_id``) let later
    reads prune."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(fmt)


def write_outputs(levels: dict[str, DataFrame], root: str, fmt: str = "parquet") -> dict[str, str]:
    """The integrated dataset, both analytical samples and the
    compatibility alias (same table under a second name)."""
    r = root.rstrip("/")
    out = {"integrated_dataset": levels["integrated"], "task_level_dataset": levels["task_level"],
           "cluster_level_dataset": levels["cluster_level"], "unified_dataset_v2_full": levels["integrated"]}
    paths = {}
    for name, df in out.items():
        paths[name] = f"{r}/{name}"
        write_table(df, paths[name], fmt)
    return paths


def replace_partitions(df: DataFrame, path: str, by: str = "analysis_id") -> None:
    """Write ``df`` below ``path``, replacing the partitions of ``by`` that
    it holds and leaving all others. The new files are staged beside the table
    and moved in when all tasks are done, so a write that fails or is killed
    before leaves the old rows; writing the same again leaves the same rows."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path))


class Run:
    """One run of a command, which replaces its result tables.

    Every row is stamped with the run's id and start (UTC). The manifest
    ``results/runs`` gets one row per table and analysis, with its number of
    rows, when the run ends; a run that fails leaves a row with the error, and
    the tables that it had not reached keep their old rows. A table of the
    manifest's last run of a command is whole exactly if that run's status is
    ``done``."""

    def __init__(self, spark: SparkSession, out: str, command: str):
        self.spark, self.root, self.command = spark, f"{out.rstrip('/')}/results", command
        self.id = uuid.uuid4().hex
        self.started = datetime.now(timezone.utc)
        self.log: list[tuple] = []

    def __enter__(self) -> "Run":
        return self

    def replace(self, name: str, parts: list[tuple[str, DataFrame]]) -> None:
        """Write a table from ``(analysis_id, rows)``; an analysis without rows leaves none of its old ones."""
        whole, path = None, f"{self.root}/{name}"
        for analysis_id, part in parts:
            tagged = part.withColumn("analysis_id", F.lit(analysis_id))
            whole = tagged if whole is None else whole.unionByName(tagged, allowMissingColumns=True)
        if whole is None:
            return
        stamped = whole.withColumns({"run_id": F.lit(self.id), "run_ts": F.lit(self.started).cast("timestamp")})
        replace_partitions(stamped, path)
        written = (self.spark.read.schema(stamped.schema).parquet(path).filter(F.col("run_id") == self.id)
                   .groupBy("analysis_id").agg(F.count(F.lit(1)).alias("n")).collect())       # one row an analysis
        n = {r["analysis_id"]: r["n"] for r in written}
        for analysis_id in dict.fromkeys(a for a, _ in parts):
            if analysis_id not in n:
                fs, old = _file_system(self.spark, f"{path}/analysis_id={analysis_id}")
                fs.delete(old, True)
            self.log.append((name, analysis_id, n.get(analysis_id, 0), "done"))

    def __exit__(self, kind, error, trace) -> None:
        rows = self.log + [(None, None, None, "done" if error is None else f"failed: {kind.__name__}: {str(error)[:500]}")]
        df = self.spark.createDataFrame(
            [(self.id, self.command, i, *r, self.started, datetime.now(timezone.utc)) for i, r in enumerate(rows)],
            "run_id string, command string, step int, table_name string, analysis_id string, n_rows long, status string, "
            "started timestamp, finished timestamp")
        df.coalesce(1).write.mode("append").parquet(f"{self.root}/runs")
