import os
import tempfile

import pytest
from pyspark.sql import functions as F

from regframe.functions.columns import COLLAB_RENAMES, coerce_numeric, rename_present
from regframe.operators.assemble import prepare_clusters
from regframe.sources.files import (CLUSTERS_SCHEMA, INTERACTION_SCHEMA, Run, SourceSpec, TASK_PCT_SCHEMA, check_sources,
                                    file_checksums, load_sources, quarantined, replace_partitions, scan, scan_parts,
                                    source_profile, write_table)


def test_csv_roundtrip_with_quotes_and_nan(spark):
    d = tempfile.mkdtemp(prefix="regframe-test-")
    p = os.path.join(d, "task_pct.csv")
    with open(p, "w") as f:
        f.write('task_name,pct\n"Say ""hi"", then go",1.5\nplain,NaN\nother,\n')
    df = scan(spark, SourceSpec(p, "csv", TASK_PCT_SCHEMA))
    got = {r["task_name"]: r["pct"] for r in df.collect()}
    assert got == {'Say "hi", then go': 1.5, "plain": None, "other": None}


def test_tsv_cluster_file_rename_and_coerce(spark):
    d = tempfile.mkdtemp(prefix="regframe-test-")
    p = os.path.join(d, "clusters.tsv")
    cols = [f.name for f in CLUSTERS_SCHEMA.fields]
    vals = ["  Compile terminology ", "c0", "c1", "", "d0", "d1", "d2",
            "0.2", "0.1", "junk", "0.3", "NaN", "0.1", "0.6", "1.5", "2.5"]
    with open(p, "w") as f:
        f.write("\t".join(cols) + "\n" + "\t".join(vals) + "\n")
    raw = scan(spark, SourceSpec(p, "tsv", CLUSTERS_SCHEMA))
    c = prepare_clusters(raw).first()
    assert c["task_name"] == "compile terminology"
    assert c["cluster_directive"] == 0.2 and c["cluster_feedback_loop"] == 0.1
    assert c["cluster_task_iteration"] is None            # bad text -> NULL, never 0
    assert c["cluster_validation"] is None                # NaN -> NULL
    assert c["cluster_thinking_fraction"] == 0.6
    assert c["cluster_automation_index"] == pytest.approx(0.3)
    assert c["cluster_augmentation_index"] is None        # null-strict


def test_rename_map_ignores_absent(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "`collaboration:directive_ratio` double, other double")
    out = rename_present(df, COLLAB_RENAMES)
    assert out.columns == ["cluster_directive", "other"]


def test_coerce_numeric(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("NaN",), (None,)], "s string")
    assert [r[0] for r in df.select(coerce_numeric("s")).collect()] == [1.5, None, None, None]


def test_manifest_missing_file_fails_early(spark):
    with pytest.raises(FileNotFoundError):
        check_sources(spark, {"x": SourceSpec("/nonexistent/file.csv")})


def test_load_profile_checksum_and_sink(spark):
    import hashlib
    d = tempfile.mkdtemp(prefix="regframe-test-")
    p = os.path.join(d, "t.csv")
    body = "task_name,pct\na,1.0\nb,2.0\n"
    with open(p, "w") as f:
        f.write(body)
    fr = load_sources(spark, {"task_pct": SourceSpec(p, "csv", TASK_PCT_SCHEMA)})
    prof = source_profile(fr).first()
    assert (prof["n_rows"], prof["n_cols"]) == (2, 2)
    ck = file_checksums(spark, [p]).first()
    assert ck["sha256"] == hashlib.sha256(body.encode()).hexdigest()
    out = os.path.join(d, "out")
    write_table(fr["task_pct"], out, "csv")
    back = spark.read.option("header", True).schema(TASK_PCT_SCHEMA).csv(out)
    assert sorted(r["task_name"] for r in back.collect()) == ["a", "b"]


def test_table_checksum_order_free(spark):
    from regframe.operators.describe import table_checksum
    df = spark.range(1000).select(F.col("id"), (F.col("id") / 7).alias("v"))
    a = table_checksum(df).first()
    b = table_checksum(df.repartition(7).orderBy(F.rand(1))).first()
    assert a == b


# --- scans by header name -------------------------------------------------

FILES = {
    "a.csv": 'task_name,directive,feedback_loop,task_iteration,learning,validation,filtered\n'
             'plain,0.1,0.2,0.3,0.4,0.5,0.6\n"says ""so"", twice",1,2,3,4,5,6\n',
    "b.csv": 'learning,extra,task_name,directive\n0.7,x,reordered,0.9\nNaN,,missing number,\n',
    "c.csv": '\ufeffnote,validation,task_name\n"two\nlines, and a ""quote""",0.5,"broken\nname"\nnone,N/A,after\n',
    "d.csv": '"task\nname",task_name,filtered\nx,quoted header,1.5\n',
    "empty.csv": "",
    "_SUCCESS": "",
}


@pytest.fixture(scope="module")
def folder():
    d = tempfile.mkdtemp(prefix="regframe test ")          # a blank in the path
    for name, text in FILES.items():
        with open(os.path.join(d, name), "w", encoding="utf-8", newline="") as f:
            f.write(text)
    return d


def _named_rows(folder):
    """What a reader by name gives: pandas, file by file."""
    import io
    import pandas as pd
    out = set()
    for name, text in FILES.items():
        if text:
            d = pd.read_csv(io.StringIO(text.removeprefix("\ufeff"))).reindex(columns=INTERACTION_SCHEMA.names)
            out |= {tuple(None if pd.isna(v) else v for v in r) for r in d.itertuples(index=False)}
    return out


@pytest.mark.parametrize("line_breaks", ["auto", "yes"])
def test_columns_are_found_by_name(spark, folder, line_breaks):
    spec = SourceSpec(folder, "csv", INTERACTION_SCHEMA, line_breaks)
    rows, bad = scan_parts(spark, spec)
    assert rows.schema == INTERACTION_SCHEMA and bad.count() == 0
    got = [tuple(r) for r in rows.collect()]
    assert len(got) == 7 and set(got) == _named_rows(folder)
    # pruned, filtered and counted scans see the same rows
    assert rows.select("learning").filter("learning > 0.5").count() == 2 and rows.count() == 7


def test_only_files_with_line_breaks_are_read_whole(spark, folder):
    from regframe.sources.files import _files_with_line_breaks, list_files
    paths = [p for p, n in list_files(spark, folder) if n]
    assert len(paths) == 4
    from pyspark.sql import types as T
    words = T.StructType([T.StructField("task_name", T.StringType())])
    assert scan(spark, SourceSpec(folder, "csv", words)).count() == 7        # no number column to read
    assert {os.path.basename(p) for p in _files_with_line_breaks(spark, paths)} == {"c.csv", "d.csv"}


def test_records_that_do_not_parse_are_set_apart(spark):
    d = tempfile.mkdtemp(prefix="regframe-test-")
    with open(os.path.join(d, "x.tsv"), "w") as f:
        f.write("pct\ttask_name\n1.5\tgood\nabc\tnot a number\n2\ttoo\tmany\n3\n 4 \tblanks\nnull\tmissing\n\tempty\n")
    manifest = {"t": SourceSpec(d, "tsv", TASK_PCT_SCHEMA)}
    rows = {tuple(r) for r in scan(spark, manifest["t"]).collect()}
    assert rows == {("good", 1.5), ("blanks", 4.0), ("missing", None), ("empty", None)}
    bad = sorted((r.source, r.reason, r["columns"], r.record) for r in quarantined(spark, manifest).collect())
    assert [(b[1], b[2]) for b in bad] == [("fields", None), ("fields", None), ("number", ["pct"])]
    assert "too" in bad[0][3] and bad[1][3] == "3" and "abc" in bad[2][3]


def test_sources_without_rows_or_declared_columns(spark, folder):
    d = tempfile.mkdtemp(prefix="regframe-test-")
    for name in ("a.csv", "b.csv"):
        open(os.path.join(d, name), "w").close()
    rows, bad = scan_parts(spark, SourceSpec(d, "csv", TASK_PCT_SCHEMA))
    assert rows.count() == 0 and rows.schema == TASK_PCT_SCHEMA and bad.count() == 0
    for text, message in (("a,b\n1,2\n", "no declared column"), ("task_name,pct,pct\nx,1,2\n", "repeat")):
        with open(os.path.join(d, "a.csv"), "w") as f:
            f.write(text)
        with pytest.raises(ValueError, match=message):
            scan(spark, SourceSpec(d, "csv", TASK_PCT_SCHEMA))


def test_gzipped_files_by_name(spark):
    import gzip
    d = tempfile.mkdtemp(prefix="regframe-test-")
    with gzip.open(os.path.join(d, "x.csv.gz"), "wt") as f:
        f.write("pct,task_name\n1.5,zipped\n")
    assert [tuple(r) for r in scan(spark, SourceSpec(d, "csv", TASK_PCT_SCHEMA)).collect()] == [("zipped", 1.5)]


# --- digests --------------------------------------------------------------

@pytest.mark.parametrize("batch", ["10000", "3"])
def test_sha256_of_files_in_batches(spark, batch):
    """Any bytes: text, binary, byte order marks, line ends of every kind, no end, empty."""
    import gzip
    import hashlib
    import random
    d = tempfile.mkdtemp(prefix="regframe test ")
    rng = random.Random(3)
    bodies = {"text": b"a\nbb\n\nccc", "ended": b"a\nb\n", "blank ends": b"\n\n\n", "one": b"\n", "bom": b"\xef\xbb\xbfa\nb\n",
              "bom alone": b"\xef\xbb\xbf", "crlf": b"a\r\nb\r\n", "cr": b"a\rb", "empty": b"", "long": b"x" * 3_000_000,
              "binary": bytes(rng.getrandbits(8) for _ in range(200_000)), "zipped.gz": gzip.compress(b"some text\n" * 100)}
    for name, body in bodies.items():
        with open(os.path.join(d, name), "wb") as f:
            f.write(body)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {os.path.basename(r.path): (r.length, r.sha256) for r in file_checksums(spark, [d]).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in bodies.items()}


# --- results that can be written twice ------------------------------------

def _rows(spark, path):
    return sorted((r.analysis_id, r.v) for r in spark.read.parquet(path).collect())


def test_partitions_are_replaced_and_a_failed_write_leaves_the_old_rows(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="regframe-test-"), "t")

    def table(pairs):
        return spark.createDataFrame(pairs, "analysis_id string, v int").repartition(3)

    replace_partitions(table([("a", 1), ("a", 2), ("b", 3)]), path)
    replace_partitions(table([("a", 1), ("a", 2)]), path)
    assert _rows(spark, path) == [("a", 1), ("a", 2), ("b", 3)]
    replace_partitions(table([("b", 4), ("c", 5)]), path)
    assert _rows(spark, path) == [("a", 1), ("a", 2), ("b", 4), ("c", 5)]
    broken = table([("a", i) for i in range(50)]).withColumn("v", F.when(F.col("v") < 40, F.col("v")).otherwise(
        F.raise_error(F.lit("killed")).cast("int")))
    with pytest.raises(Exception, match="killed"):
        replace_partitions(broken, path)
    assert _rows(spark, path) == [("a", 1), ("a", 2), ("b", 4), ("c", 5)]


def test_a_run_replaces_its_analyses_and_keeps_a_manifest(spark):
    out = tempfile.mkdtemp(prefix="regframe-test-")

    def part(*values):
        return spark.createDataFrame([(v,) for v in values], "v int")

    for _ in range(2):
        with Run(spark, out, "first") as run:
            run.replace("t", [("x", part(1, 2)), ("y", part(3)), ("y", part(4).withColumn("w", F.lit("more")))])
            run.replace("u", [("x", part(9))])
    assert _rows(spark, f"{out}/results/t") == [("x", 1), ("x", 2), ("y", 3), ("y", 4)]
    with Run(spark, out, "second") as run:
        run.replace("t", [("x", part()), ("z", part(5))])          # x has no row any more
        run.replace("none", [("x", part())])
    assert _rows(spark, f"{out}/results/t") == [("y", 3), ("y", 4), ("z", 5)]
    with pytest.raises(RuntimeError):
        with Run(spark, out, "third") as run:
            run.replace("u", [("x", part(10))])
            raise RuntimeError("lost")
    runs = spark.read.parquet(f"{out}/results/runs").orderBy("started", "step").collect()
    assert [(r.command, r.table_name, r.analysis_id, r.n_rows) for r in runs if r.command == "second"] == [
        ("second", "t", "x", 0), ("second", "t", "z", 1), ("second", "none", "x", 0), ("second", None, None, None)]
    assert [r.status for r in runs if r.command == "third"] == ["done", "failed: RuntimeError: lost"]
    assert len({r.run_id for r in runs}) == 4 and len(runs) == 4 + 4 + 4 + 2
