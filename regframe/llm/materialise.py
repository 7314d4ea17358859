"""Training-order materialisation: a keyed permutation, and fixed-stride shards.

The token streams of the input partitions are cut into sequences of ``length``
ids. A sequence's ordinal is its place in its partition plus the sequences of
all partitions before it. A keyed Feistel network permutes the ordinals; values
beyond the number of sequences walk the cycle until they fall below it, so the
slots are exactly 0..N-1 and any slot can be computed alone, both ways.

A shard is a range of ``per_shard`` slots. Its task sorts them and writes one
file of fixed-stride records; slot s is at byte (s mod per_shard) x stride of
shard s div per_shard. A file appears under its name only when it is whole, and
its bytes depend on the slots alone, so a task that runs again writes the same.
Reading goes on from any slot.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SEED, cut, quoted, shared_folder
from .tokens import codec

LENGTH = 2048
PER_SHARD = 4096
ROUNDS = 6


def _round(right: np.ndarray, key: int, turn: int, mask: int) -> np.ndarray:
    """A keyed hash of each half word."""
    salt = xxhash.xxh64_intdigest(f"{key}:{turn}".encode())
    h = (right.astype(np.uint64) ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))) & np.uint64(mask)


def _feistel(x: np.ndarray, half: int, key: int, back: bool) -> np.ndarray:
    mask = (1 << half) - 1
    left, right = x >> np.uint64(half), x & np.uint64(mask)
    for turn in (reversed(range(ROUNDS)) if back else range(ROUNDS)):
        if back:
            left, right = right ^ _round(left, key, turn, mask), left
        else:
            left, right = right, left ^ _round(right, key, turn, mask)
    return (left << np.uint64(half)) | right


def slots_of(ordinals: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """The permutation of 0..n-1 under ``key``, or its inverse."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    out = _feistel(np.asarray(ordinals, np.uint64), half, key, back)
    while (beyond := out >= np.uint64(n)).any():  # walk the cycle
        out[beyond] = _feistel(out[beyond], half, key, back)
    return out.astype(np.int64)


def token_sequences(docs: DataFrame, vocab_path: str, id_col: str, text_col: str, length: int,
                    end_id: int) -> DataFrame:
    """``part, at, n_tokens, doc_ids, ids``: the cut token stream of each partition.

    The ids are 16-bit words, compressed until the shard's task writes them.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_type
        kind = to_arrow_type(docs_id)
        part, own = TaskContext.get().partitionId(), codec(vocab_path)
        tail, packer = np.array([end_id], np.uint32).tobytes(), pa.Codec("zstd", 3)
        held, held_n, open_ids, at = [], 0, [], 0

        def out(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array([part] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int64()),
                 pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(kind)),
                 pa.array([packer.compress(r[3], asbytes=True) for r in rows], pa.binary())], names=["part", "at", "n_tokens", "doc_ids", "ids"])

        rows = []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.frombuffer(own.ids(text) + tail, np.uint32).astype("<u2")
                open_ids.append(doc_id)
                held.append(ids)
                held_n += len(ids)
                if held_n < length:
                    continue
                stream = np.concatenate(held)
                whole = held_n // length
                for k in range(whole):
                    first = open_ids if k == 0 else [doc_id]
                    rows.append((at, length, first, stream[k * length:(k + 1) * length].tobytes()))
                    at += 1
                    if len(rows) >= 512:
                        yield out(rows)
                        rows = []
                rest = stream[whole * length:]
                held, held_n, open_ids = ([rest], len(rest), [doc_id]) if len(rest) else ([], 0, [])
        if held_n:
            stream = np.concatenate(held)
            rows.append((at, len(stream), open_ids, np.pad(stream, (0, length - len(stream))).tobytes()))
        if rows:
            yield out(rows)

    docs_id = docs.schema[id_col].dataType
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
    return rows.mapInArrow(run, f"part int, at long, n_tokens int, doc_ids array<{id_type}>, ids binary")


def _folder(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _write_whole(uri: str, name: str, data: bytes) -> None:
    """A file that appears under its name with all its bytes, or not at all."""
    from pyspark import TaskContext
    fs, folder = _folder(uri)
    task = TaskContext.get()
    draft = f"{folder}/.{name}.{task.taskAttemptId() if task else 'driver'}"
    with fs.open_output_stream(draft) as f:
        f.write(data)
    whole = f"{folder}/{name}"
    if fs.get_file_info(whole).type == pafs.FileType.File:  # an earlier attempt wrote the same bytes
        fs.delete_file(draft)
    else:
        fs.move(draft, whole)


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def materialise(docs: DataFrame, vocab_path: str, path: str, id_col: str = "doc_id", text_col: str = "text",
                key: int = SEED, length: int = LENGTH, per_shard: int = PER_SHARD, end_id: int = 1) -> DataFrame:
    """Write all sequences as shards below ``path``; ``slot, shard, offset, n_tokens, ids_crc32, doc_ids`` of each.

    ``path`` is a folder that all executors share. A missing or empty text is
    its end id alone. Rows are taken as they come, repeated ones as often as
    they occur; ids may be missing. The vocabulary must have at most 65,536
    ids. An empty table writes a manifest of 0 sequences and gives no rows.
    """
    spark = docs.sparkSession
    most = max(codec(vocab_path).tok.get_vocab(with_added_tokens=True).values(), default=0)
    if max(most, end_id) >= 1 << 16:
        raise ValueError(f"ids up to {max(most, end_id)} do not fit 16 bits")
    held = f"{path}/_sequences"
    (token_sequences(docs, vocab_path, id_col, text_col, length, end_id)
     .write.option("compression", "uncompressed").parquet(held))
    sequences = spark.read.parquet(held)
    counts = sequences.groupBy("part").count().orderBy("part").collect()  # a row per partition
    offsets, n = {}, 0
    for row in counts:
        offsets[row["part"]] = n
        n += row["count"]
    stride = 2 * length
    fs, folder = _folder(path)
    fs.create_dir(folder)
    _write_whole(path, "manifest.json", json.dumps(
        {"n": n, "key": key, "length": length, "per_shard": per_shard, "stride": stride}).encode())

    def place(batches):
        for b in batches:
            start = np.array([offsets[p] for p in b.column(0).to_pylist()], np.int64)
            slots = slots_of(start + b.column(1).to_numpy(), n, key) if len(start) else start
            yield pa.RecordBatch.from_arrays([pa.array(slots // per_shard), pa.array(slots), *b.columns[2:]],
                                             names=["shard", "slot", *b.schema.names[2:]])

    id_type = docs.schema[id_col].dataType.simpleString()
    placed = sequences.select("part", "at", "n_tokens", "doc_ids", "ids").mapInArrow(
        place, f"shard long, slot long, n_tokens int, doc_ids array<{id_type}>, ids binary")

    def write(t: pa.Table) -> pa.Table:
        t = t.sort_by("slot")
        shard = t.column("shard")[0].as_py()
        packer = pa.Codec("zstd")
        bodies = [packer.decompress(b, stride, asbytes=True) for b in t.column("ids").to_pylist()]
        _write_whole(path, shard_name(shard), b"".join(bodies))
        used = t.column("n_tokens").to_pylist()
        return pa.table({
            "slot": t.column("slot"), "shard": t.column("shard"),
            "offset": pa.array([(s % per_shard) * stride for s in t.column("slot").to_pylist()], pa.int64()),
            "n_tokens": t.column("n_tokens"),
            "ids_crc32": pa.array([zlib.crc32(b[:2 * k]) for b, k in zip(bodies, used)], pa.int64()),
            "doc_ids": t.column("doc_ids")})

    return cut(placed.groupBy("shard").applyInArrow(
        write, f"slot long, shard long, offset long, n_tokens int, ids_crc32 long, doc_ids array<{id_type}>"))


def read_manifest(path: str) -> dict:
    fs, folder = _folder(path)
    with fs.open_input_stream(f"{folder}/manifest.json") as f:
        return json.loads(f.read())


def read_slots(spark: SparkSession, path: str, start: int = 0, stop: int | None = None) -> DataFrame:
    """``slot, ids`` from slot ``start`` up to ``stop``; each task reads its stretch of one shard in order."""
    m = read_manifest(path)
    stop = m["n"] if stop is None else min(stop, m["n"])
    per, stride = m["per_shard"], m["stride"]

    def read(batches):
        fs, folder = _folder(path)
        for b in batches:
            for shard in b.column(0).to_pylist():
                lo, hi = max(start, shard * per), min(stop, (shard + 1) * per)
                with fs.open_input_file(f"{folder}/{shard_name(shard)}") as f:
                    f.seek((lo - shard * per) * stride)
                    for s in range(lo, hi, 512):
                        k = min(512, hi - s)
                        ids = np.frombuffer(f.read(k * stride), "<u2").reshape(k, -1)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(range(s, s + k), pa.int64()),
                             pa.array(list(ids.astype(np.int32)), pa.list_(pa.int32()))], names=["slot", "ids"])

    shards = spark.range(start // per, (stop - 1) // per + 1) if stop > start else spark.range(0)
    return shards.mapInArrow(read, "slot long, ids array<int>")


def scratch_path(spark: SparkSession) -> str:
    return shared_folder(spark, "training_order")
