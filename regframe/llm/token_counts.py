"""Token counts by a map-side two-tier lookup.

Tier one is a compact table of the corpus's most frequent pre-token units and
their token counts: words where a text's letters are plain, else what stands
between spaces. Every partition summarises the units of its whole texts in
a bounded sketch, the sketches merge in a tree, and the table is broadcast; its
size is bounded by ``frequent`` entries of at most ``MAX_UNIT`` characters.
Tier two are the bounded caches of ids in each worker, for what the table lacks.
No unit is ever shuffled, and counts are exact whatever the table holds.
"""

from __future__ import annotations

import pickle
import uuid
from array import array
from collections import Counter
from heapq import nlargest

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partition_sketches, quoted
from .tokens import codec

MAX_UNIT = 64
FREQUENT = 1 << 16

#: The table that this worker has unpacked, by the name of the run it serves.
_TABLES: dict = {}


class UnitLengths(dict):
    """Token counts of frequent units; a unit it lacks goes to the worker's caches of ids."""

    def __init__(self, packed: tuple[bytes, bytes], encode):
        units, lengths = packed
        counts = array("H")
        counts.frombytes(lengths)
        super().__init__(zip(units.decode().split("\x00"), counts) if counts else ())
        self._encode = encode

    def __missing__(self, unit):
        return len(self._encode(unit)) // 4


def _top(counts: Counter, keep: int) -> dict[str, int]:
    """The ``keep`` units of highest counts, equal ones from the last in order."""
    if len(counts) <= keep:
        return dict(counts)
    least = sorted(counts.values(), reverse=True)[keep - 1]
    top = {u: n for u, n in counts.items() if n > least}
    return top | dict.fromkeys(nlargest(keep - len(top), (u for u, n in counts.items() if n == least)), least)


def frequent_units(docs: DataFrame, text: str, vocab_path: str,
                   frequent: int = FREQUENT) -> tuple[bytes, bytes]:
    """The packed table: frequent units of all texts, and their token counts."""
    def build(batches) -> bytes:
        counts: Counter = Counter()
        parts = codec(vocab_path).parts
        for batch in batches:
            for value in batch.column(0).to_pylist():
                if value:
                    counts.update(parts(value))
                if len(counts) > 8 * frequent:
                    counts = Counter(_top(counts, 2 * frequent))
        return pickle.dumps(_top(Counter({u: n for u, n in counts.items() if len(u) <= MAX_UNIT}), frequent))

    def merge(blobs: list[bytes]) -> bytes:
        counts: Counter = Counter()
        for blob in blobs:
            counts.update(pickle.loads(blob))
        return pickle.dumps(_top(counts, frequent))

    found = pickle.loads(partition_sketches(docs.select(quoted(text)), build, merge))
    own = codec(vocab_path)
    units, lengths = [], array("H")
    for unit in found:
        if "\x00" not in unit and not own.special(unit):
            units.append(unit)
            lengths.append(len(own.part_ids(unit)) // 4)
    return "\x00".join(units).encode(), lengths.tobytes()


def token_counts(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 1024, frequent: int = FREQUENT) -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit`` of every whole text.

    A missing text counts as empty: 0 bytes, 0 tokens. Repeated rows and ids
    give one result row each. Other columns of the table are not read.
    """
    spark = docs.sparkSession
    packed = spark.sparkContext.broadcast(frequent_units(docs, text_col, vocab_path, frequent))
    run = uuid.uuid4().hex
    own_id = docs.schema[id_col].dataType

    def count(batches):
        own = codec(vocab_path)
        if run not in _TABLES:
            _TABLES.clear()
            _TABLES[run] = UnitLengths(packed.value, own.part_ids)
        lengths = _TABLES[run].__getitem__

        def tokens(text: str | None) -> int:
            if not text:
                return 0
            if own.special(text):
                return len(own.library(text)) // 4
            return sum(map(lengths, own.parts(text)))

        for batch in batches:
            found = [tokens(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(found, pa.int64())],
                names=["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"),
                       F.coalesce(F.octet_length(quoted(text_col)), F.lit(0)).cast("long").alias("n_bytes"))
    schema = f"id {own_id.simpleString()}, n_bytes long, n_tokens long"
    return (rows.mapInArrow(count, schema)
            .select(F.col("id").alias(id_col), "n_bytes", "n_tokens",
                    (F.col("n_tokens") > limit).alias("over_limit")))
