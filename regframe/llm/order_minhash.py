"""Document fingerprints by Order MinHash.

A text is its list of k-mers of code points, each numbered by its occurrence
(the second "the cat sat" is another element than the first). Each of ``DRAWS``
hash functions orders these elements; the ``TUPLE`` smallest are put back into
the order of the text and hashed together. Two texts agree in a draw when they
share the smallest elements and hold them in one order, so the share of equal
draws falls with the edit distance, also for texts with the same k-mers in
another order.

A fingerprint is a string of four base-64 characters a draw. Documents are
compared with their neighbours in descending order of id: every range of ids
also receives the first document of the next range, so one shuffle by range
brings all neighbours together and no task reads more than its range.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted

K = 8           # code points of a k-mer
TUPLE = 2       # k-mers of a draw
DRAWS = 64
RANGE_CHARS = 1 << 23   # code points of a range of ids, about
MAX_RANGES = 1 << 17    # ranges, whose first ids are broadcast
_COLUMNS = 4096
_POSITION_BITS = 24     # texts up to so many positions number their k-mers by one packed sort


def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(13)
    return (rng.integers(0, 1 << 32, DRAWS, dtype=np.uint64).astype(np.uint32),
            rng.integers(0, 1 << 31, DRAWS, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1))


_XOR, _ODD = _functions()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def kmer_hashes(text: str, k: int = K) -> np.ndarray:
    """A 64-bit hash of the k-mer at every position; a shorter text is one k-mer."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(x):
        return x
    k = min(k, len(x))
    # value of windows of 1, 2, 4, ... code points; those of the bits of k are put together
    whole = np.full(len(x) - k + 1, np.uint64(k))
    window, size, start = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), 1, 0
    while True:
        power = np.uint64(pow(0xD1342543DE82EF95, size, 1 << 64))
        if k & size:
            whole = whole * power + window[start:start + len(whole)]
            start += size
        if 2 * size > k:
            return _mixed(whole)
        window = window[:-size] * power + window[size:]
        size *= 2


def occurrence_numbers(h: np.ndarray) -> np.ndarray:
    """How often each value has come before, position by position."""
    n = len(h)
    if n <= 1 << _POSITION_BITS:
        low = np.uint64((1 << _POSITION_BITS) - 1)
        order = np.sort(h & ~low | np.arange(n, dtype=np.uint64))
        at = (order & low).astype(np.int64)
        group = order & ~low
    else:
        at = np.argsort(h, kind="stable")
        group = h[at]
    place = np.arange(n)
    first = np.ones(n, bool)
    first[1:] = group[1:] != group[:-1]
    out = np.empty(n, np.uint64)
    out[at] = (place - np.maximum.accumulate(np.where(first, place, 0))).astype(np.uint64)
    return out


def _smallest(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``TUPLE`` rows of positions and values of each draw's smallest elements, ties to the first position."""
    keep = min(TUPLE, len(x))
    value = np.empty((DRAWS, 0), np.uint32)
    place = np.empty((DRAWS, 0), np.int64)
    rows = np.arange(DRAWS)
    for lo in range(0, len(x), _COLUMNS):
        drawn = (x[None, lo:lo + _COLUMNS] ^ _XOR[:, None]) * _ODD[:, None]
        for _ in range(min(keep, drawn.shape[1])):
            at = drawn.argmin(axis=1)
            value = np.concatenate([value, drawn[rows, at][:, None]], axis=1)
            place = np.concatenate([place, at[:, None] + lo], axis=1)
            drawn[rows, at] = np.uint32(0xFFFFFFFF)
        if value.shape[1] > keep:
            best = np.lexsort((place, value), axis=1)[:, :keep]
            value, place = np.take_along_axis(value, best, 1), np.take_along_axis(place, best, 1)
    return place, value


def fingerprint_of(text: str) -> str:
    """The fingerprint of a whole text; that of an empty one has the tuples of no k-mer."""
    h = kmer_hashes(text)
    if not len(h):
        code = np.zeros(DRAWS, np.uint64)
    else:
        h = _mixed(h + occurrence_numbers(h) * np.uint64(0x9E3779B97F4A7C15))
        place, _ = _smallest((h >> np.uint64(32)).astype(np.uint32))
        place = np.sort(place, axis=1)
        code = np.full(DRAWS, np.uint64(place.shape[1]))
        for i in range(place.shape[1]):
            code = _mixed(code * np.uint64(0xD6E8FEB86659FD93) + h[place[:, i]])
    packed = (code & np.uint64(0xFFFFFF)).astype("<u4").view(np.uint8).reshape(DRAWS, 4)[:, :3]
    return base64.b64encode(packed.tobytes()).decode()


def likeness_of(a: str, b: str) -> float:
    """The share of equal draws of two fingerprints."""
    x, y = np.frombuffer(a.encode(), np.uint32), np.frombuffer(b.encode(), np.uint32)
    return float((x == y).mean())


def likeness(a: Column, b: Column) -> Column:
    """``likeness_of`` as a Column expression."""
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(DRAWS - 1)),
                           lambda i: F.substr(a, i * 4 + 1, F.lit(4)) == F.substr(b, i * 4 + 1, F.lit(4))))
    return same / F.lit(float(DRAWS))


def edited_text(text: str, following: str) -> str:
    """``text`` with its last third replaced by the first code points of ``following``, as many or all."""
    third = len(text) // 3
    return text[:len(text) - third] + following[:third]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_chars, fingerprint`` of every row; a missing text counts as empty. No shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([fingerprint_of(t) for t in texts], pa.string())], names=["id", "n_chars", "fingerprint"])

    return (docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
            .mapInArrow(run, f"id {kind}, n_chars long, fingerprint string").withColumnRenamed("id", id_col))


def _ranges(rows: DataFrame) -> int:
    """Ranges of about ``RANGE_CHARS`` code points, ``MAX_RANGES`` at most."""
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    return int(min(MAX_RANGES, max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-chars // RANGE_CHARS))))


def _heads(rows: DataFrame, ranges: int) -> list:
    """The largest id of each range of ids, ascending; a missing id has no place among them."""
    ids = rows.select("id").filter("id is not null").repartitionByRange(ranges, F.col("id").desc())
    found = ids.groupBy(F.spark_partition_id().alias("at")).agg(F.max("id").alias("head")).select("head").distinct()
    return sorted(r["head"] for r in found.collect())  # one a range


def _dealt(rows: DataFrame, heads: list) -> DataFrame:
    """``range, visitor, id, text``: rows in their ranges, and rows of a range's first id also in the range before.

    Ranges are numbered by descending id; missing ids are in the last, and the
    first range's rows of first id are also in the last range.
    """
    kind = rows.schema["id"].dataType.simpleString()
    held = rows.sparkSession.sparkContext.broadcast(heads)

    def run(batches):
        heads = held.value
        last = max(0, len(heads) - 1)
        for batch in batches:
            at, where, visitor = [], [], []
            for i, value in enumerate(batch.column(0).to_pylist()):
                place = len(heads) if value is None else bisect_left(heads, value)
                own = last if value is None else max(0, last - place)
                at.append(i)
                where.append(own)
                visitor.append(False)
                if not heads or place <= last and heads[place] == value:
                    at.append(i)
                    where.append(own - 1 if own else last)
                    visitor.append(True)
            took = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(where, pa.int32()), pa.array(visitor, pa.bool_()), batch.column(0).take(took),
                 batch.column(1).take(took)], names=["range", "visitor", "id", "text"])

    return rows.mapInArrow(run, f"range int, visitor boolean, id {kind}, text string")


def neighbours_compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every row.

    The next document is the one of next lower id; after the last comes the
    first, and a table of one row is its own next. Rows of equal ids follow
    each other by text, rows without an id come last. A missing text counts as
    empty; an empty table gives no rows. Texts are read whole; other columns
    are not read.
    """
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("text"))
    ranges = _ranges(rows)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        pending = None                  # place, text, fingerprint of the row that waits for its next
        for batch in batches:
            places, visitors, texts = (batch.column(i).to_pylist() for i in (0, 1, 3))
            ids: list = [pending[3]] if pending else []
            done: list = []
            for i, (place, visitor, text) in enumerate(zip(places, visitors, texts)):
                if pending is None and visitor:
                    continue            # a further visitor
                own = fingerprint_of(text)
                if pending is not None:
                    before, mark = pending[1], pending[2]
                    edited = edited_text(before, text)
                    changed = fingerprint_of(edited)
                    done.append((len(before), hashlib.sha256(edited.encode()).hexdigest(), mark, changed,
                                 likeness_of(mark, changed), likeness_of(mark, own)))
                pending = None
                if not visitor:
                    pending = (place, text, own, batch.column(2).slice(i, 1))
                    ids.append(pending[3])
            if done:
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays(ids[:len(done)]),
                     *(pa.array(c, t) for c, t in zip(zip(*done), (
                         pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())))],
                    names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    ordered = (_dealt(rows, _heads(rows, ranges)).repartition(ranges, "range")
               .sortWithinPartitions("range", "visitor", F.col("id").desc_nulls_last(), "text"))
    return ordered.mapInArrow(
        run, f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             f"near_edited double, near_next double").withColumnRenamed("id", id_col)
