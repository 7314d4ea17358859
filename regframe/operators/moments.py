"""Moment blocks of wide tables.

SQL text per pair of columns grows with the square of their number. Here a
partition folds its Arrow batches into numpy blocks instead, and the blocks of
all partitions merge in a tree, so that no task holds more than ``FAN_IN`` of
them whatever the number of rows.

* ``fold_partitions``: the tree, for any number of named blobs per partition.
* ``CompleteMoments``: n, means and centred cross-products of the complete
  rows of a model, merged pairwise by the stable update.
* ``pairwise_moments``: n and r of every pair of columns on its own complete
  rows, from products of value and presence blocks of ``TILE`` columns. Tile
  pairs stay in Spark; the matrix of all pairs never reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sqltext as S
from ..session import ship_package

FAN_IN = 32
LEVELS = 3
TILE = 128                 # columns of a tile
TILE_PAIRS = 64            # tile pairs whose sums one scan of the table holds
BAND = 256                 # rows of a cross-product matrix that travel together


def as_double(name: str) -> str:
    return f"CAST({S.q(name)} AS DOUBLE)"


def columns_of(batch: pa.RecordBatch, at: Iterable[int]) -> np.ndarray:
    """The columns as one matrix; a missing value is NaN."""
    parts = [batch.column(i).to_numpy(zero_copy_only=False) for i in at]
    return np.column_stack(parts).astype(np.float64, copy=False) if parts else np.empty((batch.num_rows, 0))


def merged_blobs(df: DataFrame, build: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int, bytes]]],
                 merge: Callable[[list[bytes]], bytes]) -> DataFrame:
    """``item, node, blob``: one blob per item and top of the tree.

    ``build`` turns a partition into blobs of bounded size, one an item;
    ``merge`` turns several blobs of an item into one.
    """
    ship_package(df.sparkSession)

    def local(batches):
        from pyspark import TaskContext
        node = TaskContext.get().partitionId()
        for item, blob in build(batches):
            yield pa.RecordBatch.from_arrays([pa.array([item], pa.int32()), pa.array([node], pa.int64()),
                                              pa.array([blob], pa.binary())], names=["item", "node", "blob"])

    def fold(table: pa.Table) -> pa.Table:
        return pa.table({"item": table["item"].slice(0, 1), "node": table["node"].slice(0, 1),
                         "blob": pa.array([merge(table["blob"].to_pylist())], pa.binary())})

    schema = "item int, node long, blob binary"
    out = df.mapInArrow(local, schema)
    for _ in range(LEVELS):
        out = (out.withColumn("node", F.floor(F.col("node") / FAN_IN).cast("long"))
               .groupBy("item", "node").applyInArrow(fold, schema))
    return out


def fold_partitions(df: DataFrame, build, merge) -> dict[int, bytes]:
    """The merged blob of every item; no item of a table without partitions."""
    found: dict[int, list[bytes]] = {}
    for row in merged_blobs(df, build, merge).collect():   # items x partitions / FAN_IN ** LEVELS rows
        found.setdefault(row["item"], []).append(bytes(row["blob"]))
    return {item: merge(blobs) if len(blobs) > 1 else blobs[0] for item, blobs in found.items()}


class CompleteMoments:
    """Count, means and centred cross-products of rows, with room for further counts."""

    def __init__(self, width: int, counts: int = 0):
        self.n = 0.0
        self.counts = np.zeros(counts)
        self.mean = np.zeros(width)
        self.cross = np.zeros((width, width))

    def add(self, rows: np.ndarray) -> None:
        if not len(rows):
            return
        mean = rows.mean(axis=0)
        centred = rows - mean
        shift, n = mean - self.mean, self.n + len(rows)
        self.cross += centred.T @ centred + np.outer(shift, shift) * (self.n * len(rows) / n)
        self.mean += shift * (len(rows) / n)
        self.n = n

    def bands(self) -> Iterator[bytes]:
        """The matrix in bands of rows, each with the counts and all means."""
        for lo in range(0, len(self.mean), BAND):
            part = self.cross[lo:lo + BAND]
            yield np.concatenate([[lo, len(part), len(self.counts), self.n], self.counts, self.mean, part.ravel()]).tobytes()


def _read_band(blob: bytes):
    x = np.frombuffer(blob)
    lo, rows, counts = (int(v) for v in x[:3])
    width = len(x) - 4 - counts
    width //= rows + 1
    at = 4 + counts
    return lo, x[3], x[4:at], x[at:at + width], x[at + width:].reshape(rows, width)


def merge_bands(blobs: list[bytes]) -> bytes:
    """Bands of the same rows of one matrix, merged by the stable update."""
    lo, n, counts, mean, cross = _read_band(blobs[0])
    counts, mean, cross = counts.copy(), mean.copy(), cross.copy()
    rows = slice(lo, lo + len(cross))
    for blob in blobs[1:]:
        _, m, more, other, block = _read_band(blob)
        counts += more
        if m:
            shift, total = other - mean, n + m
            cross += block + np.outer(shift[rows], shift) * (n * m / total)
            mean += shift * (m / total)
            n = total
    return np.concatenate([[lo, len(cross), len(counts), n], counts, mean, cross.ravel()]).tobytes()


def joined_bands(blobs: list[bytes]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """``n, counts, mean, cross`` of the bands of one matrix."""
    parts = sorted((_read_band(b) for b in blobs), key=lambda p: p[0])
    return int(parts[0][1]), parts[0][2], parts[0][3], np.concatenate([p[4] for p in parts])


def n_bands(width: int) -> int:
    return -(-width // BAND)


def sum_blobs(blobs: list[bytes]) -> bytes:
    out = np.frombuffer(blobs[0]).copy()
    for blob in blobs[1:]:
        out += np.frombuffer(blob)
    return out.tobytes()


def column_means(df: DataFrame, cols: list[str]) -> np.ndarray | None:
    """The mean of every column's present values (0 where there is none); None without partitions."""
    k = len(cols)

    def build(batches):
        total = np.zeros((2, k))
        for batch in batches:
            x = columns_of(batch, range(k))
            there = ~np.isnan(x)
            total += [there.sum(axis=0), np.where(there, x, 0.0).sum(axis=0)]
        yield 0, total.tobytes()

    found = fold_partitions(df.selectExpr(*[f"{as_double(c)} AS c{i}" for i, c in enumerate(cols)]), build, sum_blobs)
    if not found:
        return None
    n, total = np.frombuffer(found[0]).reshape(2, k)
    return total / np.maximum(n, 1)


def _tile_rows(pair_cols):
    """Rows ``i, j, n, r`` of a merged tile pair."""
    def rows(batches):
        for batch in batches:
            for item, blob in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                left, right = pair_cols[item]
                n, sx, sy, sxx, syy, sxy = np.frombuffer(blob).reshape(6, len(left), len(right))
                i, j = np.meshgrid(left, right, indexing="ij")
                safe = np.maximum(n, 1)
                vx, vy = sxx - sx * sx / safe, syy - sy * sy / safe
                # a column that is constant on the pair's rows has no spread beyond rounding
                good = (n > 0) & (vx > 1e-13 * sxx) & (vy > 1e-13 * syy)
                r = np.clip((sxy - sx * sy / safe) / np.sqrt(np.where(good, vx * vy, 1.0)), -1.0, 1.0)
                own = i < j
                yield pa.RecordBatch.from_arrays(
                    [pa.array(i[own], pa.int32()), pa.array(j[own], pa.int32()), pa.array(n[own].astype(np.int64)),
                     pa.array(np.where(good, r, np.nan)[own], pa.float64(), mask=~good[own])], names=["i", "j", "n", "r"])

    return rows


def pairwise_moments(df: DataFrame, cols: list[str]) -> DataFrame:
    """``i, j, n, r`` for all ``i < j``: rows where both columns are present, and their Pearson r.

    ``r`` is NULL where a column is constant on those rows. Values are taken
    about the column's mean, so the sums do not cancel.
    """
    spark = df.sparkSession
    ship_package(spark)
    k = len(cols)
    centre = column_means(df, cols)
    if centre is None:
        at = spark.range(k * k).select(F.floor(F.col("id") / k).cast("int").alias("i"), (F.col("id") % k).cast("int").alias("j"))
        return at.filter("i < j").withColumns({"n": F.lit(0).cast("long"), "r": F.lit(None).cast("double")})
    tiles = [np.arange(lo, min(k, lo + TILE)) for lo in range(0, k, TILE)]
    pairs = [(a, b) for a in range(len(tiles)) for b in range(a, len(tiles))]
    out = None
    for lo in range(0, len(pairs), TILE_PAIRS):
        wave = pairs[lo:lo + TILE_PAIRS]
        used = sorted({t for pair in wave for t in pair})
        read = [int(c) for t in used for c in tiles[t]]
        place = {t: [read.index(int(c)) for c in tiles[t]] for t in used}
        means = centre[read]

        def build(batches, wave=wave, used=used, place=place, means=means, width=len(read)):
            sums = {pair: 0.0 for pair in wave}
            for batch in batches:
                x = columns_of(batch, range(width))
                there = ~np.isnan(x)
                x = np.where(there, x - means, 0.0)
                there = there.astype(np.float64)
                block = {t: (x[:, place[t]], there[:, place[t]]) for t in used}
                for a, b in wave:
                    (xa, pa_), (xb, pb) = block[a], block[b]
                    sums[a, b] = sums[a, b] + np.stack([pa_.T @ pb, xa.T @ pb, pa_.T @ xb, (xa * xa).T @ pb,
                                                        pa_.T @ (xb * xb), xa.T @ xb])
            for at, (a, b) in enumerate(wave):
                s = sums[a, b]
                yield at, (s if isinstance(s, np.ndarray) else np.zeros((6, len(place[a]), len(place[b])))).tobytes()

        blobs = merged_blobs(df.selectExpr(*[f"{as_double(cols[c])} AS c{i}" for i, c in enumerate(read)]), build, sum_blobs)
        # what is left of the tree: one blob a pair unless there are more than FAN_IN ** LEVELS partitions

        def top(table: pa.Table) -> pa.Table:
            return pa.table({"item": table["item"].slice(0, 1), "node": table["node"].slice(0, 1),
                             "blob": pa.array([sum_blobs(table["blob"].to_pylist())], pa.binary())})

        blobs = blobs.groupBy("item").applyInArrow(top, "item int, node long, blob binary")
        rows = blobs.mapInArrow(_tile_rows([(tiles[a], tiles[b]) for a, b in wave]), "i int, j int, n long, r double")
        out = rows if out is None else out.unionByName(rows)
    return out
