"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies, the
source's target over its size. The whole part is taken as it is. The fractional
parts are rounded to 0 or 1 by the pivotal method: two fractions meet, and mass
moves at random from one to the other until one of them is integral. Mass is
counted in words, so a source's expected words never change and its taken words
miss the target by less than the one document left at the end, a small one.

Blocks of at most about ``block`` rows are rounded in parallel. Each leaves at
most one fraction; these residuals form the next, smaller level of the tree,
until one block a source is left, where large residuals trade with all smaller
ones at once. Blocks depend on values only (source, size
class, hash of the id), never on partitions, so reruns agree.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SEED, cut, quoted

WORD = r"[^\x20\x09-\x0D]+"
SHARES = (5, 2, 1)
CAP = 3.0
BLOCK = 4096


def sized_documents(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int = SEED) -> DataFrame:
    return docs.select(
        F.col(quoted(id_col)).alias("id"), _tie(id_col, text_col, seed).alias("tie"),
        F.col(quoted(source_col)).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(quoted(text_col)).cast("string"), F.lit(WORD)), F.lit(0))
        .cast("long").alias("size"))


def source_targets(sized: DataFrame, shares: tuple = SHARES, cap: float = CAP) -> DataFrame:
    """``source, rank, source_size, target``: shares by code point order, capped and reshared.

    Sources are ranked by a range sort and one offset per partition. The level
    at which capped targets fill up is found by aggregates over the source
    table; no list of sources reaches the driver.
    """
    spark = sized.sparkSession
    ordered = cut(sized.groupBy("source").agg(F.sum("size").alias("source_size"))
                  .orderBy(F.col("source").asc_nulls_last())
                  .withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    counts = ordered.groupBy(part.alias("part")).count().orderBy("part").collect()  # a row per partition
    offsets, before = [], 0
    for row in counts:
        offsets.append((row["part"], before))
        before += row["count"]
    offset_table = spark.createDataFrame(offsets, "part long, before long")
    ranked = (ordered.withColumn("part", part).join(offset_table, "part")
              .withColumn("rank", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
              .withColumn("share", F.element_at(F.array(*[F.lit(float(s)) for s in shares]),
                                                (F.col("rank") % len(shares) + 1).cast("int"))))
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    level, full = 0.0, -1
    while True:
        is_full = F.col("most") <= F.lit(level) * F.col("share")
        row = ranked.agg(F.sum("source_size").alias("all"),
                         F.sum(F.when(is_full, F.col("most")).otherwise(0.0)).alias("held"),
                         F.sum(F.when(is_full, 0.0).otherwise(F.col("share"))).alias("open"),
                         F.sum(is_full.cast("long")).alias("full")).first()
        if not row["all"] or not row["open"] or row["full"] == full:
            break
        full = row["full"]
        level = (row["all"] - row["held"]) / row["open"]
    return ranked.select("source", "rank", "source_size",
                         F.least(F.col("most"), F.lit(level) * F.col("share")).alias("target"))


def pivotal(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Fractions rounded in order; the index of the one left open, or -1.

    Mass is counted in words, a fraction times its size, so the expected words
    stay what they were; each fraction keeps its expectation.
    """
    out, open_at, a, eps = p.copy(), -1, 0.0, 1e-9
    draws = rng.random(len(p)).tolist()
    sizes = size.tolist()
    for i, b in enumerate(p.tolist()):
        if b <= eps or b >= 1 - eps:
            out[i] = round(b)
            continue
        if open_at < 0:
            open_at, a = i, b
            continue
        s, t = sizes[open_at], sizes[i]
        up = min((1 - a) * s, b * t)     # words that can move to the open one
        down = min(a * s, (1 - b) * t)   # and away from it
        moved = up if draws[i] * (up + down) < down else -down
        a += moved / s
        b -= moved / t
        if eps < b < 1 - eps:            # the open one became integral
            out[open_at], open_at, a = round(a), i, b
        else:
            out[i] = round(b)
            if a <= eps or a >= 1 - eps:
                out[open_at], open_at = round(a), -1
    if open_at >= 0:
        out[open_at] = a
    return out, open_at


def pivotal_with_rest(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """All fractions rounded, large ones first; the other side of a pair is the rest.

    A unit trades words with all smaller ones at once, each by its variance
    p(1 - p), until it or one of them is integral. A large unit can so settle
    without moving the total, and every expectation stays. Only the last
    fraction is drawn on its own.
    """
    order = np.argsort(-size, kind="stable")
    q, s, eps = p[order].astype(float), size[order].astype(float), 1e-9
    for i in range(len(q)):
        while eps < q[i] < 1 - eps:
            rest = np.flatnonzero((q[i + 1:] > eps) & (q[i + 1:] < 1 - eps)) + i + 1
            if not len(rest):
                q[i] = float(rng.random() < q[i])
                break
            v = q[rest] * (1 - q[rest])
            words = float((v * s[rest]).sum())
            up = min((1 - q[i]) * s[i], words / float((1 - q[rest]).max()))
            down = min(q[i] * s[i], words / float(q[rest].max()))
            moved = up if rng.random() * (up + down) < down else -down
            q[i] += moved / s[i]
            q[rest] -= v * (moved / words)
    out = np.empty(len(p))
    out[order] = np.round(q)
    return out


def _round_blocks(rows: DataFrame, level: int, last: bool, seed: int, id_type: str) -> DataFrame:
    """Each block (rank, class, salt) rounded; ``p`` stays between 0 and 1 for the one left."""
    def fold(block: pd.DataFrame) -> pd.DataFrame:
        # large ones first, so that the one left open at the end is small
        block = block.sort_values(["size", "tie"], ascending=False, kind="stable", ignore_index=True)
        key = f"{seed}:{level}:{block['rank'][0]}:{block['class'][0]}:{block['salt'][0]}"
        rng = np.random.default_rng([zlib.crc32(key.encode()), seed])
        p, size = block["p"].to_numpy(float), block["size"].to_numpy(float)
        return block.assign(p=pivotal_with_rest(p, size, rng) if last else pivotal(p, size, rng)[0])

    kept = f"id {id_type}, rank long, size long, tie long, p double, class int, salt long"
    return rows.groupBy("rank", "class", "salt").applyInPandas(fold, kept)


def _tie(id_col: str, text_col: str, seed: int):
    return F.xxhash64(quoted(id_col), F.xxhash64(F.col(quoted(text_col)).cast("string")), F.lit(seed))


def _copies(docs: DataFrame, id_col: str, text_col: str, source_col: str, shares: tuple, cap: float,
            block: int, seed: int) -> DataFrame:
    """``id, tie, size, source_size, target, copies`` of every row."""
    id_type = docs.schema[id_col].dataType.simpleString()
    sized = cut(sized_documents(docs, id_col, text_col, source_col, seed))
    sources = cut(source_targets(sized, shares, cap))
    joined = (sized.join(sources, sized["source"].eqNullSafe(sources["source"]))
              .select("id", "rank", "size", "tie",
                      F.when(F.col("size") > 0, F.col("target") / F.col("source_size"))
                      .otherwise(0.0).alias("copies")))
    rows = joined.select("id", "rank", "size", "tie",
                         (F.col("copies") - F.floor("copies")).alias("p"),
                         # eight classes to a doubling of the size
                         F.floor(8 * F.log2(F.greatest("size", F.lit(1)))).cast("int").alias("class"))
    done, level = [], 0
    while True:
        blocks = rows.groupBy("rank", "class").agg(F.ceil(F.count("*") / block).alias("n"))
        if level:
            rows, blocks = cut(rows), cut(blocks)
        salted = (rows.join(blocks, ["rank", "class"])
                  .withColumn("salt", F.pmod(F.xxhash64("tie", F.lit(level)), F.col("n")))
                  .select("id", "rank", "size", "tie", "p", "class", "salt"))
        most = blocks.agg(F.max("n")).first()[0] if level else None
        last = level > 0 and (most is None or most <= 1)
        rounded = cut(_round_blocks(salted, level, last, seed, id_type))
        if last:
            done.append(rounded)
            break
        is_open = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(rounded.filter(~is_open))
        # residuals of every size class of a source meet at the next level
        rows = rounded.filter(is_open).withColumn("class", F.lit(0)).drop("salt")
        level += 1
    out = done[0].select("id", "tie", "rank", "size", "p")
    for more in done[1:]:
        out = out.unionByName(more.select("id", "tie", "rank", "size", "p"))
    copies = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("source_size")) + F.round("p")).otherwise(0)
    return (out.join(sources, "rank")
            .select("id", "tie", "size", "source_size", "target", copies.cast("long").alias("copies")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        shares: tuple = SHARES, cap: float = CAP, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """``id, size, source_size, target, copies, taken`` of every row; ``taken`` is size times copies.

    A text without words, or a missing one, has size 0 and no copy. Missing
    sources form one source, ranked last. Repeated rows are rounded one by one;
    equal rows are interchangeable. Ids may be missing.
    """
    return (_copies(docs, id_col, text_col, source_col, shares, cap, block, seed)
            .withColumn("taken", F.col("size") * F.col("copies"))
            .withColumnRenamed("id", id_col).drop("tie"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    shares: tuple = SHARES, cap: float = CAP, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    taken = (_copies(docs, id_col, text_col, source_col, shares, cap, block, seed)
             .groupBy(F.col("id").alias("taken_id"), F.col("tie").alias("taken_tie"))
             .agg(F.sum("copies").cast("int").alias("copies")).filter("copies > 0"))
    packed = docs.select(F.struct("*").alias("row"), F.col(quoted(id_col)).alias("row_id"),
                         _tie(id_col, text_col, seed).alias("row_tie"))
    # rows that repeat an id and a text were counted together, so one stands for all
    joined = packed.join(taken, F.col("row_id").eqNullSafe(F.col("taken_id")) &
                         (F.col("row_tie") == F.col("taken_tie"))).dropDuplicates(["row_id", "row_tie"])
    return joined.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
