"""Exact top-k inner products over a pivot-distance index.

A further component turns the largest inner product into the smallest
distance: with M the longest vector, x' = (x, sqrt(M^2 - |x|^2)) and
q' = (q, 0) give d(q', x')^2 = |q|^2 + M^2 - 2 q.x. Every vector is keyed by
its nearest pivot and its distance from it, and each pivot's vectors lie in
sorted annuli of at most about ``BLOCK`` rows; the pivots come from a bounded
sample, every vector is indexed.

A query first reads the annuli around its own distance from its nearest
pivots, as many as hold k vectors; that gives a k-th score. An annulus with distances r1..r2 from pivot p
holds nothing nearer than max(d(q, p) - r2, r1 - d(q, p), 0), so of each
pivot's annuli only those can hold a score as high as the k-th that meet an
interval of distances around d(q, p). These intervals are joined with a table
of the annuli's bounds, without any vector; then the queries that are left
travel to their annuli, each of which is read once for some thousand queries.
Scores are integers, the bounds allow for rounding, and so results are exact
with all ties.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SEED, cut, first_by_hash
from .vectors import matrix, pack, valid_vectors

SCALE = 1024
BLOCK = 2048
VISITORS = 4096       # queries that meet an annulus in one task, about
SAMPLE = 4096         # vectors that the pivots are chosen from, at most
PIVOTS = 64
NEAREST = 3           # pivots whose annuli a query reads first
_SLACK = 1e-6


def whole(vec: np.ndarray) -> np.ndarray:
    """Components as integers, held in doubles."""
    return np.floor(vec * SCALE)


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first picks from a bounded sample."""
    if not len(sample):
        return sample
    picked = [0]
    far = ((sample - sample[0]) ** 2).sum(1)
    while len(picked) < min(n, len(sample)) and far.max() > 0:
        picked.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[picked[-1]]) ** 2).sum(1))
    return sample[picked]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    sq = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(sq, 0))


def _lifted(x: np.ndarray, longest: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(longest - (x * x).sum(1), 0))])


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products of whole-numbered doubles."""
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)), np.int64)
    most = float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1]
    if most < 2 ** 53:
        return (q @ x.T).astype(np.int64)
    return np.array([[sum(int(a) * int(b) for a, b in zip(r, s)) for s in x] for r in q], object)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def build_index(rows: DataFrame, pivots: np.ndarray, width: int, longest: float, block: int) -> tuple[DataFrame, list]:
    """``block, pivot, ring, n, r1, r2, ids, vecs``: one row an annulus, of at most about ``block`` vectors.

    Beside it, for each pivot with vectors: ``pivot, low, high, step``, the least
    and largest distance and the width of its rings.
    """
    def key(batches):
        for b in batches:
            x = whole(matrix(b.column(1), width))
            d = _distances(_lifted(x, longest), pivots)
            near = d.argmin(1) if len(x) else np.empty(0, int)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(near, pa.int32()),
                 pa.array(d[np.arange(len(x)), near], pa.float64())], names=["id", "vec", "pivot", "r"])

    keyed = cut(rows.mapInArrow(key, "id long, vec array<double>, pivot int, r double"))
    # annuli hold about equal numbers: a sketch of each pivot's distances, then salt where values repeat
    shares = (keyed.groupBy("pivot").agg(F.count("*").alias("n"), F.min("r").alias("low"), F.max("r").alias("high")))
    rings = F.greatest(F.ceil(F.col("n") / block), F.lit(1))
    step = F.greatest((F.col("high") - F.col("low")) / rings, F.lit(1e-9))
    shares = cut(shares.select("pivot", "low", "high", step.alias("step")))  # a row a pivot
    ringed = keyed.join(shares, "pivot").withColumn("ring", F.floor((F.col("r") - F.col("low")) / F.col("step")).cast("long"))
    crowd = ringed.groupBy("pivot", "ring").agg(F.ceil(F.count("*") / block).alias("salts"))
    dealt = (ringed.join(crowd, ["pivot", "ring"])
             .withColumn("salt", F.pmod(F.xxhash64("id", F.lit(SEED)), F.col("salts")))
             .select("id", "vec", "pivot", "r", "ring", "salt",
                     F.concat_ws("-", "pivot", "ring", "salt").alias("block")))

    def gather(table: pa.Table) -> pa.Table:
        r = table.column("r").to_numpy()
        order = np.argsort(r, kind="stable")
        x = whole(matrix(table.column("vec"), width))[order]
        return pa.table({
            "block": table.column("block").slice(0, 1), "pivot": table.column("pivot").slice(0, 1),
            "ring": table.column("ring").slice(0, 1), "n": pa.array([len(order)], pa.int64()),
            "r1": pa.array([r.min()]), "r2": pa.array([r.max()]),
            "ids": pa.array([pack(table.column("id").to_numpy()[order])], pa.binary()),
            "vecs": pa.array([pack(x)], pa.binary())})

    index = cut(dealt.groupBy("block").applyInArrow(
        gather, "block string, pivot int, ring long, n long, r1 double, r2 double, ids binary, vecs binary"))
    return index, [tuple(r) for r in shares.orderBy("pivot").collect()]


def _homes(queries: DataFrame, rings: DataFrame, shares: list, pivots: np.ndarray, width: int, k: int) -> DataFrame:
    """``id, vec, block``: each query and the annuli next to it about its nearest pivots, k vectors or more."""
    used = pivots[[p for p, *_ in shares]]
    take = min(NEAREST, len(used))

    def place(batches):
        for b in batches:
            q = whole(matrix(b.column(1), width))
            d = _distances(np.column_stack([q, np.zeros(len(q))]), used)
            near = np.argsort(d, axis=1, kind="stable")[:, :take].ravel()
            row = np.repeat(np.arange(len(q)), take)
            own = d[row, near]
            at = np.array(shares, float).reshape(-1, 4)[near]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(at[:, 0].astype(np.int32)), pa.array(own),
                 pa.array(np.floor((np.clip(own, at[:, 1], at[:, 2]) - at[:, 1]) / at[:, 3]).astype(np.int64))],
                names=["id", "vec", "pivot", "d", "near"])

    placed = cut(queries.mapInArrow(place, "id long, vec array<double>, pivot int, d double, near long"))
    gap = F.greatest(F.col("d") - F.col("r2"), F.col("r1") - F.col("d"), F.lit(0.0)).alias("gap")
    # the rings about its own; only a query among empty rings looks at all of its pivots'
    around = (placed.select("id", "pivot", "d", F.explode(F.sequence(F.col("near") - 2, F.col("near") + 2)).alias("ring"))
              .join(rings, ["pivot", "ring"]).select("id", "block", "n", gap))
    others = placed.join(around, "id", "left_anti").join(rings, "pivot").select("id", "block", "n", gap)
    before = Window.partitionBy("id").orderBy("gap", "block").rowsBetween(Window.unboundedPreceding, -1)
    chosen = (around.unionByName(others).withColumn("held", F.coalesce(F.sum("n").over(before), F.lit(0)))
              .filter(F.col("held") <= k).select(F.col("id").alias("query"), "block"))  # k and the query itself
    return (placed.dropDuplicates(["id"]).select("id", "vec").join(chosen, F.col("id") == F.col("query"))
            .select("id", "vec", "block"))


def surviving_visits(queries: DataFrame, rings: DataFrame, shares: list, pivots: np.ndarray, width: int,
                     longest: float) -> DataFrame:
    """``id, vec, least, block``: the annuli that can hold a score of at least ``least`` with a query."""
    used = pivots[[p for p, *_ in shares]]
    at = np.array(shares, float).reshape(-1, 4)

    def reach(batches):
        for b in batches:
            q, least = whole(matrix(b.column(1), width)), b.column(2).to_numpy(zero_copy_only=False)
            sq = (q * q).sum(1)
            d = _distances(np.column_stack([q, np.zeros(len(q))]), used)
            # a score s lies at the squared distance sq + longest - 2 s
            square = sq + longest - 2 * (least - _SLACK * (1 + sq + longest) - 1)
            far = np.sqrt(np.maximum(square, 0))[:, None] + _SLACK * (1 + at[:, 2])
            low, high = np.maximum(d - far, at[:, 1]), np.minimum(d + far, at[:, 2])
            row, pivot = np.nonzero((low <= high) & (square >= 0)[:, None])
            low, high, start, step = low[row, pivot], high[row, pivot], at[pivot, 1], at[pivot, 3]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(least[row]),
                 pa.array(at[pivot, 0].astype(np.int32)), pa.array(low), pa.array(high),
                 pa.array(np.floor((low - start) / step).astype(np.int64) - 1),
                 pa.array(np.floor((high - start) / step).astype(np.int64) + 1)],
                names=["id", "vec", "least", "pivot", "low", "high", "first", "last"])

    reached = queries.mapInArrow(reach, "id long, vec array<double>, least double, pivot int, low double, high double, "
                                        "first long, last long")
    return (reached.withColumn("ring", F.explode(F.sequence("first", "last"))).join(rings, ["pivot", "ring"])
            .filter((F.col("r2") >= F.col("low")) & (F.col("r1") <= F.col("high")))
            .select("id", "vec", "least", "block"))


def _met(visits: DataFrame, index: DataFrame, width: int, k: int) -> DataFrame:
    """``query_id, vec_id, score``: the k best of each visit ``id, vec, least, block`` with a score of at least ``least``.

    An annulus that more than ``VISITORS`` queries visit is met in parts of them.
    """
    visits = cut(visits.select("id", "vec", "least", F.col("block").alias("place")))
    parts = visits.groupBy("place").agg(F.ceil(F.count("*") / VISITORS).cast("long").alias("parts"))
    left = (visits.join(parts, "place").withColumn("part", F.pmod(F.xxhash64("id", F.lit(SEED)), F.col("parts")))
            .select(F.col("place").alias("block"), "part", "id", "vec", "least"))
    right = (index.join(parts, F.col("block") == F.col("place")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
             .select("block", "part", "ids", "vecs"))

    def meet(queries: pa.Table, annulus: pa.Table) -> pa.Table:
        out_q, out_id, out_score = [], [], []
        if queries.num_rows and annulus.num_rows:
            ids = queries["id"].to_numpy()
            q, least = whole(matrix(queries["vec"], width)), queries["least"].to_numpy()
            rows = np.frombuffer(annulus["ids"][0].as_py(), np.int64)
            x = np.frombuffer(annulus["vecs"][0].as_py(), np.float64).reshape(len(rows), width)
            for lo in range(0, len(ids), 256):
                for i, own in enumerate(products(q[lo:lo + 256], x), lo):
                    ok = np.flatnonzero((own >= least[i]) & (rows != ids[i]))
                    top = ok[_best(own[ok], rows[ok], k)]
                    out_q += [int(ids[i])] * len(top)
                    out_id += rows[top].tolist()
                    out_score += [int(v) for v in own[top]]
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_id, pa.int64()),
                         "score": pa.array(out_score, pa.int64())})

    return (left.groupBy("block", "part").cogroup(right.groupBy("block", "part"))
            .applyInArrow(meet, "query_id long, vec_id long, score long"))


def top_inner_products(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10,
                       every: int = 100, block: int = BLOCK, n_pivots: int = PIVOTS) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k highest integer inner products of each query.

    Queries are the rows whose id is divisible by ``every``; candidates are all
    rows but the query's own. Missing vectors and those with missing or
    non-finite components take no part, nor do rows without an id; of rows that
    repeat an id the smallest vector does. Vectors of unequal length are
    compared as if filled with zeros. An empty table gives no rows.
    """
    spark = table.sparkSession
    rows = cut(valid_vectors(table, id_col, vec_col))
    squares = F.aggregate("vec", F.lit(0.0), lambda acc, v: acc + F.pow(F.floor(v * SCALE).cast("double"), F.lit(2.0)))
    stats = rows.agg(F.max(F.size("vec")).alias("width"), F.max(squares).alias("longest"),
                     F.count("*").alias("n"), F.sum((F.col("id") % every == 0).cast("long")).alias("q")).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not stats["n"] or not stats["q"]:
        return spark.createDataFrame([], schema)
    width, longest = stats["width"], float(stats["longest"])
    sample = first_by_hash(rows, SAMPLE, stats["n"], SEED, "id").collect()  # a documented bound
    picked = np.zeros((len(sample), width))
    for i, row in enumerate(sample):
        picked[i, :len(row["vec"])] = row["vec"]
    pivots = choose_pivots(_lifted(whole(picked), longest), n_pivots)
    index, shares = build_index(rows, pivots, width, longest, block)
    rings = index.select("pivot", "ring", "n", "block", "r1", "r2")
    queries = rows.filter(F.col("id") % every == 0).select("id", "vec")

    home = cut(_homes(queries, rings, shares, pivots, width, k)
               .select("id", "vec", F.lit(float("-inf")).alias("least"), "block"))
    first = cut(_met(home, index, width, k))
    known = (first.groupBy("query_id").agg(F.get(F.sort_array(F.collect_list("score"), False), F.lit(k - 1)).alias("low"))
             .select(F.col("query_id").alias("id"), F.col("low").cast("double").alias("low")))  # k scores a visit at most
    bounded = (queries.join(known, "id", "left")
               .select("id", "vec", F.coalesce("low", F.lit(float("-inf"))).alias("least")))
    others = (surviving_visits(bounded, rings, shares, pivots, width, longest)
              .join(home.select("id", "block"), ["id", "block"], "left_anti"))
    found = first.unionByName(_met(others, index, width, k))
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
