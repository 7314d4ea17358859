"""Near-duplicate vectors by range search on robust-pruned flat graphs.

Equal vectors are one node. Nodes are dealt to the shards of their ``overlap``
nearest centroids. A cluster of more than ``4 * shard`` nodes is cut into blocks
of about ``2 * shard``, home nodes apart from visitors, and each pair of blocks
that holds home nodes is a shard, so no task holds more than about ``4 * shard``
vectors. Each shard builds a graph: the nearest nodes of a node, pruned so that a neighbour stays
only if no kept one is much nearer to it. The adjacency lists that a node got
in its shards are united. Then each node searches the united graph of every
shard that it belongs to: a greedy search from the shard's medoid, then a range
expansion through all nodes near the threshold. Every pair that is counted is
verified by its cosine in double precision.

A node counts links only to the home nodes of a shard, and each node has one
home, so counts add up over shards and no pair is ever emitted. Links join
components inside the task; one row a node leaves it.

The centroids are fitted on a bounded sample; all vectors are indexed. The
recall is audited against brute force over all vectors: ``AUDIT`` queries of the
nodes with few, with many and with no found links each, and more of the last
until ``AUDIT`` audited nodes have links or ``AUDIT_MOST`` are drawn. It is the
mean over nodes with links of the share found, copies once, and no higher than
the mean among those with few or with many. The overlap grows until it reaches
``RECALL``. It is NULL if no audited node has links and not all were drawn; then
nothing speaks for lost links, and the overlap stays.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SEED, cut, first_by_hash, quoted
from .components import components
from .vectors import is_valid, matrix

THRESHOLD = 0.95
SAMPLE = 20_000       # vectors that the centroids are fitted on, at most
MAX_CENTRES = 1024    # centroids, at most; beyond it clusters are cut into blocks
SHARD = 4096          # home vectors of a cluster, about
OVERLAP = 3           # nearest clusters that a vector is dealt to at first
DEGREE = 24           # neighbours of a node in a shard's graph, at most
ALPHA = 1.2           # how much nearer a kept neighbour must be to replace one
BEAM = 16
MARGIN = 0.05         # the range expansion passes through nodes this far below the threshold
AUDIT = 256           # queries of the recall audit from each stratum of nodes, at first
AUDIT_MOST = 4096     # queries among the nodes without found links, at most
MANY = 8              # found links from which a node counts as one with many
RECALL = 0.99


def fit_centroids(sample: np.ndarray, n: int, turns: int = 8) -> np.ndarray:
    """Spherical k-means on a bounded sample of unit vectors."""
    if len(sample) <= n:
        return np.unique(sample, axis=0)
    rng = np.random.default_rng(SEED)
    centres = sample[rng.choice(len(sample), n, replace=False)]
    for _ in range(turns):
        near = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        norms = np.linalg.norm(sums, axis=1)
        centres = np.where(norms[:, None] > 0, sums / np.maximum(norms, 1e-300)[:, None], centres)
    return centres


def pruned_graph(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[np.ndarray]:
    """For each unit vector, by position: its robustly pruned neighbours, and the nodes that kept it."""
    n, pool = len(x), min(len(x) - 1, 3 * degree)
    if n < 2:
        return [np.empty(0, np.int64)] * n
    out: list[np.ndarray] = []
    for lo in range(0, n, 256):
        sims = x[lo:lo + 256] @ x.T
        sims[np.arange(len(sims)), np.arange(lo, lo + len(sims))] = -np.inf
        near = np.argpartition(-sims, pool - 1, axis=1)[:, :pool]
        for i in range(len(sims)):
            cand = near[i][np.argsort(-sims[i, near[i]], kind="stable")]
            to_self = np.sqrt(np.maximum(2 - 2 * sims[i, cand], 0))
            between = np.sqrt(np.maximum(2 - 2 * (x[cand] @ x[cand].T), 0))
            alive = np.ones(len(cand), bool)
            kept = []
            for j in range(len(cand)):
                if alive[j]:
                    kept.append(j)
                    if len(kept) == degree:
                        break
                    alive &= alpha * between[j] > to_self
            out.append(cand[kept])
    # edges count in both directions, so that no node is without a way to it
    tail = np.repeat(np.arange(n), [len(o) for o in out])
    head = np.concatenate(out)
    both = np.unique(np.concatenate([tail * n + head, head * n + tail]))
    return np.split(both % n, np.searchsorted(both // n, np.arange(1, n)))


def range_search(x: np.ndarray, graph: list, start: int, own: int, threshold: float, beam: int = BEAM,
                 margin: float = MARGIN) -> np.ndarray:
    """Positions whose cosine with node ``own`` reaches the threshold, itself left out.

    The greedy search goes from the medoid towards the node; from the best
    nodes that it meets, and from the node's own place in the graph, the
    expansion follows every edge to nodes above the threshold less the margin.
    """
    q = x[own]
    seen = np.zeros(len(x), bool)
    seen[start] = True
    front = [(float(x[start] @ q), start)]
    best = list(front)
    while front:
        front.sort()
        sim, node = front.pop()
        if len(best) >= beam and sim < min(best)[0]:
            break
        fresh = graph[node][~seen[graph[node]]]
        if len(fresh):
            seen[fresh] = True
            sims = x[fresh] @ q
            found = list(zip(sims.tolist(), fresh.tolist()))
            best = sorted(best + found)[-beam:]
            front = [f for f in front + found if f >= best[0]]
        if best[-1][0] >= threshold - margin:
            break  # the range is reached
    wide = np.array(sorted({own, *(i for s, i in best if s >= threshold - margin)}), np.int64)
    inside = np.zeros(len(x), bool)
    inside[wide] = True
    while len(wide):
        near = np.unique(np.concatenate([graph[i] for i in wide.tolist()]))
        near = near[~inside[near]]
        wide = near[x[near] @ q >= threshold - margin] if len(near) else near
        inside[wide] = True
    found = np.flatnonzero(inside)
    found = found[found != own]
    return found[x[found] @ q >= threshold]


def _unit(v: np.ndarray) -> np.ndarray:
    """Vectors of length 1; the largest component goes first, so that no square over- or underflows."""
    v = v / np.abs(v).max(axis=1, initial=0.0)[:, None]
    return v / np.linalg.norm(v, axis=1)[:, None]


def _nodes(table: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """All ids with their node or NULL, and the distinct valid vectors ``node, vec, copies``."""
    vec = F.col(quoted(vec_col)).cast("array<double>")
    valid = is_valid(vec) & F.coalesce(F.exists(vec, lambda x: x != 0), F.lit(False))
    rows = cut(table.filter(F.col(quoted(id_col)).isNotNull())
               .groupBy(F.col(quoted(id_col)).cast("long").alias("id")).agg(F.min(F.when(valid, vec)).alias("vec")))
    nodes = rows.filter("vec is not null").groupBy("vec").agg(F.min("id").alias("node"), F.count("*").alias("copies"))
    nodes = cut(nodes)
    named = rows.join(nodes.select("vec", "node"), "vec", "left").select("id", "node")
    return named, nodes


def _dealt(nodes: DataFrame, centres: np.ndarray, width: int, overlap: int, shard: int) -> DataFrame:
    """``shard, node, vec, copies, home, block, own``: every node in the shards of its nearest clusters.

    ``own`` marks shards of a single block; in the others only links between
    the two blocks count, so that each pair counts once.
    """
    take = min(overlap, len(centres))

    def near(batches):
        for b in batches:
            x = _unit(matrix(b.column(1), width))
            order = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :take]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(list(order.astype(np.int32)), pa.list_(pa.int32()))],
                names=["node", "vec", "copies", "near"])

    placed = nodes.select("node", "vec", "copies").mapInArrow(
        near, "node long, vec array<double>, copies long, near array<int>")
    rows = placed.select("node", "vec", "copies", F.posexplode("near").alias("place", "cluster"))
    rows = rows.withColumn("home", F.col("place") == 0)
    blocks = (rows.groupBy("cluster").agg(F.count_if("home").alias("h"), F.count_if(~F.col("home")).alias("v"))
              .filter("h > 0")  # without home nodes nothing counts there
              .select("cluster", (F.col("h") + F.col("v") <= 4 * shard).alias("small"),
                      F.ceil(F.col("h") / (2 * shard)).cast("int").alias("h"),
                      F.ceil(F.col("v") / (2 * shard)).cast("int").alias("v"))
              .select("cluster", "small", F.when(F.col("small"), 1).otherwise(F.col("h")).alias("h"),
                      F.when(F.col("small"), 0).otherwise(F.col("v")).alias("v")))
    rows = rows.join(F.broadcast(blocks), "cluster")  # one row a cluster
    hashed = F.xxhash64("node", F.lit(SEED))
    # blocks of home nodes are 0, 1, ..., and those of visitors -1, -2, ...
    rows = rows.withColumn("block", F.when(F.col("home") | F.col("small"), F.pmod(hashed, F.col("h")))
                           .otherwise(-1 - F.pmod(hashed, F.greatest("v", F.lit(1)))).cast("int"))
    homes, visitors = F.sequence(F.lit(0), F.col("h") - 1), F.col("v") > 0
    others = F.when((F.col("block") >= 0) & visitors, F.concat(homes, F.sequence(-F.col("v"), F.lit(-1)))).otherwise(homes)
    return (rows.withColumn("other", F.explode(others))
            .select(F.concat_ws(":", "cluster", F.greatest("block", "other"), F.least("block", "other")).alias("shard"),
                    "node", "vec", "copies", "home", "block", (F.col("block") == F.col("other")).alias("own")))


def _linked(nodes: DataFrame, centres: np.ndarray, width: int, overlap: int, shard: int,
            threshold: float) -> DataFrame:
    """``node, n, m, other``: links and linked nodes of each shard, and a node of the same component there."""
    dealt = cut(_dealt(nodes, centres, width, overlap, shard))

    def build(t: pa.Table) -> pa.Table:
        ids = t.column("node").to_numpy()
        graph = pruned_graph(_unit(matrix(t.column("vec"), width)))
        return pa.table({"node": t.column("node"), "edges": pa.array([ids[g] for g in graph], pa.list_(pa.int64()))})

    edges = (dealt.filter("own").groupBy("shard").applyInArrow(build, "node long, edges array<long>")
             .groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("edges"))).alias("edges")))
    united = dealt.join(edges, "node")

    def search(t: pa.Table) -> pa.Table:
        ids, copies = t.column("node").to_numpy(), t.column("copies").to_numpy()
        home = t.column("home").to_numpy(zero_copy_only=False)
        x = _unit(matrix(t.column("vec"), width))
        order = np.argsort(ids)
        graph = []
        for row in t.column("edges").combine_chunks():
            there = row.values.to_numpy()
            at = np.minimum(np.searchsorted(ids[order], there), len(ids) - 1)
            at = order[at]
            graph.append(at[ids[at] == there])
        block = t.column("block").to_numpy()
        own = t.column("own")[0].as_py()
        if not own:  # the united edges lie within blocks; those between two come from a graph of both
            graph = [np.union1d(a, b) for a, b in zip(graph, pruned_graph(x))]
        medoid = int((x @ x.mean(0)).argmax())
        root = list(range(len(ids)))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        n, m = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for i in range(len(ids)):
            found = range_search(x, graph, medoid, i, threshold)
            counts = found[home[found] & (own | (block[found] != block[i]))]
            n[i], m[i] = int(copies[counts].sum()), len(counts)
            for j in found.tolist():
                a, b = top(i), top(j)
                if a != b:
                    low, high = (a, b) if ids[a] < ids[b] else (b, a)
                    root[high] = low
        return pa.table({"node": t.column("node"), "n": pa.array(n), "m": pa.array(m),
                         "other": pa.array([int(ids[top(i)]) for i in range(len(ids))], pa.int64())})

    return cut(united.groupBy("shard").applyInArrow(search, "node long, n long, m long, other long"))


def _there(nodes: DataFrame, sample: list, width: int, threshold: float) -> dict[int, int]:
    """Distinct nodes linked to each sampled one, by brute force over all vectors."""
    q = np.zeros((len(sample), width))
    for i, row in enumerate(sample):
        q[i, :len(row["vec"])] = row["vec"]
    q, ids = _unit(q), np.array([r["node"] for r in sample], np.int64)

    def brute(batches):
        total = np.zeros(len(ids), np.int64)
        for b in batches:
            x, own = _unit(matrix(b.column(1), width)), b.column(0).to_numpy()
            for lo in range(0, len(ids), 256):
                hit = (q[lo:lo + 256] @ x.T >= threshold) & (ids[lo:lo + 256, None] != own[None, :])
                total[lo:lo + 256] += hit.sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["node", "there"])

    rows = (nodes.select("node", "vec").mapInArrow(brute, "node long, there long")
            .groupBy("node").agg(F.sum("there").alias("there")).collect())
    return {r["node"]: r["there"] for r in rows}


def recall_of(strata: list[tuple[int, list[tuple[int, int]]]]) -> float | None:
    """Mean share of found links from the size of each stratum and ``found, there`` of its audited nodes.

    A stratum counts by the nodes with links that its sample stands for. The
    first holds the nodes without found links; no other's mean may be lower
    than the result. None if no audited node has links and some were not audited.
    """
    shares, weights, means = [], [], [1.0]
    for k, (size, audited) in enumerate(strata):
        linked = [min(1.0, found / there) for found, there in audited if there]
        if linked:
            shares.append(sum(linked) / len(linked))
            weights.append(size * len(linked) / len(audited))
            means += shares[-1:] if k else []
    if not shares:
        return 1.0 if all(len(audited) >= size for size, audited in strata) else None
    return min(sum(s * w for s, w in zip(shares, weights)) / sum(weights), *means)


def audit_recall(nodes: DataFrame, counted: DataFrame, width: int, threshold: float,
                 n_queries: int = AUDIT, most: int = AUDIT_MOST) -> float | None:
    """The recall of the module's text, of links found in ``counted``, whose ``m`` is without copies."""
    known = cut(nodes.select("node", "vec").join(counted.select("node", "m"), "node", "left")
                .select("node", "vec", F.coalesce("m", F.lit(0)).alias("m")))
    strata, linked = [], 0
    for k, part in reversed(list(enumerate(("m = 0", f"m between 1 and {MANY - 1}", f"m >= {MANY}")))):
        own = known.filter(part)
        size, take = own.count(), n_queries
        while True:
            sample = first_by_hash(own, take, size, SEED + 1, "node").collect()  # bounded by most
            there = _there(nodes, sample, width, threshold) if sample else {}
            audited = [(r["m"], there.get(r["node"], 0)) for r in sample]
            enough = linked + sum(t > 0 for _, t in audited) >= n_queries
            if k or enough or take >= min(most, size):
                break
            take = min(4 * take, most)
        linked += sum(t > 0 for _, t in audited)
        strata.append((size, audited))
    return recall_of(strata[::-1])


def near_duplicate_vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                           threshold: float = THRESHOLD, shard: int = SHARD) -> DataFrame:
    """``id, n_links, component_id, kept, recall`` of every id.

    Missing, zero, and non-finite vectors link with nothing and are their own
    component. Rows that repeat an id are one vector, the smallest valid one;
    rows without an id are left out. Vectors of unequal length are compared as
    if filled with zeros. Other columns are not read.
    """
    named, nodes = _nodes(table, id_col, vec_col)
    stats = nodes.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("width")).first()
    recall = 1.0
    if stats["n"]:
        n, width = stats["n"], stats["width"]
        rows = first_by_hash(nodes, SAMPLE, n, SEED, "node").collect()  # a documented bound
        sample = np.zeros((len(rows), width))
        for i, row in enumerate(rows):
            sample[i, :len(row["vec"])] = row["vec"]
        centres = fit_centroids(_unit(sample), max(1, min(MAX_CENTRES, math.ceil(n / shard))))
        overlap = min(OVERLAP, len(centres))
        while True:
            links = _linked(nodes, centres, width, overlap, shard, threshold)
            counted = links.groupBy("node").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
            recall = audit_recall(nodes, counted, width, threshold)
            if recall is None or recall >= RECALL or overlap >= len(centres):
                break
            overlap = min(2 * overlap, len(centres))
        part = components(links.filter("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
        known = (nodes.select("node", "copies").join(counted, "node").join(part, "node", "left")
                 .select("node", (F.col("n") + F.col("copies") - 1).alias("n_links"),
                         F.coalesce("component", "node").alias("component_id")))
        named = named.join(known, "node", "left")
    else:
        named = named.withColumn("n_links", F.lit(0).cast("long")).withColumn("component_id", F.col("id"))
    component = F.coalesce("component_id", "id")
    return named.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                        component.alias("component_id"), (F.col("id") == component).alias("kept"),
                        F.lit(recall).cast("double").alias("recall"))
