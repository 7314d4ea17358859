"""Ops 5 and 10 against brute force."""

import numpy as np
from helpers import vector_classes

from regframe.llm.topk import top_inner_products
from regframe.llm.vector_dedup import _dealt, _nodes, audit_recall, near_duplicate_vectors, recall_of

SCHEMA = "vec_id long, embedding array<float>, label int, node string, score double"


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "n", 0.5) for i, v in rows], SCHEMA)


def _vectors(n=500, groups=6, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16))
    for g in range(groups):  # tight groups, one of them large
        size = 120 if g == 0 else 8
        x[g * 20:g * 20 + size] = rng.normal(size=16) * 3 + rng.normal(size=(len(x[g * 20:g * 20 + size]), 16)) * 0.25
    x[-5:] = x[-10:-5]
    return [(int(i), [float(np.float32(c)) for c in v]) for i, v in zip(rng.permutation(n * 3)[:n], x)]


def test_links_and_components_equal_brute_force(spark):
    rows = _vectors()
    got = {r.vec_id: r for r in near_duplicate_vectors(_frame(spark, rows), shard=100).collect()}
    want = vector_classes([i for i, _ in rows], np.array([v for _, v in rows]))
    found = sum(got[i].n_links for i in got)
    assert found <= sum(n for n, _ in want.values()) and found >= 0.99 * sum(n for n, _ in want.values())
    assert sum(got[i].component_id != want[i][1] for i in want) <= 2
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert all(got[i].n_links <= want[i][0] for i in want)


def test_no_task_holds_a_whole_crowded_cluster(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=16) * 3 + rng.normal(size=(400, 16)) * 0.2, rng.normal(size=(200, 16))])
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    _, nodes = _nodes(_frame(spark, rows), "vec_id", "embedding")
    centres = np.linalg.qr(rng.normal(size=(16, 16)))[0][:4]
    for overlap in (1, 3):
        held = _dealt(nodes, centres, 16, overlap, 20).groupBy("shard").count().collect()
        assert max(r["count"] for r in held) <= 4 * 20 * 1.5  # the blocks are dealt by a hash
    want = vector_classes([i for i, _ in rows], np.array([v for _, v in rows]))
    got = {r.vec_id: r for r in near_duplicate_vectors(_frame(spark, rows), shard=20).collect()}
    assert all(got[i].n_links <= n for i, (n, _) in want.items())
    assert sum(r.n_links for r in got.values()) >= 0.99 * sum(n for n, _ in want.values())
    assert sum(got[i].component_id != want[i][1] for i in want) <= 2


def test_audit_sees_lost_links_of_small_groups(spark):
    assert recall_of([(900, [(0, 0)] * 9), (100, [(1, 2)] * 5), (800, [(500, 500)] * 5)]) == 0.5
    assert recall_of([(900, [(0, 0)] * 9)]) is None and recall_of([(9, [(0, 0)] * 9)]) == 1.0
    assert recall_of([(10, [(0, 3)] * 10)]) == 0.0
    rng = np.random.default_rng(6)
    hub = rng.normal(size=16) * 3 + rng.normal(size=(150, 16)) * 0.1
    pairs = np.repeat(rng.normal(size=(120, 16)), 2, axis=0) + rng.normal(size=(240, 16)) * 0.01
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(np.vstack([hub, pairs]))]
    _, nodes = _nodes(_frame(spark, rows), "vec_id", "embedding")
    want = vector_classes([i for i, _ in rows], np.array([v for _, v in rows]))
    whole = spark.createDataFrame([(i, n) for i, (n, _) in want.items()], "node long, m long")
    lost = spark.createDataFrame([(i, n if i < 150 else 0) for i, (n, _) in want.items()], "node long, m long")
    assert audit_recall(nodes, whole, 16, 0.95) == 1.0 and audit_recall(nodes, lost, 16, 0.95) < 0.5


def test_recall_with_over_a_hundred_clusters(spark):
    rng = np.random.default_rng(7)
    x = np.repeat(rng.normal(size=(700, 16)), 3, axis=0) + rng.normal(size=(2100, 16)) * 0.12
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    want = vector_classes([i for i, _ in rows], x)
    got = {r.vec_id: r for r in near_duplicate_vectors(_frame(spark, rows), shard=20).collect()}  # 105 clusters
    shares = [got[i].n_links / n for i, (n, _) in want.items() if n]
    assert len(shares) > 1000 and sum(shares) / len(shares) >= 0.98
    assert abs(got[0].recall - sum(shares) / len(shares)) < 0.02


def test_odd_vectors_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, [None, 1.0]), (8, []), (9, [1.0, 0.0]), (9, [1.0, 0.0]), (None, [1.0, 0.0]), (10, [-1.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept)
           for r in near_duplicate_vectors(_frame(spark, rows)).collect()}
    assert {i: got[i] for i in (1, 2, 9)} == {1: (2, 1, True), 2: (2, 1, False), 9: (2, 1, False)}
    assert all(got[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 10)) and len(got) == 10
    assert near_duplicate_vectors(_frame(spark, [])).collect() == []
    assert near_duplicate_vectors(_frame(spark, [(1, None)])).collect()[0].component_id == 1


def _brute(rows, k, every):
    ids = np.array([i for i, _ in rows])
    x = np.floor(np.array([v for _, v in rows], float) * 1024).astype(np.int64)
    out = []
    for i, q in zip(ids, x):
        if i % every == 0:
            s = x @ q
            out += [(int(i), r + 1, int(ids[j]), int(s[j]))
                    for r, j in enumerate([j for j in np.lexsort((ids, -s)) if ids[j] != i][:k])]
    return sorted(out)


def test_top_k_equals_brute_force_with_ties(spark):
    rows = _vectors(600, seed=2)
    rows += [(10_000 + i, rows[0][1]) for i in range(40)]  # forty ties
    for block, pivots in ((32, 8), (2048, 64)):
        got = top_inner_products(_frame(spark, rows), k=10, every=20, block=block, n_pivots=pivots).collect()
        assert sorted(tuple(r) for r in got) == _brute(rows, 10, 20)


def test_top_k_of_odd_tables(spark):
    nan = float("nan")
    rows = [(0, [1.0, 2.0]), (100, [0.5, -1.0]), (200, None), (300, [nan, 1.0]), (1, [1.0, 2.0]), (None, [9.0, 9.0]),
            (1, [1.0, 2.0])]
    got = sorted(tuple(r) for r in top_inner_products(_frame(spark, rows)).collect())
    assert got == _brute([(0, [1.0, 2.0]), (100, [0.5, -1.0]), (1, [1.0, 2.0])], 10, 100)
    assert top_inner_products(_frame(spark, [])).collect() == []
    assert top_inner_products(_frame(spark, [(7, [1.0])])).collect() == []
    big = [(0, [3e15, 1.0]), (1, [3e15, 2.0])]
    assert len(top_inner_products(_frame(spark, big[:1])).collect()) == 0


def test_queries_visit_few_annuli_of_clustered_vectors(spark):
    """Bounds prune before any vector moves, and no annulus above a k-th score is left out."""
    from regframe.llm import topk
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(30, 8)) * 4
    x = centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 8)) * 0.05
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    table = _frame(spark, rows)
    seen = []
    real = topk.surviving_visits

    def counted(*args):
        out = real(*args)
        seen.append((out.count(), args[1].count()))
        return out

    topk.surviving_visits = counted
    try:
        got = top_inner_products(table, k=5, every=50, block=32, n_pivots=30).collect()
    finally:
        topk.surviving_visits = real
    (visits, annuli), = seen
    assert sorted(tuple(r) for r in got) == _brute(rows, 5, 50)
    assert annuli > 60 and visits < 0.4 * 60 * annuli


def test_crowded_annuli_are_met_in_parts(spark, monkeypatch):
    monkeypatch.setattr("regframe.llm.topk.VISITORS", 7)
    rows = _vectors(400, seed=9)
    got = top_inner_products(_frame(spark, rows), k=10, every=4, block=64, n_pivots=4).collect()
    assert sorted(tuple(r) for r in got) == _brute(rows, 10, 4)


def test_vectors_of_extreme_length(spark):
    """Squares that over- or underflow change no cosine."""
    rows = [(1, [1e-200, 2e-200]), (2, [1.0, 0.01]), (3, [1e200, 2e200]), (4, [2e200, 4e200]), (5, [5e-324, 0.0]), (6, [1e308, 1e308]),
            (7, [1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicate_vectors(table).collect()}
    assert got == {1: (2, 1), 3: (2, 1), 4: (2, 1), 2: (1, 2), 5: (1, 2), 6: (1, 6), 7: (1, 6)}


def test_a_table_without_links_is_dealt_once(spark, monkeypatch):
    from regframe.llm import vector_dedup
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 24))
    turns = []
    real = vector_dedup._linked
    monkeypatch.setattr(vector_dedup, "_linked", lambda *a: turns.append(a[3]) or real(*a))
    monkeypatch.setattr(vector_dedup, "AUDIT", 32)
    got = near_duplicate_vectors(_frame(spark, [(i, [float(c) for c in v]) for i, v in enumerate(x)]), shard=64).collect()
    assert turns == [3] and all(r.n_links == 0 and r.kept for r in got)
