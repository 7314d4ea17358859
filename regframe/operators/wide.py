"""OLS models with many predictors (L1, L15 for any k).

The fused SQL passes of :mod:`linear` write one expression per pair of
predictors, which is right for a few and hopeless for hundreds. A wide model
takes the same three steps on numpy blocks inside the tasks:

* pass 1 -- every partition folds its complete rows into one centred k x k
  block (:class:`moments.CompleteMoments`), and the blocks merge in a tree;
* driver -- the p x p solve, shared with the narrow models;
* pass 2 -- residuals, leverages (a matrix product instead of k^2 literals),
  SSR and the sandwich meat; cluster-robust scores are vectors per group, added
  up by the group key in Spark, and their outer products fold like pass 1.

All wide models of a battery share both scans, and the numbers equal those of
the narrow path.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sqltext as S
from ..session import ship_package
from . import moments as M


def leverage_column(means: np.ndarray, sinv: np.ndarray, n: int, names: list[str]) -> Column:
    """Leverage of a row as an Arrow-batched function of its predictors."""
    centre, inverse = np.asarray(means, float), np.asarray(sinv, float)

    @F.pandas_udf("double")
    def leverage(rows: pd.Series) -> pd.Series:
        x = np.stack(rows.to_numpy()) - centre if len(rows) else np.empty((0, len(centre)))
        return pd.Series(1.0 / n + ((x @ inverse) * x).sum(axis=1))

    whole = F.array(*[F.col(S.plain(c)).cast("double") for c in names])
    complete = F.expr(" AND ".join(f"{S.q(c)} IS NOT NULL" for c in names))
    return F.when(complete, leverage(F.when(complete, whole).otherwise(F.array(*[F.lit(0.0)] * len(names)))))


def _matrix(data: DataFrame, specs: list) -> tuple[DataFrame, dict[str, list[int]], dict[str, int]]:
    """Every needed column as a double, group columns as text; where each model finds its own."""
    names: list[str] = []
    for s in specs:
        names += [c for c in (s.y, *s.x) if c not in names]
    groups = sorted({s.groups for s in specs if s.groups})
    frame = data.selectExpr(*[f"{M.as_double(c)} AS c{i}" for i, c in enumerate(names)],
                            *[f"CAST({S.q(g)} AS STRING) AS g{i}" for i, g in enumerate(groups)])
    at = {s.model_id: [names.index(c) for c in (s.y, *s.x)] for s in specs}
    group_at = {g: len(names) + i for i, g in enumerate(groups)}
    return frame, at, group_at


def _rows(batch: pa.RecordBatch, at: list[int], group: int | None, log_y: bool):
    """Complete rows ``[y, x...]`` of a model in a batch, with the counts of rows left out and the rows' places."""
    x = M.columns_of(batch, at)
    ok = ~np.isnan(x).any(axis=1)
    no_group = not_positive = 0
    if group is not None:
        there = batch.column(group).is_valid().to_numpy(zero_copy_only=False)
        no_group = int((ok & ~there).sum())
        ok &= there
    if log_y:
        not_positive = int((ok & (x[:, 0] <= 0)).sum())
        ok &= x[:, 0] > 0
    x = x[ok]
    if log_y:
        x[:, 0] = np.log(x[:, 0])
    return x, no_group, not_positive, ok


def fit_wide(data: DataFrame, specs: list, nonpositive: str) -> dict:
    """``model_id -> ModelResult`` of the given specs."""
    from .linear import FULL_LEVERAGE, ModelResult, covariance, solve
    ship_package(data.sparkSession)
    frame, at, group_at = _matrix(data, specs)
    plan = [(at[s.model_id], group_at.get(s.groups), s.log_y) for s in specs]
    first = np.concatenate([[0], np.cumsum([M.n_bands(len(s.x) + 1) for s in specs])])

    def moments(batches):
        held = [M.CompleteMoments(len(cols), 3) for cols, _, _ in plan]
        for batch in batches:
            for state, (cols, group, log_y) in zip(held, plan):
                x, no_group, not_positive, _ = _rows(batch, cols, group, log_y)
                state.add(x)
                state.counts += [batch.num_rows, no_group, not_positive]
        for i, state in enumerate(held):
            for b, blob in enumerate(state.bands()):
                yield int(first[i]) + b, blob

    found = M.fold_partitions(frame, moments, M.merge_bands)
    models = {}
    for i, s in enumerate(specs):
        bands = [found[b] for b in range(first[i], first[i + 1]) if b in found]
        n, counts, mean, cross = M.joined_bands(bands) if bands else (
            0, np.zeros(3), np.zeros(len(s.x) + 1), np.zeros((len(s.x) + 1,) * 2))
        m = models[s.model_id] = ModelResult(spec=s, n=n, n_total=int(counts[0]))
        if s.log_y and counts[2] and nonpositive != "drop":
            m.status = "domain"
        elif counts[1]:
            m.status = "null group"
        elif m.n <= len(s.x) + 1:
            m.status = "insufficient"
        else:
            solve(m, mean, cross)
    live = [(i, s, models[s.model_id]) for i, s in enumerate(specs) if models[s.model_id].status == "ok"]
    if not live:
        return models
    fits = data.sparkSession.sparkContext.broadcast(
        [(plan[i], s.cov, m.n, m.means, m.beta, m.Sinv) for i, s, m in live])

    def residuals(batch, fit):
        (cols, group, log_y), cov, n, means, beta, sinv = fit
        x, _, _, ok = _rows(batch, cols, group, log_y)
        centred = x[:, 1:] - means[1:]
        e = (x[:, 0] - means[0]) - centred @ beta[1:]
        return np.column_stack([np.ones(len(e)), centred]), e, centred, ok

    def meat(batches):
        sums = [[np.zeros(4), np.zeros((len(f[3]),) * 2)] for f in fits.value]
        for batch in batches:
            for state, fit in zip(sums, fits.value):
                z, e, centred, _ = residuals(batch, fit)
                w, full = e * e, 0
                if fit[1] in ("HC2", "HC3"):
                    h = 1.0 / fit[2] + ((centred @ fit[5]) * centred).sum(axis=1)
                    free = 1.0 - h > FULL_LEVERAGE
                    full = int((~free).sum())
                    w = np.where(free, w / np.where(free, 1.0 - h, 1.0) ** (2 if fit[1] == "HC3" else 1), 0.0)
                state[0] += [float(e @ e), float((e ** 3).sum()), float((e ** 4).sum()), full]
                if fit[1] not in ("classical", "cluster"):
                    state[1] += z.T @ (z * w[:, None])
        for i, (head, block) in enumerate(sums):
            yield i, np.concatenate([head, block.ravel()]).tobytes()

    totals = M.fold_partitions(frame, meat, M.sum_blobs)
    for j, (i, s, m) in enumerate(live):
        x = np.frombuffer(totals[j])
        m.ssr, m.extras["sum_e3"], m.extras["sum_e4"] = float(x[0]), float(x[1]), float(x[2])
        if x[3]:
            m.status = "leverage one"
            continue
        block = x[4:].reshape(m.p, m.p)
        if s.cov == "cluster":
            m.n_groups, block = _cluster_meat(frame, residuals, fits, j, plan[i][1], m.p)
        covariance(m, block)
    return models


def _cluster_meat(frame: DataFrame, residuals, fits, j: int, group: int, p: int) -> tuple[int, np.ndarray]:
    """Number of groups, and the sum of the outer products of their scores."""
    def scores(batches):
        for batch in batches:
            z, e, _, ok = residuals(batch, fits.value[j])
            names = batch.column(group).filter(pa.array(ok)).dictionary_encode()
            code = names.indices.to_numpy(zero_copy_only=False)
            u = np.zeros((len(names.dictionary), p))
            np.add.at(u, code, z * e[:, None])
            yield pa.RecordBatch.from_arrays(
                [names.dictionary, pa.FixedSizeListArray.from_arrays(pa.array(u.ravel()), p).cast(pa.list_(pa.float64()))],
                names=["g", "u"])

    by_group = (frame.mapInArrow(scores, "g string, u array<double>").groupBy("g")
                .agg(F.array(*[F.sum(F.col("u")[a]) for a in range(p)]).alias("u")))

    def outer(batches):
        total, n = np.zeros((p, p)), 0.0
        for batch in batches:
            u = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            total, n = total + u.T @ u, n + len(u)
        yield 0, np.concatenate([[n], total.ravel()]).tobytes()

    found = M.fold_partitions(by_group.select("u"), outer, M.sum_blobs)
    x = np.frombuffer(found[0])
    return int(x[0]), x[1:].reshape(p, p)
