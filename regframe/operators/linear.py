"""Ordinary least squares as Spark aggregation.

How a fit runs
--------------
* pass 1 -- ONE ``agg`` over the (persisted, column-pruned) input gives, for
  every model of the battery at once, ``n``, the means and the centred
  cross-products (Spark's ``covar_samp`` / ``var_samp`` merge co-moments
  stably, so no ``sum(x^2) - n*mean^2`` cancellation);
* driver -- solves the p x p system per model (numpy), checks conditioning;
* pass 2 -- ONE ``agg`` with the coefficients and the inverse moment matrix
  as literals: residual ``e``, leverage ``h`` (a quadratic form in literals),
  SSR and the sandwich "meat" for HC0/HC1/HC2/HC3;
* cluster-robust errors -- per-group scores (``sum(e*x)``, combined
  map-side, so a hot group costs nothing extra) and one ``agg`` of their
  outer products; the first group column shares pass 2's scan (pass-2 sums
  are summed per group, then over groups), so a clustered battery reads its
  sample twice, not three times.

Models of more than ``SQL_WIDTH`` predictors take the same steps on numpy
blocks inside the tasks (:mod:`wide`), because SQL text per pair of predictors
does not scale to hundreds.

Only O(p^2) numbers per model ever reach the driver. Listwise deletion is
per model (``sample="per_model"``, the default, as statsmodels'
``missing="drop"``) or one common complete-case sample for the whole battery
(``sample="common"``). NULL and NaN both count as missing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import sqltext as S
from ..functions.tail_columns import f_p, normal_p
from ..functions.tails import Z975

COND_LIMIT = 1e12
SQL_WIDTH = 8                 # predictors up to which a model is one of the fused SQL passes
FULL_LEVERAGE = 1e-10         # 1 - h at or below this: the row fits itself exactly


@dataclass
class ModelSpec:
    model_id: str
    y: str
    x: list[str]
    cov: str = "HC3"              # HC0 | HC1 | HC2 | HC3 | classical | cluster
    groups: str | None = None     # group column for cov="cluster"
    log_y: bool = False           # regress ln(y) (rows with y <= 0 -> status "domain")

    @property
    def cols(self) -> list[str]:
        return [self.y, *self.x] + ([self.groups] if self.groups else [])


@dataclass
class ModelResult:
    spec: ModelSpec
    status: str = "ok"
    n: int = 0
    n_total: int = 0
    means: np.ndarray | None = None        # [mean_y, mean_x...]
    S: np.ndarray | None = None            # centred X'X (k x k)
    Sinv: np.ndarray | None = None
    syy: float = float("nan")
    beta: np.ndarray | None = None         # [const, b...]
    cov: np.ndarray | None = None          # p x p, original parametrisation
    ssr: float = float("nan")
    n_groups: int | None = None
    cond: float = float("nan")
    extras: dict = field(default_factory=dict)

    @property
    def k(self) -> int:
        return len(self.spec.x)

    @property
    def p(self) -> int:
        return self.k + 1

    @property
    def terms(self) -> list[str]:
        return ["const", *self.spec.x]

    # ---- expressions built from the fitted numbers (L11, N1, N2) ----
    def fitted_sql(self) -> str:
        return S.linear(self.beta[0], self.beta[1:], [S.q(x) for x in self.spec.x])

    def resid_sql(self) -> str:
        return f"({_ysql(self.spec)} - {self.fitted_sql()})"

    def leverage_sql(self) -> str:
        """SQL text of k^2 terms, for models of few predictors."""
        xc = [f"({S.q(x)} - {S.lit(m)})" for x, m in zip(self.spec.x, self.means[1:])]
        return f"({S.lit(1.0 / self.n)} + {S.quad(self.Sinv, xc)})"


    def fitted(self) -> Column:
        return F.expr(self.fitted_sql())

    def resid(self) -> Column:
        return F.expr(self.resid_sql())

    def leverage(self) -> Column:
        if self.k <= SQL_WIDTH:
            return F.expr(self.leverage_sql())
        from .wide import leverage_column
        return leverage_column(self.means[1:], self.Sinv, self.n, self.spec.x)

    def cooks_distance(self) -> Column:
        """Cook's distance; a row of leverage 1 is infinitely influential."""
        h, e = self.leverage(), self.resid()
        free, s2 = F.lit(1.0) - h, self.ssr / (self.n - self.p)
        return (F.when(free <= F.lit(FULL_LEVERAGE), F.lit(float("inf")))
                .otherwise(F.try_divide(e * e * h, F.lit(self.p * s2) * free * free)))


def _ysql(spec: ModelSpec) -> str:
    return f"ln({S.q(spec.y)})" if spec.log_y else S.q(spec.y)


def _ok(cols: list[str], dtypes: dict[str, str]) -> Column:
    return F.expr(S.ok_cond(cols, dtypes))


class OLSFit:
    """Result of :func:`fit_ols`: ``coef`` and ``fit`` DataFrames plus the
    small per-model numbers (``models``) used to build Column expressions."""

    def __init__(self, spark, models: dict[str, ModelResult]):
        self.spark = spark
        self.models = models

    def __getitem__(self, model_id: str) -> ModelResult:
        return self.models[model_id]

    @property
    def coef(self) -> DataFrame:
        rows = []
        for mid, m in self.models.items():
            if m.status != "ok":
                continue
            se = np.sqrt(np.diag(m.cov))
            for t, b, s in zip(m.terms, m.beta, se):
                z = b / s if s > 0 else float("nan")
                rows.append((mid, t, float(b), float(s), float(z), float(b - Z975 * s), float(b + Z975 * s), m.spec.cov))
        return coef_frame(self.spark, rows)

    @property
    def fit(self) -> DataFrame:
        rows = [fit_row(mid, m) for mid, m in self.models.items()]
        df = self.spark.createDataFrame(rows, T.StructType([*_without(FIT_SCHEMA, "f_p").fields, T.StructField("d2", T.LongType())]))
        return df.withColumn("f_p", f_p(F.col("f"), F.col("k"), F.col("d2"))).select(*FIT_SCHEMA.names)


COEF_SCHEMA = T.StructType([
    T.StructField("model_id", T.StringType()), T.StructField("term", T.StringType()),
    T.StructField("coef", T.DoubleType()), T.StructField("se", T.DoubleType()),
    T.StructField("z", T.DoubleType()), T.StructField("p", T.DoubleType()),
    T.StructField("ci_lo", T.DoubleType()), T.StructField("ci_hi", T.DoubleType()),
    T.StructField("cov_type", T.StringType())])

FIT_SCHEMA = T.StructType([
    T.StructField("model_id", T.StringType()), T.StructField("y", T.StringType()),
    T.StructField("n_used", T.LongType()), T.StructField("n_dropped", T.LongType()),
    T.StructField("k", T.IntegerType()), T.StructField("r2", T.DoubleType()),
    T.StructField("adj_r2", T.DoubleType()), T.StructField("f", T.DoubleType()),
    T.StructField("f_p", T.DoubleType()), T.StructField("ssr", T.DoubleType()),
    T.StructField("rmse", T.DoubleType()), T.StructField("ll", T.DoubleType()),
    T.StructField("aic", T.DoubleType()), T.StructField("bic", T.DoubleType()),
    T.StructField("cond", T.DoubleType()), T.StructField("n_groups", T.LongType()),
    T.StructField("status", T.StringType())])


def _without(schema: T.StructType, name: str) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name != name])


def coef_frame(spark, rows: list[tuple]) -> DataFrame:
    """Coefficient rows without ``p``, which is a Column expression of ``z``."""
    df = spark.createDataFrame(rows, _without(COEF_SCHEMA, "p"))
    return df.withColumn("p", normal_p(F.col("z"))).select(*COEF_SCHEMA.names)


def fit_row(mid: str, m: ModelResult) -> tuple:
    """A row of the fit table without ``f_p``, with the F test's denominator degrees of freedom last."""
    nan = float("nan")
    if m.status != "ok":
        return (mid, m.spec.y, int(m.n), int(m.n_total - m.n), m.k, None, None, None,
                None, None, None, None, None, float(m.cond), m.n_groups, m.status, None)
    n, p, k = m.n, m.p, m.k
    r2 = 1.0 - m.ssr / m.syy if m.syy > 0 else nan
    adj = 1.0 - (1.0 - r2) * (n - 1) / (n - p) if n > p else nan
    ll = -0.5 * n * (math.log(2 * math.pi) + math.log(m.ssr / n) + 1.0) if m.ssr > 0 else nan
    aic = -2.0 * ll + 2.0 * p
    bic = -2.0 * ll + p * math.log(n)
    f, d2 = nan, n - p
    if k > 0:
        b = m.beta[1:]
        V = m.cov[1:, 1:]
        try:
            f = float(b @ np.linalg.solve(V, b)) / k
            d2 = (m.n_groups - 1) if (m.spec.cov == "cluster" and m.n_groups) else (n - p)
        except np.linalg.LinAlgError:
            pass
    fl = lambda v: None if v is None else float(v)
    return (mid, m.spec.y if not m.spec.log_y else f"ln({m.spec.y})", int(n),
            int(m.n_total - n), k, fl(r2), fl(adj), fl(f), fl(m.ssr),
            math.sqrt(m.ssr / n), fl(ll), fl(aic), fl(bic), fl(m.cond), m.n_groups, "ok", int(d2))


def fit_ols(df: DataFrame, specs: list[ModelSpec], sample: str = "per_model",
            persist: bool = True, nonpositive: str = "status") -> OLSFit:
    """Fit a battery of OLS models over one table.

    A model that cannot be fitted keeps its place with a status and never
    stops the others: ``insufficient`` (too few rows), ``singular``,
    ``domain`` (ln(y) of y <= 0; ``nonpositive="drop"`` leaves those rows
    out), ``null group`` (a complete row without its group) and ``leverage
    one`` (HC2 / HC3 undefined, because a row fits itself exactly)."""
    if not specs:
        raise ValueError("no model specs")
    spark = df.sparkSession
    need = []
    for s in specs:
        for c in s.cols:
            if c not in need:
                need.append(c)
    missing = [c for c in need if c not in df.columns]
    if missing:
        raise ValueError(f"columns not in table: {missing}")
    dtypes = dict(df.dtypes)
    data = df.select(*need)
    if sample == "common":
        data = data.filter(_ok(need, dtypes))
    elif sample != "per_model":
        raise ValueError("sample must be 'per_model' or 'common'")
    if persist:
        data = data.persist()
    try:
        models = _fit(data, specs, dtypes, nonpositive)
    finally:
        if persist:
            data.unpersist()
    return OLSFit(spark, models)


def solve(m: ModelResult, means: np.ndarray, cross: np.ndarray) -> None:
    """Means and centred cross-products of ``[y, x...]`` -> coefficients, or the status ``singular``."""
    m.means, m.syy, m.S = means, cross[0, 0], cross[1:, 1:]
    d = np.diag(m.S)
    spread = m.n * (1e-13 * np.abs(means[1:])) ** 2      # of a constant, by rounding
    if not np.all(np.isfinite(m.S)) or np.any(d <= spread):
        m.status = "singular"
        return
    D = 1.0 / np.sqrt(d)
    ev = np.linalg.eigvalsh(m.S * np.outer(D, D))
    m.cond = float(ev[-1] / ev[0]) if ev[0] > 0 else float("inf")
    if not (m.cond < COND_LIMIT):
        m.status = "singular"
        return
    m.Sinv = np.linalg.inv(m.S)
    b = m.Sinv @ cross[1:, 0]
    m.beta = np.concatenate([[means[0] - means[1:] @ b], b])


def covariance(m: ModelResult, meat: np.ndarray | None) -> None:
    """The covariance of the coefficients from the sandwich meat (none for classical errors)."""
    p = m.p
    Ainv = np.zeros((p, p))
    Ainv[0, 0] = 1.0 / m.n
    Ainv[1:, 1:] = m.Sinv
    if m.spec.cov == "classical":
        Vt = Ainv * (m.ssr / (m.n - p))
    else:
        if m.spec.cov == "HC1":
            meat = meat * (m.n / (m.n - p))
        if m.spec.cov == "cluster":
            G = m.n_groups
            meat = meat * ((G / (G - 1.0)) * ((m.n - 1.0) / (m.n - p)) if G > 1 else float("nan"))
        Vt = Ainv @ meat @ Ainv
    Tm = np.eye(p)
    Tm[0, 1:] = -m.means[1:]
    m.cov = Tm @ Vt @ Tm.T


def _fit(data: DataFrame, specs: list[ModelSpec], dtypes: dict, nonpositive: str) -> dict:
    for s in specs:
        if s.cov == "cluster" and not s.groups:
            raise ValueError(f"{s.model_id}: cov='cluster' needs groups")
    narrow, wide = ([s for s in specs if (len(s.x) > SQL_WIDTH) == w] for w in (False, True))
    models = _fit_sql(data, narrow, dtypes, nonpositive) if narrow else {}
    if wide:
        from .wide import fit_wide
        models |= fit_wide(data, wide, nonpositive)
    return {s.model_id: models[s.model_id] for s in specs}


def _fit_sql(data: DataFrame, specs: list[ModelSpec], dtypes: dict, nonpositive: str) -> dict:
    oks, raw = {}, {}
    for s in specs:
        ok = S.ok_cond(s.cols, dtypes)
        if s.log_y:
            raw[s.model_id] = ok
            ok = f"({ok} AND {S.q(s.y)} > 0)"
        oks[s.model_id] = ok

    # ---- pass 1: n, means, centred cross-products for every model ----
    aggs = ["count(1) AS n_total"]
    for i, s in enumerate(specs):
        ok = oks[s.model_id]
        v = [_ysql(s)] + [S.q(x) for x in s.x]
        aggs.append(f"count_if({ok}) AS n_{i}")
        if s.groups:
            complete = S.ok_cond([s.y, *s.x], dtypes)
            aggs.append(f"count_if({complete} AND {S.q(s.groups)} IS NULL) AS ng_{i}")
        if s.log_y:
            aggs.append(f"count_if({raw[s.model_id]} AND {S.q(s.y)} <= 0) AS np_{i}")
        for a in range(len(v)):
            aggs.append(f"avg({S.when(ok, v[a])}) AS m_{i}_{a}")
            for b in range(a, len(v)):
                aggs.append(f"covar_samp({S.when(ok, v[a])}, {S.when(ok, v[b])}) AS c_{i}_{a}_{b}")
    r1 = S.select_agg(data, aggs)

    models: dict[str, ModelResult] = {}
    for i, s in enumerate(specs):
        m = ModelResult(spec=s, n=int(r1[f"n_{i}"]), n_total=int(r1["n_total"]))
        models[s.model_id] = m
        if s.log_y and r1.get(f"np_{i}") and nonpositive != "drop":
            m.status = "domain"
            continue
        if r1.get(f"ng_{i}"):
            m.status = "null group"
            continue
        k = len(s.x)
        if m.n <= k + 1:
            m.status = "insufficient"
            continue
        nv = k + 1
        C = np.empty((nv, nv))
        for a in range(nv):
            for b in range(a, nv):
                val = r1[f"c_{i}_{a}_{b}"]
                C[a, b] = C[b, a] = float("nan") if val is None else val
        solve(m, np.array([r1[f"m_{i}_{a}"] for a in range(nv)], dtype=float), C * (m.n - 1))

    live = [s for s in specs if models[s.model_id].status == "ok"]
    if not live:
        return models

    def centred(s: ModelSpec, m: ModelResult) -> tuple[list[str], str, str]:
        xc = [f"({S.q(x)} - {S.lit(mu)})" for x, mu in zip(s.x, m.means[1:])]
        e = f"({_ysql(s)} - {S.lit(m.means[0])})"
        for bj, c in zip(m.beta[1:], xc):
            e += f" - {S.lit(bj)} * {c}"
        h = f"({S.lit(1.0 / m.n)} + {S.quad(m.Sinv, xc)})"
        return xc, f"({e})", h

    # ---- pass 2: SSR and sandwich meat (HC*), residual moments ----
    # residual e and leverage h are computed once per row and model in an
    # inner projection (NULL outside the model's complete cases), then the
    # aggregates only multiply and add. All pass-2 quantities are sums.
    p2, st1, st2 = [], [], []            # p2: (expression, name) of each sum
    for i, s in enumerate(live):
        m = models[s.model_id]
        ok = oks[s.model_id]
        xc, e, h = centred(s, m)
        st1 += [f"{S.when(ok, e)} AS __e{i}", f"{S.when(ok, h)} AS __h{i}"]
        st1 += [f"{S.when(ok, c)} AS __x{i}_{a}" for a, c in enumerate(xc, start=1)]
        e, h = f"__e{i}", f"__h{i}"
        if s.cov == "HC3":
            w = f"power({e} / CASE WHEN 1D - {h} > {S.lit(FULL_LEVERAGE)} THEN 1D - {h} END, 2)"
        elif s.cov == "HC2":
            w = f"({e} * {e} / CASE WHEN 1D - {h} > {S.lit(FULL_LEVERAGE)} THEN 1D - {h} END)"
        else:
            w = f"({e} * {e})"
        st2.append(f"{w} AS __w{i}")
        if s.cov in ("HC2", "HC3"):
            p2.append((f"CASE WHEN {e} IS NOT NULL AND __w{i} IS NULL THEN 1D ELSE 0D END", f"full_{i}"))
        p2 += [(f"{e} * {e}", f"sse_{i}"), (f"power({e}, 3)", f"s3_{i}"), (f"power({e}, 4)", f"s4_{i}")]
        if s.cov not in ("classical", "cluster"):
            z = ["1D"] + [f"__x{i}_{a}" for a in range(1, len(xc) + 1)]
            for a in range(len(z)):
                for b in range(a, len(z)):
                    p2.append((f"__w{i} * {z[a]} * {z[b]}", f"w_{i}_{a}_{b}"))

    # ---- cluster-robust: per-group scores ----
    by_group: dict[str, list[tuple[int, ModelSpec]]] = {}
    for i, s in enumerate(live):
        if s.cov == "cluster":
            by_group.setdefault(s.groups, []).append((i, s))

    def group_scores(lst):
        gaggs, oaggs = [], []
        for i, s in lst:
            k = len(s.x)
            z = ["1D"] + [f"__x{i}_{a}" for a in range(1, k + 1)]
            gaggs.append(f"count(__e{i}) AS gn_{i}")
            gaggs += [f"sum(__e{i} * {z[a]}) AS u_{i}_{a}" for a in range(len(z))]
            oaggs.append(f"count_if(gn_{i} > 0) AS G_{i}")
            oaggs += [f"sum(u_{i}_{a} * u_{i}_{b}) AS w_{i}_{a}_{b}"
                      for a in range(len(z)) for b in range(a, len(z))]
        return gaggs, oaggs

    spark = data.sparkSession
    groups = list(by_group)
    if not groups:
        r2 = S.select_agg_staged(data, [st1, st2], [f"sum({x}) AS {n}" for x, n in p2])
    else:
        # the first group column shares the pass-2 scan: per-group partial
        # sums of every pass-2 quantity, added up in the outer aggregate
        gaggs, oaggs = group_scores(by_group[groups[0]])
        inner = spark.sql("SELECT " + ", ".join([f"sum({x}) AS {n}" for x, n in p2] + gaggs) + " FROM "
                          + S.staged_from([st1, st2]) + " GROUP BY " + S.q(groups[0]), t=data)
        r2 = S.select_agg(inner, [f"sum({n}) AS {n}" for _, n in p2] + oaggs)
    for g in groups[1:]:
        gaggs, oaggs = group_scores(by_group[g])
        inner = spark.sql("SELECT " + ", ".join(gaggs) + " FROM " + S.staged_from([st1]) + " GROUP BY " + S.q(g),
                          t=data)
        r2.update(S.select_agg(inner, oaggs))

    for i, s in enumerate(live):
        m = models[s.model_id]
        p = m.p
        m.ssr = float(r2[f"sse_{i}"])
        if r2.get(f"full_{i}"):
            m.status = "leverage one"
            continue
        m.extras["sum_e3"] = r2[f"s3_{i}"]
        m.extras["sum_e4"] = r2[f"s4_{i}"]
        M = np.empty((p, p))
        if s.cov != "classical":
            for a in range(p):
                for b in range(a, p):
                    M[a, b] = M[b, a] = r2[f"w_{i}_{a}_{b}"]
        if s.cov == "cluster":
            m.n_groups = int(r2[f"G_{i}"])
        covariance(m, M)
    return models


def ols(df: DataFrame, y: str, x: list[str], cov: str = "HC3", groups: str | None = None,
        model_id: str = "m", log_y: bool = False) -> OLSFit:
    """One model; convenience wrapper of :func:`fit_ols`."""
    return fit_ols(df, [ModelSpec(model_id, y, list(x), cov, groups, log_y)])


def omnibus_k2(skew: float, kurt: float, n: int) -> float | None:
    """D'Agostino and Pearson's K^2 of a sample's skewness and kurtosis; none below 8 rows."""
    if n < 8:
        return None
    y = skew * math.sqrt((n + 1.0) * (n + 3) / (6.0 * (n - 2)))
    b2 = 3.0 * (n * n + 27.0 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w2 = math.sqrt(2 * (b2 - 1)) - 1
    z1 = math.asinh(y / math.sqrt(2 / (w2 - 1))) / math.sqrt(0.5 * math.log(w2))
    e = 3.0 * (n - 1) / (n + 1)
    var = 24.0 * n * (n - 2) * (n - 3) / ((n + 1.0) ** 2 * (n + 3) * (n + 5))
    x = (kurt - e) / math.sqrt(var)
    sb = 6.0 * (n * n - 5 * n + 2) / ((n + 7.0) * (n + 9)) * math.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2.0) * (n - 3)))
    a = 6.0 + 8.0 / sb * (2.0 / sb + math.sqrt(1 + 4.0 / (sb * sb)))
    d = 1 + x * math.sqrt(2 / (a - 4))
    t = math.copysign((abs(1 - 2.0 / a) / abs(d)) ** (1 / 3), d) if d else 0.0
    z2 = (1 - 2 / (9.0 * a) - t) / math.sqrt(2 / (9.0 * a))
    return z1 * z1 + z2 * z2


def resid_diagnostics(fitres: OLSFit) -> DataFrame:
    """Residual skewness and kurtosis (population moments, as printed by
    regression summaries), Jarque-Bera and its chi^2(2) tail, from the
    residual moments the fit pass already summed. Residuals have mean 0
    (intercept), so m_k = sum(e^k)/n."""
    rows = []
    for mid, m in fitres.models.items():
        if m.status != "ok":
            continue
        n = m.n
        m2, m3, m4 = m.ssr / n, m.extras["sum_e3"] / n, m.extras["sum_e4"] / n
        skew = m3 / m2 ** 1.5
        kurt = m4 / (m2 * m2)
        jb = n / 6.0 * (skew * skew + (kurt - 3.0) ** 2 / 4.0)
        omnibus = omnibus_k2(skew, kurt, n)
        rows.append((mid, int(n), float(skew), float(kurt), float(jb), float(math.exp(-jb / 2.0)),
                     float(m.cond), omnibus, None if omnibus is None else math.exp(-omnibus / 2.0)))
    return fitres.spark.createDataFrame(rows, "model_id string, n bigint, resid_skew double, "
                                              "resid_kurtosis double, jarque_bera double, jb_p double, "
                                              "cond double, omnibus double, omnibus_p double")
