"""Generalised linear models by IRLS over Spark aggregates.

One Spark job per Newton/IRLS iteration for a whole battery of models: each model
still iterating contributes ``sum(w*z_a*z_b)`` and ``sum(w*z_a*zz)`` to one
``agg`` over the persisted, column-pruned input; the p x p solves happen on
the driver. After convergence one more job gives deviance, null deviance,
Pearson chi^2, log-likelihood pieces, raw-scale RMSE and the sandwich
(``A^-1 B A^-1``) of every model.

Families: binomial/logit (fractional logit, Papke-Wooldridge QMLE, 0<y<1),
Poisson/log (QMLE for non-negative y), Gamma/log (y > 0).

Robust errors (G4): the White sandwich "HC0" with the observed information
as bread (default); no published GLM standard error pins down what the
reference's library did for ``cov_type='HC3'`` on a GLM, so the label says
HC0. Options: ``cov='HC1'`` (n/(n-p)) and ``cov='HC3'`` (GLM leverage from
the IRLS weights, one extra pass).
Log-likelihoods follow the usual library conventions: binomial with one
trial and continuous y (``lgamma`` terms), Poisson with ``lgamma(y+1)``,
Gamma at the Pearson scale estimate; AIC = -2 ll + 2p, BIC = -2 ll + p ln n.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import sqltext as S
from ..functions.special import lgamma_sql
from ..functions.tails import Z975
from .linear import COND_LIMIT, coef_frame

FAMILIES = ("binomial", "poisson", "gamma")


@dataclass
class GLMSpec:
    model_id: str
    y: str
    x: list[str]
    family: str                   # binomial (logit) | poisson (log) | gamma (log)
    y_scale: float = 1.0          # model y = column * y_scale (e.g. 0.01: percent -> proportion)
    cov: str = "HC0"              # HC0 (default) | HC1 (n/(n-p)) | HC3 (GLM leverage)

    def __post_init__(self):
        if self.family not in FAMILIES:
            raise ValueError(f"family must be one of {FAMILIES}")
        if self.cov not in ("HC0", "HC1", "HC3"):
            raise ValueError("cov must be HC0, HC1 or HC3")


@dataclass
class GLMResult:
    spec: GLMSpec
    status: str = "ok"
    n: int = 0
    n_total: int = 0
    ybar: float = float("nan")
    x_at: np.ndarray | None = None            # means and deviations that standardise x
    x_sd: np.ndarray | None = None
    beta: np.ndarray | None = None
    cov: np.ndarray | None = None
    iterations: int = 0
    stats: dict = field(default_factory=dict)
    stats_bread: np.ndarray | None = None     # A^-1 of the sandwich

    @property
    def terms(self) -> list[str]:
        return ["const", *self.spec.x]

    @property
    def back(self) -> np.ndarray:
        """Matrix from coefficients of standardised predictors to those of the columns."""
        t = np.diag(np.concatenate([[1.0], 1.0 / self.x_sd]))
        t[0, 1:] = -self.x_at / self.x_sd
        return t

    def z_sql(self) -> list[str]:
        return ["1D"] + [f"(({S.q(x)} - {S.lit(a)}) / {S.lit(d)})"
                         for x, a, d in zip(self.spec.x, self.x_at, self.x_sd)]

    def eta_sql(self) -> str:
        return S.linear(self.beta[0], self.beta[1:], [S.q(x) for x in self.spec.x])

    def mean_sql(self) -> str:
        return _linkinv(self.spec.family, self.eta_sql())

    def mean_raw_sql(self) -> str:
        return f"({self.mean_sql()} / {S.lit(self.spec.y_scale)})"

    def mean(self) -> Column:
        """Fitted mean on the model scale (inverse link)."""
        return F.expr(self.mean_sql())

    def mean_raw(self) -> Column:
        """Fitted mean in the raw units of the y column."""
        return F.expr(self.mean_raw_sql())


def _linkinv(family: str, eta: str) -> str:
    """Inverse link, kept inside its open range, so that a step too far gives
    a huge deviance (and is halved) instead of a division by zero."""
    # greatest / least skip NULL and NaN, which have to stay what they are
    if family == "binomial":
        inside = f"least(greatest(1D / (1D + exp(-greatest({eta}, -700D))), 1e-15D), 1D - 1e-15D)"
    else:
        inside = f"exp(least(greatest({eta}, -300D), 300D))"
    return f"(CASE WHEN {eta} IS NULL OR isnan({eta}) THEN {eta} ELSE {inside} END)"


def _link(family: str, mu: float) -> float:
    return math.log(mu / (1.0 - mu)) if family == "binomial" else math.log(mu)


def _ysql(s: GLMSpec) -> str:
    return f"({S.q(s.y)} * {S.lit(s.y_scale)})" if s.y_scale != 1.0 else S.q(s.y)


def _irls_terms(family: str, y: str, mu: str, eta: str) -> tuple[str, str]:
    """Working weight w and working response zz (SQL text)."""
    if family == "binomial":
        v = f"({mu} * (1D - {mu}))"
        return v, f"({eta} + ({y} - {mu}) / {v})"
    if family == "poisson":
        return mu, f"({eta} + ({y} - {mu}) / {mu})"
    return "1D", f"({eta} + ({y} - {mu}) / {mu})"          # gamma, log link (Fisher scoring)


def _newton_terms(family: str, y: str, mu: str, eta: str) -> tuple[str, str]:
    """Newton step in IRLS form (observed information). Same as Fisher
    scoring for the canonical links; for Gamma/log the weight is y/mu
    (always > 0, and the objective is convex in eta), which converges
    quadratically where scoring converges linearly. Same fixed point."""
    if family == "gamma":
        return f"({y} / {mu})", f"({eta} + ({y} - {mu}) / {y})"
    return _irls_terms(family, y, mu, eta)


def _unit_deviance(family: str, y: str, mu: str) -> str:
    if family == "binomial":
        return (f"(2D * ((CASE WHEN {y} > 0 THEN {y} * ln({y} / {mu}) ELSE 0D END) + "
                f"(CASE WHEN {y} < 1 THEN (1D - {y}) * ln((1D - {y}) / (1D - {mu})) ELSE 0D END)))")
    if family == "poisson":
        return f"(2D * ((CASE WHEN {y} > 0 THEN {y} * ln({y} / {mu}) ELSE 0D END) - ({y} - {mu})))"
    return f"(2D * (-ln({y} / {mu}) + ({y} - {mu}) / {mu}))"


def _variance(family: str, mu: str) -> str:
    if family == "binomial":
        return f"({mu} * (1D - {mu}))"
    if family == "poisson":
        return mu
    return f"({mu} * {mu})"


def _bread_weight(family: str, y: str, mu: str) -> str:
    """Observed information weight (canonical links: the IRLS weight)."""
    if family == "binomial":
        return f"({mu} * (1D - {mu}))"
    if family == "poisson":
        return mu
    return f"({y} / {mu})"


def _score_factor(family: str, y: str, mu: str) -> str:
    if family == "gamma":
        return f"(({y} - {mu}) / {mu})"
    return f"({y} - {mu})"


GLM_FIT_SCHEMA = T.StructType([
    T.StructField("model_id", T.StringType()), T.StructField("family", T.StringType()),
    T.StructField("n_used", T.LongType()), T.StructField("n_dropped", T.LongType()),
    T.StructField("iterations", T.IntegerType()), T.StructField("deviance", T.DoubleType()),
    T.StructField("null_deviance", T.DoubleType()), T.StructField("pseudo_r2", T.DoubleType()),
    T.StructField("pearson_chi2", T.DoubleType()), T.StructField("scale", T.DoubleType()),
    T.StructField("llf", T.DoubleType()), T.StructField("aic", T.DoubleType()),
    T.StructField("bic", T.DoubleType()), T.StructField("rmse_raw", T.DoubleType()),
    T.StructField("status", T.StringType())])


class GLMFit:
    def __init__(self, spark, models: dict[str, GLMResult]):
        self.spark = spark
        self.models = models

    def __getitem__(self, k: str) -> GLMResult:
        return self.models[k]

    @property
    def coef(self) -> DataFrame:
        rows = []
        for mid, m in self.models.items():
            if m.status != "ok":
                continue
            se = np.sqrt(np.diag(m.cov))
            for t, b, s in zip(m.terms, m.beta, se):
                z = float(b / s) if s > 0 else float("nan")
                rows.append((mid, t, float(b), float(s), z, float(b - Z975 * s), float(b + Z975 * s), m.spec.cov))
        return coef_frame(self.spark, rows)

    @property
    def fit(self) -> DataFrame:
        rows = []
        for mid, m in self.models.items():
            s = m.stats
            g = lambda k: None if s.get(k) is None else float(s[k])
            rows.append((mid, m.spec.family, int(m.n), int(m.n_total - m.n), int(m.iterations),
                         g("deviance"), g("null_deviance"), g("pseudo_r2"), g("pearson_chi2"), g("scale"),
                         g("llf"), g("aic"), g("bic"), g("rmse_raw"), m.status))
        return self.spark.createDataFrame(rows, GLM_FIT_SCHEMA)


def fit_glm(df: DataFrame, specs: list[GLMSpec], max_iter: int = 100, tol: float = 1e-12,
            persist: bool = True, check_domain: bool = False) -> GLMFit:
    """Fit a battery of GLMs over one table.

    A model that cannot be fitted keeps its place with a status (``domain``,
    ``insufficient``, ``singular``, ``diverged``, ``not converged``) and never
    stops the others; ``check_domain`` raises on the first one outside its
    domain instead. Newton steps run on standardised predictors; a step that
    raises the deviance is halved, and a model is done when a step changes the
    deviance by less than ``tol`` of itself."""
    spark = df.sparkSession
    need = []
    for s in specs:
        for c in [s.y, *s.x]:
            if c not in need:
                need.append(c)
    dtypes = dict(df.dtypes)
    data = df.select(*need)
    if persist:
        data = data.persist()
    try:
        return GLMFit(spark, _fit(data, specs, dtypes, max_iter, tol, check_domain))
    finally:
        if persist:
            data.unpersist()


def _fit(data, specs, dtypes, max_iter, tol, check_domain):
    oks = {s.model_id: S.ok_cond([s.y, *s.x], dtypes) for s in specs}
    aggs = ["count(1) AS n_total"]
    for i, s in enumerate(specs):
        ok, y = oks[s.model_id], _ysql(s)
        aggs += [f"count_if({ok}) AS n_{i}", f"avg({S.when(ok, y)}) AS ybar_{i}"]
        if s.family == "binomial":
            bad = f"({y} <= 0 OR {y} >= 1)"
        elif s.family == "gamma":
            bad = f"{y} <= 0"
        else:
            bad = f"{y} < 0"
        aggs.append(f"count_if({ok} AND {bad}) AS bad_{i}")
        for a, x in enumerate(s.x):
            aggs += [f"avg({S.when(ok, S.q(x))}) AS xm_{i}_{a}", f"stddev_samp({S.when(ok, S.q(x))}) AS xs_{i}_{a}"]
        if s.family == "gamma":
            # moments of (ln y, x) for a log-linear least-squares start
            v = [f"ln({y})"] + [S.q(x) for x in s.x]
            okp = f"({ok} AND {y} > 0)"
            for a in range(len(v)):
                aggs.append(f"avg({S.when(okp, v[a])}) AS gm_{i}_{a}")
                for b in range(a, len(v)):
                    aggs.append(f"covar_samp({S.when(okp, v[a])}, {S.when(okp, v[b])}) AS gc_{i}_{a}_{b}")
    r0 = S.select_agg(data, aggs)
    models = {}
    for i, s in enumerate(specs):
        m = GLMResult(spec=s, n=int(r0[f"n_{i}"]), n_total=int(r0["n_total"]))
        models[s.model_id] = m
        if r0[f"bad_{i}"]:
            if check_domain:
                raise ValueError(f"{s.model_id}: {r0[f'bad_{i}']} rows outside the {s.family} domain")
            m.status = "domain"
            continue
        if m.n <= len(s.x) + 1:
            m.status = "insufficient"
            continue
        at = [r0[f"xm_{i}_{a}"] for a in range(len(s.x))]
        sd = [r0[f"xs_{i}_{a}"] for a in range(len(s.x))]
        if any(v is None or not (v > 0) or not math.isfinite(v) for v in sd):
            m.status = "singular"
            continue
        m.x_at, m.x_sd = np.array(at, float), np.array(sd, float)
        m.ybar = float(r0[f"ybar_{i}"])
        if not 0 < m.ybar < (1 if s.family == "binomial" else math.inf):
            m.status = "domain"
            continue
        m.beta = np.zeros(len(s.x) + 1)
        m.beta[0] = _link(s.family, m.ybar)
        if s.family == "gamma":
            m.beta = _loglinear_start(r0, i, len(s.x), m.beta)

    live = {s.model_id: i for i, s in enumerate(specs) if models[s.model_id].status == "ok"}
    active = set(live)
    at = {mid: np.linalg.solve(models[mid].back, models[mid].beta) for mid in live}   # standardised coefficients
    kept: dict[str, tuple[np.ndarray, float]] = {}                                    # last accepted, its deviance
    it = 0
    while active and it < max_iter:
        it += 1
        aggs, st1, st2, st3 = [], [], [], []
        for mid in sorted(active):
            i, m = live[mid], models[mid]
            s, ok, y = m.spec, oks[mid], _ysql(m.spec)
            z = m.z_sql()
            eta = " + ".join(f"{S.lit(b)} * {x}" for b, x in zip(at[mid], z))
            st1 += [f"{S.when(ok, y)} AS __y{i}", f"{S.when(ok, f'({eta})')} AS __eta{i}"]
            st1 += [f"{x} AS __z{i}_{a}" for a, x in enumerate(z)]
            st2.append(f"{_linkinv(s.family, f'__eta{i}')} AS __mu{i}")
            w, zz = _newton_terms(s.family, f"__y{i}", f"__mu{i}", f"__eta{i}")
            st3 += [f"{w} AS __w{i}", f"{zz} AS __zz{i}"]
            aggs.append(f"sum({_unit_deviance(s.family, f'__y{i}', f'__mu{i}')}) AS dev_{i}")
            for a in range(len(z)):
                aggs.append(f"sum(__w{i} * __z{i}_{a} * __zz{i}) AS r_{i}_{a}")
                for b in range(a, len(z)):
                    aggs.append(f"sum(__w{i} * __z{i}_{a} * __z{i}_{b}) AS a_{i}_{a}_{b}")
        r = S.select_agg_staged(data, [st1, st2, st3], aggs)
        for mid in sorted(active):
            i, m = live[mid], models[mid]
            dev = r[f"dev_{i}"]
            m.iterations = it
            if mid in kept and not (dev <= kept[mid][1] * (1 + 1e-10) + 1e-12):
                if np.max(np.abs(at[mid] - kept[mid][0])) < 1e-12 * (1 + np.max(np.abs(at[mid]))):
                    m.status = "diverged"
                    active.discard(mid)
                at[mid] = (at[mid] + kept[mid][0]) / 2        # halve the step
                continue
            p = len(m.spec.x) + 1
            A = np.empty((p, p))
            for a in range(p):
                for b in range(a, p):
                    A[a, b] = A[b, a] = r[f"a_{i}_{a}_{b}"]
            rhs = np.array([r[f"r_{i}_{a}"] for a in range(p)], float)
            if not (np.all(np.isfinite(A)) and np.all(np.isfinite(rhs)) and dev is not None and math.isfinite(dev)):
                m.status = "diverged"
                active.discard(mid)
                continue
            d = np.sqrt(np.maximum(np.diag(A), 1e-300))
            if not (np.linalg.cond(A / np.outer(d, d)) < COND_LIMIT):
                m.status = "singular"
                active.discard(mid)
                continue
            before = kept.get(mid, (None, math.inf))[1]
            kept[mid] = (at[mid], dev)
            at[mid] = np.linalg.solve(A, rhs)
            # the step from a point this close squares its error once more
            if before - dev <= tol * (abs(dev) + tol):
                active.discard(mid)
    for mid in active:
        models[mid].status = "not converged"
    for mid in live:
        models[mid].beta = models[mid].back @ at[mid]

    done = [mid for mid in live if models[mid].status == "ok"]
    if not done:
        return models
    # ---- final pass: deviances, Pearson, llf pieces, RMSE, sandwich ----
    aggs, st1, st2 = [], [], []
    for mid in done:
        i, m = live[mid], models[mid]
        s, ok, y0 = m.spec, oks[mid], _ysql(m.spec)
        fam = s.family
        st1 += [f"{S.when(ok, y0)} AS __y{i}", f"{S.when(ok, m.mean_sql())} AS __mu{i}",
                f"{S.when(ok, S.q(s.y))} AS __yr{i}"]
        y, mu = f"__y{i}", f"__mu{i}"
        mu0 = S.lit(m.ybar)
        st2.append(f"(__yr{i} - {mu} / {S.lit(s.y_scale)}) AS __er{i}")
        aggs += [f"sum({_unit_deviance(fam, y, mu)}) AS dev_{i}",
                 f"sum({_unit_deviance(fam, y, mu0)}) AS dev0_{i}",
                 f"sum(({y} - {mu}) * ({y} - {mu}) / {_variance(fam, mu)}) AS chi_{i}",
                 f"avg(__er{i} * __er{i}) AS mse_{i}"]
        if fam == "binomial":
            ll = (f"(-{lgamma_sql(f'({y} + 1D)')} - {lgamma_sql(f'(2D - {y})')} "
                  f"+ {y} * ln({mu} / (1D - {mu})) + ln(1D - {mu}))")
            aggs.append(f"sum({ll}) AS ll_{i}")
        elif fam == "poisson":
            ll = f"({y} * ln({mu}) - {mu} - {lgamma_sql(f'({y} + 1D)')})"
            aggs.append(f"sum({ll}) AS ll_{i}")
        else:
            aggs += [f"sum(ln({y} / {mu})) AS lym_{i}", f"sum({y} / {mu}) AS ym_{i}", f"sum(ln({y})) AS ly_{i}"]
        bw = _bread_weight(fam, y, mu)
        sf = _score_factor(fam, y, mu)
        ww = _irls_terms(fam, y, mu, "0D")[0]
        z = m.z_sql()
        for a in range(len(z)):
            for b in range(a, len(z)):
                aggs.append(f"sum({bw} * {z[a]} * {z[b]}) AS A_{i}_{a}_{b}")
                aggs.append(f"sum({sf} * {sf} * {z[a]} * {z[b]}) AS B_{i}_{a}_{b}")
                if s.cov == "HC3":
                    aggs.append(f"sum({ww} * {z[a]} * {z[b]}) AS Q_{i}_{a}_{b}")
    r = S.select_agg_staged(data, [st1, st2], aggs)
    hc3: list = []
    for mid in done:
        i, m = live[mid], models[mid]
        p, n = len(m.spec.x) + 1, m.n
        A, B = np.empty((p, p)), np.empty((p, p))
        for a in range(p):
            for b in range(a, p):
                A[a, b] = A[b, a] = r[f"A_{i}_{a}_{b}"]
                B[a, b] = B[b, a] = r[f"B_{i}_{a}_{b}"]
        Ai = np.linalg.inv(A)
        if m.spec.cov == "HC1":
            B = B * (n / (n - p))
        m.cov = m.back @ Ai @ B @ Ai @ m.back.T
        m.stats_bread = Ai
        if m.spec.cov == "HC3":
            Q = np.empty((p, p))
            for a in range(p):
                for b in range(a, p):
                    Q[a, b] = Q[b, a] = r[f"Q_{i}_{a}_{b}"]
            hc3.append((mid, i, np.linalg.inv(Q)))
        dev, dev0, chi = r[f"dev_{i}"], r[f"dev0_{i}"], r[f"chi_{i}"]
        fam = m.spec.family
        scale = chi / (n - p) if fam == "gamma" else 1.0
        if fam == "gamma":
            ws = 1.0 / scale
            llf = (ws * (math.log(ws) * n + r[f"lym_{i}"]) - ws * r[f"ym_{i}"]
                   - n * math.lgamma(ws) - r[f"ly_{i}"])
        else:
            llf = r[f"ll_{i}"]
        m.stats = {"deviance": dev, "null_deviance": dev0, "pseudo_r2": 1.0 - dev / dev0 if dev0 else None,
                   "pearson_chi2": chi, "scale": scale, "llf": llf, "aic": -2.0 * llf + 2.0 * p,
                   "bic": -2.0 * llf + p * math.log(n), "rmse_raw": math.sqrt(r[f"mse_{i}"])}
    if hc3:
        _hc3_pass(data, models, oks, hc3)
    return models


def _loglinear_start(r0: dict, i: int, k: int, default: np.ndarray) -> np.ndarray:
    """Least squares of ln(y) on x from first-pass moments: a start close to
    the Gamma/log optimum (IRLS from the null model needs more steps).
    Falls back to the null start when the moments are unusable."""
    try:
        nv = k + 1
        C = np.empty((nv, nv))
        for a in range(nv):
            for b in range(a, nv):
                C[a, b] = C[b, a] = r0[f"gc_{i}_{a}_{b}"]
        mu = np.array([r0[f"gm_{i}_{a}"] for a in range(nv)], dtype=float)
        b = np.linalg.solve(C[1:, 1:], C[1:, 0])
        out = np.concatenate([[mu[0] - mu[1:] @ b], b])
        return out if np.all(np.isfinite(out)) else default
    except (TypeError, np.linalg.LinAlgError):
        return default


def _hc3_pass(data, models, oks, hc3) -> None:
    """G4 option: HC3 with GLM leverage h_i = w_i x_i' (X'WX)^-1 x_i (IRLS
    weights at the final fit); meat sum(s_i^2 / (1 - h_i)^2 x x'). One more
    aggregation for all HC3 models."""
    aggs, st1, st2 = [], [], []
    for mid, i, Qi in hc3:
        m = models[mid]
        s, ok = m.spec, oks[mid]
        y, mu = f"__y{i}", f"__mu{i}"
        st1 += [f"{S.when(ok, _ysql(s))} AS {y}", f"{S.when(ok, m.mean_sql())} AS {mu}"]
        z = m.z_sql()
        w = _irls_terms(s.family, y, mu, "0D")[0]
        sf = _score_factor(s.family, y, mu)
        left = f"(1D - {w} * {S.quad(Qi, z)})"
        st2.append(f"power({sf} / CASE WHEN {left} > 1e-10D THEN {left} END, 2) AS __s{i}")
        aggs.append(f"count_if({y} IS NOT NULL AND __s{i} IS NULL) AS full_{i}")
        for a in range(len(z)):
            for b in range(a, len(z)):
                aggs.append(f"sum(__s{i} * {z[a]} * {z[b]}) AS H_{i}_{a}_{b}")
    r = S.select_agg_staged(data, [st1, st2], aggs)
    for mid, i, _ in hc3:
        m = models[mid]
        if r[f"full_{i}"]:
            m.status = "leverage one"
            continue
        p = len(m.spec.x) + 1
        Bm = np.empty((p, p))
        for a in range(p):
            for b in range(a, p):
                Bm[a, b] = Bm[b, a] = r[f"H_{i}_{a}_{b}"]
        m.cov = m.back @ m.stats_bread @ Bm @ m.stats_bread @ m.back.T

