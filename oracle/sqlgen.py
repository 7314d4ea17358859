"""Generators of DuckDB SQL for the model oracles.

OLS: centre on the sample means, sum the centred cross-products, invert
the k x k matrix by unrolled Gauss-Jordan elimination (one CTE per pivot; the
matrix is symmetric positive definite, so no pivoting), then residuals,
leverage and the sandwich in plain SQL. GLM: a fixed number of unrolled
Newton (IRLS) steps from the null model, one aggregate CTE per step.
"""

from __future__ import annotations


def _r(v: str, d: int) -> str:
    return f"round({v}, {d})"


def _simpson(i: str, n: int) -> str:
    return f"(CASE WHEN {i} = 0 OR {i} = {n} THEN 1 WHEN {i} % 2 = 1 THEN 4 ELSE 2 END)"


def normal_p(z: str, n: int = 2000, upto: float = 12.0) -> str:
    """Two-sided normal tail by Simpson's rule: exp(-z^2/2) times the integral of exp(-z s - s^2/2)."""
    h = upto / n
    return (f"(2 * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * {h / 3!r} * list_sum([{_simpson('i', n)} * "
            f"exp(-abs({z}) * i * {h!r} - i * i * {h * h / 2!r}) for i in range({n + 1})]))")


def f_p(u: str, d1: str, d2: str, n: int = 20000) -> str:
    """Upper tail of F(d1, d2) at u = d1 F / d2 (for t: u = t^2 / df, d1 = 1): the integral of
    sin^(d1-1) cos^(d2-1) from atan(sqrt(u)) to pi/2 over the one from 0, by Simpson's rule."""
    def integral(lo: str) -> str:
        at = f"({lo} + (pi() / 2 - {lo}) * i / {n})"
        return (f"((pi() / 2 - {lo}) * list_sum([{_simpson('i', n)} * pow(sin({at}), {d1} - 1) * "
                f"pow(greatest(cos({at}), 0), {d2} - 1) for i in range({n + 1})]))")

    return f"({integral(f'atan(sqrt({u}))')} / {integral('0.0')})"


class Ols:
    """CTEs for one OLS model; ``self.ctes`` (list) and expressions over the
    final CTE ``self.final`` for ``coef(i)``, ``se(i)`` (i = 0 const)."""

    def __init__(self, p: str, src: str, y: str, xs: list[str], cov: str = "HC3",
                 groups: str | None = None, where: str | None = None, keep: list[str] | None = None):
        self.p, self.k, self.cov = p, len(xs), cov
        k = self.k
        conds = [f"({y}) IS NOT NULL"] + [f"({x}) IS NOT NULL" for x in xs]
        if groups:
            conds.append(f"({groups}) IS NOT NULL")
        if where:
            conds.append(f"({where})")
        sel = [f"({y}) AS yv"] + [f"({x}) AS x{i}" for i, x in enumerate(xs)]
        if groups:
            sel.append(f"({groups}) AS gv")
        keep = keep or []
        sel += keep
        c = []
        c.append(f"{p}_d AS (SELECT {', '.join(sel)} FROM {src} WHERE {' AND '.join(conds)})")
        c.append(f"{p}_m AS (SELECT count(*) AS n, avg(yv) AS my"
                 + "".join(f", avg(x{i}) AS mx{i}" for i in range(k)) + f" FROM {p}_d)")
        cs = ["yv - my AS yc"] + [f"x{i} - mx{i} AS c{i}" for i in range(k)]
        if groups:
            cs.append("gv")
        cs += keep
        c.append(f"{p}_c AS (SELECT {', '.join(cs)} FROM {p}_d CROSS JOIN {p}_m)")
        sums = ["sum(yc*yc) AS syy"] + [f"sum(c{i}*yc) AS sy{i}" for i in range(k)]
        sums += [f"sum(c{i}*c{j}) AS a{i}_{j}" for i in range(k) for j in range(k)]
        c.append(f"{p}_s AS (SELECT * FROM (SELECT {', '.join(sums)} FROM {p}_c) CROSS JOIN {p}_m)")
        carry = ["n", "my", "syy"] + [f"mx{i}" for i in range(k)] + [f"sy{i}" for i in range(k)]
        # Gauss-Jordan on [A | I]
        prev = f"{p}_s"
        ident = [f"CAST({1.0 if i == j else 0.0} AS DOUBLE) AS b{i}_{j}" for i in range(k) for j in range(k)]
        c.append(f"{p}_g0 AS (SELECT {', '.join(carry)}, "
                 + ", ".join(f"a{i}_{j}" for i in range(k) for j in range(k)) + ", "
                 + ", ".join(ident) + f" FROM {prev})")
        for t in range(k):
            cols = []
            for i in range(k):
                for j in range(k):
                    for m in ("a", "b"):
                        if i == t:
                            cols.append(f"{m}{t}_{j} / a{t}_{t} AS {m}{i}_{j}")
                        else:
                            cols.append(f"{m}{i}_{j} - a{i}_{t} * ({m}{t}_{j} / a{t}_{t}) AS {m}{i}_{j}")
            c.append(f"{p}_g{t + 1} AS (SELECT {', '.join(carry)}, {', '.join(cols)} FROM {p}_g{t})")
        inv = [f"b{i}_{j} AS i{i}_{j}" for i in range(k) for j in range(k)]
        betas = [" + ".join(f"b{i}_{j} * sy{j}" for j in range(k)) + f" AS be{i}" for i in range(k)]
        c.append(f"{p}_b AS (SELECT {', '.join(carry)}, {', '.join(inv)}, {', '.join(betas)} FROM {p}_g{k})")
        e = "yc - (" + " + ".join(f"be{i} * c{i}" for i in range(k)) + ")"
        h = "1.0 / n + " + " + ".join(f"i{i}_{j} * c{i} * c{j}" for i in range(k) for j in range(k))
        rc = ["yc"] + [f"c{i}" for i in range(k)] + (["gv"] if groups else []) + keep
        c.append(f"{p}_r AS (SELECT {', '.join(rc)}, {e} AS e, {h} AS h FROM {p}_c CROSS JOIN {p}_b)")
        z = ["1.0"] + [f"c{i}" for i in range(k)]
        if cov in ("HC3", "HC0", "HC1", "HC2"):
            w = {"HC3": "((e / (1 - h)) * (e / (1 - h)))", "HC2": "(e * e / (1 - h))"}.get(cov, "(e * e)")
            ms = [f"sum({w} * {z[a]} * {z[b]}) AS m{a}_{b}" for a in range(k + 1) for b in range(k + 1)]
            c.append(f"{p}_mt AS (SELECT sum(e*e) AS sse, count(*) AS gg, {', '.join(ms)} FROM {p}_r)")
        elif cov == "cluster":
            us = [f"sum(e * {z[a]}) AS u{a}" for a in range(k + 1)]
            c.append(f"{p}_u AS (SELECT gv, {', '.join(us)} FROM {p}_r GROUP BY gv)")
            ms = [f"sum(u{a} * u{b}) AS m{a}_{b}" for a in range(k + 1) for b in range(k + 1)]
            c.append(f"{p}_mt AS (SELECT * FROM (SELECT count(*) AS gg, {', '.join(ms)} FROM {p}_u) "
                     f"CROSS JOIN (SELECT sum(e*e) AS sse FROM {p}_r))")
        elif cov == "classical":
            c.append(f"{p}_mt AS (SELECT sum(e*e) AS sse, count(*) AS gg FROM {p}_r)")
        else:
            raise ValueError(cov)
        pp = k + 1
        # covariance of the centred parametrisation
        vs = []
        if cov == "classical":
            s2 = f"(sse / (n - {pp}))"
            vs.append(f"{s2} / n AS v0_0")
            for j in range(k):
                vs.append(f"0.0 AS v0_{j + 1}")
                for i in range(k):
                    vs.append(f"{s2} * i{i}_{j} AS v{i + 1}_{j + 1}")
        else:
            fac = "1.0"
            if cov == "HC1":
                fac = f"(n * 1.0 / (n - {pp}))"
            if cov == "cluster":
                fac = f"((gg * 1.0 / (gg - 1)) * ((n - 1.0) / (n - {pp})))"
            vs.append(f"{fac} * m0_0 / (n * n) AS v0_0")
            for j in range(k):
                vs.append(f"{fac} * (" + " + ".join(f"m0_{l + 1} * i{l}_{j}" for l in range(k)) + f") / n AS v0_{j + 1}")
                for i in range(k):
                    vs.append(f"{fac} * (" + " + ".join(f"i{i}_{l} * m{l + 1}_{q + 1} * i{q}_{j}"
                                                        for l in range(k) for q in range(k)) + f") AS v{i + 1}_{j + 1}")
        b0 = "my - (" + " + ".join(f"mx{i} * be{i}" for i in range(k)) + ")"
        c.append(f"{p}_v AS (SELECT *, {b0} AS be_c, {', '.join(vs)} FROM {p}_b CROSS JOIN {p}_mt)")
        var0 = ("v0_0 - 2 * (" + " + ".join(f"mx{j} * v0_{j + 1}" for j in range(k)) + ") + ("
                + " + ".join(f"mx{i} * mx{j} * v{i + 1}_{j + 1}" for i in range(k) for j in range(k)) + ")")
        c.append(f"{p}_f AS (SELECT *, {var0} AS var_c FROM {p}_v)")
        self.ctes = c
        self.final = f"{p}_f"

    def coef(self, i: int) -> str:
        return "be_c" if i == 0 else f"be{i - 1}"

    def se(self, i: int) -> str:
        return "sqrt(var_c)" if i == 0 else f"sqrt(v{i}_{i})"

    def rows(self, model_id: str, terms: list[str], dc: int = 8, dz: int = 6, with_p: bool = False) -> str:
        """UNION ALL of (model_id, term, coef, se, z[, p]) rows, rounded."""
        out = []
        for i, t in enumerate(["const", *terms]):
            out.append(f"SELECT '{model_id}' AS model_id, '{t}' AS term, {_r(self.coef(i), dc)} AS coef, "
                       f"{_r(self.se(i), dc)} AS se, {_r(self.coef(i) + '/' + self.se(i), dz)} AS z"
                       + (f", {_r(normal_p(self.coef(i) + '/' + self.se(i)), dc)} AS p" if with_p else "")
                       + f" FROM {self.final}")
        return "\nUNION ALL\n".join(out)

    def fit_row(self, model_id: str, d: int = 8) -> str:
        """(model_id, n_used, r2, adj_r2, ll, aic, bic)."""
        pp = self.k + 1
        ll = "(-0.5 * n * (ln(2 * pi()) + ln(sse / n) + 1))"
        return (f"SELECT '{model_id}' AS model_id, n AS n_used, {_r('1 - sse / syy', d)} AS r2, "
                f"{_r(f'1 - (sse / syy) * (n - 1) / (n - {pp})', d)} AS adj_r2, "
                f"{_r(ll, 6)} AS ll, {_r(f'-2 * {ll} + 2 * {pp}', 6)} AS aic, "
                f"{_r(f'-2 * {ll} + {pp} * ln(n)', 6)} AS bic FROM {self.final}")


def ols_query(base_with, models: list[tuple], extra_ctes: str = "", dc: int = 8, dz: int = 6,
              kind: str = "coef", with_p: bool = False) -> str:
    """``models``: (model_id, src, y, xs, cov, groups[, where]) tuples."""
    ctes, rows = [], []
    for j, m in enumerate(models):
        mid, src, y, xs, cov, groups = m[:6]
        where = m[6] if len(m) > 6 else None
        o = Ols(f"q{j}", src, y, xs, cov, groups, where)
        ctes += o.ctes
        rows.append(o.rows(mid, [t if isinstance(t, str) else t for t in _names(xs)], dc, dz, with_p)
                    if kind == "coef" else o.fit_row(mid))
    allc = (extra_ctes + ",\n" if extra_ctes.strip() else "") + ",\n".join(ctes)
    return base_with(allc, "\nUNION ALL\n".join(rows))


def _names(xs: list[str]) -> list[str]:
    return [x.split(" AS ")[-1] if " AS " in x else x for x in xs]


# ---------------------------------------------------------------- GLM (k = 1)

def _glm_mu(fam: str, eta: str) -> str:
    return f"(1.0 / (1.0 + exp(-({eta}))))" if fam == "binomial" else f"exp({eta})"


def _glm_link(fam: str, mu: str) -> str:
    return f"ln(({mu}) / (1.0 - ({mu})))" if fam == "binomial" else f"ln({mu})"


def _glm_wz(fam: str) -> tuple[str, str]:
    """(working weight, working response) in terms of y, mu, eta."""
    if fam == "binomial":
        return "mu * (1.0 - mu)", "eta + (y - mu) / (mu * (1.0 - mu))"
    if fam == "poisson":
        return "mu", "eta + (y - mu) / mu"
    return "1.0", "eta + (y - mu) / mu"


def _glm_dev(fam: str, mu: str) -> str:
    if fam == "binomial":
        return (f"2.0 * ((CASE WHEN y > 0 THEN y * ln(y / {mu}) ELSE 0 END) + "
                f"(CASE WHEN y < 1 THEN (1.0 - y) * ln((1.0 - y) / (1.0 - {mu})) ELSE 0 END))")
    if fam == "poisson":
        return f"2.0 * ((CASE WHEN y > 0 THEN y * ln(y / {mu}) ELSE 0 END) - (y - {mu}))"
    return f"2.0 * (-ln(y / {mu}) + (y - {mu}) / {mu})"


class Glm:
    """Unrolled Newton/IRLS for one GLM with one predictor."""

    def __init__(self, p: str, src: str, y: str, x: str, fam: str, raw: str, y_scale: float = 1.0,
                 steps: int = 25, where: str | None = None):
        self.p = p
        cond = f"({y}) IS NOT NULL AND ({x}) IS NOT NULL" + (f" AND ({where})" if where else "")
        c = [f"{p}_d AS (SELECT ({y}) AS y, ({x}) AS x, ({raw}) AS yraw FROM {src} WHERE {cond})",
             f"{p}_b0 AS (SELECT {_glm_link(fam, 'avg(y)')} AS b0, 0e0 AS b1, avg(y) AS ybar, count(*) AS n FROM {p}_d)"]
        w, zz = _glm_wz(fam)
        for k in range(1, steps + 1):
            inner = (f"SELECT d.x, d.y, b.b0 + b.b1 * d.x AS eta, b.ybar, b.n FROM {p}_d d CROSS JOIN {p}_b{k - 1} b")
            mu = f"SELECT x, y, eta, ybar, n, {_glm_mu(fam, 'eta')} AS mu FROM ({inner})"
            wz = f"SELECT x, ybar, n, {w} AS w, {zz} AS zz FROM ({mu})"
            s = (f"SELECT sum(w) AS s00, sum(w * x) AS s01, sum(w * x * x) AS s11, sum(w * zz) AS r0, "
                 f"sum(w * x * zz) AS r1, any_value(ybar) AS ybar, any_value(n) AS n FROM ({wz})")
            c.append(f"{p}_b{k} AS MATERIALIZED (SELECT (s11 * r0 - s01 * r1) / (s00 * s11 - s01 * s01) AS b0, "
                     f"(s00 * r1 - s01 * r0) / (s00 * s11 - s01 * s01) AS b1, ybar, n FROM ({s}))")
        last = f"{p}_b{steps}"
        if fam == "binomial":
            bw, sf = "mu * (1.0 - mu)", "(y - mu)"
            ll = "(-lgamma(y + 1.0) - lgamma(2.0 - y) + y * ln(mu / (1.0 - mu)) + ln(1.0 - mu))"
        elif fam == "poisson":
            bw, sf = "mu", "(y - mu)"
            ll = "(y * ln(mu) - mu - lgamma(y + 1.0))"
        else:
            bw, sf = "y / mu", "((y - mu) / mu)"
            ll = "0.0"
        var = {"binomial": "mu * (1.0 - mu)", "poisson": "mu", "gamma": "mu * mu"}[fam]
        rows = (f"SELECT d.x, d.y, d.yraw, b.b0, b.b1, b.ybar, b.n, {_glm_mu(fam, 'b.b0 + b.b1 * d.x')} AS mu "
                f"FROM {p}_d d CROSS JOIN {last} b")
        c.append(f"{p}_fin AS (SELECT any_value(b0) AS b0, any_value(b1) AS b1, any_value(n) AS n, "
                 f"sum({bw}) AS a00, sum({bw} * x) AS a01, sum({bw} * x * x) AS a11, "
                 f"sum({sf} * {sf}) AS q00, sum({sf} * {sf} * x) AS q01, sum({sf} * {sf} * x * x) AS q11, "
                 f"sum({_glm_dev(fam, 'mu')}) AS dev, sum({_glm_dev(fam, 'ybar')}) AS dev0, "
                 f"sum((y - mu) * (y - mu) / ({var})) AS chi, sum({ll}) AS ll, "
                 f"sum(ln(y / mu)) AS lym, sum(y / mu) AS ym, sum(ln(y)) AS ly, "
                 f"avg((yraw - mu / {y_scale!r}) * (yraw - mu / {y_scale!r})) AS mse FROM ({rows}))")
        det = "(a00 * a11 - a01 * a01)"
        i00, i01, i11 = f"(a11 / {det})", f"(-a01 / {det})", f"(a00 / {det})"
        v00 = f"({i00} * {i00} * q00 + 2 * {i00} * {i01} * q01 + {i01} * {i01} * q11)"
        v11 = f"({i01} * {i01} * q00 + 2 * {i01} * {i11} * q01 + {i11} * {i11} * q11)"
        if fam == "gamma":
            sc = "(chi / (n - 2))"
            llf = f"((1.0 / {sc}) * (ln(1.0 / {sc}) * n + lym) - (1.0 / {sc}) * ym - n * lgamma(1.0 / {sc}) - ly)"
        else:
            llf = "ll"
        c.append(f"{p}_f AS (SELECT *, {v00} AS v00, {v11} AS v11, {llf} AS llf FROM {p}_fin)")
        self.ctes = c
        self.final = f"{p}_f"

    def rows(self, model_id: str, term: str, dc: int = 8, dz: int = 6) -> str:
        f = self.final
        return (f"SELECT '{model_id}' AS model_id, 'const' AS term, round(b0, {dc}) AS coef, "
                f"round(sqrt(v00), {dc}) AS se, round(b0 / sqrt(v00), {dz}) AS z FROM {f}\nUNION ALL\n"
                f"SELECT '{model_id}', '{term}', round(b1, {dc}), round(sqrt(v11), {dc}), "
                f"round(b1 / sqrt(v11), {dz}) FROM {f}")
