"""SURVEY §5.5: NaN, NULL, all-NULL column, constant predictor, n <= p,
empty table -- every operator returns a status or NULLs, never crashes."""

import pytest

from regframe.operators import describe as D
from regframe.operators.glm import GLMSpec, fit_glm
from regframe.operators.linear import ModelSpec, fit_ols
from regframe.operators.mediation import mediation


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(1.0, 0.10, None, 5.0, 0.2), (2.0, 0.20, None, 5.0, 0.3), (float("nan"), 0.30, None, 5.0, 0.4),
            (4.0, None, None, 5.0, 0.5), (5.0, 0.50, None, 5.0, 0.6), (6.0, 0.45, None, 5.0, 0.7)]
    return spark.createDataFrame(rows, "x double, y double, allnull double, const double, p double")


def test_ols_statuses(edge):
    r = fit_ols(edge, [ModelSpec("ok", "y", ["x"]), ModelSpec("const", "y", ["const"]),
                       ModelSpec("allnull", "y", ["allnull"]), ModelSpec("np", "y", ["x", "p", "const"])])
    st = {x["model_id"]: x["status"] for x in r.fit.collect()}
    assert st["ok"] == "ok" and st["const"] == "singular" and st["allnull"] == "insufficient"
    assert st["np"] in ("singular", "insufficient")
    assert {x["model_id"] for x in r.coef.collect()} == {"ok"}


def test_ols_empty_table(edge):
    r = fit_ols(edge.where("x > 100"), [ModelSpec("m", "y", ["x"])])
    f = r.fit.first()
    assert f["status"] == "insufficient" and f["n_used"] == 0 and r.coef.count() == 0


def test_glm_statuses(edge):
    r = fit_glm(edge, [GLMSpec("ok", "p", ["x"], "binomial"), GLMSpec("allnull", "p", ["allnull"], "binomial"),
                       GLMSpec("empty", "p", ["x"], "gamma")], check_domain=False)
    st = {x["model_id"]: x["status"] for x in r.fit.collect()}
    assert st["ok"] == "ok" and st["allnull"] == "insufficient"
    e = fit_glm(edge.where("x > 100"), [GLMSpec("m", "p", ["x"], "poisson")]).fit.first()
    assert e["status"] == "insufficient"


def test_describe_and_corr_degenerate(edge):
    d = {x["variable"]: x for x in D.descriptives(edge, ["x", "allnull", "const"]).collect()}
    assert d["x"]["n"] == 5 and d["allnull"]["n"] == 0 and d["allnull"]["mean"] is None
    assert d["const"]["sd"] == 0.0
    c = {(x["var_i"], x["var_j"]): x for x in D.corr_pairwise(edge, ["x", "allnull", "const"]).collect()}
    assert c[("x", "allnull")]["n"] == 0 and c[("x", "allnull")]["r"] is None
    assert c[("x", "const")]["r"] is None
    empty = edge.where("x > 100")
    assert D.descriptives(empty, ["x"]).first()["n"] == 0
    assert D.corr_pairwise(empty, ["x", "y"]).first()["n"] == 0


def test_mediation_insufficient_raises_clearly(edge):
    with pytest.raises(ValueError):
        mediation(edge, "x", "allnull", "y")
