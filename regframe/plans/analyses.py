"""The named analyses as compositions of operators.

Each function takes the analytical samples (``task_level``,
``cluster_level``) and returns result DataFrames with a ``model_id``
column. Models that share a table are fused into one battery (two or three
Spark jobs for the whole battery, whatever its size).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import TECH_KEYWORDS, concat_names, keyword_flag
from ..operators.describe import simple_linreg
from ..operators.linear import ModelSpec, OLSFit, fit_ols
from ..operators.mediation import mediation, moderation_frame

# The variable lists, samples and control sets of the reference's
# named analyses, which its published results depend on.
SHARE = "task_conversation_share"
TASK_VARS = [SHARE, "directive", "feedback_loop", "task_iteration", "learning", "validation",
             "automation_index", "augmentation_index", "risk_management_index", "thinking_fraction"]
CLUSTER_VARS = [SHARE, "cluster_directive", "cluster_feedback_loop", "cluster_task_iteration",
                "cluster_learning", "cluster_validation", "cluster_automation_index",
                "cluster_augmentation_index", "cluster_risk_management_index",
                "cluster_thinking_fraction", "percent_users", "percent_records"]
TASK_CORR_VARS = TASK_VARS
CLUSTER_CORR_VARS = [SHARE, "cluster_automation_index", "cluster_augmentation_index",
                     "cluster_risk_management_index", "cluster_thinking_fraction",
                     "percent_users", "percent_records"]
THINK = "cluster_thinking_fraction"
CAUG = "cluster_augmentation_index"
CAUTO = "cluster_automation_index"


# The regressions behind the reference's figures (model, level, x, y, log of y).
FIGURES = [("fig1_linear", "task", "augmentation_index", SHARE, False),
           ("fig1_log", "task", "augmentation_index", SHARE, True),
           ("fig2_h2a", "task", "risk_management_index", SHARE, False),
           ("fig3_h3", "cluster", CAUG, THINK, False)]


def figure_regressions(task_level: DataFrame, cluster_level: DataFrame) -> DataFrame:
    """``model_id, b0, b1, r2, r, n`` of every figure's simple regression."""
    out = None
    for name, level, x, y, log_y in FIGURES:
        r = simple_linreg(task_level if level == "task" else cluster_level, x, y, log_y)
        r = r.select(F.lit(name).alias("model_id"), "*")
        out = r if out is None else out.unionByName(r)
    return out


def h1_specs(cov: str = "HC3") -> list[ModelSpec]:
    return [ModelSpec("1a", SHARE, ["augmentation_index"], cov),
            ModelSpec("1b", SHARE, ["task_iteration", "learning"], cov),
            ModelSpec("1c", SHARE, ["augmentation_index"], cov, log_y=True)]


def h2_specs(cov: str = "HC3") -> list[ModelSpec]:
    return [ModelSpec("2a", SHARE, ["risk_management_index"], cov),
            ModelSpec("2b", "directive", ["risk_management_index"], cov),
            ModelSpec("2c", "task_iteration", ["risk_management_index"], cov)]


def plan_h1(task_level: DataFrame) -> OLSFit:
    """M7: H1 1a / 1b / 1c (log-linear), HC3."""
    return fit_ols(task_level, h1_specs())


def plan_h2(task_level: DataFrame) -> OLSFit:
    """M8: H2a-c, HC3."""
    return fit_ols(task_level, h2_specs())


def plan_task_models(task_level: DataFrame) -> OLSFit:
    """H1 and H2 fused: six models, one table, two Spark jobs."""
    return fit_ols(task_level, h1_specs() + h2_specs())


def h3_sample(cluster_level: DataFrame) -> DataFrame:
    return cluster_level.na.drop(subset=[THINK])


def plan_h3(cluster_level: DataFrame) -> OLSFit:
    """M9: thinking ~ cluster augmentation, HC3."""
    return fit_ols(h3_sample(cluster_level), [ModelSpec("3", THINK, [CAUG])])


def plan_h4(cluster_level: DataFrame) -> OLSFit:
    """Thinking ~ automation + augmentation, HC3."""
    return fit_ols(h3_sample(cluster_level), [ModelSpec("4", THINK, [CAUTO, CAUG])])


def plan_h5(cluster_level: DataFrame) -> DataFrame:
    """Mediation augmentation -> thinking -> share (HC3, Sobel, Baron-Kenny)."""
    return mediation(h3_sample(cluster_level), "augmentation_index", THINK, SHARE)


def h6_frame(cluster_level: DataFrame) -> DataFrame:
    return moderation_frame(cluster_level, CAUG, THINK, "percent_users")


def h6_specs(cov: str = "HC3", groups: str | None = None, centered_a: bool = False) -> list[ModelSpec]:
    xa, wa = ("aug_c", "thk_c") if centered_a else (CAUG, THINK)
    return [ModelSpec("6a", "percent_users", [xa], cov, groups),
            ModelSpec("6b", "percent_users", [xa, wa], cov, groups),
            ModelSpec("6c", "percent_users", ["aug_c", "thk_c", "interaction"], cov, groups)]


def plan_h6(cluster_level: DataFrame) -> OLSFit:
    """Hierarchical moderation 6a / 6b / 6c, HC3."""
    return fit_ols(h6_frame(cluster_level), h6_specs())


def robustness_ols(cluster_level: DataFrame) -> OLSFit:
    """M13 (OLS part): H3 with added controls, HC3, listwise per spec."""
    d = h3_sample(cluster_level)
    return fit_ols(d, [ModelSpec("h3_ctrl_users", THINK, [CAUG, "percent_users"]),
                       ModelSpec("h3_ctrl_records", THINK, [CAUG, "percent_records"])])


def cooks_trim(cluster_level: DataFrame, y: str = THINK, x: list[str] | None = None,
               factor: float = 4.0, min_rows: int = 10) -> tuple[OLSFit, OLSFit | None, int, float]:
    """Classical fit, Cook's D > factor/n excluded, HC3 refit on
    the rest (only if more than ``min_rows`` remain). Returns (classical fit,
    refit or None, n_excluded, threshold)."""
    x = x or [CAUG]
    d = cluster_level.na.drop(subset=[y, *x])
    full = fit_ols(d, [ModelSpec("full", y, x, cov="classical")])
    m = full["full"]
    thr = factor / m.n
    flagged = d.withColumn("cooks_d", m.cooks_distance())
    kept = flagged.filter(F.col("cooks_d") <= F.lit(thr)).drop("cooks_d").persist()
    n_kept = kept.count()
    refit = None
    if n_kept > min_rows:
        refit = fit_ols(kept, [ModelSpec("trimmed", y, x)])
    kept.unpersist()
    return full, refit, m.n - n_kept, thr


def clustered_battery(cluster_level: DataFrame) -> OLSFit:
    """M15 part 1 / L4 / L5 / N9: H3 with HC3, clustered by task and by the
    level-1 cluster name; H4 HC3 and clustered by task. One battery."""
    d = h3_sample(cluster_level)
    h3 = d.na.drop(subset=[CAUG])
    return fit_ols(h3.select(THINK, CAUG, CAUTO, "task_name", "cluster_name_1"), [
        ModelSpec("h3_hc3", THINK, [CAUG]),
        ModelSpec("h3_cl_task", THINK, [CAUG], "cluster", "task_name"),
        ModelSpec("h3_cl_name1", THINK, [CAUG], "cluster", "cluster_name_1"),
        ModelSpec("h4_hc3", THINK, [CAUTO, CAUG]),
        ModelSpec("h4_cl_task", THINK, [CAUTO, CAUG], "cluster", "task_name")])


def h6_clustered(cluster_level: DataFrame) -> OLSFit:
    """H6 a/b/c with centred predictors, clustered by task."""
    d = moderation_frame(h3_sample(cluster_level), CAUG, THINK, "percent_users")
    return fit_ols(d, h6_specs("cluster", "task_name", centered_a=True))


def with_technical_domain(df: DataFrame, keywords=TECH_KEYWORDS) -> DataFrame:
    """Lower-cased name text and the 0/1 keyword flag."""
    text = concat_names(["cluster_name_0", "cluster_name_1", "cluster_name_2"])
    return df.withColumn("name_text", text).withColumn("technical_domain", keyword_flag(F.col("name_text"), keywords))


CTRL_SETS = [
    ("ctrl_tech", [CAUG, "technical_domain"]),
    ("ctrl_feedback", [CAUG, "cluster_feedback_loop"]),
    ("ctrl_volume", [CAUG, "percent_records", "percent_users"]),
    ("ctrl_full", [CAUG, "technical_domain", "cluster_feedback_loop", "percent_records", "percent_users"]),
]


def proxies_battery(cluster_level: DataFrame, keywords=TECH_KEYWORDS) -> OLSFit:
    """M15 part 3 / N5: H3 with complexity proxies, clustered by task,
    listwise deletion per control set."""
    d = with_technical_domain(h3_sample(cluster_level).na.drop(subset=[CAUG]), keywords)
    return fit_ols(d, [ModelSpec(mid, THINK, cols, "cluster", "task_name") for mid, cols in CTRL_SETS])


def task_complete_case(task_level: DataFrame) -> DataFrame:
    """C11: the common complete-case sample of the estimator comparison."""
    return task_level.na.drop(subset=[SHARE, "augmentation_index", "risk_management_index",
                                      "task_iteration", "learning"])


# N6 (OLS part): H1 log-linear, H1 components, H2a OLS and log-linear
TRIMMED_SPECS = [ModelSpec("t_h1_log", SHARE, ["augmentation_index"], log_y=True),
                 ModelSpec("t_h1_comp", SHARE, ["task_iteration", "learning"]),
                 ModelSpec("t_h2a", SHARE, ["risk_management_index"]),
                 ModelSpec("t_h2a_log", SHARE, ["risk_management_index"], log_y=True)]


# ------------------------------------------------------------------ GLM suites

def glm_suite_specs(x: str, prefix: str = "") -> list:
    from ..operators.glm import GLMSpec
    return [GLMSpec(f"{prefix}frac_logit", SHARE, [x], "binomial", y_scale=0.01),
            GLMSpec(f"{prefix}gamma_log", SHARE, [x], "gamma"),
            GLMSpec(f"{prefix}poisson_log", SHARE, [x], "poisson")]


def glm_battery(task_level: DataFrame, ids: list[str] | None = None):
    """G1-G3 for both predictors of the estimator comparison (or the listed
    models), fused: one job per Newton step for all of them."""
    from ..operators.glm import fit_glm
    d = task_complete_case(task_level)
    specs = glm_suite_specs("augmentation_index", "aug_") + glm_suite_specs("risk_management_index", "risk_")
    return fit_glm(d, [s for s in specs if ids is None or s.model_id in ids])


def log_linear_rmse(df: DataFrame, fitres: OLSFit, mid: str) -> float:
    """Raw-scale RMSE of a log-linear fit via Duan smearing
    (``exp(fitted) * mean(exp(resid))``); two small aggregations."""
    m = fitres[mid]
    d = df.na.drop(subset=[m.spec.y, *m.spec.x])
    smear = d.agg(F.avg(F.exp(m.resid())).alias("s")).first()["s"]
    yhat = F.exp(m.fitted()) * F.lit(float(smear))
    mse = d.agg(F.avg((F.col(m.spec.y) - yhat) * (F.col(m.spec.y) - yhat)).alias("m")).first()["m"]
    return float(smear), float(mse) ** 0.5


def model_comparison(task_level: DataFrame, glm=None, glm_prefix: str = "") -> DataFrame:
    """OLS, log-linear OLS, fractional logit, Gamma and Poisson on
    one complete-case sample: AIC, BIC, (pseudo-)R^2, raw-scale RMSE.
    ``glm``: an already fitted battery holding the three GLMs on the same
    sample (ids ``<glm_prefix>frac_logit`` ...), to avoid refitting."""
    import math
    d = task_complete_case(task_level).persist()
    o = fit_ols(d, [ModelSpec("ols_raw", SHARE, ["augmentation_index"]),
                    ModelSpec("log_linear", SHARE, ["augmentation_index"], log_y=True)])
    _, rmse_log = log_linear_rmse(d, o, "log_linear")
    if glm is None:
        from ..operators.glm import fit_glm
        glm, glm_prefix = fit_glm(d, glm_suite_specs("augmentation_index")), ""
    g = glm
    rows = []
    for mid in ("ols_raw", "log_linear"):
        m = o[mid]
        n, p = m.n, m.p
        ll = -0.5 * n * (math.log(2 * math.pi) + math.log(m.ssr / n) + 1.0)
        rmse = math.sqrt(m.ssr / n) if mid == "ols_raw" else rmse_log
        rows.append((mid, -2 * ll + 2 * p, -2 * ll + p * math.log(n), 1.0 - m.ssr / m.syy, rmse))
    for mid in ("frac_logit", "gamma_log", "poisson_log"):
        s = g[glm_prefix + mid].stats
        rows.append((mid, s["aic"], s["bic"], s["pseudo_r2"], s["rmse_raw"]))
    d.unpersist()
    return task_level.sparkSession.createDataFrame(
        [(a, float(b), float(c), float(e), float(f)) for a, b, c, e, f in rows],
        "model_id string, aic double, bic double, r2 double, rmse_raw double")


def trimmed_battery(task_level: DataFrame, threshold: float | None = None, factor: float = 1.5):
    """Drop share > threshold (default ``factor`` x the sample mean),
    re-estimate H1 log-linear, H1 components, H2a OLS and log-linear, and
    the H1 fractional logit. Returns (OLSFit, GLMFit, threshold, n_excluded)."""
    from ..operators.glm import GLMSpec, fit_glm
    d = task_complete_case(task_level)
    if threshold is None:
        threshold = factor * d.agg(F.avg(SHARE).alias("m")).first()["m"]
    flagged = d.withColumn("__hi", F.col(SHARE) > F.lit(float(threshold)))
    cnt = flagged.agg(F.count_if("__hi").alias("x")).first()["x"]
    kept = flagged.filter(~F.col("__hi")).drop("__hi").persist()
    o = fit_ols(kept, TRIMMED_SPECS)
    g = fit_glm(kept, [GLMSpec("t_h1_frac", SHARE, ["augmentation_index"], "binomial", y_scale=0.01)])
    kept.unpersist()
    return o, g, float(threshold), int(cnt)


# ------------------------------------------------------------------ bootstrap

N_BOOT = 5000
SEED = 42


def h5_sample(cluster_level: DataFrame) -> DataFrame:
    return h3_sample(cluster_level).na.drop(subset=["augmentation_index", SHARE])


def plan_bootstrap(cluster_level: DataFrame, B: int = N_BOOT, seed: int = SEED,
                   row_key: str = "cluster_name_0", group: str = "task_name") -> DataFrame:
    """M15 part 2 / O4-O6: IID and task-cluster bootstrap intervals of the
    H5 indirect effect, one row per scheme."""
    from ..operators.bootstrap import boot_ci, boot_replicates
    d = h5_sample(cluster_level)
    out = None
    for scheme, kw in (("iid", {"key": row_key}), ("cluster", {"group": group})):
        reps = boot_replicates(d, "augmentation_index", THINK, SHARE, B, seed, scheme, **kw)
        r = boot_ci(reps).select(F.lit(scheme).alias("scheme"), "*")
        out = r if out is None else out.unionByName(r)
    return out
