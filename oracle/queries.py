"""DuckDB oracle SQL, one string per registered query key.

Written against the fixture views and the SQL build in ``views.py``; models
through the generators in ``sqlgen.py``. Rounding matches the Spark side.
"""

from __future__ import annotations

from .sqlgen import Ols, f_p, normal_p, ols_query
from .views import with_base as W

# The variable lists of the reference's named analyses.
SHARE = "task_conversation_share"
TASK_VARS = [SHARE, "directive", "feedback_loop", "task_iteration", "learning", "validation",
             "automation_index", "augmentation_index", "risk_management_index", "thinking_fraction"]
CLUSTER_VARS = [SHARE, "cluster_directive", "cluster_feedback_loop", "cluster_task_iteration",
                "cluster_learning", "cluster_validation", "cluster_automation_index",
                "cluster_augmentation_index", "cluster_risk_management_index",
                "cluster_thinking_fraction", "percent_users", "percent_records"]
CLUSTER_CORR_VARS = [SHARE, "cluster_automation_index", "cluster_augmentation_index",
                     "cluster_risk_management_index", "cluster_thinking_fraction",
                     "percent_users", "percent_records"]
THINK = "cluster_thinking_fraction"
CAUG = "cluster_augmentation_index"
CAUTO = "cluster_automation_index"

TASK_BASE_COLS = ["task_name", SHARE, "directive", "feedback_loop", "task_iteration", "learning",
                  "validation", "filtered", "thinking_fraction", "automation_index", "augmentation_index",
                  "risk_management_index"]
CLUSTER_COLS = ["task_name", "cluster_name_0", "cluster_name_1", "cluster_name_2", "cluster_directive",
                "cluster_feedback_loop", "cluster_task_iteration", "cluster_learning", "cluster_validation",
                "cluster_none", "cluster_thinking_fraction", "percent_records", "percent_users",
                "cluster_automation_index", "cluster_augmentation_index", "cluster_risk_management_index"]
STRINGS = {"task_name", "cluster_name_0", "cluster_name_1", "cluster_name_2"}


def _sel_round(cols: list[str], d: int = 8) -> str:
    return ", ".join(c if c in STRINGS else f"round({c}, {d}) AS {c}" for c in cols)


Q: dict[str, str] = {}

Q["source_profile"] = W("", """
SELECT 'task_pct' AS source, count(*) AS n_rows, 2::BIGINT AS n_cols FROM fx_task_pct
UNION ALL SELECT 'interaction', count(*), 7::BIGINT FROM fx_interaction
UNION ALL SELECT 'thinking', count(*), 2::BIGINT FROM fx_thinking
UNION ALL SELECT 'clusters', count(*), 13::BIGINT FROM fx_clusters""")

Q["normalize_key"] = W("", r"""
SELECT cluster_name_0, onet_task, regexp_replace(lower(onet_task), '^\s+|\s+$', '', 'g') AS task_name
FROM fx_clusters""")

Q["outer_join_indicator"] = W("", """
SELECT task_name, merge_status, round(pct, 8) AS pct, round(directive, 8) AS directive FROM outer_ind""")

Q["merge_breakdown"] = W("", "SELECT merge_status, count(*) AS n_rows FROM outer_ind GROUP BY merge_status")

Q["key_gaps"] = W("""
lo AS (SELECT task_name FROM tp WHERE task_name NOT IN (SELECT task_name FROM ia)),
ro AS (SELECT task_name FROM ia WHERE task_name NOT IN (SELECT task_name FROM tp))""", """
SELECT 'left_only' AS side, (SELECT count(*) FROM lo) AS n_keys,
       (SELECT string_agg(task_name, ' | ' ORDER BY task_name) FROM (SELECT task_name FROM lo ORDER BY task_name LIMIT 5)) AS sample
UNION ALL
SELECT 'right_only', (SELECT count(*) FROM ro),
       (SELECT string_agg(task_name, ' | ' ORDER BY task_name) FROM (SELECT task_name FROM ro ORDER BY task_name LIMIT 5))""")

Q["assemble_task_base"] = W("", f"SELECT {_sel_round(TASK_BASE_COLS)} FROM task_base")
Q["task_sample"] = W("", f"SELECT {_sel_round(TASK_BASE_COLS)} FROM task_level")
Q["prepare_clusters"] = W("", f"SELECT {_sel_round(CLUSTER_COLS)} FROM clusters_prep")
Q["integrate_levels"] = W("", f"SELECT {_sel_round(TASK_BASE_COLS + CLUSTER_COLS[1:])} FROM integrated")


def _framed(col: str, text: bool) -> str:
    v = col if text else f"CAST(CAST(round({col} * 1e6) AS DECIMAL(38,0)) AS VARCHAR)"
    return f"coalesce('V' || length({v}) || ':' || {v}, 'N;')"


_TEXT_COLS = {"task_name", "cluster_name_0", "cluster_name_1", "cluster_name_2", "merge_status"}
Q["table_checksum"] = W(
    "hs AS (SELECT md5(" + " || ".join(_framed(c, c in _TEXT_COLS) for c in TASK_BASE_COLS + CLUSTER_COLS[1:])
    + ") AS h FROM integrated)",
    "SELECT count(*) AS n_rows, " + ", ".join(
        f"CAST(sum(('0x' || substr(h, {at}, 15))::BIGINT::HUGEINT) AS VARCHAR) AS sum_{n}" for n, at in (("a", 1), ("b", 16)))
    + " FROM hs")
Q["cluster_sample"] = W("", f"SELECT {_sel_round(TASK_BASE_COLS + CLUSTER_COLS[1:])} FROM cluster_level")

Q["integration_diagnostics"] = W("""
pt AS (SELECT task_name, count(*) AS n, count(cluster_name_0) AS n_cl FROM integrated GROUP BY task_name)""", """
SELECT sum(n)::BIGINT AS rows_total, sum(n_cl)::BIGINT AS rows_with_cluster,
       sum(n - n_cl)::BIGINT AS rows_without_cluster, count(*) AS unique_tasks,
       count(*) FILTER (WHERE n_cl > 0) AS tasks_with_clusters,
       count(*) FILTER (WHERE n_cl < n) AS tasks_without_clusters,
       count(*) FILTER (WHERE n_cl > 1) AS multi_cluster_tasks FROM pt""")

Q["row_counts"] = W("", """
SELECT 'integrated' AS table_name, count(*) AS n_rows FROM integrated
UNION ALL SELECT 'task_level', count(*) FROM task_level
UNION ALL SELECT 'cluster_level', count(*) FROM cluster_level""")

Q["distinct_counts"] = W("", """
SELECT count(DISTINCT task_name) AS unique_tasks,
       count(DISTINCT CASE WHEN cluster_name_0 IS NOT NULL THEN task_name END) AS tasks_with_clusters,
       count(DISTINCT cluster_name_0) AS n_cluster_name_0,
       count(DISTINCT cluster_name_1) AS n_cluster_name_1,
       count(DISTINCT cluster_name_2) AS n_cluster_name_2 FROM integrated""")

Q["multi_map_keys"] = W("", """
SELECT count(*) AS multi_cluster_tasks FROM
  (SELECT task_name FROM cluster_level GROUP BY task_name HAVING count(*) > 1)""")

Q["qc_expectations"] = W("""
pt AS (SELECT task_name, count(*) AS n, count(cluster_name_0) AS n_cl FROM integrated GROUP BY task_name),
act AS (
  SELECT 'integrated_rows' AS check_name, (SELECT sum(n) FROM pt)::BIGINT AS actual, 3612::BIGINT AS expected
  UNION ALL SELECT 'task_level_rows', (SELECT count(*) FROM task_level), 3365
  UNION ALL SELECT 'cluster_level_rows', (SELECT count(*) FROM cluster_level), 593
  UNION ALL SELECT 'unique_tasks', (SELECT count(*) FROM pt), 3365
  UNION ALL SELECT 'tasks_with_clusters', (SELECT count(*) FROM pt WHERE n_cl > 0), 346
  UNION ALL SELECT 'multi_cluster_tasks', (SELECT count(*) FROM pt WHERE n_cl > 1), 94)""", """
SELECT check_name, actual, expected,
       CASE WHEN actual = expected THEN 'PASS' ELSE 'CHECK - expected ' || CAST(expected AS VARCHAR) END AS status
FROM act""")

Q["composite_index"] = W("", """
SELECT task_name, round(directive + feedback_loop, 8) AS automation_index,
       round(task_iteration + learning + validation, 8) AS augmentation_index,
       round(feedback_loop + validation, 8) AS risk_management_index FROM task_base""")

Q["coverage_pct"] = W("", "\nUNION ALL\n".join(
    f"SELECT '{v}' AS variable, count({v}) AS n_present, count(*) AS n_rows, "
    f"round(100e0 * count({v}) / count(*), 8) AS pct_present FROM task_level" for v in TASK_VARS))

Q["keyword_flag"] = W("", """
SELECT cluster_name_0, name_text,
       CASE WHEN contains(name_text, 'build') OR contains(name_text, 'machin') OR contains(name_text, 'auto')
            THEN 1 ELSE 0 END::INTEGER AS technical_domain
FROM (SELECT cluster_name_0,
             lower(coalesce(cluster_name_0, '') || ' ' || coalesce(cluster_name_1, '') || ' '
                   || coalesce(cluster_name_2, '')) AS name_text FROM cluster_level)""")

Q["first_per_key"] = W("", """
SELECT task_name, cluster_name_0, cluster_name_1 FROM (
  SELECT task_name, cluster_name_0, cluster_name_1,
         row_number() OVER (PARTITION BY task_name ORDER BY cluster_name_0) AS rn FROM cluster_level) WHERE rn = 1""")

Q["dense_codes"] = W("", """
SELECT task_name, (dense_rank() OVER (ORDER BY task_name) - 1)::BIGINT AS code
FROM (SELECT DISTINCT task_name FROM cluster_level)""")


def _desc(table: str, variables: list[str]) -> str:
    parts = []
    for v in variables:
        parts.append(
            f"SELECT '{v}' AS variable, count({v}) AS n, round(avg({v}), 8) AS mean, "
            f"round(stddev_samp({v}), 8) AS sd, round(min({v}), 8) AS min, round(max({v}), 8) AS max, "
            f"round(skewness({v}), 6) AS skewness, round(kurtosis({v}), 6) AS kurtosis FROM {table}")
    return W("", "\nUNION ALL\n".join(parts))


Q["descriptives"] = _desc("task_level", TASK_VARS)
Q["descriptives_cluster"] = _desc("cluster_level", CLUSTER_VARS)


def _corr(table: str, variables: list[str]) -> str:
    parts = []
    for i in range(len(variables)):
        for j in range(i + 1, len(variables)):
            a, b = variables[i], variables[j]
            parts.append(
                f"SELECT '{a}' AS var_i, '{b}' AS var_j, n, round(r, 8) AS r, "
                f"round(CASE WHEN n > 2 AND abs(r) < 1 THEN r * sqrt((n - 2) / (1 - r * r)) END, 6) AS t FROM "
                f"(SELECT count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n, corr({a}, {b}) AS r "
                f"FROM {table})")
    return W("", "\nUNION ALL\n".join(parts))


Q["corr_pairwise"] = _corr("task_level", TASK_VARS)
Q["corr_cluster"] = _corr("cluster_level", CLUSTER_CORR_VARS)

_FIG = [("fig1_linear", "task_level", "augmentation_index", SHARE),
        ("fig1_log", "task_level", "augmentation_index", f"ln({SHARE})"),
        ("fig2_h2a", "task_level", "risk_management_index", SHARE),
        ("fig3_h3", "cluster_level", CAUG, THINK)]
Q["simple_linreg"] = W("", "\nUNION ALL\n".join(
    f"SELECT '{m}' AS model_id, round(regr_intercept({y}, {x}), 8) AS b0, round(regr_slope({y}, {x}), 8) AS b1, "
    f"round(regr_r2({y}, {x}), 8) AS r2, round(corr({x}, {y}), 8) AS r, CAST(regr_count({y}, {x}) AS BIGINT) AS n FROM {t}"
    for m, t, x, y in _FIG))

TASK_CC = ("task_cc AS (SELECT * FROM task_level WHERE task_conversation_share IS NOT NULL AND "
           "augmentation_index IS NOT NULL AND risk_management_index IS NOT NULL AND "
           "task_iteration IS NOT NULL AND learning IS NOT NULL)")

Q["share_total"] = W(TASK_CC, "SELECT count(*) AS n, round(sum(task_conversation_share), 8) AS share_total FROM task_cc")
Q["domain_check"] = W(TASK_CC, """
SELECT count(*) AS n,
       count(*) FILTER (WHERE task_conversation_share / 100e0 > 0 AND task_conversation_share / 100e0 < 1) AS n_in_domain,
       bool_and(task_conversation_share / 100e0 > 0 AND task_conversation_share / 100e0 < 1) AS ok FROM task_cc""")
Q["common_sample"] = W(TASK_CC, "SELECT count(*) AS n_common FROM task_cc")
Q["trim_high_share"] = W(TASK_CC + ", thr AS (SELECT 1.5 * avg(task_conversation_share) AS thr FROM task_cc)", """
SELECT round(min(thr), 10) AS threshold, count(*) FILTER (WHERE task_conversation_share > thr) AS n_excluded,
       count(*) FILTER (WHERE task_conversation_share <= thr) AS n_kept FROM task_cc CROSS JOIN thr""")

# ----------------------------------------------------------------------- OLS
H3S = "h3s AS (SELECT * FROM cluster_level WHERE cluster_thinking_fraction IS NOT NULL)"
H3A = "h3a AS (SELECT * FROM h3s WHERE cluster_augmentation_index IS NOT NULL)"

Q["plan_h1"] = ols_query(W, [("1a", "task_level", SHARE, ["augmentation_index"], "HC3", None),
                             ("1b", "task_level", SHARE, ["task_iteration", "learning"], "HC3", None),
                             ("1c", "task_level", f"ln({SHARE})", ["augmentation_index"], "HC3", None)])
Q["ols_hc3_1x"] = ols_query(W, [("1a", "task_level", SHARE, ["augmentation_index"], "HC3", None)])
Q["ols_hc3_2x"] = ols_query(W, [("1b", "task_level", SHARE, ["task_iteration", "learning"], "HC3", None)])
Q["plan_h2"] = ols_query(W, [("2a", "task_level", SHARE, ["risk_management_index"], "HC3", None),
                             ("2b", "task_level", "directive", ["risk_management_index"], "HC3", None),
                             ("2c", "task_level", "task_iteration", ["risk_management_index"], "HC3", None)])
_TASK_MODELS = [("1a", "task_level", SHARE, ["augmentation_index"], "HC3", None),
                ("1b", "task_level", SHARE, ["task_iteration", "learning"], "HC3", None),
                ("1c", "task_level", f"ln({SHARE})", ["augmentation_index"], "HC3", None),
                ("2a", "task_level", SHARE, ["risk_management_index"], "HC3", None),
                ("2b", "task_level", "directive", ["risk_management_index"], "HC3", None),
                ("2c", "task_level", "task_iteration", ["risk_management_index"], "HC3", None)]
Q["fit_stats"] = ols_query(W, _TASK_MODELS, kind="fit")
Q["n_by_model"] = W("", "\nUNION ALL\n".join(
    f"SELECT '{m}' AS model_id, count(*) FILTER (WHERE {y} IS NOT NULL AND "
    + " AND ".join(f"{x} IS NOT NULL" for x in xs)
    + f") AS n_used, count(*) FILTER (WHERE NOT ({y} IS NOT NULL AND "
    + " AND ".join(f"{x} IS NOT NULL" for x in xs) + ")) AS n_dropped FROM task_level"
    for m, _, y, xs, _, _ in _TASK_MODELS))

Q["log_linear"] = W(",\n".join(Ols("q0", "task_level", f"ln({SHARE})", ["augmentation_index"]).ctes), """
SELECT '1c' AS model_id, 'augmentation_index' AS term, round(be0, 8) AS coef, round(sqrt(v1_1), 8) AS se,
       round(be0 / sqrt(v1_1), 6) AS z, round(exp(be0), 6) AS fold_change FROM q0_f""")

Q["ols_classical"] = ols_query(W, [("3_classical", "h3s", THINK, [CAUG], "classical", None)], extra_ctes=H3S)
Q["plan_h3"] = ols_query(W, [("3", "h3s", THINK, [CAUG], "HC3", None)], extra_ctes=H3S)
Q["plan_h4"] = ols_query(W, [("4", "h3s", THINK, [CAUTO, CAUG], "HC3", None)], extra_ctes=H3S)


def _h6_ctes(src: str) -> str:
    return (f"h6d AS (SELECT * FROM {src} WHERE percent_users IS NOT NULL AND {CAUG} IS NOT NULL "
            f"AND {THINK} IS NOT NULL),\n"
            f"h6m AS (SELECT avg({CAUG}) AS ma, avg({THINK}) AS mt FROM h6d),\n"
            f"h6 AS (SELECT h6d.*, {CAUG} - ma AS aug_c, {THINK} - mt AS thk_c, "
            f"({CAUG} - ma) * ({THINK} - mt) AS interaction FROM h6d CROSS JOIN h6m)")


Q["plan_h6"] = ols_query(W, [("6a", "h6", "percent_users", [CAUG], "HC3", None),
                             ("6b", "h6", "percent_users", [CAUG, THINK], "HC3", None),
                             ("6c", "h6", "percent_users", ["aug_c", "thk_c", "interaction"], "HC3", None)],
                         extra_ctes=_h6_ctes("cluster_level"))
Q["moderation_hier"] = ols_query(
    W, [("6a", "h6", "percent_users", ["aug_c"], "cluster", "task_name"),
        ("6b", "h6", "percent_users", ["aug_c", "thk_c"], "cluster", "task_name"),
        ("6c", "h6", "percent_users", ["aug_c", "thk_c", "interaction"], "cluster", "task_name")],
    extra_ctes=H3S + ",\n" + _h6_ctes("h3s"))

Q["ols_cluster_se"] = ols_query(W, [("h3_cl_task", "h3a", THINK, [CAUG], "cluster", "task_name"),
                                    ("h4_cl_task", "h3a", THINK, [CAUTO, CAUG], "cluster", "task_name")],
                                extra_ctes=H3S + ",\n" + H3A)
Q["ols_cluster_se_alt"] = ols_query(W, [("h3_cl_name1", "h3a", THINK, [CAUG], "cluster", "cluster_name_1")],
                                    extra_ctes=H3S + ",\n" + H3A)

_se = [Ols("s0", "h3a", THINK, [CAUG], "HC3"), Ols("s1", "h3a", THINK, [CAUG], "cluster", "task_name"),
       Ols("s2", "h3a", THINK, [CAUG], "cluster", "cluster_name_1")]
Q["se_comparison"] = W(H3S + ",\n" + H3A + ",\n" + ",\n".join(c for o in _se for c in o.ctes), """
SELECT 'const' AS term, round(s0_f.be_c, 8) AS coef, round(sqrt(s0_f.var_c), 8) AS se_hc3,
       round(sqrt(s1_f.var_c), 8) AS se_task, round(sqrt(s2_f.var_c), 8) AS se_name1
FROM s0_f CROSS JOIN s1_f CROSS JOIN s2_f
UNION ALL
SELECT 'cluster_augmentation_index', round(s0_f.be0, 8), round(sqrt(s0_f.v1_1), 8),
       round(sqrt(s1_f.v1_1), 8), round(sqrt(s2_f.v1_1), 8)
FROM s0_f CROSS JOIN s1_f CROSS JOIN s2_f""")

Q["control_battery"] = ols_query(W, [("h3_ctrl_users", "h3s", THINK, [CAUG, "percent_users"], "HC3", None),
                                     ("h3_ctrl_records", "h3s", THINK, [CAUG, "percent_records"], "HC3", None)],
                                 extra_ctes=H3S)

TECH = ("tech AS (SELECT *, CASE WHEN contains(nt, 'build') OR contains(nt, 'machin') OR contains(nt, 'auto') "
        "THEN 1e0 ELSE 0e0 END AS technical_domain FROM (SELECT *, lower(coalesce(cluster_name_0, '') || ' ' || "
        "coalesce(cluster_name_1, '') || ' ' || coalesce(cluster_name_2, '')) AS nt FROM h3a))")
_CTRL = [("ctrl_tech", [CAUG, "technical_domain"]),
         ("ctrl_feedback", [CAUG, "cluster_feedback_loop"]),
         ("ctrl_volume", [CAUG, "percent_records", "percent_users"]),
         ("ctrl_full", [CAUG, "technical_domain", "cluster_feedback_loop", "percent_records", "percent_users"])]
Q["control_battery_clustered"] = ols_query(
    W, [(m, "tech", THINK, xs, "cluster", "task_name") for m, xs in _CTRL],
    extra_ctes=H3S + ",\n" + H3A + ",\n" + TECH)
Q["plan_proxies"] = ols_query(
    W, [(m, "tech", THINK, xs, "cluster", "task_name") for m, xs in _CTRL],
    extra_ctes=H3S + ",\n" + H3A + ",\n" + TECH, kind="fit")

H5S = ("h5 AS (SELECT * FROM h3s WHERE augmentation_index IS NOT NULL AND task_conversation_share IS NOT NULL)")
Q["mediation_paths"] = ols_query(W, [("c", "h5", SHARE, ["augmentation_index"], "HC3", None),
                                     ("a", "h5", THINK, ["augmentation_index"], "HC3", None),
                                     ("b", "h5", SHARE, ["augmentation_index", THINK], "HC3", None)],
                                 extra_ctes=H3S + ",\n" + H5S)

_med = [Ols("mc", "h5", SHARE, ["augmentation_index"]), Ols("ma", "h5", THINK, ["augmentation_index"]),
        Ols("mb", "h5", SHARE, ["augmentation_index", THINK])]
Z = "1.959963984540054"
Q["plan_h5"] = W(H3S + ",\n" + H5S + ",\n" + ",\n".join(c for o in _med for c in o.ctes) + """,
pv AS (SELECT mb_f.n AS n, mc_f.be0 AS c, mc_f.be0 / sqrt(mc_f.v1_1) AS cz, ma_f.be0 AS a,
              sqrt(ma_f.v1_1) AS a_se, ma_f.be0 / sqrt(ma_f.v1_1) AS az, mb_f.be1 AS b, sqrt(mb_f.v2_2) AS b_se,
              mb_f.be1 / sqrt(mb_f.v2_2) AS bz, mb_f.be0 AS cp, mb_f.be0 / sqrt(mb_f.v1_1) AS cpz
       FROM mc_f CROSS JOIN ma_f CROSS JOIN mb_f)""", f"""
SELECT n, round(c, 8) AS c, round(a, 8) AS a, round(b, 8) AS b, round(cp, 8) AS c_prime,
       round(a * b, 8) AS indirect, round(a * b / sqrt(a * a * b_se * b_se + b * b * a_se * a_se), 6) AS sobel_z,
       CASE WHEN abs(cz) > {Z} THEN 'YES' ELSE 'NO' END AS crit_c,
       CASE WHEN abs(az) > {Z} THEN 'YES' ELSE 'NO' END AS crit_a,
       CASE WHEN abs(bz) > {Z} THEN 'YES' ELSE 'NO' END AS crit_b,
       CASE WHEN abs(cp) < abs(c) THEN 'YES' ELSE 'NO' END AS crit_reduced,
       CASE WHEN abs(cpz) <= {Z} AND abs(bz) > {Z} THEN 'full mediation'
            WHEN abs(cp) < abs(c) AND abs(bz) > {Z} THEN 'partial mediation'
            ELSE 'not established' END AS conclusion
FROM pv""")

_ck = Ols("ck", "h3a", THINK, [CAUG], "classical", keep=["cluster_name_0"])
Q["cooks_distance"] = W(H3S + ",\n" + H3A + ",\n" + ",\n".join(_ck.ctes), """
SELECT r.cluster_name_0, round(r.h, 8) AS leverage,
       round(r.e * r.e * r.h / (2 * (f.sse / (f.n - 2)) * (1 - r.h) * (1 - r.h)), 8) AS cooks_d
FROM ck_r r CROSS JOIN ck_f f""")

_tr = Ols("tr", "kept", THINK, [CAUG], "HC3")
Q["refit_trimmed"] = W(H3S + ",\n" + H3A + ",\n" + ",\n".join(_ck.ctes) + """,
cd AS (SELECT r.cluster_name_0, r.e * r.e * r.h / (2 * (f.sse / (f.n - 2)) * (1 - r.h) * (1 - r.h)) AS d,
              4.0 / f.n AS thr FROM ck_r r CROSS JOIN ck_f f),
kept AS (SELECT h3a.* FROM h3a JOIN cd USING (cluster_name_0) WHERE cd.d <= cd.thr),
nex AS (SELECT count(*) FILTER (WHERE d > thr) AS n_excluded FROM cd),
""" + ",\n".join(_tr.ctes), _tr.rows("trimmed", [CAUG]).replace(
    "FROM tr_f", "FROM tr_f CROSS JOIN nex").replace(" AS z FROM", " AS z, n_excluded FROM"))


# ----------------------------------------------------------------------- GLM
from .sqlgen import Glm  # noqa: E402

_FAMS = [("frac_logit", "binomial", f"{SHARE} / 100e0", 0.01), ("gamma_log", "gamma", SHARE, 1.0),
         ("poisson_log", "poisson", SHARE, 1.0)]
_GLMS = {}
for _px, _x in (("aug_", "augmentation_index"), ("risk_", "risk_management_index")):
    for _nm, _fam, _y, _sc in _FAMS:
        _GLMS[_px + _nm] = (Glm(f"g_{_px}{_nm}", "task_cc", _y, _x, _fam, SHARE, _sc), _x)


def _glm_coef_sql(ids):
    ctes = TASK_CC + ",\n" + ",\n".join(c for i in ids for c in _GLMS[i][0].ctes)
    return W(ctes, "\nUNION ALL\n".join(_GLMS[i][0].rows(i, _GLMS[i][1]) for i in ids))


Q["glm_fractional_logit"] = _glm_coef_sql(["aug_frac_logit", "risk_frac_logit"])
Q["glm_gamma_log"] = _glm_coef_sql(["aug_gamma_log", "risk_gamma_log"])
Q["glm_poisson_log"] = _glm_coef_sql(["aug_poisson_log", "risk_poisson_log"])


def _glm_fit_row(mid, g):
    return (f"SELECT '{mid}' AS model_id, n AS n_used, round(dev, 6) AS deviance, round(dev0, 6) AS null_deviance, "
            f"round(1 - dev / dev0, 8) AS pseudo_r2, round(chi, 6) AS pearson_chi2, round(llf, 4) AS llf, "
            f"round(-2 * llf + 4, 4) AS aic, round(-2 * llf + 2 * ln(n), 4) AS bic, round(sqrt(mse), 8) AS rmse_raw "
            f"FROM {g.final}")


Q["glm_fit_stats"] = W(TASK_CC + ",\n" + ",\n".join(c for g, _ in _GLMS.values() for c in g.ctes),
                       "\nUNION ALL\n".join(_glm_fit_row(m, g) for m, (g, _) in _GLMS.items()))

_olr = Ols("olr", "task_cc", SHARE, ["augmentation_index"])
_oll = Ols("oll", "task_cc", f"ln({SHARE})", ["augmentation_index"], keep=[SHARE])
_cmp_glms = ["aug_frac_logit", "aug_gamma_log", "aug_poisson_log"]
_LL = "(-0.5 * n * (ln(2 * pi()) + ln(sse / n) + 1))"
Q["model_comparison"] = W(
    TASK_CC + ",\n" + ",\n".join(_olr.ctes + _oll.ctes) + ",\n"
    + ",\n".join(c for i in _cmp_glms for c in _GLMS[i][0].ctes) + f""",
duan AS (SELECT avg(exp(e)) AS smear FROM oll_r),
duan_rmse AS (SELECT sqrt(avg(({SHARE} - {SHARE} * exp(-e) * smear) * ({SHARE} - {SHARE} * exp(-e) * smear))) AS rmse
              FROM oll_r CROSS JOIN duan)""",
    f"""SELECT 'ols_raw' AS model_id, round(-2 * {_LL} + 4, 4) AS aic, round(-2 * {_LL} + 2 * ln(n), 4) AS bic,
       round(1 - sse / syy, 8) AS r2, round(sqrt(sse / n), 8) AS rmse_raw FROM olr_f
UNION ALL
SELECT 'log_linear', round(-2 * {_LL} + 4, 4), round(-2 * {_LL} + 2 * ln(n), 4), round(1 - sse / syy, 8),
       round((SELECT rmse FROM duan_rmse), 8) FROM oll_f
UNION ALL
""" + "\nUNION ALL\n".join(
        f"SELECT '{i[4:]}', round(-2 * llf + 4, 4), round(-2 * llf + 2 * ln(n), 4), round(1 - dev / dev0, 8), "
        f"round(sqrt(mse), 8) FROM {_GLMS[i][0].final}" for i in _cmp_glms))

Q["duan_smearing"] = W(TASK_CC + ",\n" + ",\n".join(_oll.ctes) + f""",
duan AS (SELECT avg(exp(e)) AS smear FROM oll_r)""",
    f"""SELECT round(smear, 8) AS smear,
       round(sqrt(avg(({SHARE} - {SHARE} * exp(-e) * smear) * ({SHARE} - {SHARE} * exp(-e) * smear))), 8) AS rmse_raw
FROM oll_r CROSS JOIN duan GROUP BY smear""")

_rl = Ols("rl", "task_cc", f"ln({SHARE})", ["risk_management_index"])
_risk = ["risk_frac_logit", "risk_gamma_log", "risk_poisson_log"]
Q["model_comparison_2"] = W(
    TASK_CC + ",\n" + ",\n".join(_rl.ctes) + ",\n" + ",\n".join(c for i in _risk for c in _GLMS[i][0].ctes),
    "\nUNION ALL\n".join(
        f"SELECT '{i}' AS model_id, round(b1, 8) AS coef, round(sqrt(v11), 8) AS se, round(b1 / sqrt(v11), 6) AS z, "
        f"round(exp(b1), 6) AS fold_change, round(1 - dev / dev0, 8) AS r2 FROM {_GLMS[i][0].final}" for i in _risk)
    + "\nUNION ALL\nSELECT 'risk_log_linear', round(be0, 8), round(sqrt(v1_1), 8), round(be0 / sqrt(v1_1), 6), "
      "round(exp(be0), 6), round(1 - sse / syy, 8) FROM rl_f")

TRIM = (TASK_CC + ",\nthr AS (SELECT 1.5 * avg(task_conversation_share) AS thr FROM task_cc),\n"
        "kept AS (SELECT task_cc.* FROM task_cc CROSS JOIN thr WHERE task_conversation_share <= thr),\n"
        "nex AS (SELECT count(*) AS n_excluded FROM task_cc CROSS JOIN thr WHERE task_conversation_share > thr)")
_tm = [("t_h1_log", Ols("t1", "kept", f"ln({SHARE})", ["augmentation_index"])),
       ("t_h1_comp", Ols("t2", "kept", SHARE, ["task_iteration", "learning"])),
       ("t_h2a", Ols("t3", "kept", SHARE, ["risk_management_index"])),
       ("t_h2a_log", Ols("t4", "kept", f"ln({SHARE})", ["risk_management_index"]))]
_tx = {"t_h1_log": ["augmentation_index"], "t_h1_comp": ["task_iteration", "learning"],
       "t_h2a": ["risk_management_index"], "t_h2a_log": ["risk_management_index"]}
_tg = Glm("tg", "kept", f"{SHARE} / 100e0", "augmentation_index", "binomial", SHARE, 0.01)
_trows = []
for _m, _o in _tm:
    for _j, _t in enumerate(_tx[_m], start=1):
        _trows.append(f"SELECT '{_m}' AS model_id, '{_t}' AS term, round({_o.coef(_j)}, 8) AS coef, "
                      f"round({_o.se(_j)}, 8) AS se, round({_o.coef(_j)} / {_o.se(_j)}, 6) AS z, n_excluded "
                      f"FROM {_o.final} CROSS JOIN nex")
_trows.append("SELECT 't_h1_frac', 'augmentation_index', round(b1, 8), round(sqrt(v11), 8), "
              "round(b1 / sqrt(v11), 6), n_excluded FROM tg_f CROSS JOIN nex")
Q["trimmed_battery"] = W(TRIM + ",\n" + ",\n".join(c for _, o in _tm for c in o.ctes) + ",\n" + ",\n".join(_tg.ctes),
                         "\nUNION ALL\n".join(_trows))

_rb_ols = [Ols("rb1", "h3s", THINK, [CAUG, "percent_users"]), Ols("rb2", "h3s", THINK, [CAUG, "percent_records"])]
Q["plan_robustness"] = W(
    TASK_CC + ",\n" + H3S + ",\n" + H3A + ",\n" + ",\n".join(c for i in ["aug_frac_logit", "risk_frac_logit"]
                                                             for c in _GLMS[i][0].ctes)
    + ",\n" + ",\n".join(c for o in _rb_ols for c in o.ctes) + ",\n" + ",\n".join(_ck.ctes) + """,
cd AS (SELECT r.cluster_name_0, r.e * r.e * r.h / (2 * (f.sse / (f.n - 2)) * (1 - r.h) * (1 - r.h)) AS d,
              4.0 / f.n AS thr FROM ck_r r CROSS JOIN ck_f f),
kept AS (SELECT h3a.* FROM h3a JOIN cd USING (cluster_name_0) WHERE cd.d <= cd.thr),
""" + ",\n".join(_tr.ctes),
    "\nUNION ALL\n".join([_GLMS["aug_frac_logit"][0].rows("aug_frac_logit", "augmentation_index"),
                          _GLMS["risk_frac_logit"][0].rows("risk_frac_logit", "risk_management_index"),
                          _rb_ols[0].rows("h3_ctrl_users", [CAUG, "percent_users"]),
                          _rb_ols[1].rows("h3_ctrl_records", [CAUG, "percent_records"]),
                          _tr.rows("trimmed", [CAUG])]))


# ----------------------------------------------------------------- bootstrap
import math as _math  # noqa: E402
import re as _re  # noqa: E402


def _poisson_case(u: str) -> str:
    th, acc, term, k = [], 0.0, _math.exp(-1.0), 0
    while acc < 1 - 2.0 ** -52:
        if k > 0:
            term /= k
        acc += term
        th.append(acc)
        k += 1
    parts = " ".join(f"WHEN {u} < '{t!r}'::DOUBLE THEN {k}" for k, t in enumerate(th))
    return f"(CASE {parts} ELSE {len(th)} END)"


def _md5_word(text: str, at: int) -> str:
    return f"('0x' || substr(md5({text}), {at}, 8))::BIGINT"


def _mix32(v: str) -> str:
    return f"((xor({v}, ({v}) >> 16) * 73244475) % 4294967296)"


_U52 = "((xor(a, a >> 16) * 1048576 + (xor(b, b >> 16) >> 12)) / 4503599627370496e0)"


def _boot_sql(scheme: str, B: int = 5000, seed: int = 42, px: str = "") -> tuple[str, str]:
    if scheme == "iid":
        base = ("bb AS (SELECT cluster_name_0 AS k, 1e0 AS w, augmentation_index - mx AS x, "
                f"{THINK} - mm AS m, {SHARE} - my AS y FROM h5 CROSS JOIN mu)")
    else:
        base = ("bb AS (SELECT task_name AS k, sum(1e0) AS w, sum(augmentation_index - mx) AS x, "
                f"sum({THINK} - mm) AS m, sum({SHARE} - my) AS y, "
                f"sum((augmentation_index - mx) * (augmentation_index - mx)) AS xx, "
                f"sum(({THINK} - mm) * ({THINK} - mm)) AS mmm, "
                f"sum((augmentation_index - mx) * ({THINK} - mm)) AS xm, "
                f"sum((augmentation_index - mx) * ({SHARE} - my)) AS xy, "
                f"sum(({THINK} - mm) * ({SHARE} - my)) AS my2 FROM h5 CROSS JOIN mu GROUP BY task_name)")
    if scheme == "iid":
        mom = "w, x, m, y, x * x AS xx, m * m AS mmm, x * m AS xm, x * y AS xy, m * y AS my2"
    else:
        mom = "w, x, m, y, xx, mmm, xm, xy, my2"
    rep = f"'{seed}:rep:' || rep"
    ctes = [f"mu AS (SELECT avg(augmentation_index) AS mx, avg({THINK}) AS mm, avg({SHARE}) AS my FROM h5)",
            base,
            f"kh AS (SELECT {_md5_word(f"'{seed}:' || k", 1)} AS k1, {_md5_word(f"'{seed}:' || k", 9)} AS k2, {mom} FROM bb)",
            f"rp AS (SELECT rep, {_md5_word(rep, 1)} AS r1, {_md5_word(rep, 9)} AS r2 FROM range(0, {B}) r(rep))",
            "e0 AS (SELECT * EXCLUDE (k1, k2, r1, r2), xor(k1, r1) AS a, xor(k2, r2) AS b FROM kh CROSS JOIN rp)",
            f"e1 AS (SELECT * EXCLUDE (a), {_mix32('a')} AS a FROM e0)",
            f"e2 AS (SELECT * EXCLUDE (b), {_mix32('xor(b, a)')} AS b FROM e1)",
            f"e4 AS (SELECT * EXCLUDE (a), {_mix32('xor(a, b)')} AS a FROM e2)",
            f"e5 AS (SELECT * EXCLUDE (b), {_mix32('xor(b, a)')} AS b FROM e4)",
            f"e3 AS (SELECT * EXCLUDE (a, b), {_poisson_case(_U52)} AS wt FROM e5)",
            "s AS (SELECT rep, sum(wt * w) AS W, sum(wt * x) AS sx, sum(wt * m) AS sm, sum(wt * y) AS sy, "
            "sum(wt * xx) AS sxx, sum(wt * mmm) AS smm, sum(wt * xm) AS sxm, sum(wt * xy) AS sxy, "
            "sum(wt * my2) AS smy FROM e3 WHERE wt > 0 GROUP BY rep)",
            "c AS (SELECT rep, sxx - sx * sx / W AS cxx, smm - sm * sm / W AS cmm, sxm - sx * sm / W AS cxm, "
            "sxy - sx * sy / W AS cxy, smy - sm * sy / W AS cmy FROM s)",
            "p AS (SELECT rep, (cxm / cxx) * ((cxx * cmy - cxm * cxy) / (cxx * cmm - cxm * cxm)) AS ind FROM c)"]
    sel = ("SELECT count(*) AS n_reps, count(ind) AS n_valid, round(avg(ind), 8) AS boot_mean, "
           "round(stddev_samp(ind), 8) AS boot_sd, round(quantile_cont(ind, 0.025), 8) AS ci_lo, "
           "round(quantile_cont(ind, 0.975), 8) AS ci_hi, "
           "CASE WHEN quantile_cont(ind, 0.025) * quantile_cont(ind, 0.975) > 0 THEN 'excludes 0' "
           "ELSE 'includes 0' END AS verdict FROM p")
    txt = ",\n".join(ctes)
    for nm in ("e5", "e4", "e3", "e2", "e1", "e0", "rp", "kh", "bb", "mu", "s", "c", "p"):
        txt = _re.sub(rf"\b{nm}\b(?=( AS \(|\.|\s|\)|,|$))", px + nm, txt)
        sel = _re.sub(rf"\bFROM {nm}\b", f"FROM {px}{nm}", sel)
    return txt, sel


_bi, _bis = _boot_sql("iid", px="bi_")
_bc, _bcs = _boot_sql("cluster", px="bc_")
Q["boot_iid"] = W(H3S + ",\n" + H5S + ",\n" + _bi, _bis)
Q["boot_cluster"] = W(H3S + ",\n" + H5S + ",\n" + _bc, _bcs)
Q["plan_bootstrap"] = W(H3S + ",\n" + H5S + ",\n" + _bi + ",\n" + _bc,
                        "SELECT 'iid' AS scheme, * FROM (" + _bis + ")\nUNION ALL\nSELECT 'cluster', * FROM ("
                        + _bcs + ")")


# ------------------------------------------------------ further operator keys
Q["ols_1x"] = ols_query(W, [("2b", "task_level", "directive", ["risk_management_index"], "HC3", None)])
Q["ols_2x"] = ols_query(W, [("4", "h3s", THINK, [CAUTO, CAUG], "HC3", None)], extra_ctes=H3S)
OLS4 = [CAUG, "cluster_feedback_loop", "percent_records", "percent_users"]
Q["ols_4x"] = ols_query(W, [("h3_4x", "h3s", THINK, OLS4, "HC3", None)], extra_ctes=H3S)
Q["model_battery"] = ols_query(W, _TASK_MODELS)

_h1 = [("1a", Ols("c1", "task_level", SHARE, ["augmentation_index"])),
       ("1b", Ols("c2", "task_level", SHARE, ["task_iteration", "learning"])),
       ("1c", Ols("c3", "task_level", f"ln({SHARE})", ["augmentation_index"]))]
_h1x = {"1a": ["augmentation_index"], "1b": ["task_iteration", "learning"], "1c": ["augmentation_index"]}
_rows = []
for _m, _o in _h1:
    for _j, _t in enumerate(["const"] + _h1x[_m]):
        _rows.append(f"SELECT '{_m}' AS model_id, '{_t}' AS term, round({_o.coef(_j)}, 8) AS coef, "
                     f"round({_o.coef(_j)} - {Z} * {_o.se(_j)}, 8) AS ci_lo, "
                     f"round({_o.coef(_j)} + {Z} * {_o.se(_j)}, 8) AS ci_hi FROM {_o.final}")
Q["coef_ci"] = W(",\n".join(c for _, o in _h1 for c in o.ctes), "\nUNION ALL\n".join(_rows))

_tm6 = [(m, Ols(f"jf{i}", src, y, xs, cov)) for i, (m, src, y, xs, cov, _) in enumerate(_TASK_MODELS)]
_jf = []
for _m, _o in _tm6:
    if _o.k == 1:
        f = "be0 * be0 / v1_1"
    else:
        f = "((be0 * be0 * v2_2 - 2 * be0 * be1 * v1_2 + be1 * be1 * v1_1) / (v1_1 * v2_2 - v1_2 * v1_2)) / 2"
    _jf.append(f"SELECT model_id, k, round(f, 6) AS f, round({f_p('(k * f / (n - k - 1))', 'k', '(n - k - 1)')}, 8) AS f_p "
               f"FROM (SELECT '{_m}' AS model_id, {_o.k} AS k, {f} AS f, n FROM {_o.final})")
Q["joint_f"] = W(",\n".join(c for _, o in _tm6 for c in o.ctes), "\nUNION ALL\n".join(_jf))

Q["info_criteria"] = ols_query(W, [("3", "h3s", THINK, [CAUG], "HC3", None),
                                   ("4", "h3s", THINK, [CAUTO, CAUG], "HC3", None)], extra_ctes=H3S, kind="fit")

_pr = Ols("pr", "h3a", THINK, [CAUG], keep=["cluster_name_0"])
Q["predict_ols"] = W(H3S + ",\n" + H3A + ",\n" + ",\n".join(_pr.ctes), """
SELECT r.cluster_name_0, round(r.yc - r.e + f.my, 8) AS fitted, round(r.e, 8) AS resid FROM pr_r r CROSS JOIN pr_f f""")
Q["leverage"] = W(H3S + ",\n" + H3A + ",\n" + ",\n".join(_pr.ctes),
                  "SELECT cluster_name_0, round(h, 8) AS leverage FROM pr_r")
Q["trim_influential"] = W(H3S + ",\n" + H3A + ",\n" + ",\n".join(_ck.ctes) + """,
cd AS (SELECT r.e * r.e * r.h / (2 * (f.sse / (f.n - 2)) * (1 - r.h) * (1 - r.h)) AS d, 4.0 / f.n AS thr, f.n
       FROM ck_r r CROSS JOIN ck_f f)""",
    "SELECT any_value(n) AS n, count(*) FILTER (WHERE d > thr) AS n_excluded, round(any_value(thr), 10) AS threshold FROM cd")

_rd = []
_rdc = []
for _i, (_m, _src, _y, _xs, _cov, _g) in enumerate(_TASK_MODELS):
    _o = Ols(f"rd{_i}", _src, _y, _xs, _cov)
    _rdc += _o.ctes
    _rdc.append(f"rdm{_i} AS (SELECT count(*) AS n, avg(e * e) AS m2, avg(e * e * e) AS m3, "
                f"avg(e * e * e * e) AS m4, {'abs(corr(c0, c1))' if _o.k == 2 else '0.0'} AS rho FROM rd{_i}_r)")
    # D'Agostino's z of the skewness and Anscombe's z of the kurtosis
    _rdc.append(f"rdo{_i} AS (SELECT *, pow(z_skew, 2) + pow((1 - 2 / (9 * aa) - cbrt((1 - 2 / aa) / "
                "(1 + (m4 / (m2 * m2) - 3e0 * (n - 1) / (n + 1)) / sqrt(24e0 * n * (n - 2) * (n - 3) / "
                "(pow(n + 1, 2) * (n + 3) * (n + 5))) * sqrt(2 / (aa - 4))))) / sqrt(2 / (9 * aa)), 2) AS k2 FROM ("
                "SELECT *, asinh(ys / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS z_skew, "
                "6 + 8 / sb * (2 / sb + sqrt(1 + 4 / (sb * sb))) AS aa FROM ("
                "SELECT *, sqrt(2 * (bb - 1)) - 1 AS w2 FROM (SELECT *, m3 / pow(m2, 1.5) * sqrt((n + 1e0) * (n + 3) / (6e0 * (n - 2))) AS ys, "
                "3e0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2e0) * (n + 5) * (n + 7) * (n + 9)) AS bb, "
                "6e0 * (n * n - 5 * n + 2) / ((n + 7e0) * (n + 9)) * sqrt(6e0 * (n + 3) * (n + 5) / (n * (n - 2e0) * (n - 3))) AS sb "
                f"FROM rdm{_i}))))")
    _rd.append(f"SELECT '{_m}' AS model_id, n, round(m3 / pow(m2, 1.5), 6) AS resid_skew, "
               f"round(m4 / (m2 * m2), 6) AS resid_kurtosis, "
               f"round(n / 6.0 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4), 4) AS jarque_bera, "
               f"round(exp(-n / 12.0 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4)), 6) AS jb_p, "
               f"round((1 + rho) / (1 - rho), 6) AS cond, round(k2, 4) AS omnibus, round(exp(-k2 / 2), 6) AS omnibus_p "
               f"FROM rdo{_i}")
Q["resid_diagnostics"] = W(",\n".join(_rdc), "\nUNION ALL\n".join(_rd))

_dw = []
_dwc = []
for _m, _o_ in (("1a", Ols("dw1", "task_level", SHARE, ["augmentation_index"], keep=["task_name"])),
                ("1b", Ols("dw2", "task_level", SHARE, ["task_iteration", "learning"], keep=["task_name"]))):
    _dwc += _o_.ctes
    _dw.append(f"SELECT '{_m}' AS model_id, round(sum(d * d) / sum(e * e), 8) AS durbin_watson FROM "
               f"(SELECT e, e - lag(e) OVER (ORDER BY task_name) AS d FROM {_o_.p}_r)")
Q["durbin_watson"] = W(",\n".join(_dwc), "\nUNION ALL\n".join(_dw))

_r1 = Ols("rm1", "task_level", SHARE, ["augmentation_index"])
_r3 = Ols("rm3", "h3s", THINK, [CAUG])
Q["rmse"] = W(H3S + ",\n" + ",\n".join(_r1.ctes + _r3.ctes),
              "SELECT '1a' AS model_id, round(sqrt(sse / n), 8) AS rmse FROM rm1_f UNION ALL "
              "SELECT '3', round(sqrt(sse / n), 8) FROM rm3_f")

Q["log_transform"] = W("", f"SELECT task_name, round(ln({SHARE}), 8) AS ln_share FROM task_level")
_fa = Ols("fa", "task_cc", f"ln({SHARE})", ["augmentation_index"])
_fr = Ols("fr", "task_cc", f"ln({SHARE})", ["risk_management_index"])
Q["fold_change"] = W(TASK_CC + ",\n" + ",\n".join(_fa.ctes + _fr.ctes),
                     "SELECT 'aug_log' AS model_id, 'augmentation_index' AS term, round(exp(be0), 6) AS fold_change "
                     "FROM fa_f UNION ALL SELECT 'risk_log', 'risk_management_index', round(exp(be0), 6) FROM fr_f")
Q["mean_center"] = W(_h6_ctes("cluster_level"),
                     "SELECT cluster_name_0, round(aug_c, 8) AS aug_c, round(thk_c, 8) AS thk_c FROM h6")
Q["interaction_term"] = W(_h6_ctes("cluster_level"),
                          "SELECT cluster_name_0, round(interaction, 8) AS interaction FROM h6")
Q["concat_text"] = W("", """
SELECT cluster_name_0, lower(coalesce(cluster_name_0, '') || ' ' || coalesce(cluster_name_1, '') || ' '
                             || coalesce(cluster_name_2, '')) AS name_text FROM cluster_level""")
Q["coerce_numeric"] = W("", """
SELECT cluster_name_0,
       round(TRY_CAST(coalesce(CAST(collab_directive_ratio AS VARCHAR), 'n/a') AS DOUBLE), 8) AS cluster_directive
FROM fx_clusters""")
Q["left_join_optional"] = W("", "SELECT task_name, round(thinking_fraction, 8) AS thinking_fraction FROM task_base")
Q["listwise"] = W("", f"""
SELECT 'h3' AS sample, count(*) AS n FROM cluster_level WHERE {THINK} IS NOT NULL AND {CAUG} IS NOT NULL
UNION ALL SELECT 'h4', count(*) FROM cluster_level WHERE {THINK} IS NOT NULL AND {CAUTO} IS NOT NULL AND {CAUG} IS NOT NULL
UNION ALL SELECT 'h5', count(*) FROM cluster_level WHERE {THINK} IS NOT NULL AND augmentation_index IS NOT NULL
                                                   AND {SHARE} IS NOT NULL
UNION ALL SELECT 'h6', count(*) FROM cluster_level WHERE percent_users IS NOT NULL AND {CAUG} IS NOT NULL
                                                   AND {THINK} IS NOT NULL""")
Q["shape_stats"] = W("", "\nUNION ALL\n".join(
    f"SELECT '{v}' AS variable, count({v}) AS n, round(skewness({v}), 6) AS skewness, "
    f"round(kurtosis({v}), 6) AS kurtosis FROM task_level" for v in TASK_VARS))
Q["corr_pvalues"] = W("", "\nUNION ALL\n".join(
    f"SELECT '{a}' AS var_i, '{b}' AS var_j, n, round(t, 6) AS t, round({f_p('(t * t / (n - 2))', '1', '(n - 2)')}, 8) AS p FROM "
    f"(SELECT n, CASE WHEN n > 2 AND abs(r) < 1 THEN r * sqrt((n - 2) / (1 - r * r)) END AS t FROM "
    f"(SELECT count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n, corr({a}, {b}) AS r FROM task_level))"
    for i, a in enumerate(TASK_VARS) for b in TASK_VARS[i + 1:]))


def _cm(a, b):
    if a == b:
        return "1.0"
    return f"(SELECT round(corr({a}, {b}), 8) FROM cluster_level)"


Q["corr_matrix_wide"] = W("", "\nUNION ALL\n".join(
    f"SELECT '{a}' AS var_i, " + ", ".join(f"{_cm(a, b)} AS {b}" for b in CLUSTER_CORR_VARS)
    for a in CLUSTER_CORR_VARS))
Q["percentile_ci"] = W("", f"""
SELECT '{SHARE}' AS variable, round(quantile_cont({SHARE}, 0.025), 8) AS p025,
       round(quantile_cont({SHARE}, 0.975), 8) AS p975 FROM task_level
UNION ALL SELECT 'augmentation_index', round(quantile_cont(augmentation_index, 0.025), 8),
       round(quantile_cont(augmentation_index, 0.975), 8) FROM task_level""")
Q["fit_line_grid"] = W(",\n".join(_r1.ctes) + f""",
rg AS (SELECT min(augmentation_index) AS lo, max(augmentation_index) AS hi FROM task_level
       WHERE augmentation_index IS NOT NULL AND {SHARE} IS NOT NULL)""", """
SELECT g.i, round(lo + g.i * ((hi - lo) / 99), 8) AS x, round(be_c + be0 * (lo + g.i * ((hi - lo) / 99)), 8) AS yhat
FROM range(0, 100) g(i) CROSS JOIN rg CROSS JOIN rm1_f""")
Q["scatter_points"] = W("", f"""
SELECT task_name, round(augmentation_index, 8) AS augmentation_index, round({SHARE}, 8) AS {SHARE},
       round(ln({SHARE}), 8) AS ln_share FROM task_level
WHERE augmentation_index IS NOT NULL AND {SHARE} IS NOT NULL""")
Q["scatter_binned"] = W(f"""
sb AS (SELECT augmentation_index AS x, {SHARE} AS y FROM task_level
       WHERE augmentation_index IS NOT NULL AND {SHARE} IS NOT NULL),
sr AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM sb)""", """
SELECT least(CAST(floor((x - x0) / (x1 - x0) * 20) AS INTEGER), 19) AS bx,
       least(CAST(floor((y - y0) / (y1 - y0) * 20) AS INTEGER), 19) AS by, count(*) AS n
FROM sb CROSS JOIN sr GROUP BY ALL""")
Q["sobel"] = Q["plan_h5"].replace(
    Q["plan_h5"][Q["plan_h5"].rindex("SELECT n, round(c, 8)"):],
    "SELECT round(a * b, 8) AS indirect, round(sqrt(a * a * b_se * b_se + b * b * a_se * a_se), 8) AS sobel_se, "
    "round(a * b / sqrt(a * a * b_se * b_se + b * b * a_se * a_se), 6) AS sobel_z FROM pv")
_pd = Q["plan_h5"]
Q["mediation_decision"] = _pd[:_pd.rindex("SELECT n, round(c, 8)")] + (
    "SELECT " + _pd[_pd.index("CASE WHEN abs(cz)"):])
_d6 = [(m, Ols(f"d6{i}", "h6", "percent_users", xs)) for i, (m, xs) in
       enumerate([("6a", [CAUG]), ("6b", [CAUG, THINK]), ("6c", ["aug_c", "thk_c", "interaction"])])]
Q["delta_r2"] = W(_h6_ctes("cluster_level") + ",\n" + ",\n".join(c for _, o in _d6 for c in o.ctes), """
SELECT '6a' AS model_id, 0 AS step, round(1 - d60_f.sse / d60_f.syy, 8) AS r2, CAST(NULL AS DOUBLE) AS delta_r2 FROM d60_f
UNION ALL SELECT '6b', 1, round(1 - d61_f.sse / d61_f.syy, 8),
       round((1 - d61_f.sse / d61_f.syy) - (1 - d60_f.sse / d60_f.syy), 8) FROM d61_f CROSS JOIN d60_f
UNION ALL SELECT '6c', 2, round(1 - d62_f.sse / d62_f.syy, 8),
       round((1 - d62_f.sse / d62_f.syy) - (1 - d61_f.sse / d61_f.syy), 8) FROM d62_f CROSS JOIN d61_f""")

_all_glm = list(_GLMS)
_gct = TASK_CC + ",\n" + ",\n".join(c for g, _ in _GLMS.values() for c in g.ctes)
Q["glm_robust_se"] = W(_gct, "\nUNION ALL\n".join(
    f"SELECT '{m}' AS model_id, 'const' AS term, round(sqrt(v00), 8) AS se FROM {g.final} UNION ALL "
    f"SELECT '{m}', '{x}', round(sqrt(v11), 8) FROM {g.final}" for m, (g, x) in _GLMS.items()))
Q["glm_pseudo_r2"] = W(_gct, "\nUNION ALL\n".join(
    f"SELECT '{m}' AS model_id, round(dev, 6) AS deviance, round(dev0, 6) AS null_deviance, "
    f"round(1 - dev / dev0, 8) AS pseudo_r2 FROM {g.final}" for m, (g, _) in _GLMS.items()))
Q["glm_info_criteria"] = W(_gct, "\nUNION ALL\n".join(
    f"SELECT '{m}' AS model_id, round(llf, 4) AS llf, round(-2 * llf + 4, 4) AS aic, "
    f"round(-2 * llf + 2 * ln(n), 4) AS bic FROM {g.final}" for m, (g, _) in _GLMS.items()))
_gf = _GLMS["aug_frac_logit"][0]
Q["predict_glm"] = W(TASK_CC + ",\n" + ",\n".join(_gf.ctes), f"""
SELECT t.task_name, round(100e0 / (1 + exp(-(f.b0 + f.b1 * t.augmentation_index))), 8) AS fitted_raw
FROM task_cc t CROSS JOIN {_gf.final} f""")
Q["plan_model_comparison"] = Q["model_comparison"]

_pc = ols_query(W, [("h3_hc3", "h3a", THINK, [CAUG], "HC3", None),
                    ("h3_cl_task", "h3a", THINK, [CAUG], "cluster", "task_name"),
                    ("h3_cl_name1", "h3a", THINK, [CAUG], "cluster", "cluster_name_1"),
                    ("h4_hc3", "h3a", THINK, [CAUTO, CAUG], "HC3", None),
                    ("h4_cl_task", "h3a", THINK, [CAUTO, CAUG], "cluster", "task_name"),
                    ("h6_6a", "h6", "percent_users", ["aug_c"], "cluster", "task_name"),
                    ("h6_6b", "h6", "percent_users", ["aug_c", "thk_c"], "cluster", "task_name"),
                    ("h6_6c", "h6", "percent_users", ["aug_c", "thk_c", "interaction"], "cluster", "task_name")],
                extra_ctes=H3S + ",\n" + H3A + ",\n" + _h6_ctes("h3s"))
Q["plan_clustered"] = _pc

Q["qc_fingerprint"] = W("", f"""
SELECT round(avg({SHARE}), 8) AS {SHARE}_mean, round(stddev_samp({SHARE}), 8) AS {SHARE}_sd,
       round(min({SHARE}), 8) AS {SHARE}_min, round(max({SHARE}), 8) AS {SHARE}_max,
       round(avg(augmentation_index), 8) AS augmentation_index_mean,
       round(stddev_samp(augmentation_index), 8) AS augmentation_index_sd,
       round(min(augmentation_index), 8) AS augmentation_index_min,
       round(max(augmentation_index), 8) AS augmentation_index_max,
       round(avg(automation_index), 8) AS automation_index_mean,
       round(stddev_samp(automation_index), 8) AS automation_index_sd,
       round(min(automation_index), 8) AS automation_index_min,
       round(max(automation_index), 8) AS automation_index_max,
       count(thinking_fraction) AS tasks_with_thinking, count(*) AS tasks FROM task_level""")

_qa = Ols("qa", "task_level", SHARE, ["augmentation_index"])
_qc = Ols("qc", "task_level", f"ln({SHARE})", ["augmentation_index"])
_qr = Ols("qr", "task_level", SHARE, ["risk_management_index"])
Q["qc_coefficients"] = W(",\n".join(_qa.ctes + _qc.ctes + _qr.ctes) + """,
qx AS (SELECT '1a' AS model_id, 'augmentation_index' AS term, be0 AS coef, 0.0596 AS value, 0.003 AS tol FROM qa_f
       UNION ALL SELECT '1c', 'augmentation_index', be0, 2.8144, 0.02 FROM qc_f
       UNION ALL SELECT '2a', 'risk_management_index', be0, 0.6649, 0.01 FROM qr_f)""", """
SELECT model_id, term, round(coef, 8) AS coef, CAST(value AS DOUBLE) AS value, CAST(tol AS DOUBLE) AS tol,
       CASE WHEN abs(coef - value) < tol THEN 'PASS' ELSE 'CHECK' END AS status FROM qx""")


Q["normal_tail"] = W("", f"""
SELECT task_name, round(z, 6) AS z, round({normal_p('z')}, 6) AS p FROM (
  SELECT task_name, ({SHARE} - avg({SHARE}) OVER ()) / stddev_samp({SHARE}) OVER () AS z FROM task_level WHERE {SHARE} IS NOT NULL)""")
Q["t_tail"] = W("", f"""
SELECT cluster_name_1, n, round(t, 6) AS t, round({f_p('(t * t / (n - 1))', '1', '(n - 1)')}, 6) AS p FROM (
  SELECT cluster_name_1, count(*) AS n, (avg({THINK}) - 0.5e0) / (stddev_samp({THINK}) / sqrt(count(*))) AS t
  FROM cluster_level WHERE {THINK} IS NOT NULL GROUP BY cluster_name_1 HAVING count(*) > 2 AND stddev_samp({THINK}) > 0)""")
Q["safe_ratio"] = W("", "SELECT task_name, round(CASE WHEN automation_index <> 0 THEN directive / automation_index END, 8) "
                        "AS directive_part FROM task_base")
Q["min_rows_guard"] = W("", f"""
SELECT cluster_name_1, cluster_name_2, n, round(CASE WHEN n > 2 AND u > 0 AND v > 0 THEN r END, 8) AS r FROM (
  SELECT cluster_name_1, cluster_name_2, count(*) AS n, var_pop({THINK}) AS u, var_pop({CAUG}) AS v, corr({THINK}, {CAUG}) AS r
  FROM cluster_level WHERE {THINK} IS NOT NULL AND {CAUG} IS NOT NULL GROUP BY ALL)""")
Q["constant_predictor"] = W("", "\nUNION ALL\n".join(
    f"SELECT '{m}' AS model_id, count(*) AS n_used, '{st}' AS status FROM task_level "
    f"WHERE {SHARE} IS NOT NULL AND augmentation_index IS NOT NULL" for m, st in (("plain", "ok"), ("with_constant", "singular"))))
Q["present_columns"] = W("", "\nUNION ALL\n".join(
    f"SELECT '{v}' AS variable, count({v}) AS n_present, count(*) AS n_rows FROM task_level" for v in TASK_VARS))
_wx = ["directive", "feedback_loop", "task_iteration", "learning", "validation"]
_wide = [*_wx, *(f"pow({c}, 2) AS {c}_2" for c in _wx), *(f"pow({c}, 3) AS {c}_3" for c in _wx[:2])]
_wm = [(m, Ols(f"wd{j}", "task_level", SHARE, [x.split(" AS ")[0] for x in xs], cov), xs)
       for j, (m, xs, cov) in enumerate((("wide", _wide, "HC3"), ("wide_classical", _wide[:10], "classical")))]
Q["ols_wide"] = W(",\n".join(c for _, o, _x in _wm for c in o.ctes), "\nUNION ALL\n".join(
    f"SELECT '{m}' AS model_id, '{t}' AS term, round({o.coef(j)}, 6) AS coef, round({o.se(j)}, 6) AS se FROM {o.final}"
    for m, o, xs in _wm for j, t in enumerate(["const", *(x.split(" AS ")[-1] for x in xs)])))
_cw = {**{v: v for v in TASK_VARS}, **{f"{v}_2": f"pow({v}, 2)" for v in TASK_VARS},
       **{f"{v}_3": f"pow({v}, 3)" for v in TASK_VARS[:6]}}
_cwn = list(_cw)
Q["corr_wide"] = W("cw AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _cw.items()) + " FROM task_level)", "\nUNION ALL\n".join(
    f"SELECT '{a}' AS var_i, '{b}' AS var_j, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n, "
    f"round(corr({a}, {b}), 8) AS r FROM cw" for i, a in enumerate(_cwn) for b in _cwn[i + 1:]))
Q["run_replace"] = W("", "\nUNION ALL\n".join(
    f"SELECT '{level}' AS analysis_id, '{v}' AS variable, count({v}) AS n, round(avg({v}), 8) AS mean FROM {level}_level"
    for level, names in (("task", TASK_VARS), ("cluster", CLUSTER_VARS)) for v in names))
Q["run_log"] = f"""
SELECT 'describe' AS command, step::INTEGER AS step, table_name, analysis_id, n_rows::BIGINT AS n_rows, 'done' AS status,
       2::BIGINT AS n_runs, true AS in_order
FROM (VALUES (0, 'descriptives', 'task', {len(TASK_VARS)}), (1, 'descriptives', 'cluster', {len(CLUSTER_VARS)}), (2, NULL, NULL, 0))
  AS t(step, table_name, analysis_id, n_rows)"""
Q["qc_columns"] = W("", f"""
SELECT 'integrated' AS table_name, {len(TASK_BASE_COLS) + len(CLUSTER_COLS) - 1} AS n_cols, count(*) AS n_rows FROM integrated
UNION ALL SELECT 'task_level', {len(TASK_BASE_COLS)}, count(*) FROM task_level
UNION ALL SELECT 'cluster_level', {len(TASK_BASE_COLS) + len(CLUSTER_COLS) - 1}, count(*) FROM cluster_level""")

Q["file_sha256"] = """
SELECT part_no, strlen(body)::BIGINT AS length, sha256(body) AS sha256 FROM (
  SELECT (c_custkey % 64)::INTEGER AS part_no,
         string_agg(c_custkey || ',' || c_name || ',' || c_mktsegment || chr(10), '' ORDER BY c_custkey) AS body
  FROM customer GROUP BY ALL)"""

Q["qc_statistics"] = W("", """
SELECT model_id, statistic, round(actual, 8) AS actual, value::DOUBLE AS value, tol::DOUBLE AS tol,
       CASE WHEN abs(actual - value) < tol THEN 'PASS' ELSE 'CHECK' END AS status FROM (
""" + "\nUNION ALL\n".join(
    f"SELECT '{m}' AS model_id, '{st}' AS statistic, {dict(b1='regr_slope(y, x)', r2='regr_r2(y, x)', r='corr(y, x)', n='regr_count(y, x)')[st]}"
    f"::DOUBLE AS actual, {v} AS value, {t} AS tol FROM (SELECT {y} AS y, {x} AS x FROM {src})"
    for m, src, y, x, checks in (
        ("fig1_linear", "task_level", SHARE, "augmentation_index", (("b1", 0.0596, 0.003), ("r2", 0.011, 0.004))),
        ("fig1_log", "task_level", f"ln({SHARE})", "augmentation_index", (("b1", 2.8144, 0.02), ("r2", 0.399, 0.01))),
        ("fig2_h2a", "task_level", SHARE, "risk_management_index", (("b1", 0.6649, 0.01), ("n", 3364.0, 0.5))),
        ("fig3_h3", "cluster_level", THINK, CAUG, (("b1", -0.0611, 0.003), ("n", 508.0, 0.5), ("r", -0.327, 0.01))))
    for st, v, t in checks) + ")")

Q["key_constancy"] = W("", "\nUNION ALL\n".join(
    f"SELECT '{part}' AS part, task_name, count(*) AS n_rows FROM {src} GROUP BY task_name "
    f"HAVING count(DISTINCT ({', '.join(f'coalesce({c}::VARCHAR, chr(1))' for c in cols)})) > 1"
    for part, src, cols in (("task_columns", "integrated", [c for c in TASK_BASE_COLS if c != "task_name"]),
                            ("cluster_columns", "cluster_level", ["cluster_name_1", "percent_users"]))))

Q["coef_table"] = ols_query(W, [("3", "h3s", THINK, [CAUG], "HC3", None),
                                ("3_classical", "h3s", THINK, [CAUG], "classical", None),
                                ("4", "h3s", THINK, [CAUTO, CAUG], "HC3", None)], extra_ctes=H3S, with_p=True)
Q["boot_ci"] = W(H3S + ",\n" + H5S + ",\n" + _bi + ",\n" + _bc,
                 "SELECT 'iid' AS scheme, n_valid, ci_lo, ci_hi, verdict FROM (" + _bis + ")\nUNION ALL\n"
                 "SELECT 'cluster', n_valid, ci_lo, ci_hi, verdict FROM (" + _bcs + ")")


def _boot_exact_sql(scheme: str, B: int = 5000, seed: int = 42) -> str:
    if scheme == "iid":
        units = ("un AS (SELECT cluster_name_0 AS k, 1e0 AS w, augmentation_index - mx AS x, "
                 f"{THINK} - mm AS m, {SHARE} - my AS y, "
                 f"(augmentation_index - mx) * (augmentation_index - mx) AS xx, ({THINK} - mm) * ({THINK} - mm) AS mmm, "
                 f"(augmentation_index - mx) * ({THINK} - mm) AS xm, (augmentation_index - mx) * ({SHARE} - my) AS xy, "
                 f"({THINK} - mm) * ({SHARE} - my) AS my2 FROM h5 CROSS JOIN mu)")
    else:
        units = ("un AS (SELECT task_name AS k, sum(1e0) AS w, sum(augmentation_index - mx) AS x, "
                 f"sum({THINK} - mm) AS m, sum({SHARE} - my) AS y, "
                 f"sum((augmentation_index - mx) * (augmentation_index - mx)) AS xx, "
                 f"sum(({THINK} - mm) * ({THINK} - mm)) AS mmm, sum((augmentation_index - mx) * ({THINK} - mm)) AS xm, "
                 f"sum((augmentation_index - mx) * ({SHARE} - my)) AS xy, sum(({THINK} - mm) * ({SHARE} - my)) AS my2 "
                 "FROM h5 CROSS JOIN mu GROUP BY task_name)")
    sk = (seed * 3266489917) % 4294967296
    rep = f"'{seed}:rep:' || rep"
    # all units lie in block 0 here (fewer than 65,536 of them)
    ctes = [H3S, H5S,
            f"mu AS (SELECT avg(augmentation_index) AS mx, avg({THINK}) AS mm, avg({SHARE}) AS my FROM h5)",
            units,
            "cu AS (SELECT *, dense_rank() OVER (ORDER BY k) - 1 AS code FROM un)",
            "uu AS (SELECT count(*) AS U FROM cu)",
            f"rp AS (SELECT rep, {_md5_word(rep, 1)} AS r1, {_md5_word(rep, 9)} AS r2 FROM range(0, {B}) r(rep))",
            f"w1 AS (SELECT {_mix32(f'((code + {sk}) % 4294967296)')} AS k1 FROM cu)",
            f"w2 AS (SELECT k1, {_mix32('k1')} AS k2 FROM w1)",
            "d0 AS (SELECT rep, xor(k1, r1) AS a, xor(k2, r2) AS b FROM w2 CROSS JOIN rp)",
            f"d1 AS (SELECT rep, {_mix32('a')} AS a, b FROM d0)",
            f"d2 AS (SELECT rep, a, {_mix32('xor(b, a)')} AS b FROM d1)",
            f"d3 AS (SELECT rep, {_mix32('xor(a, b)')} AS a, b FROM d2)",
            f"d5 AS (SELECT rep, a, {_mix32('xor(b, a)')} AS b FROM d3)",
            f"d4 AS (SELECT rep, least(CAST(floor({_U52} * U) AS BIGINT), U - 1) AS code FROM d5 CROSS JOIN uu)",
            "cnt AS (SELECT rep, code, count(*) AS c FROM d4 GROUP BY rep, code)",
            "s AS (SELECT rep, sum(c * w) AS W, sum(c * x) AS sx, sum(c * m) AS sm, sum(c * y) AS sy, "
            "sum(c * xx) AS sxx, sum(c * mmm) AS smm, sum(c * xm) AS sxm, sum(c * xy) AS sxy, sum(c * my2) AS smy "
            "FROM cnt JOIN cu USING (code) GROUP BY rep)",
            "cc AS (SELECT rep, sxx - sx * sx / W AS cxx, smm - sm * sm / W AS cmm, sxm - sx * sm / W AS cxm, "
            "sxy - sx * sy / W AS cxy, smy - sm * sy / W AS cmy FROM s)",
            "p AS (SELECT rep, (cxm / cxx) * ((cxx * cmy - cxm * cxy) / (cxx * cmm - cxm * cxm)) AS ind FROM cc)"]
    sel = ("SELECT count(*) AS n_reps, count(ind) AS n_valid, round(avg(ind), 8) AS boot_mean, "
           "round(stddev_samp(ind), 8) AS boot_sd, round(quantile_cont(ind, 0.025), 8) AS ci_lo, "
           "round(quantile_cont(ind, 0.975), 8) AS ci_hi, "
           "CASE WHEN quantile_cont(ind, 0.025) * quantile_cont(ind, 0.975) > 0 THEN 'excludes 0' "
           "ELSE 'includes 0' END AS verdict FROM p")
    return W(",\n".join(ctes), sel)


Q["boot_iid_exact"] = _boot_exact_sql("iid")
Q["boot_cluster_exact"] = _boot_exact_sql("cluster")


def _long(key: str, part: str, values: list[str], term: bool = False) -> str:
    t = "term" if term else "''"
    return "\nUNION ALL\n".join(
        f"SELECT '{part}' AS part, model_id, {t} AS term, '{v}' AS metric, CAST({v} AS DOUBLE) AS value "
        f"FROM ({Q[key]})" for v in values)


Q["plan_model_comparison"] = "\nUNION ALL\n".join([
    _long("model_comparison", "comparison", ["aic", "bic", "r2", "rmse_raw"]),
    _long("model_comparison_2", "second_predictor", ["coef", "se", "z", "fold_change", "r2"]),
    _long("trimmed_battery", "trimmed", ["coef", "se", "z", "n_excluded"], term=True)])

Q["glm_status"] = W(TASK_CC, f"""
SELECT 'share' AS model_id, count(*) AS n_used, 'ok' AS status FROM task_cc
UNION ALL SELECT 'beyond_one', count(*), CASE WHEN count(*) FILTER (WHERE {SHARE} * 100 >= 1) > 0 THEN 'domain' ELSE 'ok' END FROM task_cc
UNION ALL SELECT 'log_link', count(*), 'ok' FROM task_cc""")

Q["scan_csv"] = W("", "SELECT task_name, round(pct, 8) AS pct FROM fx_task_pct")
Q["scan_tsv"] = Q["prepare_clusters"]
Q["rename_map"] = W("", f"SELECT {_sel_round(['cluster_name_0', *[c for c in CLUSTER_COLS if c in ('cluster_directive', 'cluster_feedback_loop', 'cluster_task_iteration', 'cluster_learning', 'cluster_validation', 'cluster_none')]])} FROM clusters_prep")
Q["load_sources"] = Q["source_profile"].replace("13::BIGINT", "16::BIGINT")
Q["sink_csv"] = W("", f"SELECT {_sel_round(['task_name', SHARE, 'augmentation_index', 'thinking_fraction'])} FROM task_level")
Q["file_checksum"] = """
WITH hs AS (SELECT md5('V' || length(l) || ':' || l) AS h
            FROM (SELECT CAST(c_custkey AS VARCHAR) || ',' || c_name AS l FROM customer))
SELECT count(*) AS n_rows, CAST(sum(('0x' || substr(h, 1, 15))::BIGINT::HUGEINT) AS VARCHAR) AS sum_a,
       CAST(sum(('0x' || substr(h, 16, 15))::BIGINT::HUGEINT) AS VARCHAR) AS sum_b FROM hs"""


def oracle_sql() -> dict[str, str]:
    return dict(Q)
