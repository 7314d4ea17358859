"""DuckDB text of the fixture mapping (FIXTURES.md §3) and of the dataset
build, written independently of the Spark code. Every oracle query is
``WITH <BASE>, <its own CTEs> SELECT ...``; DuckDB drops CTEs a query does
not reference.
"""

FX = """
fx_item AS (
  SELECT l_partkey, l_extendedprice, l_discount, l_returnflag || l_linestatus AS pattern FROM lineitem),
fx_line AS (
  SELECT l.l_orderkey, l.l_partkey, o.o_custkey, l.l_extendedprice, l.l_discount,
         l.l_returnflag || l.l_linestatus AS pattern
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
fx_task_pct AS (
  SELECT lower(p.p_name) || ' #' || CAST(p.p_partkey AS VARCHAR) AS task_name,
         100e0 * sum(f.l_extendedprice) / (SELECT sum(l_extendedprice) FROM fx_item) AS pct
  FROM fx_item f JOIN part p ON p.p_partkey = f.l_partkey
  GROUP BY p.p_partkey, p.p_name HAVING count(*) FILTER (WHERE pattern = 'AF') > 0),
fx_interaction AS (
  SELECT lower(p.p_name) || ' #' || CAST(p.p_partkey AS VARCHAR) AS task_name,
         avg(CASE WHEN pattern = 'AF' THEN 1e0 ELSE 0e0 END) AS directive,
         avg(CASE WHEN pattern = 'AO' THEN 1e0 ELSE 0e0 END) AS feedback_loop,
         avg(CASE WHEN pattern = 'NF' THEN 1e0 ELSE 0e0 END) AS task_iteration,
         avg(CASE WHEN pattern = 'NO' THEN 1e0 ELSE 0e0 END) AS learning,
         avg(CASE WHEN pattern = 'RF' THEN 1e0 ELSE 0e0 END) AS validation,
         avg(CASE WHEN pattern = 'RO' THEN 1e0 ELSE 0e0 END) AS filtered
  FROM fx_item f JOIN part p ON p.p_partkey = f.l_partkey
  GROUP BY p.p_partkey, p.p_name HAVING count(*) FILTER (WHERE pattern = 'RO') > 0),
fx_thinking AS (
  SELECT lower(p.p_name) || ' #' || CAST(p.p_partkey AS VARCHAR) AS task_name,
         avg(CASE WHEN f.l_discount >= 5e-2 THEN 1e0 ELSE 0e0 END) AS thinking_fraction
  FROM fx_item f JOIN part p ON p.p_partkey = f.l_partkey
  GROUP BY p.p_partkey, p.p_name HAVING count(*) FILTER (WHERE pattern = 'RO' AND l_discount >= 5e-2) > 0),
fx_cust_part AS (
  SELECT o_custkey, l_partkey,
         row_number() OVER (PARTITION BY o_custkey ORDER BY sum(l_extendedprice) DESC, l_partkey) AS rn
  FROM fx_line GROUP BY o_custkey, l_partkey),
fx_cust AS (
  SELECT o_custkey, count(*) AS n_lines, count(DISTINCT l_orderkey) AS n_orders,
         avg(CASE WHEN pattern = 'AF' THEN 1e0 ELSE 0e0 END) AS r1,
         avg(CASE WHEN pattern = 'AO' THEN 1e0 ELSE 0e0 END) AS r2,
         avg(CASE WHEN pattern = 'NF' THEN 1e0 ELSE 0e0 END) AS r3,
         avg(CASE WHEN pattern = 'NO' THEN 1e0 ELSE 0e0 END) AS r4,
         avg(CASE WHEN pattern = 'RF' THEN 1e0 ELSE 0e0 END) AS r5,
         avg(CASE WHEN pattern = 'RO' THEN 1e0 ELSE 0e0 END) AS r6,
         avg(CASE WHEN l_discount >= 5e-2 THEN 1e0 ELSE 0e0 END) AS rt
  FROM fx_line GROUP BY o_custkey),
fx_clusters AS (
  SELECT '  ' || upper(substring(p.p_name, 1, 1)) || substring(p.p_name, 2)
              || ' #' || CAST(p.p_partkey AS VARCHAR) || ' ' AS onet_task,
         c.c_name AS cluster_name_0,
         n.n_name || ' ' || c.c_mktsegment AS cluster_name_1,
         CASE WHEN s.r6 < 8e-2 THEN NULL ELSE r.r_name END AS cluster_name_2,
         CASE WHEN s.r1 < 8e-2 THEN NULL ELSE s.r1 END AS collab_directive_ratio,
         CASE WHEN s.r2 < 8e-2 THEN NULL ELSE s.r2 END AS collab_feedback_loop_ratio,
         CASE WHEN s.r3 < 8e-2 THEN NULL ELSE s.r3 END AS collab_task_iteration_ratio,
         CASE WHEN s.r4 < 8e-2 THEN NULL ELSE s.r4 END AS collab_learning_ratio,
         CASE WHEN s.r5 < 8e-2 THEN NULL ELSE s.r5 END AS collab_validation_ratio,
         CASE WHEN s.r6 < 8e-2 THEN NULL ELSE s.r6 END AS collab_none_ratio,
         CASE WHEN s.rt < 3e-1 THEN NULL ELSE s.rt END AS has_thinking_ratio,
         100e0 * s.n_lines / (SELECT count(*) FROM fx_line) AS percent_records,
         100e0 * s.n_orders / (SELECT count(*) FROM orders) AS percent_users
  FROM fx_cust s
  JOIN fx_cust_part t ON t.o_custkey = s.o_custkey AND t.rn = 1
  JOIN customer c ON c.c_custkey = s.o_custkey
  JOIN nation n ON n.n_nationkey = c.c_nationkey
  JOIN region r ON r.r_regionkey = n.n_regionkey
  JOIN part p ON p.p_partkey = t.l_partkey)"""

# dataset build in SQL: normalised keys, full outer + provenance, left
# thinking, null-strict indices, cluster preparation, integration, samples.
BUILD = r"""
tp AS (SELECT regexp_replace(lower(task_name), '^\s+|\s+$', '', 'g') AS task_name, pct FROM fx_task_pct),
ia AS (SELECT regexp_replace(lower(task_name), '^\s+|\s+$', '', 'g') AS task_name,
              directive, feedback_loop, task_iteration, learning, validation, filtered FROM fx_interaction),
th AS (SELECT regexp_replace(lower(task_name), '^\s+|\s+$', '', 'g') AS task_name, thinking_fraction FROM fx_thinking),
outer_ind AS (
  SELECT coalesce(tp.task_name, ia.task_name) AS task_name, tp.pct,
         ia.directive, ia.feedback_loop, ia.task_iteration, ia.learning, ia.validation, ia.filtered,
         CASE WHEN tp.task_name IS NOT NULL AND ia.task_name IS NOT NULL THEN 'both'
              WHEN tp.task_name IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS merge_status
  FROM tp FULL OUTER JOIN ia ON tp.task_name = ia.task_name),
task_base AS (
  SELECT o.task_name, o.pct AS task_conversation_share,
         o.directive, o.feedback_loop, o.task_iteration, o.learning, o.validation, o.filtered,
         th.thinking_fraction,
         o.directive + o.feedback_loop AS automation_index,
         o.task_iteration + o.learning + o.validation AS augmentation_index,
         o.feedback_loop + o.validation AS risk_management_index
  FROM outer_ind o LEFT JOIN th ON o.task_name = th.task_name),
clusters_prep AS (
  SELECT regexp_replace(lower(onet_task), '^\s+|\s+$', '', 'g') AS task_name,
         cluster_name_0, cluster_name_1, cluster_name_2,
         collab_directive_ratio AS cluster_directive,
         collab_feedback_loop_ratio AS cluster_feedback_loop,
         collab_task_iteration_ratio AS cluster_task_iteration,
         collab_learning_ratio AS cluster_learning,
         collab_validation_ratio AS cluster_validation,
         collab_none_ratio AS cluster_none,
         has_thinking_ratio AS cluster_thinking_fraction,
         percent_records, percent_users,
         collab_directive_ratio + collab_feedback_loop_ratio AS cluster_automation_index,
         collab_task_iteration_ratio + collab_learning_ratio + collab_validation_ratio AS cluster_augmentation_index,
         collab_feedback_loop_ratio + collab_validation_ratio AS cluster_risk_management_index
  FROM fx_clusters),
integrated AS (
  SELECT b.*, c.cluster_name_0, c.cluster_name_1, c.cluster_name_2,
         c.cluster_directive, c.cluster_feedback_loop, c.cluster_task_iteration, c.cluster_learning,
         c.cluster_validation, c.cluster_none, c.cluster_thinking_fraction,
         c.percent_records, c.percent_users,
         c.cluster_automation_index, c.cluster_augmentation_index, c.cluster_risk_management_index
  FROM task_base b LEFT JOIN clusters_prep c ON b.task_name = c.task_name),
task_level AS (SELECT * FROM task_base),
cluster_level AS (SELECT * FROM integrated WHERE cluster_name_0 IS NOT NULL)"""

BASE = FX + "," + BUILD


def with_base(ctes: str, select: str) -> str:
    """``WITH <fixture+build>[, ctes] <select>``."""
    c = BASE + ("," + ctes if ctes.strip() else "")
    return "WITH " + c + "\n" + select
