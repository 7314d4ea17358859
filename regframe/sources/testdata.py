"""The four logical sources, derived from the TPC-H-style test tables.

Mapping (documented in FIXTURES.md §3): part = task, customer = cluster, the
customer's top part by spend = the cluster's task, nation+segment / region =
the coarser cluster levels, the six ``returnflag||linestatus`` values = five
interaction patterns plus ``none``, high-discount lines = thinking rate.
Key gaps come from the lines themselves: a part without any line of one
pattern is absent from a task file. Ratios below a floor are suppressed
(NULL), keys are padded and of mixed case, and a customer whose last ratio is
suppressed has no third name level. No part, line or customer is left out by
its key.

Scale notes
-----------
* ``lineitem`` is the largest input. Per-part statistics are one
  partial/final aggregation of it on the part key; that part-sized table is
  joined to the names once, persisted, and feeds the three task sources. The
  grand total scans one column.
* Per-customer statistics read the lines joined to ``orders`` on the order
  key, through a per-(order, customer) pre-aggregate -- which the join's
  order-key partitioning already satisfies, so it adds no shuffle -- then a
  partial/final aggregation on the customer. Counting the per-order rows
  gives "orders with lines" without a DISTINCT. No line-sized copy is kept:
  the two customer aggregates share the join's exchange within their query.
* The customer's top part needs the (customer, part) grain: that is the one
  wide shuffle, three columns wide, followed by an arg-max aggregate
  (``max(struct(spend, -partkey))``), not a window -- a customer holding a
  third of all lines is spread by its parts, and its maxima combine map-side.
* ``part`` and ``customer`` grow with the lines, so their joins are merge
  joins by hint: from a file's size Spark takes them for small enough to
  collect on the driver and broadcast, long after they are not.
* Grand totals (for percentage shares) are one-row aggregates attached with
  a broadcast cross join -- the broadcast side has exactly one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Interaction pattern codes (returnflag || linestatus) -> source column.
# Fixed values of the mapping:
PATTERNS = [
    ("AF", "directive"),
    ("AO", "feedback_loop"),
    ("NF", "task_iteration"),
    ("NO", "learning"),
    ("RF", "validation"),
    ("RO", "filtered"),
]
# Cluster-file column names for the same six patterns (plain names; the
# original names with ``collaboration:`` prefixes are handled by the rename
# map in functions.columns).
CLUSTER_PATTERN_COLS = [
    "collab_directive_ratio",
    "collab_feedback_loop_ratio",
    "collab_task_iteration_ratio",
    "collab_learning_ratio",
    "collab_validation_ratio",
    "collab_none_ratio",
]
LINES_PER_TASK = 1_000_000   # lines that one task of a line-sized shuffle sorts or adds up
THINK_DISCOUNT = 0.05        # a line "uses thinking" when discount >= 5 %
RATIO_SUPPRESS = 0.08        # cluster ratios below this are withheld (NULL)
THINK_SUPPRESS = 0.30        # cluster thinking ratio below this is withheld


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _task_name(p: DataFrame) -> Column:
    return F.concat(F.lower(p["p_name"]), F.lit(" #"), p["p_partkey"].cast("string"))


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_extendedprice", "l_discount",
        F.concat("l_returnflag", "l_linestatus").alias("pattern"))


def _line_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Partitions of line-sized shuffles. Their number follows the number of lines (which Spark counts in the
    files' footers), so that what one task sorts and adds up stays the same; sized by compressed bytes, as AQE
    does, columns that compress well put many times as many lines into a task."""
    return max(spark.sparkContext.defaultParallelism, -(-_lineitem(spark, sf_dir).count() // LINES_PER_TASK))


def _lines(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    n = tasks or _line_tasks(spark, sf_dir)
    li = _lineitem(spark, sf_dir).repartition(n, "l_orderkey")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").repartition(n, "o_orderkey")
    return li.join(o.hint("merge"), li["l_orderkey"] == o["o_orderkey"]).drop("o_orderkey")


_COUNTS = [f"c_{name}" for _, name in PATTERNS] + ["c_think"]


def _line_counts() -> list[Column]:
    aggs = [F.count_if(F.col("pattern") == code).alias(f"c_{name}") for code, name in PATTERNS]
    return aggs + [F.count_if(F.col("l_discount") >= THINK_DISCOUNT).alias("c_think")]


def _per_part(lines: DataFrame) -> DataFrame:
    """Task-level statistics: one partial/final aggregation of the lines on
    the part key (map-side combine leaves one row per part per partition).
    Ratios are counts over lines -- integer sums, so identical to averaging
    the 0/1 flags."""
    g = lines.groupBy("l_partkey").agg(
        F.sum("l_extendedprice").alias("spend"), F.count(F.lit(1)).alias("n"), *_line_counts(),
        F.count_if((F.col("pattern") == PATTERNS[-1][0]) & (F.col("l_discount") >= THINK_DISCOUNT)).alias("c_last"))
    return g.select("l_partkey", "spend", "c_last",
                    *[(F.col(f"c_{name}") / F.col("n")).alias(name) for _, name in PATTERNS],
                    (F.col("c_think") / F.col("n")).alias("thinking_fraction"))


def task_sources(spark: SparkSession, sf_dir: str, persist: bool = True) -> dict[str, DataFrame]:
    """``task_pct`` lacks parts without a line of the first pattern,
    ``interaction`` those without one of the last, ``thinking`` those without
    a discounted line of the last."""
    lines = _lineitem(spark, sf_dir)
    pp = _per_part(lines)
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name").hint("merge")
    total = lines.agg(F.sum("l_extendedprice").alias("total_spend"))   # over all lines, as the share base
    named = pp.join(part, pp["l_partkey"] == part["p_partkey"]).drop("l_partkey")
    if persist:
        named = named.persist()                           # one row per part
    name = _task_name(named).alias("task_name")
    task_pct = (named.filter(F.col(PATTERNS[0][1]) > 0).crossJoin(F.broadcast(total))
                .select(name, (F.lit(100.0) * F.col("spend") / F.col("total_spend")).alias("pct")))
    interaction = named.filter(F.col(PATTERNS[-1][1]) > 0).select(name, *[n for _, n in PATTERNS])
    thinking = named.filter("c_last > 0").select(name, "thinking_fraction")
    return {"task_pct": task_pct, "interaction": interaction, "thinking": thinking}


def cluster_source(spark: SparkSession, sf_dir: str, persist: bool = True) -> DataFrame:
    tasks = _line_tasks(spark, sf_dir)
    lines = _lines(spark, sf_dir, tasks)
    # per customer, through a per-order pre-aggregate: grouping by
    # (order, customer) is satisfied by the join's order-key partitioning
    # (no shuffle), and counting the order rows gives "orders with lines"
    # without a DISTINCT
    per_order = lines.groupBy("l_orderkey", "o_custkey").agg(F.count(F.lit(1)).alias("n"), *_line_counts())
    cust = per_order.groupBy("o_custkey").agg(
        F.sum("n").alias("n_lines"), F.count(F.lit(1)).alias("n_orders"), *[F.sum(c).alias(c) for c in _COUNTS])
    cust = cust.select("o_custkey", "n_lines", "n_orders",
                       *[(F.col(f"c_{name}") / F.col("n_lines")).alias(f"r{i}")
                         for i, (_, name) in enumerate(PATTERNS, 1)],
                       (F.col("c_think") / F.col("n_lines")).alias("rt"))
    if persist:
        cust = cust.persist()                             # one row per customer, for the totals too
    # top part per customer: the one wide shuffle ((customer, part, spend)),
    # then an arg-max aggregate (ties to the smaller part key) -- no window.
    # Hardly two lines share a pair, so they are added up behind the shuffle only
    top = (lines.repartition(tasks, "o_custkey", "l_partkey").groupBy("o_custkey", "l_partkey").agg(F.sum("l_extendedprice").alias("spend"))
           .groupBy(F.col("o_custkey").alias("t_custkey"))
           .agg(F.max(F.struct(F.col("spend"), (-F.col("l_partkey")).alias("neg_key"))).alias("best"))
           .select("t_custkey", (-F.col("best.neg_key")).alias("top_partkey")))

    orders = read_table(spark, sf_dir, "orders").select("o_orderkey")
    totals = cust.agg(F.sum("n_lines").alias("all_lines")).crossJoin(
        orders.agg(F.count(F.lit(1)).alias("all_orders")))

    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment").hint("merge")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name").hint("merge")

    j = (cust.join(top, cust["o_custkey"] == top["t_custkey"])
         .join(c, F.col("o_custkey") == c["c_custkey"])
         .join(n, c["c_nationkey"] == n["n_nationkey"])
         .join(r, n["n_regionkey"] == r["r_regionkey"])
         .join(p, F.col("top_partkey") == p["p_partkey"])
         .crossJoin(F.broadcast(totals)))

    def suppress(col: str, floor: float) -> Column:
        return F.when(F.col(col) < floor, F.lit(None).cast("double")).otherwise(F.col(col))

    onet = F.concat(F.lit("  "), F.upper(F.expr("substring(p_name, 1, 1)")),
                    F.expr("substring(p_name, 2)"), F.lit(" #"),
                    F.col("p_partkey").cast("string"), F.lit(" "))
    return j.select(
        onet.alias("onet_task"),
        F.col("c_name").alias("cluster_name_0"),
        F.concat(F.col("n_name"), F.lit(" "), F.col("c_mktsegment")).alias("cluster_name_1"),
        F.when(F.col(f"r{len(PATTERNS)}") >= RATIO_SUPPRESS, F.col("r_name")).alias("cluster_name_2"),
        *[suppress(f"r{i}", RATIO_SUPPRESS).alias(name) for i, name in enumerate(CLUSTER_PATTERN_COLS, 1)],
        suppress("rt", THINK_SUPPRESS).alias("has_thinking_ratio"),
        (F.lit(100.0) * F.col("n_lines") / F.col("all_lines")).alias("percent_records"),
        (F.lit(100.0) * F.col("n_orders") / F.col("all_orders")).alias("percent_users"),
    )


def testdata_sources(spark: SparkSession, sf_dir: str, persist: bool = True) -> dict[str, DataFrame]:
    """``{task_pct, interaction, thinking, clusters}`` over the test tables.

    ``persist`` keeps the per-part and the per-customer aggregate (recomputable
    from lineage if an executor is lost), so the task files share one aggregation
    of the lines, and the clusters and their totals another."""
    return {**task_sources(spark, sf_dir, persist), "clusters": cluster_source(spark, sf_dir, persist)}
