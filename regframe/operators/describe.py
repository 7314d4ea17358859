"""Descriptives and correlation.

Every statistic of every variable comes out of ONE aggregation (partial
aggregates per partition, a tiny final merge), then is unpivoted to a long
table. Nothing is collected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sqltext as S
from ..functions.columns import present
from ..functions.tail_columns import t_p


WIDE = 24                     # variables up to which correlation unpivots rows into pairs


def descriptives(df: DataFrame, variables: list[str]) -> DataFrame:
    """Per variable n, mean, sd (n-1), min, max and the
    bias-corrected skewness G1 and excess kurtosis G2 (pandas' defaults).

    Spark's ``skewness``/``kurtosis`` are the population g1/g2;
    G1 = g1*sqrt(n(n-1))/(n-2), G2 = (n-1)/((n-2)(n-3))*((n+1)g2 + 6).

    Plan: unpivot to (variable, value) with ``stack`` inside the scan task,
    drop missing values, ``groupBy(variable)`` with seven aggregates. The
    partial aggregation leaves one row per variable per partition, so the
    shuffle is tiny and the aggregate stays inside whole-stage codegen
    (one wide 80-buffer aggregate would not)."""
    spark = df.sparkSession
    vs = present(df, variables)
    st = ", ".join(f"{i}, '{v}', CAST({_numsql(v)} AS DOUBLE)" for i, v in enumerate(vs))
    long = spark.sql(f"SELECT stack({len(vs)}, {st}) AS (ord, variable, value) FROM {{t}}", t=df)
    g = long.where("value IS NOT NULL").groupBy("ord", "variable").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"),
        F.min("value").alias("min"), F.max("value").alias("max"), F.skewness("value").alias("g1"),
        F.kurtosis("value").alias("g2"))
    allv = spark.createDataFrame([(i, v) for i, v in enumerate(vs)], "ord int, variable string")
    j = allv.join(g.drop("variable"), "ord", "left")
    n = "CAST(n AS DOUBLE)"
    return spark.sql(
        "SELECT ord, variable, coalesce(n, 0L) AS n, mean, sd, min, max, "
        f"CASE WHEN n > 2 THEN g1 * sqrt({n} * ({n} - 1)) / ({n} - 2) END AS skewness, "
        f"CASE WHEN n > 3 THEN ({n} - 1) / (({n} - 2) * ({n} - 3)) * (({n} + 1) * g2 + 6) END AS kurtosis "
        "FROM {t}", t=j)


def _numsql(c: str) -> str:
    """Value with NaN treated as missing."""
    return f"CASE WHEN NOT isnan({S.q(c)}) THEN {S.q(c)} END"


def coverage(df: DataFrame, variables: list[str]) -> DataFrame:
    """Non-null count and percentage with data, per variable."""
    vs = present(df, variables)
    wide = S.sql_df(df, "count(1) AS n_rows, " + ", ".join(f"count({_numsql(v)}) AS c{i}" for i, v in enumerate(vs)))
    rows = ", ".join(f"'{v}', c{i}" for i, v in enumerate(vs))
    return wide.sparkSession.sql(
        "SELECT variable, n_present, n_rows, try_divide(100D * n_present, n_rows) AS pct_present FROM "
        f"(SELECT n_rows, stack({len(vs)}, {rows}) AS (variable, n_present) FROM {{t}})", t=wide)


def corr_pairwise(df: DataFrame, variables: list[str], both_orders: bool = False) -> DataFrame:
    """Pearson r for every pair on pairwise-complete rows, its n
    and t = r*sqrt((n-2)/(1-r^2)) (p from t with n-2 df is added by
    :func:`with_corr_pvalues`).

    One pass: each row is unpivoted into its (pair, a, b) values inside the
    scan task (``stack``), rows with a missing side are dropped (pairwise
    deletion), and ``groupBy(pair)`` computes the count and the population
    co-moments. These merge stably across partitions, partial aggregation
    leaves one row per pair per partition, and with three small aggregates
    per group the operator stays inside whole-stage codegen. That makes k^2/2
    rows of each input row, so tables of more than ``WIDE`` variables take
    products of value and presence blocks instead
    (:func:`moments.pairwise_moments`)."""
    spark = df.sparkSession
    vs = present(df, variables)
    if len(vs) > WIDE:
        from .moments import pairwise_moments
        names = F.lit(vs)
        res = pairwise_moments(df, vs).select(names[F.col("i")].alias("var_i"), names[F.col("j")].alias("var_j"), "n", "r")
        return _with_t(res, both_orders)
    pairs = [(i, j) for i in range(len(vs)) for j in range(i + 1, len(vs))]
    cast = [f"CAST({_numsql(v)} AS DOUBLE)" for v in vs]
    st = ", ".join(f"{i}, {j}, {cast[i]}, {cast[j]}" for i, j in pairs)
    long = spark.sql(f"SELECT stack({len(pairs)}, {st}) AS (i, j, a, b) FROM {{t}}", t=df)
    # covar_pop / var_pop merge co-moments stably; r = cov / sqrt(va vb)
    # with try_divide, because Spark's own corr raises on a constant column
    # under ANSI arithmetic
    g = (long.where("a IS NOT NULL AND b IS NOT NULL").groupBy("i", "j")
         .agg(F.count(F.lit(1)).alias("n"),
              F.expr("try_divide(covar_pop(a, b), sqrt(var_pop(a) * var_pop(b)))").alias("r")))
    allp = spark.createDataFrame([(i, j, vs[i], vs[j]) for i, j in pairs],
                                 "i int, j int, var_i string, var_j string")
    res = spark.sql("SELECT var_i, var_j, coalesce(n, 0L) AS n, CASE WHEN NOT isnan(r) THEN r END AS r FROM {t}",
                    t=allp.join(g, ["i", "j"], "left"))
    return _with_t(res, both_orders)


def _with_t(res: DataFrame, both_orders: bool) -> DataFrame:
    if both_orders:
        res = res.unionByName(res.select(F.col("var_j").alias("var_i"), F.col("var_i").alias("var_j"), "n", "r"))
    return res.withColumn("t", F.expr(
        "CASE WHEN n > 2 AND abs(r) < 1 THEN r * sqrt((CAST(n AS DOUBLE) - 2) / (1 - r * r)) END"))


def with_corr_pvalues(corr_long: DataFrame) -> DataFrame:
    """Two-sided t p-values with n - 2 degrees of freedom, beside every pair."""
    return corr_long.withColumn("p", t_p(F.col("t"), F.col("n") - 2))


def corr_matrix_wide(corr_long: DataFrame, variables: list[str]) -> DataFrame:
    """Labelled square matrix (diagonal 1) from the long table."""
    both = corr_long.select("var_i", "var_j", "r").unionByName(
        corr_long.select(F.col("var_j").alias("var_i"), F.col("var_i").alias("var_j"), "r"))
    diag = corr_long.sparkSession.createDataFrame([(v, v, 1.0) for v in variables], "var_i string, var_j string, r double")
    return both.unionByName(diag).groupBy("var_i").pivot("var_j", variables).agg(F.first("r"))


def simple_linreg(df: DataFrame, x: str, y: str, y_log: bool = False) -> DataFrame:
    """Closed-form simple regression b0, b1, R^2, r, n on complete
    cases, from population co-moments (one aggregation). Divisions are
    ``try_divide``: a constant x gives NULL slope instead of an ANSI error;
    R^2 is NULL when var(x) = 0 and 1 when var(y) = 0."""
    yy = f"ln({S.q(y)})" if y_log else S.q(y)
    d = S.sql_df(df, f"{_numsql(x)} AS x, {yy} AS y").where("x IS NOT NULL AND y IS NOT NULL")
    m = S.sql_df(d, "avg(x) AS mx, avg(y) AS my, covar_pop(x, y) AS cxy, var_pop(x) AS vx, var_pop(y) AS vy, "
                    "count(1) AS n")
    return S.sql_df(m, (
        "my - try_divide(cxy, vx) * mx AS b0, try_divide(cxy, vx) AS b1, "
        "CASE WHEN vx = 0 THEN NULL WHEN vy = 0 THEN 1D ELSE power(try_divide(cxy, sqrt(vx * vy)), 2) END AS r2, "
        "try_divide(cxy, sqrt(vx * vy)) AS r, n"))


def percentiles(df: DataFrame, col: str, probs: list[float], n_ranges: int | None = None,
                method: str = "exact", accuracy: int = 10000) -> DataFrame:
    """Exact percentiles with linear interpolation (numpy's default),
    without funnelling the column through one task (Spark's ``percentile``
    merges every distinct value in a single final buffer).

    Equal values are counted first (combining map-side), so a column that is
    mostly one value is one row of that value. The distinct values are
    range-partitioned, each range is counted (one row per range to the driver),
    and running counts inside the ranges that hold order statistics
    floor(p(n-1)) and ceil(p(n-1)) give them. The range assignment is
    checkpointed so a recomputed partition cannot move a boundary. Returns one
    row with array column ``q``.

    ``method="approx"``: Spark's ``percentile_approx`` (mergeable sketches,
    one aggregation, rank error about 1/accuracy) for when exact order
    statistics are not needed."""
    if method == "approx":
        return df.agg(F.percentile_approx(F.col(col).cast("double"), list(probs), accuracy).alias("q"))
    if method != "exact":
        raise ValueError("method must be 'exact' or 'approx'")
    from pyspark.sql import Window
    from ..session import checkpoint_dir
    spark = df.sparkSession
    checkpoint_dir(spark)
    v = df.select(F.col(col).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    v = v.groupBy("v").agg(F.count(F.lit(1)).alias("times"))
    v = v.repartitionByRange(n_ranges, "v") if n_ranges else v.repartitionByRange("v")
    v = v.withColumn("pid", F.spark_partition_id()).checkpoint(eager=True)
    counts = sorted((r["pid"], r["n"]) for r in v.groupBy("pid").agg(F.sum("times").alias("n")).collect())
    n = sum(c for _, c in counts)
    if n == 0:
        return spark.createDataFrame([([None] * len(probs),)], "q array<double>")
    starts, acc = {}, 0
    for pid, c in counts:
        starts[pid] = acc
        acc += c
    ranks = {}
    for p in probs:
        r = p * (n - 1)
        for k in (math.floor(r), math.ceil(r)):
            pid = max(q for q, s0 in starts.items() if s0 <= k)
            ranks[k] = (pid, k - starts[pid])
    w = Window.partitionBy("pid").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    upto = (v.where(F.col("pid").isin(sorted({p for p, _ in ranks.values()})))
            .withColumn("upto", F.sum("times").over(w)))
    val = {}
    for pid, i in set(ranks.values()):                    # two ranks per probability
        hit = (F.col("pid") == pid) & (F.col("upto") > i) & (F.col("upto") - F.col("times") <= i)
        val[(pid, i)] = hit
    hits = upto.select("v", *[h.alias(f"h{j}") for j, h in enumerate(val.values())])
    got = hits.agg(*[F.max(F.when(F.col(f"h{j}"), F.col("v"))).alias(f"v{j}") for j in range(len(val))]).first()
    val = {k: got[f"v{j}"] for j, k in enumerate(val)}
    out = []
    for p in probs:
        r = p * (n - 1)
        lo, hi = val[ranks[math.floor(r)]], val[ranks[math.ceil(r)]]
        out.append(lo + (r - math.floor(r)) * (hi - lo))
    return spark.createDataFrame([(out,)], "q array<double>")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table."""
    out = None
    for name, t in tables.items():
        r = t.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = r if out is None else out.unionByName(r)
    return out


def table_checksum(df: DataFrame, cols: list[str] | None = None, digits: int = 9) -> DataFrame:
    """Order-free content checksum: row count, and two sums of 60-bit
    words of an md5 of each row.

    Every column enters with a NULL mark or its length and text, so values
    cannot move between columns unseen; doubles are rounded to ``digits``
    decimals first. Sums, unlike XOR, also see rows that occur twice. Any SQL
    engine can compute the same."""
    dt = dict(df.dtypes)

    def text(c: str) -> Column:
        v = df["`" + c.replace("`", "``") + "`"]
        if dt[c] not in ("double", "float"):
            return v.cast("string")
        whole = F.round(v.cast("double") * F.lit(float(10 ** digits))).cast("decimal(38,0)").cast("string")
        finite = ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
        return F.when(v.isNull() | finite, whole).otherwise(v.cast("string"))

    framed = [F.coalesce(F.concat(F.lit("V"), F.length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("N;"))
              for c in (cols or df.columns)]
    words = df.select(F.md5(F.concat(*framed)).alias("h"))

    def total(at: int) -> Column:
        word = F.conv(F.substring("h", at, 15), 16, 10).cast("decimal(20,0)")
        return F.coalesce(F.sum(word), F.lit(0)).cast("decimal(38,0)").cast("string")

    return words.agg(F.count(F.lit(1)).alias("n_rows"), total(1).alias("sum_a"), total(16).alias("sum_b"))


def fit_line_grid(df: DataFrame, x: str, b0: float, b1: float, points: int = 100,
                  y_log: bool = False) -> DataFrame:
    """``points`` equally spaced x over [min, max] of ``x`` (complete
    cases) with the fitted line ``b0 + b1 x`` (exp'd back when ``y_log``).
    One aggregate for the range; the grid is ``spark.range(points)``."""
    spark = df.sparkSession
    rng = S.select_agg(df, [f"min({S.q(x)}) AS lo", f"max({S.q(x)}) AS hi"])
    lo, hi = rng["lo"], rng["hi"]
    step = (hi - lo) / (points - 1) if points > 1 else 0.0
    xs = f"({S.lit(lo)} + CAST(id AS DOUBLE) * {S.lit(step)})"
    yhat = f"({S.lit(b0)} + {S.lit(b1)} * {xs})"
    return spark.range(points).selectExpr("id AS i", f"{xs} AS x", f"{yhat} AS yhat")


def scatter_binned(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """B23 at scale: a 2-D histogram instead of millions of points. Bin
    edges span [min, max] of each axis on complete cases; counts per
    non-empty cell come from one groupBy (cells <= bins^2)."""
    d = df.select(F.col(x).alias("x"), F.col(y).alias("y")).na.drop()
    r = S.select_agg(d, ["min(x) AS x0", "max(x) AS x1", "min(y) AS y0", "max(y) AS y1"])

    def b(c: str, lo: float, hi: float) -> str:
        w = (hi - lo) if hi > lo else 1.0
        return f"least(CAST(floor(({c} - {S.lit(lo)}) / {S.lit(w)} * {bins}) AS INT), {bins - 1})"
    return d.selectExpr(f"{b('x', r['x0'], r['x1'])} AS bx", f"{b('y', r['y0'], r['y1'])} AS by") \
        .groupBy("bx", "by").agg(F.count(F.lit(1)).alias("n"))


def durbin_watson(df: DataFrame, resid: Column, order: str, n_ranges: int | None = None) -> float:
    """sum((e_t - e_{t-1})^2) / sum(e_t^2) along an explicit order
    column, without a single-partition window: range-partition by the order
    key, take differences inside each range (window per range id), then add
    the few boundary differences between consecutive ranges from a
    first/last-per-range aggregate (one row per range).

    The order must be an order: rows that share an order value, or lack one,
    have no place among each other, and raise a ``ValueError``."""
    from pyspark.sql import Window
    from ..session import checkpoint_dir
    spark = df.sparkSession
    checkpoint_dir(spark)
    d = df.select(F.col(order).alias("__o"), resid.alias("__e")).where("__e IS NOT NULL")
    d = d.repartitionByRange(n_ranges, "__o") if n_ranges else d.repartitionByRange("__o")
    d = d.withColumn("__pid", F.spark_partition_id()).checkpoint(eager=True)
    w = Window.partitionBy("__pid").orderBy("__o")
    inner = d.withColumns({"__d": F.col("__e") - F.lag("__e").over(w), "__p": F.lag("__o").over(w)}).agg(
        F.sum(F.col("__d") * F.col("__d")).alias("num"), F.sum(F.col("__e") * F.col("__e")).alias("den"),
        F.count_if(F.col("__o").isNull()).alias("without"),
        F.count_if(F.col("__o") == F.col("__p")).alias("repeated")).first()
    if inner["repeated"] or inner["without"]:          # equal values share a range
        raise ValueError(f"{order} orders no rows: {inner['repeated']} repeat a value, {inner['without']} have none")
    ends = (d.groupBy("__pid").agg(F.min_by("__e", "__o").alias("first"), F.max_by("__e", "__o").alias("last"))
            .orderBy("__pid").collect())          # one row per range
    num = inner["num"] or 0.0
    for a, b_ in zip(ends, ends[1:]):
        num += (b_["first"] - a["last"]) ** 2
    return num / inner["den"] if inner["den"] else float("nan")


def distinct_counts(df: DataFrame, cols: list[str], approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """Distinct values per column in one aggregation -- exact
    ``count(DISTINCT)`` (Spark plans it as a two-level aggregate, partial
    per key first) or HyperLogLog++ sketches (``approx=True``, relative
    standard deviation ``rsd``) when exact counts are not needed."""
    f = (lambda c: F.approx_count_distinct(c, rsd)) if approx else F.count_distinct
    return df.agg(*[f(c).alias(f"n_{c}") for c in cols])
