"""Multi-level dataset assembly.

All joins are equi-joins on the normalised ``task_name``. At scale Spark
shuffles both sides on that key once (or broadcasts a side AQE measured as
small); the fan-out of the cluster join is bounded by the number of clusters
per task, and every diagnostic is an aggregate with a map-side partial phase.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (COLLAB_RENAMES, coerce_numeric, composite, drop_present,
                                 nan_to_null, normalize_key, present, rename_present)

KEY = "task_name"

TASK_RATIOS = ["directive", "feedback_loop", "task_iteration", "learning", "validation", "filtered"]
CLUSTER_RATIOS = ["cluster_directive", "cluster_feedback_loop", "cluster_task_iteration",
                  "cluster_learning", "cluster_validation", "cluster_none"]
# composite indices: name -> parts (task level and cluster level)
TASK_INDICES = {
    "automation_index": ["directive", "feedback_loop"],
    "augmentation_index": ["task_iteration", "learning", "validation"],
    "risk_management_index": ["feedback_loop", "validation"],
}
CLUSTER_INDICES = {f"cluster_{k}": [f"cluster_{p}" for p in v] for k, v in TASK_INDICES.items()}
PERCENT_COLS = ["percent_records", "percent_users"]


def with_normalized_key(df: DataFrame, col: str = KEY) -> DataFrame:
    return df.withColumn(col, normalize_key(col))


def key_gaps(left: DataFrame, right: DataFrame, key: str = KEY, sample: int = 5) -> DataFrame:
    """Keys on one side only, both ways: count plus the ``sample``
    smallest offending keys. Anti-join, then a count and a bounded top-k (the
    sample is the feature; the gap set itself is never collected)."""
    def side(a: DataFrame, b: DataFrame, label: str) -> DataFrame:
        only = a.select(key).distinct().join(b.select(key), key, "left_anti")
        cnt = only.agg(F.count(F.lit(1)).alias("n_keys"))
        smp = (only.orderBy(key).limit(sample)
               .agg(F.array_join(F.sort_array(F.collect_list(key)), " | ").alias("sample")))
        return cnt.crossJoin(smp).select(F.lit(label).alias("side"), "n_keys", "sample")
    return side(left, right, "left_only").unionByName(side(right, left, "right_only"))


def outer_join_indicator(left: DataFrame, right: DataFrame, key: str = KEY,
                         indicator: str = "_merge") -> DataFrame:
    """Full outer equi-join with a provenance column
    ``both | left_only | right_only`` (pandas' ``indicator=True``).

    Written as an inner join and two anti-joins. Spark cannot split a full
    outer join, so a key that holds a third of one side would be one task; of
    an inner join it splits both sides, of an anti-join the rows that are kept
    (the other side is keys alone). Rows without a key match nothing and
    skip the joins, so they stay where they were read."""
    other = {"left": [F.lit(None).cast(f.dataType).alias(f.name) for f in left.schema.fields if f.name != key],
             "right": [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema.fields if f.name != key]}
    keyed_left, keyed_right = (d.filter(F.col(key).isNotNull()) for d in (left, right))

    def alone(d: DataFrame, keyed: DataFrame, against: DataFrame) -> DataFrame:
        return (keyed.join(against.select(key), key, "left_anti")
                .unionByName(d.filter(F.col(key).isNull())))

    both = keyed_left.join(keyed_right, key).withColumn(indicator, F.lit("both"))
    left_only = alone(left, keyed_left, keyed_right).select("*", *other["right"], F.lit("left_only").alias(indicator))
    right_only = alone(right, keyed_right, keyed_left).select("*", *other["left"], F.lit("right_only").alias(indicator))
    return both.unionByName(left_only).unionByName(right_only)


def merge_breakdown(joined: DataFrame, indicator: str = "_merge") -> DataFrame:
    """Rows per provenance value."""
    return joined.groupBy(indicator).agg(F.count(F.lit(1)).alias("n_rows"))


def prepare_task_sources(frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Normalise keys of the three task files and turn NaN into NULL."""
    out = {}
    for name in ("task_pct", "interaction", "thinking"):
        df = with_normalized_key(frames[name])
        num = [c for c, t in df.dtypes if c != KEY and t in ("double", "float")]
        out[name] = df.select(KEY, *[nan_to_null(c).alias(c) for c in num],
                              *[c for c in df.columns if c != KEY and c not in num])
    return out


def assemble_task_base(frames: dict[str, DataFrame], keep_indicator: bool = False) -> DataFrame:
    """M1: task_pct (full outer, with provenance) interaction, left thinking,
    null-strict indices, ``pct`` renamed ``task_conversation_share``."""
    f = prepare_task_sources(frames)
    base = outer_join_indicator(f["task_pct"], f["interaction"])
    if not keep_indicator:
        base = base.drop("_merge")
    base = base.join(f["thinking"], KEY, "left")
    have = set(base.columns)
    idx = {k: composite(v) for k, v in TASK_INDICES.items() if set(v) <= have}
    return base.withColumns(idx).withColumnRenamed("pct", "task_conversation_share")


def prepare_clusters(clusters: DataFrame) -> DataFrame:
    """M2: ``onet_task`` -> normalised ``task_name``, collaboration columns
    renamed, numeric coercion (bad text / NaN -> NULL, never 0), cluster
    indices."""
    c = clusters.withColumnRenamed("onet_task", KEY)
    c = with_normalized_key(c)
    c = rename_present(c, COLLAB_RENAMES)
    num = present(c, CLUSTER_RATIOS + ["cluster_thinking_fraction"] + PERCENT_COLS)
    c = c.withColumns({n: coerce_numeric(n) for n in num})
    have = set(c.columns)
    idx = {k: composite(v) for k, v in CLUSTER_INDICES.items() if set(v) <= have}
    return c.withColumns(idx)


def integrate_levels(task_base: DataFrame, clusters_prepared: DataFrame) -> DataFrame:
    """M3/D3: left join with 1:N fan-out. Row-count law:
    ``n = n_task - matched_tasks + cluster_rows_of_matched_tasks``.

    Matched tasks are an inner join, whose two sides Spark can both split, so
    a task that holds very many clusters is no single task; the others, which
    an anti-join finds, get NULL cluster columns."""
    matched = task_base.join(clusters_prepared, KEY)
    other = task_base.join(clusters_prepared.select(KEY).distinct(), KEY, "left_anti")
    return matched.unionByName(other, allowMissingColumns=True)


def integration_diagnostics(integrated: DataFrame, level0: str = "cluster_name_0") -> DataFrame:
    """M3 diagnostics in two aggregations: rows with / without a cluster,
    distinct tasks with / without, tasks mapped to more than one cluster."""
    per_task = integrated.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n"), F.count(level0).alias("n_cl"))
    t = per_task.agg(
        F.sum("n").alias("rows_total"),
        F.sum("n_cl").alias("rows_with_cluster"),
        F.sum(F.col("n") - F.col("n_cl")).alias("rows_without_cluster"),
        F.count(F.lit(1)).alias("unique_tasks"),
        F.count_if(F.col("n_cl") > 0).alias("tasks_with_clusters"),
        F.count_if(F.col("n_cl") < F.col("n")).alias("tasks_without_clusters"),
        F.count_if(F.col("n_cl") > 1).alias("multi_cluster_tasks"))
    return t


def cluster_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("cluster_") or c in PERCENT_COLS]


def task_sample(integrated: DataFrame) -> DataFrame:
    """One row per task, cluster columns dropped. Task columns are
    constant within a task, so the kept row is immaterial;
    :func:`one_row_per_key` checks that and keeps a reproducible row."""
    return one_row_per_key(drop_present(integrated, cluster_columns(integrated)), KEY)[0]


def one_row_per_key(df: DataFrame, key: str = KEY) -> tuple[DataFrame, DataFrame]:
    """``(rows, violations)``: one row per key, and the keys whose rows differ.

    A single aggregate with a map-side phase keeps the row of smallest
    fingerprint (a hash of all columns, with NULL marked) and that of the
    largest; where they differ, the key is not constant. ``violations`` holds
    ``key, n_rows`` and ``columns``: the names in which those two rows differ.
    NULL is a key like any other, as in a plain dedup."""
    others = [c for c in df.columns if c != key]

    def there(c: str) -> Column:
        return F.col("`" + c.replace("`", "``") + "`")

    marked = [x for c in others for x in (there(c), there(c).isNull())]
    print_ = F.xxhash64(*marked) if others else F.lit(0).cast("long")
    row = F.struct(*[there(c).alias(c) for c in others]) if others else F.struct(F.lit(0).alias("__none"))
    per_key = (df.select(key, print_.alias("__h"), row.alias("__row")).groupBy(key)
               .agg(F.count(F.lit(1)).alias("n_rows"), F.min_by("__row", "__h").alias("__lo"),
                    F.max_by("__row", "__h").alias("__hi"), F.min("__h").alias("__a"), F.max("__h").alias("__b")))
    rows = per_key.select(*[F.col(key) if c == key else F.col("__lo")[c].alias(c) for c in df.columns])
    differ = [F.when(~F.col("__lo")[c].eqNullSafe(F.col("__hi")[c]), F.lit(c)) for c in others]
    violations = per_key.filter("__a <> __b").select(
        key, "n_rows", F.array_compact(F.array(*(differ or [F.lit(None).cast("string")]))).alias("columns"))
    return rows, violations


def task_sample_from_base(task_base: DataFrame) -> DataFrame:
    """Same rows as :func:`task_sample` without touching the fan-out join."""
    return task_base.dropDuplicates([KEY])


def cluster_sample(integrated: DataFrame, level0: str = "cluster_name_0") -> DataFrame:
    """Rows with a cluster assignment."""
    return integrated.filter(F.col(level0).isNotNull())


def first_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Deterministic first row per key by an explicit order.

    Implemented as an arg-min aggregate over a struct of the order columns
    (map-side combinable, skew-safe) rather than a window over the key."""
    others = [c for c in df.columns if c != key]
    s = F.struct(*[F.col(c) for c in order], *[F.col(c).alias(f"__v_{c}") for c in others])
    return (df.groupBy(key).agg(F.min(s).alias("__m"))
            .select(key, *[F.col(f"__m.__v_{c}").alias(c) for c in others]))


def build_levels(frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Whole build (M1-M4) as lazy DataFrames. The task base, one row per task, is kept: both parts
    of the fan-out join and the task sample read it."""
    tb = assemble_task_base(frames).persist()
    cp = prepare_clusters(frames["clusters"])
    integ = integrate_levels(tb, cp)
    return {"task_base": tb, "clusters_prepared": cp, "integrated": integ,
            "task_level": task_sample_from_base(tb), "cluster_level": cluster_sample(integ)}
