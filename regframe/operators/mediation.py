"""Mediation and moderation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tails import Z975, norm_sf2
from .linear import ModelSpec, OLSFit, fit_ols

ALPHA = 0.05

MEDIATION_SCHEMA = T.StructType([
    T.StructField("n", T.LongType()),
    T.StructField("c", T.DoubleType()), T.StructField("c_se", T.DoubleType()),
    T.StructField("c_z", T.DoubleType()), T.StructField("c_p", T.DoubleType()),
    T.StructField("a", T.DoubleType()), T.StructField("a_se", T.DoubleType()),
    T.StructField("a_z", T.DoubleType()), T.StructField("a_p", T.DoubleType()),
    T.StructField("b", T.DoubleType()), T.StructField("b_se", T.DoubleType()),
    T.StructField("b_z", T.DoubleType()), T.StructField("b_p", T.DoubleType()),
    T.StructField("c_prime", T.DoubleType()), T.StructField("c_prime_se", T.DoubleType()),
    T.StructField("c_prime_z", T.DoubleType()), T.StructField("c_prime_p", T.DoubleType()),
    T.StructField("indirect", T.DoubleType()), T.StructField("sobel_se", T.DoubleType()),
    T.StructField("sobel_z", T.DoubleType()), T.StructField("sobel_p", T.DoubleType()),
    T.StructField("prop_mediated", T.DoubleType()),
    T.StructField("crit_c", T.StringType()), T.StructField("crit_a", T.StringType()),
    T.StructField("crit_b", T.StringType()), T.StructField("crit_reduced", T.StringType()),
    T.StructField("conclusion", T.StringType())])


def mediation_fits(df: DataFrame, iv: str, med: str, dv: str, cov: str = "HC3",
                   groups: str | None = None, sample: str = "common") -> OLSFit:
    """O1: paths c (dv~iv), a (med~iv), b/c' (dv~iv+med), fused in one
    battery. ``sample='common'`` (default) fits all three on one
    complete-case sample, so ``c = c' + a*b`` holds exactly."""
    specs = [ModelSpec("c", dv, [iv], cov, groups), ModelSpec("a", med, [iv], cov, groups),
             ModelSpec("b", dv, [iv, med], cov, groups)]
    return fit_ols(df, specs, sample=sample)


def sobel(a: float, b: float, se_a: float, se_b: float) -> tuple[float, float, float, float]:
    """O2: (indirect, se, z, p) of a*b, first-order Sobel."""
    ind = a * b
    se = math.sqrt(a * a * se_b * se_b + b * b * se_a * se_a)
    z = ind / se if se > 0 else float("nan")
    return ind, se, z, norm_sf2(z)


def decision(c_p: float, a_p: float, b_p: float, c: float, c_prime: float, c_prime_p: float) -> tuple:
    """O3: Baron-Kenny criteria and conclusion, in the reference's order."""
    yn = lambda ok: "YES" if ok else "NO"
    if c_prime_p >= ALPHA and b_p < ALPHA:
        concl = "full mediation"
    elif abs(c_prime) < abs(c) and b_p < ALPHA:
        concl = "partial mediation"
    else:
        concl = "not established"
    return yn(c_p < ALPHA), yn(a_p < ALPHA), yn(b_p < ALPHA), yn(abs(c_prime) < abs(c)), concl


def mediation(df: DataFrame, iv: str, med: str, dv: str, cov: str = "HC3",
              groups: str | None = None, sample: str = "common") -> DataFrame:
    """O1-O3 in one result row."""
    r = mediation_fits(df, iv, med, dv, cov, groups, sample)
    for mid in ("a", "b", "c"):
        if r[mid].status != "ok":
            raise ValueError(f"mediation path {mid}: {r[mid].status}")

    def path(mid: str, idx: int):
        m = r[mid]
        b = float(m.beta[idx])
        se = float(math.sqrt(m.cov[idx, idx]))
        z = b / se
        return b, se, z, norm_sf2(z)

    c = path("c", 1)
    a = path("a", 1)
    cp = path("b", 1)
    b = path("b", 2)
    ind, sse, sz, sp = sobel(a[0], b[0], a[1], b[1])
    prop = ind / c[0] if c[0] != 0 else None
    crit = decision(c[3], a[3], b[3], c[0], cp[0], cp[3])
    row = (r["b"].n, *c, *a, *b, *cp, ind, sse, sz, sp, prop, *crit)
    return df.sparkSession.createDataFrame([tuple(float(v) if isinstance(v, float) else v for v in row)],
                                           MEDIATION_SCHEMA)


def mean_center(df: DataFrame, cols: list[str], suffix: str = "_c",
                names: dict[str, str] | None = None) -> DataFrame:
    """Subtract the sample mean (one aggregate; means re-enter the plan
    as literals -- no global window, no driver-side data)."""
    means = df.agg(*[F.avg(c).alias(c) for c in cols]).first().asDict()
    names = names or {}
    return df.withColumns({names.get(c, c + suffix): F.col(c) - F.lit(float(means[c])) for c in cols})


def moderation_frame(df: DataFrame, x: str, w: str, y: str, xc: str = "aug_c", wc: str = "thk_c",
                     inter: str = "interaction") -> DataFrame:
    """O7 data prep: complete cases on (y, x, w), centre x and w, product."""
    d = df.na.drop(subset=[y, x, w])
    d = mean_center(d, [x, w], names={x: xc, w: wc})
    return d.withColumn(inter, F.col(xc) * F.col(wc))


def moderation(df: DataFrame, x: str, w: str, y: str, cov: str = "HC3", groups: str | None = None,
               centered_a: bool = False) -> OLSFit:
    """Hierarchical models a (x), b (x + w), c (centred x, w and their
    product) on one complete-case sample. ``centered_a`` uses the centred x
    in models a and b (same slopes and R^2, other intercept)."""
    d = moderation_frame(df, x, w, y)
    xa, wa = ("aug_c", "thk_c") if centered_a else (x, w)
    specs = [ModelSpec("a", y, [xa], cov, groups), ModelSpec("b", y, [xa, wa], cov, groups),
             ModelSpec("c", y, ["aug_c", "thk_c", "interaction"], cov, groups)]
    return fit_ols(d, specs)


def delta_r2(fit: DataFrame, order: list[str]) -> DataFrame:
    """R^2 and its change along an ordered list of nested models."""
    pos = F.create_map(*[x for i, m in enumerate(order) for x in (F.lit(m), F.lit(i))])
    from pyspark.sql import Window
    w = Window.orderBy("step")   # a handful of model rows, never data rows
    return (fit.filter(F.col("model_id").isin(order))
            .withColumn("step", pos[F.col("model_id")])
            .select("model_id", "step", "r2", (F.col("r2") - F.lag("r2").over(w)).alias("delta_r2")))


__all__ = ["mediation", "mediation_fits", "sobel", "decision", "mean_center", "moderation",
           "moderation_frame", "delta_r2", "Z975"]
