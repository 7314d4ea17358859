"""Bootstrap of the indirect effect a*b and dense
group codes (B22).

Design
------
* Replicate weights are a pure function of ``(seed, replicate, key)``. A key
  and a replicate each get two 32-bit words from md5; the words are combined
  by exclusive or and mixed into each other four times, which gives a 52-bit
  uniform. Replicates are hashed before they are combined, so one is no
  shifted copy of another. Recomputing a lost partition gives the same
  weights (``rand()`` would not), and any engine can reproduce them.
* IID scheme: a task makes the weights of its rows for all replicates in numpy
  blocks that stay in the processor's cache and adds them up there by a matrix
  product, so the shuffle carries B rows per partition, not B x n, and no
  weight ever becomes a row.
* Cluster scheme: rows are first reduced to per-group sufficient statistics
  (one groupBy on the group key; a hot group is just one row), then groups
  are weighted per replicate -- B x G work, never a list of group rows.
* Each replicate's a and b come from closed forms of its weighted,
  pre-centred moments; the interval is read off range-partitioned order
  statistics, so neither B nor the number of rows has a limit.

Two draw schemes. ``poisson`` (the scale default): each row or group gets
an independent Poisson(1) weight, so a replicate's total size is random
around n (or G), and all work combines map-side. ``multinomial``: exactly U
draws with replacement per replicate (numpy's ``rng.integers(0, U, U)``
semantics). Units lie in blocks of dense codes; a replicate's U draws are
first split over the blocks by one multinomial draw, then each block's task
makes its own draws beside its units and returns one row per replicate, so
no draw is ever shuffled. numpy's own generator cannot be replayed in Spark,
so intervals agree with the reference's in distribution, not digit for digit.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir, ship_package
from .describe import percentiles

M32 = 4294967296            # 2^32
MIX = 73244475              # 0x45d9f3b, 32-bit avalanche multiplier
DRAW_MULT = 2246822519      # odd 32-bit multiplier for the block of a draw
SEED_MULT = 3266489917      # odd 32-bit multiplier for the seed
BLOCK = 65536               # units whose draws one task makes
MIN_TASKS = 64
TILE = 64, 1024             # replicates and units whose weights are made at once
REP_BLOCK = 65536           # replicates whose sums one task holds


def poisson1_thresholds() -> list[float]:
    """CDF of Poisson(1) at 0, 1, ... up to the resolution of the uniform."""
    out, acc, term, k = [], 0.0, math.exp(-1.0), 0
    while acc < 1 - 2.0 ** -52:
        if k > 0:
            term /= k
        acc += term
        out.append(acc)
        k += 1
    return out


def _words(text: Column) -> tuple[Column, Column]:
    """Two 32-bit words of a text's md5."""
    h = F.md5(text)
    return tuple(F.conv(F.substring(h, k, 8), 16, 10).cast("bigint") for k in (1, 9))


def _mix(x):
    """32-bit avalanche; products stay below 2^59, exact in any SQL engine."""
    return ((x.bitwiseXOR(F.shiftright(x, 16))) * F.lit(MIX)) % F.lit(M32)


def with_uniform(df: DataFrame, name: str = "__u") -> DataFrame:
    """``df`` with a 52-bit uniform on [0, 1) made of words ``__k1, __k2`` (key) and ``__r1, __r2`` (replicate)."""
    a, b = F.col("__a"), F.col("__b")
    d = (df.withColumn("__a", F.col("__k1").bitwiseXOR(F.col("__r1")))
         .withColumn("__b", F.col("__k2").bitwiseXOR(F.col("__r2")))
         .withColumn("__a", _mix(a)).withColumn("__b", _mix(b.bitwiseXOR(a)))
         .withColumn("__a", _mix(a.bitwiseXOR(b))).withColumn("__b", _mix(b.bitwiseXOR(a))))
    hi, lo = (x.bitwiseXOR(F.shiftright(x, 16)) for x in (a, b))
    u = (hi * F.lit(1 << 20) + F.shiftright(lo, 12)).cast("double") / F.lit(float(1 << 52))
    return d.withColumn(name, u).drop("__a", "__b", "__k1", "__k2", "__r1", "__r2")


def replicate_words(seed: int, reps) -> tuple[np.ndarray, np.ndarray]:
    """Two 32-bit words of each replicate's md5, as :func:`_words` makes them."""
    digests = [hashlib.md5(f"{seed}:rep:{rep}".encode()).hexdigest() for rep in reps]
    return tuple(np.array([int(d[k:k + 8], 16) for d in digests], np.uint32) for k in (0, 8))


def _mix_words(x: np.ndarray, spare: np.ndarray) -> None:
    """:func:`_mix` in place; products of 32-bit words wrap around by themselves."""
    np.right_shift(x, np.uint32(16), out=spare)
    np.bitwise_xor(x, spare, out=x)
    np.multiply(x, np.uint32(MIX), out=x)


def _high_words(a: np.ndarray, b: np.ndarray) -> None:
    """Turn ``a``, ``b`` (key word xor replicate word) in place into the upper 32 bits of the uniform and
    the word that :func:`_exact` needs for the other 20."""
    spare = np.empty_like(a)
    _mix_words(a, spare)
    np.bitwise_xor(b, a, out=b)
    _mix_words(b, spare)
    np.bitwise_xor(a, b, out=a)
    _mix_words(a, spare)
    np.right_shift(a, np.uint32(16), out=spare)
    np.bitwise_xor(a, spare, out=a)


def _exact(hi: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All 52 bits of the uniforms of :func:`_high_words`."""
    lo = b ^ hi ^ (hi >> np.uint32(16))                   # the last shift and xor undoes itself
    _mix_words(lo, np.empty_like(lo))
    lo ^= lo >> np.uint32(16)
    return (hi.astype(np.uint64) << np.uint64(20)) + (lo >> np.uint32(12))


def draw_words(n: int, block: int, seed: int, start: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The key words of draws ``start .. start+n`` of a block, the same for every replicate."""
    j = np.arange(start, start + n, dtype=np.uint64)
    k1 = ((j + np.uint64(seed * SEED_MULT % M32)) % np.uint64(M32)).astype(np.uint32)
    _mix_words(k1, np.empty_like(k1))
    k2 = k1 + np.uint32(block * DRAW_MULT % M32)
    _mix_words(k2, np.empty_like(k2))
    return k1, k2


def draw_uniforms(n: int, rep: int, block: int, seed: int, start: int = 0) -> np.ndarray:
    """Uniforms of draws ``start .. start+n`` of a replicate in a block: the same mixing, in numpy."""
    k1, k2 = draw_words(n, block, seed, start)
    r1, r2 = replicate_words(seed, [rep])
    a, b = k1 ^ r1, k2 ^ r2
    _high_words(a, b)
    return _exact(a, b) / float(1 << 52)


def draw_counts(n: int, words: tuple[np.ndarray, np.ndarray], r1, r2, size: int) -> np.ndarray:
    """How often each of ``size`` units is among a replicate's first ``n`` draws: unit ``floor(u * size)``.

    The upper 32 bits of u settle the unit unless ``u * size`` is that close below a whole number; only
    those draws take all 52 bits."""
    a, b = words[0][:n] ^ r1, words[1][:n] ^ r2
    _high_words(a, b)
    product = a.astype(np.uint64) * np.uint64(size)
    unit = (product >> np.uint64(32)).astype(np.int64)
    near = np.flatnonzero((product & np.uint64(M32 - 1)) >= np.uint64(max(M32 - 2 * size, 0)))
    if len(near):
        u = _exact(a[near], b[near]) / float(1 << 52)
        unit[near] = np.minimum((u * size).astype(np.int64), size - 1)
    return np.bincount(unit, minlength=size)


def poisson1_counts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Poisson(1) weights of words ``a``, ``b`` (key xor replicate; overwritten), equal to
    :func:`poisson1_weight` of :func:`with_uniform`: thresholds are compared with the upper 32 bits,
    and with all 52 where those are equal."""
    _high_words(a, b)
    weight = np.zeros(a.shape, np.uint8)
    for t in poisson1_thresholds():
        cut = math.ceil(t * (1 << 52))                    # u < t if its 52 bits are below this
        if cut >= 1 << 52:                                # as all are below 1
            break
        top = np.uint32(cut >> 20)
        above = a >= top
        if not above.any():
            break
        weight += above
        tie = a == top
        if tie.any():
            weight[tie] -= _exact(a[tie], b[tie]) < cut
    return weight


def poisson1_weight(u: Column) -> Column:
    th = poisson1_thresholds()
    expr = F.when(u < F.lit(th[0]), F.lit(0))
    for k, t in enumerate(th[1:], start=1):
        expr = expr.when(u < F.lit(t), F.lit(k))
    return expr.otherwise(F.lit(len(th)))


_STATS = ["w", "x", "m", "y", "xx", "mm", "xm", "xy", "my"]


def _moment_cols(x: Column, m: Column, y: Column) -> list[Column]:
    return [F.lit(1.0), x, m, y, x * x, m * m, x * m, x * y, m * y]


def _paths(s: dict[str, Column]) -> tuple[Column, Column]:
    """a (m ~ x) and b (y ~ x + m, coefficient of m) from weighted sums."""
    def centred(product: str, p: str, q: str) -> Column:
        return s[product] - F.try_divide(s[p] * s[q], s["w"])

    cxx, cmm = centred("xx", "x", "x"), centred("mm", "m", "m")
    cxm, cxy, cmy = centred("xm", "x", "m"), centred("xy", "x", "y"), centred("my", "m", "y")
    # a degenerate replicate (no unit drawn, no spread in x, or collinear x
    # and m) gives NULL and is counted as invalid instead of failing the job
    a = F.try_divide(cxm, cxx)
    b = F.try_divide(cxx * cmy - cxm * cxy, cxx * cmm - cxm * cxm)
    return a, b


def spark_parallelism(df: DataFrame) -> int:
    return df.sparkSession.sparkContext.defaultParallelism


def boot_replicates(df: DataFrame, iv: str, med: str, dv: str, B: int = 5000, seed: int = 42,
                    scheme: str = "iid", key: str | list[str] | None = None,
                    group: str | None = None, draw: str = "poisson") -> DataFrame:
    """One row per replicate: (rep, n_w, a, b, indirect).

    ``scheme='iid'`` weights rows; ``key`` names column(s) that identify a
    row, and a key that repeats is an error, because equal keys would share
    their draws. ``scheme='cluster'`` weights whole groups of ``group``. The
    work is B x rows (or B x groups), generated and reduced inside tasks."""
    if B <= 0:
        raise ValueError("B must be positive")
    d = df.na.drop(subset=[iv, med, dv])
    mu = d.agg(F.avg(iv).alias("x"), F.avg(med).alias("m"), F.avg(dv).alias("y")).first()
    if mu["x"] is None:
        raise ValueError("empty sample")
    x = F.col(iv) - F.lit(float(mu["x"]))
    m = F.col(med) - F.lit(float(mu["m"]))
    y = F.col(dv) - F.lit(float(mu["y"]))
    moments = [c.alias(n) for c, n in zip(_moment_cols(x, m, y), _STATS)]
    if scheme == "iid":
        if key is None:
            raise ValueError("iid scheme needs a row key")
        keys = [key] if isinstance(key, str) else list(key)
        # one shuffle by key deals the rows over all cores, because the expansion multiplies the work by B,
        # which AQE cannot see, and shows keys that repeat; the copy serves every later pass
        checkpoint_dir(df.sparkSession)
        base = (d.select(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("__g"), *moments)
                .repartition(max(spark_parallelism(df), 1), "__g")
                .groupBy("__g").agg(F.count(F.lit(1)).alias("__n"), *[F.first(n).alias(n) for n in _STATS])
                .checkpoint(eager=True))
        if not base.where("__n > 1").isEmpty():
            raise ValueError(f"key {keys} does not identify a row")
        base = base.drop("__n")
    elif scheme == "cluster":
        if group is None:
            raise ValueError("cluster scheme needs a group column")
        base = (d.select(F.col(group).cast("string").alias("__g"), *moments)
                .groupBy("__g").agg(*[F.sum(n).alias(n) for n in _STATS]))
    else:
        raise ValueError("scheme must be 'iid' or 'cluster'")
    if draw == "multinomial":
        sums = _multinomial(base, B, seed)
    elif draw == "poisson":
        sums = _poisson(base, B, seed, spread=scheme == "cluster")
    else:
        raise ValueError("draw must be 'poisson' or 'multinomial'")
    a, b = _paths({n: F.col(n) for n in _STATS})
    return sums.select("rep", F.col("w").alias("n_w"), a.alias("a"), b.alias("b"), (a * b).alias("indirect"))


def _replicates(spark, B: int) -> DataFrame:
    return spark.range(B).select(F.col("id").alias("rep"))


def boot_ci(reps: DataFrame, col: str = "indirect", level: float = 0.95) -> DataFrame:
    """Exact percentile interval (linear interpolation) and whether
    it excludes zero; invalid replicates (NULL / NaN) are skipped."""
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    checkpoint_dir(reps.sparkSession)
    v = F.when(~F.isnan(F.col(col)), F.col(col))
    values = reps.select(v.alias("v")).checkpoint(eager=True)     # one value per replicate
    q = percentiles(values, "v", [lo, hi])
    s = values.agg(F.count(F.lit(1)).alias("n_reps"), F.count("v").alias("n_valid"),
                   F.avg("v").alias("boot_mean"), F.stddev_samp("v").alias("boot_sd")).crossJoin(q)  # one row each
    return s.select("n_reps", "n_valid", "boot_mean", "boot_sd", F.col("q")[0].alias("ci_lo"),
                    F.col("q")[1].alias("ci_hi"),
                    F.when(F.col("q")[0] * F.col("q")[1] > 0, F.lit("excludes 0"))
                    .otherwise(F.lit("includes 0")).alias("verdict"))


def dense_codes(df: DataFrame, key: str, n_partitions: int | None = None) -> DataFrame:
    """Distinct keys -> 0-based code in sorted key order, computed
    without a global single-partition window: range-partition the distinct
    keys, number rows inside each range, add the (tiny, one row per
    partition) prefix sum of partition sizes."""
    d = df.select(key).distinct()
    if n_partitions:
        d = d.repartitionByRange(n_partitions, key)
    else:
        d = d.repartitionByRange(key)
    # freeze the range assignment (a recomputed sample could move the
    # boundaries): reliable checkpoint into the shared checkpoint folder
    checkpoint_dir(df.sparkSession)
    d = d.withColumn("__pid", F.spark_partition_id()).checkpoint(eager=True)
    local = d.withColumn("__rn", F.row_number().over(Window.partitionBy("__pid").orderBy(key)) - 1)
    sizes = d.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    offs = sizes.withColumn("__off", F.coalesce(F.sum("__n").over(
        Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (local.join(F.broadcast(offs.select("__pid", "__off")), "__pid")
            .select(key, (F.col("__off") + F.col("__rn")).cast("bigint").alias("code")))


_SUMS = "rep long, " + ", ".join(f"{n} double" for n in _STATS)


def _poisson(base: DataFrame, B: int, seed: int, spread: bool) -> DataFrame:
    """Weighted sums per replicate: each unit has a Poisson(1) weight in each replicate. A task goes
    through its units once for ``REP_BLOCK`` replicates, and holds their sums and one tile of weights."""
    ship_package(base.sparkSession)
    k1, k2 = _words(F.concat_ws(":", F.lit(str(seed)), F.col("__g")))
    units = base.select(k1.alias("k1"), k2.alias("k2"), *_STATS)
    if spread:                                            # groups come out of an aggregate that AQE coalesces
        units = units.repartition(max(spark_parallelism(base), 1))

    def pass_over(first: int, last: int):
        def run(batches):
            r1, r2 = (r[:, None] for r in replicate_words(seed, range(first, last)))
            sums, any_unit = np.zeros((last - first, len(_STATS))), False
            for batch in batches:
                any_unit = any_unit or batch.num_rows > 0
                w1, w2 = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.uint32) for k in (0, 1))
                x = np.column_stack([batch.column(2 + k).to_numpy(zero_copy_only=False) for k in range(len(_STATS))])
                for u in range(0, len(w1), TILE[1]):
                    unit = slice(u, u + TILE[1])
                    for r in range(0, last - first, TILE[0]):
                        rep = slice(r, r + TILE[0])
                        sums[rep] += poisson1_counts(w1[unit] ^ r1[rep], w2[unit] ^ r2[rep]).astype(float) @ x[unit]
            if any_unit:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, last)), *map(pa.array, sums.T.copy())],
                                                 names=["rep", *_STATS])
        return run

    sums = None
    for first in range(0, B, REP_BLOCK):
        part = units.mapInArrow(pass_over(first, min(first + REP_BLOCK, B)), _SUMS)
        sums = part if sums is None else sums.unionByName(part)
    return sums.groupBy("rep").agg(*[F.sum(n).alias(n) for n in _STATS])


def _multinomial(base: DataFrame, B: int, seed: int, block: int = BLOCK) -> DataFrame:
    """Exact-size resampling: weighted sums per replicate of U draws with
    replacement from the U units, in dense codes of sorted key order.

    Blocks of ``block`` codes meet their share of each replicate's draws in
    one task. Few blocks are repeated for groups of replicates, so that at
    least ``MIN_TASKS`` tasks share the B x U draws."""
    spark = base.sparkSession
    ship_package(spark)
    codes = dense_codes(base, "__g")
    checkpoint_dir(spark)
    units = base.join(codes, "__g").select("code", *_STATS).checkpoint(eager=True)
    U = units.count()
    n_blocks = max(1, -(-U // block))
    groups = max(1, -(-MIN_TASKS // n_blocks))

    def split(batches):
        share = np.full(n_blocks, block, float)
        share[-1] = U - (n_blocks - 1) * block
        for pdf in batches:
            for rep in pdf["rep"]:
                n = np.random.default_rng([seed, int(rep)]).multinomial(U, share / U)
                yield pd.DataFrame({"rep": rep, "block": np.arange(n_blocks), "n": n})

    shares = (_replicates(spark, B).mapInPandas(split, "rep long, block long, n long")
              .withColumn("part", F.col("rep") % groups))
    blocks = (units.withColumn("block", F.floor(F.col("code") / block))
              .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))))

    def draw(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("code")
        x, rows = left[_STATS].to_numpy(float), []
        for k, part in right.groupby("block"):
            words = draw_words(int(part["n"].max()), int(k), seed)
            r1, r2 = replicate_words(seed, part["rep"])
            for at in range(0, len(part), 16):            # their counts meet the units in one matrix product
                few = slice(at, at + 16)
                times = np.array([draw_counts(int(n), words, p, q, len(x))
                                  for n, p, q in zip(part["n"][few], r1[few], r2[few])], float)
                rows.append(pd.DataFrame(times @ x, columns=_STATS).assign(rep=part["rep"].to_numpy()[few]))
        out = pd.concat(rows) if rows else pd.DataFrame(columns=["rep", *_STATS])
        return out[["rep", *_STATS]].astype({"rep": "int64"})

    sums = (blocks.groupBy("block", "part").cogroup(shares.groupBy("block", "part"))
            .applyInPandas(draw, _SUMS))
    return sums.groupBy("rep").agg(*[F.sum(n).alias(n) for n in _STATS])
