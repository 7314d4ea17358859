"""Models that cannot be fitted keep a status and never stop a battery."""

import math

import numpy as np
import pytest

from regframe.operators.describe import table_checksum
from regframe.operators.linear import ModelSpec, fit_ols, omnibus_k2
from regframe.session import checkpoint_dir


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(0)
    rows = [(float(a), float(b), f"g{i % 9}" if i % 3 else None, 0.0) for i, (a, b) in
            enumerate(rng.normal(size=(300, 2)))]
    rows = [(a, b, g, 1.0 if i == 7 else 0.0) for i, (a, b, g, _) in enumerate(rows)]
    return spark.createDataFrame(rows, "x double, y double, g string, only double").repartition(4)


def test_statuses_stand_beside_good_models(frame):
    r = fit_ols(frame, [ModelSpec("good", "y", ["x"]), ModelSpec("lev", "y", ["x", "only"]),
                        ModelSpec("grp", "y", ["x"], "cluster", "g"), ModelSpec("log", "y", ["x"], log_y=True),
                        ModelSpec("hc0", "y", ["x", "only"], "HC0")])
    assert {k: m.status for k, m in r.models.items()} == {
        "good": "ok", "lev": "leverage one", "grp": "null group", "log": "domain", "hc0": "ok"}
    assert {t["model_id"] for t in r.coef.collect()} == {"good", "hc0"}
    d = frame.withColumn("d", r["hc0"].cooks_distance()).collect()
    assert [math.isinf(t["d"]) for t in d].count(True) == 1
    assert next(t for t in d if math.isinf(t["d"]))["only"] == 1.0


def test_names_with_braces(spark):
    df = spark.createDataFrame([(float(i), float(i * i % 7)) for i in range(30)], "`a{b}` double, `y{}` double")
    assert fit_ols(df, [ModelSpec("m", "y{}", ["a{b}"])])["m"].status == "ok"


def test_checksum_sees_moved_nulls(spark):
    schema = "k string, a int, b int"
    one = spark.createDataFrame([("k", 1, None), ("j", None, 2)], schema)
    two = spark.createDataFrame([("k", None, 1), ("j", 2, None)], schema)
    assert table_checksum(one).first() != table_checksum(two).first()
    assert table_checksum(one).first() == table_checksum(one.repartition(3).orderBy("k")).first()
    assert table_checksum(one.limit(0)).first()["n_rows"] == 0


def test_percentiles_of_a_column_that_is_mostly_one_value(spark):
    from regframe.operators.describe import percentiles
    x = np.concatenate([np.full(9_900, 5.0), np.arange(100) / 10.0])
    df = spark.createDataFrame([(float(v),) for v in x], "v double").repartition(8)
    probs = [0.0, 0.001, 0.004, 0.0049, 0.5, 0.9951, 0.999, 1.0]
    assert percentiles(df, "v", probs, n_ranges=6).first()["q"] == pytest.approx(np.quantile(x, probs).tolist())


def test_durbin_watson_needs_an_order_and_not_a_partitioning(spark):
    """A hot order value would leave its rows without an order among each other: an error, found in any split."""
    from pyspark.sql import functions as F
    from regframe.operators.describe import durbin_watson
    df = spark.createDataFrame([(i, math.sin(i)) for i in range(4_000)], "o long, e double").repartition(5)
    a = durbin_watson(df, F.col("e"), "o", n_ranges=7)
    assert a == pytest.approx(durbin_watson(df.repartition(3), F.col("e"), "o", n_ranges=2), rel=1e-9)
    hot = df.withColumn("o", F.when(F.col("o") % 100 == 0, F.col("o")).otherwise(0))
    for n in (2, 7):
        with pytest.raises(ValueError, match="3960 repeat"):
            durbin_watson(hot, F.col("e"), "o", n_ranges=n)



def test_omnibus_of_known_samples():
    # symmetric, mesokurtic: near 0; strongly skewed: far from it
    assert omnibus_k2(0.0, 3.0, 10_000) < 0.05 and omnibus_k2(1.0, 5.0, 500) > 40 and omnibus_k2(0.1, 3.0, 5) is None


def test_checkpoint_folder_must_be_shared_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError, match="checkpoint"):
        checkpoint_dir(Session)
