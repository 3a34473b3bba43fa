import random

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from custscope.functions.ordered import exact_quantiles, running_totals_desc, value_bin

QS = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q95": 0.95, "q100": 1.0}
SLOW = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


@SLOW
@given(st.lists(st.tuples(st.sampled_from("ab"), st.floats(-1e6, 1e6)), min_size=1, max_size=60))
def test_quantiles_equal_numpy(spark, rows):
    df = spark.createDataFrame([(g, float(v)) for g, v in rows], "g string, v double")
    got = {r.g: [r[q] for q in QS] for r in exact_quantiles(df, ["g"], "v", QS).collect()}
    for g in {g for g, _ in rows}:
        want = np.quantile([v for k, v in rows if k == g], list(QS.values()))
        np.testing.assert_allclose(got[g], want, rtol=1e-9, atol=1e-9)


def test_quantiles_with_a_hot_value_and_weights(spark):
    """A third of all rows share one value."""
    rng = random.Random(1)
    values = [7.0] * 1000 + [rng.uniform(0, 5000) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").withColumn("g", F.lit("x"))
    want = np.quantile(values, list(QS.values()))
    plain = exact_quantiles(df, ["g"], "v", QS).first()
    counted = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    weighted = exact_quantiles(counted, ["g"], "v", QS, weight="n").first()
    np.testing.assert_allclose([plain[q] for q in QS], want)
    np.testing.assert_allclose([weighted[q] for q in QS], want)


def test_nulls_are_ignored(spark):
    df = spark.createDataFrame([("a", None), ("a", 3.0), ("b", None)], "g string, v double")
    assert [tuple(r) for r in exact_quantiles(df, ["g"], "v", {"m": 0.5}).collect()] == [("a", 3.0)]


def test_bins_keep_the_order(spark):
    values = sorted([0.0, -1.0, 1e-9, 5e300, -5e300, 12.5, 12.500001, 3e5, 3e5 + 0.01])
    df = spark.createDataFrame([(v,) for v in values], "v double").select(value_bin(F.col("v")).alias("b"))
    bins = [r.b for r in df.collect()]
    assert bins == sorted(bins)


def test_running_totals_equal_a_range_window(spark):
    rng = random.Random(2)
    values = [float(rng.choice([5, 5, 5, rng.randrange(1, 900)])) for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in running_totals_desc(df, "v").collect():
        above = [v for v in values if v >= r.v]
        assert (r.n_upto, r.sum_upto, r.n_total, r.sum_total) == (len(above), sum(above), 400, sum(values))
