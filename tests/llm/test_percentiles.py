"""Percentile sketches: the error bound, merging, and what doesn't count."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.percentiles import daily_sketch, measurements, merge, percentiles, session_percentiles, sketch

Q = {"p1": 0.01, "p50": 0.5, "p90": 0.9, "p99": 0.99, "p100": 1.0, "p0": 0.0}
SESSION = "session_id string, strategy string, created_at timestamp_ntz, latency_ms double, cost_usd double, loaded_at timestamp_ntz, n int, sign int"
T0 = dt.datetime(2024, 1, 1)


def exact(values, q):
    return sorted(values)[max(math.ceil(q * len(values)), 1) - 1]


@pytest.mark.parametrize("error", [0.01, 0.05])
def test_error_is_bounded(spark, error):
    rng = random.Random(1)
    groups = {
        "tail": [rng.lognormvariate(3, 4) for _ in range(3000)],
        "ties": [rng.choice((0.0, 5.0, 1500.0)) for _ in range(999)],
        "both": [rng.uniform(-1e6, 1e6) for _ in range(1001)],
        "small": [1.4e-9, 4e-10, 4.1e-10, 3e-8, 7e-11],
        "one": [7.25],
        "tiny": [5e-310, 1e-300, 1e300],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    s = sketch(spark.createDataFrame(rows, "g string, value double"), ["g"], error=error)
    for r in percentiles(s, ["g"], Q, error).collect():
        assert r.n == len(groups[r.g])
        for name, q in Q.items():
            want = exact(groups[r.g], q)
            assert abs(r[name] - want) <= error * abs(want) * (1 + 1e-9), (r.g, name)


def test_merging_is_the_sketch_of_the_whole(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("part"), (F.pow(F.lit(1.01), F.col("id") % 900) - 3).alias("value"))
    parts = merge(sketch(df, ["part"]).drop("part"), [])
    assert {tuple(r) for r in parts.collect()} == {tuple(r) for r in sketch(df, []).collect()}


def test_only_real_measurements_of_the_latest_save(spark):
    rows = [
        ("a", "x", T0, 100.0, 0.0, T0, 1, 1),
        ("a", "x", T0, 200.0, 0.0, T0 + dt.timedelta(hours=1), 1, 1),
        ("a", "x", T0, 200.0, 0.0, T0 + dt.timedelta(hours=1), 1, 1),
        ("b", None, T0, float("nan"), None, T0, 1, 1),
        ("c", None, T0, -1.0, float("inf"), T0, 1, 1),
        ("d", None, None, 0.0, -2.0, None, 1, 1),
        (None, "x", T0, 5.0, 1.0, T0, 1, 1),
        (None, "x", T0, 6.0, 1.0, T0, 1, 1),
    ]
    df = spark.createDataFrame(rows, SESSION)
    assert sorted((r.metric, r.value) for r in measurements(df).collect()) == [("cost_usd", 0.0), ("cost_usd", 1.0), ("cost_usd", 1.0), ("latency_ms", 5.0), ("latency_ms", 6.0), ("latency_ms", 200.0)]
    out = {(r.scope, r.key, r.metric): r.n for r in session_percentiles(daily_sketch(df)).collect()}
    assert out == {("strategy", "x", "latency_ms"): 3, ("strategy", "x", "cost_usd"): 3, ("day", "2024-01-01", "latency_ms"): 3, ("day", "2024-01-01", "cost_usd"): 3}


def test_empty(spark):
    assert session_percentiles(daily_sketch(spark.createDataFrame([], SESSION))).count() == 0
