"""Percentiles of very large numeric columns with a bound on their error (problem 1).

A value counts in the signed logarithmic bucket i with g**(i-1) < |v| <= g**i,
g = (1 + a) / (1 - a). Counts of equal buckets add up, across partitions and days,
so the table of counts is the form that is kept and merged. A percentile is the
value at rank ceil(q * n), at least 1; the middle 2 * g**i / (g + 1) of its bucket
is off by at most the share ``a`` of that value, whatever the values are (below 1e-310
the spacing of doubles adds to it).

Defined results: nulls, NaN, infinities and values that the column can't measure
don't count; a group without measurements has no row; null group keys are a group;
zero has a bucket of its own and no error; of a session that was saved again the
latest save counts, of several at once the one with the largest values; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Relative error of every percentile.
ERROR = 0.01
QUANTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def real(value: Column, least: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (value >= least) & (value < F.lit(float("inf")))


def sketch(values: DataFrame, groups: list[str], value: str = "value", error: float = ERROR) -> DataFrame:
    """(groups, sign, bucket, n) of a column of finite numbers: one count for each bucket of a group."""
    log_g = math.log((1 + error) / (1 - error))
    v = F.col(value)
    bucket = F.when(v == 0, 0).otherwise(F.ceil(F.log(F.abs(v)) / F.lit(log_g))).cast("int")
    return values.select(*groups, F.signum(v).cast("int").alias("sign"), bucket.alias("bucket")).groupBy(*groups, "sign", "bucket").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """The sketch of larger groups: counts of equal buckets add up."""
    return sketches.groupBy(*groups, "sign", "bucket").agg(F.sum("n").alias("n"))


def percentiles(sketches: DataFrame, groups: list[str], quantiles: dict[str, float] | None = None, error: float = ERROR) -> DataFrame:
    """(groups, n, a column for each quantile): a group has no more rows here than it has buckets."""
    g = (1 + error) / (1 - error)
    by = Window.partitionBy(*groups)
    place = F.struct("sign", (F.col("sign") * F.col("bucket")).alias("order"), "bucket")
    ranked = sketches.withColumn("upto", F.sum("n").over(by.orderBy("sign", F.col("sign") * F.col("bucket")).rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(by))
    quantiles = quantiles or QUANTILES
    first = [F.min(F.when(F.col("upto") >= F.greatest(F.ceil(F.lit(q) * F.col("total")), F.lit(1)), place)).alias(f"at_{name}") for name, q in quantiles.items()]
    at = ranked.groupBy(*groups).agg(F.max("total").alias("n"), *first)
    value = [(F.col(f"at_{name}.sign") * 2 * F.pow(F.lit(g), F.col(f"at_{name}.bucket")) / (g + 1)).alias(name) for name in quantiles]
    return at.select(*groups, "n", *value)


def measurements(sessions: DataFrame) -> DataFrame:
    """(strategy, day, metric, value) of the latest save of each session."""
    cols = ("strategy", "created_at", "latency_ms", "cost_usd", "loaded_at")
    rows = sessions.select("session_id", *cols)
    own = F.coalesce("session_id", F.concat(F.lit("row "), F.xxhash64(*cols).cast("string")))
    last = rows.groupBy(own.alias("session")).agg(F.max_by(F.struct("strategy", "created_at", "latency_ms", "cost_usd"), F.struct("loaded_at", "latency_ms", "cost_usd", "strategy", "created_at")).alias("s"))
    day = F.to_date("s.created_at").cast("string")
    metric = F.explode(
        F.array(
            F.struct(F.lit("latency_ms").alias("metric"), F.col("s.latency_ms").alias("value"), F.lit(4.9e-324).alias("least")),
            F.struct(F.lit("cost_usd").alias("metric"), F.col("s.cost_usd").alias("value"), F.lit(0.0).alias("least")),
        )
    )
    flat = last.select(F.col("s.strategy").alias("strategy"), day.alias("day"), metric.alias("m"))
    return flat.select("strategy", "day", "m.metric", "m.value").where(real(F.col("m.value"), F.col("m.least")))


def daily_sketch(sessions: DataFrame) -> DataFrame:
    """(strategy, day, metric, sign, bucket, n): what is kept of a day."""
    return sketch(measurements(sessions), ["strategy", "day", "metric"])


def session_percentiles(daily: DataFrame) -> DataFrame:
    """(scope, key, metric, n, percentiles, error) for each strategy and for each day, from the daily sketches."""
    both = daily.select(
        F.explode(F.array(F.struct(F.lit("strategy").alias("scope"), F.col("strategy").alias("key")), F.struct(F.lit("day").alias("scope"), F.col("day").alias("key")))).alias("g"),
        "metric",
        "sign",
        "bucket",
        "n",
    ).select("g.scope", "g.key", "metric", "sign", "bucket", "n")
    groups = ["scope", "key", "metric"]
    return percentiles(merge(both, groups), groups).withColumn("relative_error", F.lit(ERROR))
