"""Queries of problem 1 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.percentiles import ERROR, QUANTILES, daily_sketch, session_percentiles
from ledgerloom.tables import table


def p1_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The percentiles to twelve significant digits, as two engines compute powers alike only so far."""
    found = session_percentiles(daily_sketch(table(spark, sf_dir, "sessions")))
    return found.withColumns({q: F.format_string("%.11e", F.col(q)).cast("double") for q in QUANTILES})


def p1_daily_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_sketch(table(spark, sf_dir, "sessions"))


_G = (1 + ERROR) / (1 - ERROR)
_SKETCH = f"""
WITH last AS (
  SELECT * FROM sessions
  QUALIFY row_number() OVER (PARTITION BY coalesce(session_id, 'row ' || hash(strategy, created_at, latency_ms, cost_usd, loaded_at))
    ORDER BY loaded_at DESC NULLS LAST, latency_ms DESC NULLS LAST, cost_usd DESC NULLS LAST, strategy DESC NULLS LAST, created_at DESC NULLS LAST) = 1),
measured AS (
  SELECT strategy, CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, 'latency_ms' AS metric, latency_ms AS v FROM last WHERE latency_ms > 0 AND isfinite(latency_ms)
  UNION ALL
  SELECT strategy, CAST(CAST(created_at AS DATE) AS VARCHAR), 'cost_usd', cost_usd FROM last WHERE cost_usd >= 0 AND isfinite(cost_usd)),
sketch AS (
  SELECT strategy, day, metric, CAST(sign(v) AS INT) AS sign, CASE WHEN v = 0 THEN 0 ELSE CAST(ceil(ln(abs(v)) / ln({_G!r})) AS INT) END AS bucket, count(*) AS n
  FROM measured GROUP BY ALL)
"""
_PICK = ", ".join(
    f"CAST(printf('%.11e', arg_min(sign * 2 * pow({_G!r}, bucket) / ({_G!r} + 1), struct_pack(a := sign, b := sign * bucket)) FILTER (WHERE upto >= greatest(ceil({q} * total), 1))) AS DOUBLE) AS {name}" for name, q in QUANTILES.items()
)
QUERIES = {"p1_percentiles": p1_percentiles, "p1_daily_sketch": p1_daily_sketch}
SQL = {
    "p1_percentiles": _SKETCH
    + f""", both_ AS (
  SELECT 'strategy' AS scope, strategy AS key, metric, sign, bucket, n FROM sketch UNION ALL SELECT 'day', day, metric, sign, bucket, n FROM sketch),
merged AS (SELECT scope, key, metric, sign, bucket, sum(n) AS n FROM both_ GROUP BY ALL),
ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY scope, key, metric ORDER BY sign, sign * bucket) AS upto, sum(n) OVER (PARTITION BY scope, key, metric) AS total FROM merged)
SELECT scope, key, metric, CAST(max(total) AS BIGINT) AS n, {_PICK}, CAST({ERROR} AS DOUBLE) AS relative_error FROM ranked GROUP BY scope, key, metric""",
    "p1_daily_sketch": _SKETCH + "SELECT * FROM sketch",
}
