"""Queries of problem 4 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.orphan_refs import find_orphans
from ledgerloom.tables import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("traces", "golden_set_v1", "trajectories", "chunks", "sessions")
    return find_orphans(*(table(spark, sf_dir, n) for n in names))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans per referring table, month and reason."""
    return p4_found(spark, sf_dir).groupBy("ref_table", "ref_month", "reason").agg(F.count("*").alias("n_refs"), F.countDistinct("ref_key").alias("n_rows"))


_FOUND = r"""
WITH refs AS (
  SELECT 'traces' AS ref_table, CAST(trace_id AS VARCHAR) AS ref_key, unnest(citations) AS ref_value, created_at AS at, 'chunk' AS space FROM traces
  UNION ALL
  SELECT 'golden_set_v1', id, unnest(expected.citations), created_at, 'chunk' FROM golden_set_v1
  UNION ALL
  SELECT 'trajectories', CAST(id AS VARCHAR), session_id, logged_at, 'session' FROM trajectories),
keyed AS (
  SELECT DISTINCT *, regexp_replace(lower(ref_value), '^[\s\[\]()]+|[\s\[\]()]+$', '', 'g') AS k FROM refs WHERE ref_value IS NOT NULL),
asked AS (SELECT * FROM keyed WHERE k <> ''),
split AS (SELECT string_split(lower(id), ':') AS parts, ingested_at AS born, deleted_at AS died FROM chunks),
spans AS (
  SELECT DISTINCT 'chunk' AS space, array_to_string(parts[1:n], ':') AS k, born, died
  FROM (SELECT parts, born, died, unnest(range(1, len(parts) + 1)) AS n FROM split)
  UNION ALL
  SELECT 'session', lower(session_id), min(loaded_at), max(deleted_at) FROM sessions GROUP BY session_id),
births AS (SELECT space, k, min(born) AS first_born FROM spans GROUP BY 1, 2),
good AS (
  SELECT DISTINCT a.space, a.k, a.at FROM asked a JOIN spans s ON a.space = s.space AND a.k = s.k AND s.born <= a.at AND (s.died IS NULL OR s.died > a.at)),
found AS (
  SELECT DISTINCT a.ref_table, strftime(a.at, '%Y-%m') AS ref_month, a.ref_key, a.ref_value,
    CASE WHEN b.first_born IS NULL THEN 'missing' WHEN b.first_born > a.at THEN 'late' ELSE 'deleted' END AS reason
  FROM asked a LEFT JOIN births b ON a.space = b.space AND a.k = b.k
  WHERE NOT EXISTS (SELECT 1 FROM good g WHERE g.space = a.space AND g.k = a.k AND g.at = a.at))
"""

QUERIES = {"p4_found": p4_found, "p4_report": p4_report}
SQL = {
    "p4_found": _FOUND + "SELECT * FROM found",
    "p4_report": _FOUND + "SELECT ref_table, ref_month, reason, count(*) AS n_refs, count(DISTINCT ref_key) AS n_rows FROM found GROUP BY 1, 2, 3",
}
