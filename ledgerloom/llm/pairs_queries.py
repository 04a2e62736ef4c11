"""Queries of problem 2. SQL has no look-around; fixtures check them by brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.pairs import broken_pairs
from ledgerloom.tables import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken_pairs(table(spark, sf_dir, "judge_calibration_v1"), table(spark, sf_dir, "synthesis_responses"))


def p2_by_defect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective pairs per table and defect."""
    return p2_found(spark, sf_dir).groupBy("pair_table", "defect").agg(F.count("*").alias("n_pairs"))


QUERIES = {"p2_found": p2_found, "p2_by_defect": p2_by_defect}
SQL: dict[str, str] = {}
