"""Queries of problem 5. SQL has no look-around, so brute force on fixtures checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.units import golden_quantities
from ledgerloom.tables import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden_quantities(table(spark, sf_dir, "golden_set_v1"), table(spark, sf_dir, "common_units"))


def p5_same_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cases record each amount, whatever unit they wrote it in."""
    return p5_found(spark, sf_dir).groupBy("quantity", "common_unit", "amount").agg(F.countDistinct("id").alias("n_cases"))


QUERIES = {"p5_found": p5_found, "p5_same_amount": p5_same_amount}
SQL: dict[str, str] = {}
