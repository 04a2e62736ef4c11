"""Queries of problem 8. SQL has no look-around; fixtures check them by brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.residue import find_residue
from ledgerloom.tables import table


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_residue(table(spark, sf_dir, "documents"))


def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus without the texts with residue."""
    documents = table(spark, sf_dir, "documents")
    return documents.join(p8_found(spark, sf_dir), "doc_id", "left_anti").select("doc_id", "source", "text")


QUERIES = {"p8_found": p8_found, "p8_clean": p8_clean}
SQL: dict[str, str] = {}
