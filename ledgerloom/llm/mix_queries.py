"""Queries of problem 7. The draw is random, so its constraints are tested instead of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.bpe import TOKENIZERS
from ledgerloom.llm.mix import mix, shares
from ledgerloom.tables import table


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, str]:
    return table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), spark.conf.get("ledgerloom.tokenizers", TOKENIZERS)


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(*_tables(spark, sf_dir))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(*_tables(spark, sf_dir))


QUERIES = {"p7_mix": p7_mix, "p7_shares": p7_shares}
SQL: dict[str, str] = {}
