"""Queries of problem 6; the ids are checked against the tokenizer's own library and by decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.bpe import TOKENIZERS, decoded_bytes, encode
from ledgerloom.tables import table


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), folder=spark.conf.get("ledgerloom.tokenizers", TOKENIZERS))


def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and bytes that come back from the ids."""
    folder = spark.conf.get("ledgerloom.tokenizers", TOKENIZERS)
    back = decoded_bytes(spark, encode(table(spark, sf_dir, "documents"), folder=folder), folder=folder)
    return back.agg(F.count("*").alias("n_docs"), F.sum("n_bytes").alias("n_bytes"))


QUERIES = {"p6_ids": p6_ids, "p6_round_trip": p6_round_trip}
SQL = {"p6_round_trip": "SELECT count(*) AS n_docs, sum(strlen(text)) AS n_bytes FROM documents WHERE text <> ''"}
