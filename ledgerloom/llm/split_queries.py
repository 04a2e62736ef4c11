"""Queries of problem 3 and the SQL of the cases; pieces are checked on fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.split import cut_kinds, split_sections
from ledgerloom.tables import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_kinds(table(spark, sf_dir, "sections"), table(spark, sf_dir, "split_limits"))


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sections(table(spark, sf_dir, "sections"), table(spark, sf_dir, "split_limits")).drop("hard").distinct()


QUERIES = {"p3_found": p3_found, "p3_pieces": p3_pieces}
SQL = {
    "p3_found": r"""
SELECT DISTINCT section_key,
  CASE WHEN list_max(list_transform(regexp_split_to_array(text, '[ \t\r\n。]'), lambda x: length(x))) > max_chars THEN 'hard' ELSE 'soft' END AS cut
FROM sections JOIN split_limits USING (doc_type) WHERE length(text) > max_chars"""
}
