"""Columns that are computed once, however often later filters name them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, *keep: str, **columns: Column) -> DataFrame:
    """``df`` with the columns ``keep`` and the new ``columns``.

    A filter on a projected column is pushed below the projection with the whole
    expression in it, so that costly text functions run again in every filter;
    it can't be pushed below a generator.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files are too few to keep half of them busy; a scan of many files stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 < cores else df
