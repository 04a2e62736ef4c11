"""Sessions and steps as streams: windows over latency and cost, resumable de-duplication, error streaks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def first_seen(stream: DataFrame, keys: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """Rows once for each key, as long as copies arrive within ``late``."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def windowed(stream: DataFrame, at: str, value: str, group: str, size: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Count, mean and greatest value by window and group."""
    win = F.window(at, size, slide) if slide else F.window(at, size)
    g = stream.withWatermark(at, late).groupBy(win.alias("w"), group)
    return g.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("greatest")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), group, "n", "mean", "greatest")


def sessions(stream: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Spells of activity of a key, split by a gap."""
    g = stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key)
    return g.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def breaker(stream: DataFrame, key: str, flag: str, limit: int = 5) -> DataFrame:
    """(key, streak): a row whenever a key has ``limit`` flagged rows in a row; the streak is the only state."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak = state.get[0] if state.exists else 0
        hits = []
        for pdf in batches:
            for f in pdf[flag]:
                streak = streak + 1 if f else 0
                if streak == limit:
                    hits.append(streak)
        state.update((streak,))
        yield pd.DataFrame({key: [k[0]] * len(hits), "streak": hits})

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} string, streak int", "streak int", "append", GroupStateTimeout.NoTimeout)
