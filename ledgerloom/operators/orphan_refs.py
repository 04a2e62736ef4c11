"""References to records that do not exist (problem 4).

Keys of all references are encoded as integers (a dictionary of key ranges and
positions), each block of a key range has one compressed bitmap per month (sorted
positions where few bits are set, else bits) for the references and one for the
parents that live through that whole month, and
``references AND NOT parents`` leaves the keys whose references of that month
need a look at the exact times. Only those rows meet the parents' life spans.

Defined results: null, empty and blank references (also after brackets are
taken off) are none; a reference without a time is reported only where the
record exists at no time, with a null month; repeated rows count once; columns
that are not named here are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Positions of a block, and those up to which its container lists them instead of setting bits.
BLOCK, LISTED = 32768, 2048
#: Hash ranges of the dictionary. Ranks inside a range are streamed in the order of the keys, so a range may grow.
RANGES = 512
FOREVER = 1 << 30


def normal_key(c: Column) -> Column:
    """A reference without case and without white space and brackets around it."""
    return F.regexp_replace(F.lower(c), r"(?U)^[\s\[\]()]+|[\s\[\]()]+$", "")


def month_index(ts: Column) -> Column:
    return F.year(ts) * 12 + F.month(ts)


def references(df: DataFrame, ref_table: str, key: Column, value: Column, at: Column, space: str) -> DataFrame:
    """Rows (ref_table, ref_key, ref_value, space, key, at, period) of one referring table."""
    rows = df.select(
        F.lit(ref_table).alias("ref_table"), key.cast("string").alias("ref_key"), value.alias("ref_value"), at.cast("timestamp_ntz").alias("at")
    )
    return rows.select("*", F.lit(space).alias("space"), normal_key(F.col("ref_value")).alias("key"), F.coalesce(month_index(F.col("at")), F.lit(-1)).alias("period")).where(
        F.col("key") != ""
    )


def life_spans(df: DataFrame, key: Column, born: Column, died: Column, space: str) -> DataFrame:
    """Distinct (space, key, born, died); rows without a key or a time of birth never lived."""
    return (
        df.select(F.lit(space).alias("space"), normal_key(key).alias("key"), born.cast("timestamp_ntz").alias("born"), died.cast("timestamp_ntz").alias("died"))
        .where((F.col("key") != "") & F.col("born").isNotNull())
        .distinct()
    )


def with_prefixes(spans: DataFrame, sep: str = ":") -> DataFrame:
    """Each span under its key and under every shorter key that ends before a separator."""
    parts = F.split("key", sep)
    keys = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), sep))
    return spans.withColumn("key", F.explode(keys)).distinct()


def dictionary(refs: DataFrame, ranges: int) -> DataFrame:
    """(space, range, block, pos, key, periods): an integer for each referenced key.

    ``range`` is a hash range, (block, pos) the rank of the key inside it, so the
    same keys always get the same integers and a lost task can be run again. A
    range with more than BLOCK keys goes on in its next block.
    """
    keys = refs.groupBy("space", "key").agg(F.array_sort(F.collect_set("period")).alias("periods"))
    keys = keys.withColumn("range", F.pmod(F.xxhash64("key"), F.lit(ranges)).cast("int"))
    rank = F.row_number().over(Window.partitionBy("space", "range").orderBy("key")) - 1
    return keys.withColumn("rank", rank).select(
        "space", "range", F.floor(F.col("rank") / BLOCK).cast("int").alias("block"), (F.col("rank") % BLOCK).alias("pos"), "key", "periods"
    )


def _unpack(block: bytes) -> np.ndarray:
    """The bits of a container."""
    if block[0] == 1:
        return np.unpackbits(np.frombuffer(block, np.uint8, offset=1), bitorder="little")
    bits = np.zeros(BLOCK, np.uint8)
    bits[np.frombuffer(block, "<u2", offset=1)] = 1
    return bits


def _listed(block: bytes) -> np.ndarray | None:
    return np.frombuffer(block, "<u2", offset=1) if block[0] == 0 else None


@F.pandas_udf(T.BinaryType())
def container(positions: pd.Series) -> pd.Series:
    """A compressed bitmap of a block: 0 and its sorted positions where they are few, else 1 and its bits."""

    def packed(at: np.ndarray) -> bytes:
        if len(at) <= LISTED:
            return b"\0" + np.unique(at).astype("<u2").tobytes()
        bits = np.zeros(BLOCK, np.uint8)
        bits[at] = 1
        return b"\1" + np.packbits(bits, bitorder="little").tobytes()

    return positions.map(packed)


def bitmaps(bits: DataFrame, name: str) -> DataFrame:
    """One compressed bitmap per block of a key range and period; a block bounds what is gathered."""
    blocks = bits.groupBy("space", "range", "block", "period").agg(F.collect_list(F.col("pos").cast("int")).alias("positions"))
    return blocks.select("space", "range", "block", "period", container("positions").alias(name))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def and_not(refs: pd.Series, parents: pd.Series) -> pd.Series:
    """Positions of the bits of ``refs AND NOT parents``; no parents at all is the empty bitmap."""

    def surviving(a: bytes, b: bytes | None) -> np.ndarray:
        listed = _listed(a)
        if listed is not None:
            if b is not None:
                other = _listed(b)
                listed = listed[_unpack(b)[listed] == 0] if other is None else np.setdiff1d(listed, other, assume_unique=True)
            return listed.astype(np.int32)
        left = _unpack(a)
        if b is not None:
            left = left & ~_unpack(b)
        return np.flatnonzero(left).astype(np.int32)

    return pd.Series([surviving(a, b) for a, b in zip(refs, parents, strict=True)])


def intervals(spans: DataFrame) -> DataFrame:
    """(space, key, born, died): the disjoint intervals in which a key lives; ``died`` is null for one that goes on."""
    end = F.coalesce("died", F.lit("9999-12-31").cast("timestamp_ntz"))
    lived = spans.groupBy("space", "key", "born").agg(F.max(end).alias("end")).where(F.col("end") > F.col("born"))
    key = Window.partitionBy("space", "key").orderBy("born")
    before = F.max("end").over(key.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col("born") > before), 1).otherwise(0)
    island = F.sum("new").over(key.rowsBetween(Window.unboundedPreceding, 0))
    merged = lived.withColumn("new", new).withColumn("island", island).groupBy("space", "key", "island").agg(F.min("born").alias("born"), F.max("end").alias("end"))
    return merged.select("space", "key", "born", F.when(F.col("end") < F.lit("9999-12-31").cast("timestamp_ntz"), F.col("end")).alias("died"))


def suspects(refs: DataFrame, spans: DataFrame, ranges: int) -> DataFrame:
    """(space, key, period) in which a referenced key does not live all through the period."""
    encoded = dictionary(refs, ranges)
    month = month_index(F.col("born"))
    first = F.when(F.col("born") == F.date_trunc("month", F.col("born")).cast("timestamp_ntz"), month).otherwise(month + 1)
    last = F.coalesce(month_index(F.col("died")) - 1, F.lit(FOREVER))
    lived = spans.select("space", "key", first.alias("first"), last.alias("last")).distinct().join(encoded, ["space", "key"])
    lived = lived.withColumn("period", F.explode(F.filter("periods", lambda p: (p >= F.col("first")) & (p <= F.col("last")))))
    asked = encoded.withColumn("period", F.explode("periods"))
    left = bitmaps(asked, "ref_bits").join(bitmaps(lived, "parent_bits"), ["space", "range", "block", "period"], "left")
    survivors = left.select("space", "range", "block", "period", F.explode(and_not("ref_bits", "parent_bits")).alias("pos"))
    return survivors.join(encoded, ["space", "range", "block", "pos"]).select("space", "key", "period")


def orphans(refs: DataFrame, spans: DataFrame, ranges: int = RANGES) -> DataFrame:
    """(ref_table, ref_month, ref_key, ref_value, reason) of each reference that does not hold.

    A hot key weighs one bit in each period, and its surviving rows are spread by the
    skew join on their way to the exact check, where they meet disjoint intervals.
    """
    alive_in = intervals(spans)
    doubtful = refs.join(suspects(refs, alive_in, ranges), ["space", "key", "period"], "left_semi")
    lives = alive_in.select(F.col("space").alias("p_space"), F.col("key").alias("p_key"), "born", "died")
    alive = (
        (F.col("space") == F.col("p_space"))
        & (F.col("key") == F.col("p_key"))
        & (F.col("born") <= F.col("at"))
        & (F.col("died").isNull() | (F.col("died") > F.col("at")))
    )
    births = spans.groupBy("space", "key").agg(F.min("born").alias("first_born"))
    reason = (
        F.when(F.col("first_born").isNull(), "missing").when(F.col("at").isNull(), None).when(F.col("first_born") > F.col("at"), "late").otherwise("deleted")
    )
    month = F.when(F.col("at").isNotNull(), F.format_string("%04d-%02d", F.year("at"), F.month("at")))
    return (
        doubtful.join(lives, alive, "left_anti")
        .join(births, ["space", "key"], "left")
        .select("ref_table", month.alias("ref_month"), "ref_key", "ref_value", reason.alias("reason"))
        .where(F.col("reason").isNotNull())
        .distinct()
    )


def find_orphans(traces: DataFrame, golden: DataFrame, trajectories: DataFrame, chunks: DataFrame, sessions: DataFrame, ranges: int = RANGES) -> DataFrame:
    """The orphan references of the three referring tables of this project."""
    t = traces.select("trace_id", "created_at", F.explode("citations").alias("citation"))
    g = golden.select("id", "created_at", F.explode("expected.citations").alias("citation"))
    refs = (
        references(t, "traces", F.col("trace_id"), F.col("citation"), F.col("created_at"), "chunk")
        .unionByName(references(g, "golden_set_v1", F.col("id"), F.col("citation"), F.col("created_at"), "chunk"))
        .unionByName(references(trajectories, "trajectories", F.col("id"), F.col("session_id"), F.col("logged_at"), "session"))
    )
    lives = sessions.groupBy("session_id").agg(F.min("loaded_at").alias("born"), F.max("deleted_at").alias("died"))
    spans = with_prefixes(life_spans(chunks, F.col("id"), F.col("ingested_at"), F.col("deleted_at"), "chunk")).unionByName(
        life_spans(lives, F.col("session_id"), F.col("born"), F.col("died"), "session")
    )
    return orphans(refs, spans, ranges)
