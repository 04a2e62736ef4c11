"""Lexical, dense and fused ranking of passages for batches of questions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.text import tokenize
from ledgerloom.operators import lexical
from ledgerloom.operators.lexical import B, EPSILON, K1

# Fixed value. Parameter of the fusion.
RRF = 60


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf)."""
    return docs.select(key, F.explode(tokenize(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def weighted_postings(docs: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """(key, term, part): what each of the terms adds to the score of a document, written once."""
    posts = postings(docs, key, text)
    lengths = posts.groupBy(key).agg(F.sum("tf").alias("dl"))
    corpus = docs.agg(F.count("*").alias("n")).crossJoin(lengths.agg(F.sum("dl").alias("total")))
    one = corpus.select((F.col("total") / F.col("n")).alias("avgdl"), F.col("n").cast("double").alias("n_docs"))
    df = posts.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(one))
    raw = df.select("term", (F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    idf = raw.crossJoin(F.broadcast(raw.agg(F.avg("raw").alias("mean")))).select("term", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return posts.join(terms, "term", "left_semi").join(lengths, key).crossJoin(F.broadcast(one)).join(idf, "term").select(key, "term", part.alias("part"))


def bm25_top_k(docs: DataFrame | lexical.Index, key: str, text: str, queries: DataFrame, query_key: str, query_text: str, k: int, within: str | None = None, shared: bool = False, carry: list[str] | None = None) -> DataFrame:
    """(query_key, key, score, rank): the k best documents of each query, exactly.

    ``docs`` is a table with one row for each key, or its index, which further searches use again. ``within`` names a column of both sides
    that has to be equal, for searches inside a part of the documents; the statistics are those of all. ``shared`` adds the
    number of distinct words that query and document share; ``carry`` names columns of the queries that come along.
    """
    index = docs if isinstance(docs, lexical.Index) else bm25_index(docs, key, text, within)
    asked = queries.select(query_key, *([within] if within else []), *(carry or []), tokenize(F.col(query_text)).alias("words"))
    return lexical.search(index, asked, query_key, "words", k, within, shared=shared, carry=carry)


def bm25_index(docs: DataFrame, key: str, text: str, within: str | None = None) -> lexical.Index:
    """The index of ``docs`` for ``bm25_top_k``."""
    return lexical.indexed(docs.select(key, *([within] if within else []), tokenize(F.col(text)).alias("words")), key, "words", within)


def top_k(scored: DataFrame, query_key: str, key: str, k: int, score: str = "score") -> DataFrame:
    """The k best of each query, ties by key; ranked rows beyond k are cut before the shuffle."""
    w = Window.partitionBy(query_key).orderBy(F.desc(score), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def inner_products(vectors: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, k: int | None = None, part: int = 4096, block: int = 512) -> DataFrame:
    """(query_key, key, score): inner products, block by block; with ``k`` at least the k best of each query.

    Vectors are hashed into parts of about ``part`` rows and queries into blocks of about
    ``block``; every part meets every block in a task of its own as one matrix product and
    keeps what is asked of it, so no task holds more than a part and a block.
    """
    n_parts = max(1, -(-vectors.count() // part))
    n_blocks = max(1, -(-queries.count() // block))
    at = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = vectors.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"), at(key, n_parts).alias("part"), each(n_blocks).alias("block"))
    asked = queries.select(F.col(query_key).alias("q"), F.col(query_vector).cast("array<double>").alias("v"), at(query_key, n_blocks).alias("block"), each(n_parts).alias("part"))
    kind, qkind = vectors.schema[key].dataType.simpleString(), queries.schema[query_key].dataType.simpleString()

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({query_key: [], key: [], "score": []})
        m, v = np.array(left["v"].tolist()), np.array(right["v"].tolist())
        s, ids = v @ m.T, left["k"].to_numpy()
        order = np.lexsort((np.broadcast_to(ids, s.shape), -np.round(s, 9)), axis=1)[:, : k or len(ids)]
        return pd.DataFrame({query_key: np.repeat(right["q"].to_numpy(), order.shape[1]), key: ids[order].ravel(), "score": np.take_along_axis(s, order, axis=1).ravel()})

    best = rows.groupBy("part", "block").cogroup(asked.groupBy("part", "block")).applyInPandas(score, f"{query_key} {qkind}, {key} {kind}, score double")
    return best.withColumn("score", F.round("score", 6))


def dense_top_k(vectors: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, k: int) -> DataFrame:
    """(query_key, key, score, rank): the k vectors with the greatest inner products, exactly."""
    return top_k(inner_products(vectors, key, vector, queries, query_key, query_vector, k), query_key, key, k)


def numbered(rows: DataFrame, group: str, order: list[Column], part: Column, name: str = "rank") -> DataFrame:
    """``rows`` with their place in a group, counted part by part so that no task sorts a whole group.

    ``part`` is a whole number that does not fall along the order. Rows are numbered within (group, part), and the
    parts before it, of which a group has few, add their counts.
    """
    t = rows.withColumn("_part", part)
    counts = t.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = counts.select(group, "_part", F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order))
    return t.withColumn("_place", place).join(before, [group, "_part"]).withColumn(name, F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")


def fuse(*ranked: DataFrame, query_key: str, key: str) -> DataFrame:
    """(query_key, key, rrf): reciprocal rank fusion of ranked lists with a 1-based column rank."""
    every = None
    for r in ranked:
        part = r.select(query_key, key, (1.0 / (RRF + F.col("rank"))).alias("w"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy(query_key, key).agg(F.round(F.sum("w"), 8).alias("rrf"))
