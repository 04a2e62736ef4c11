"""Mixing sources to target weights (problem 7).

Sizes are tokens of a public tokenizer. The mix is the largest in which every
source that has texts keeps its share while no text is used more often than the
source allows; each text of a source then has the same expected number of copies.
Its whole part is taken as it is. The rest is an inclusion probability, and the
cube method draws a sample that keeps the token and the text total of the source:
three texts at a time, the probabilities move along the null space of both
constraints until one of them is 0 or 1, each as often up as down on average, so
that every text keeps its probability. Buckets of a source fly apart from each
other, and what is left of them (two texts each) flies on, level by level; the last
two texts of a source land by giving up one constraint after the other. Both totals
are off by less than the two largest texts of the source.

Defined results: null and blank texts are not used; equal texts count as one text
under the smallest doc_id, in the source of that row; sources without a target, and
null, are not used; targets without texts reach 0 and the other targets are scaled
to 1; the draw depends only on the ids and the seed; other columns are ignored.
"""

from __future__ import annotations

import functools
import random
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.bpe import TOKENIZERS, count_tokens
from ledgerloom.session import checkpointed

#: Texts of a source that fly in one task.
BUCKET = 20_000
EPS = 1e-9


def _between(x: float) -> bool:
    return EPS < x < 1 - EPS


def _step(p: list[float], at: list[int], u: list[float], rng: random.Random) -> None:
    """Move the probabilities ``at`` along ``u`` until one is 0 or 1; to which end is drawn so that none changes on average."""
    up = min((1 - p[i]) / v if v > 0 else p[i] / -v for i, v in zip(at, u, strict=True) if v)
    down = min(p[i] / v if v > 0 else (1 - p[i]) / -v for i, v in zip(at, u, strict=True) if v)
    step = up if rng.random() * (up + down) < down else -down
    for i, v in zip(at, u, strict=True):
        p[i] = min(1.0, max(0.0, p[i] + step * v))


def fly(tokens: list[int], probs: list[float], rng: random.Random) -> list[float]:
    """Move probabilities to 0 or 1, keeping sum(p) and sum(p * tokens); at most two stay between.

    Three at a time, along the null space of both constraints: long texts first, so that the short ones make up for them.
    """
    p = list(probs)
    order = [i for i, x in enumerate(p) if _between(x)]
    rng.shuffle(order)
    order.sort(key=lambda i: -tokens[i])
    pool: list[int] = []
    for k in order:
        pool.append(k)
        while len(pool) == 3:
            a, b, c = pool
            u = [float(tokens[b] - tokens[c]), float(tokens[c] - tokens[a]), float(tokens[a] - tokens[b])]
            _step(p, pool, u if any(u) else [1.0, -1.0, 0.0], rng)
            pool = [i for i in pool if _between(p[i])]
    return p


def land(tokens: list[int], probs: list[float], rng: random.Random) -> list[float]:
    """Draw the last probabilities, giving up one constraint after the other, in an order that is drawn as well."""
    p = list(probs)
    left = [i for i, x in enumerate(p) if _between(x)]
    while len(left) >= 2:
        a, b = left[:2]
        _step(p, [a, b], [1.0, -1.0] if rng.random() < 0.5 else [float(tokens[b]), -float(tokens[a])], rng)
        left = [i for i in left if _between(p[i])]
    for i in left:
        p[i] = 1.0 if rng.random() < p[i] else 0.0
    return [float(round(x)) for x in p]


def texts(documents: DataFrame, targets: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, source, tokens): one row for each distinct text of a source with a target."""
    wanted = targets.where("target_share > 0 and max_repeats > 0 and source is not null").select("source").distinct()
    rows = documents.select("doc_id", "source", "text").where(F.col("text").rlike(r"\S")).join(F.broadcast(wanted), "source", "left_semi")
    counted = count_tokens(rows.withColumn("same", F.md5("text")), ["doc_id", "source", "same"], folder=folder)
    return (
        counted.groupBy("same")
        .agg(F.min("doc_id").alias("doc_id"), F.min_by("source", "doc_id").alias("source"), F.max("tokens").alias("tokens"))
        .where("tokens > 0")
        .select("doc_id", "source", "tokens")
    )


def plan(units: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, n_texts, have, share, copies): expected copies of each text; a row for each usable source."""
    one = targets.where("target_share > 0 and max_repeats > 0 and source is not null").groupBy("source").agg(F.sum("target_share").alias("share"), F.min("max_repeats").alias("max_repeats"))
    sizes = units.groupBy("source").agg(F.count("*").alias("n_texts"), F.sum("tokens").alias("have"))
    use = sizes.join(F.broadcast(one), "source")
    total = use.agg(F.sum("share").alias("all_shares"), F.min(F.col("max_repeats") * F.col("have") / F.col("share")).alias("least"))
    # least / all_shares * all_shares: the mix holds share / all_shares of each source, and the scarcest source sets its size
    return use.crossJoin(F.broadcast(total)).select(
        "source", "n_texts", "have", "share", F.least(F.col("share") * F.col("least") / F.col("have"), F.col("max_repeats").cast("double")).alias("copies")
    )


def draw(units: DataFrame, targets: DataFrame, seed: int = 7, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, source, tokens, copies) of the texts used, each at least once.

    Buckets of a source fly apart from each other; the two texts that each may leave fly on in
    buckets of their own, level by level, until a source has one bucket, which lands.
    """
    planned = plan(units, targets)
    rows = units.join(F.broadcast(planned.select("source", "copies")), "source")
    rows = rows.select("doc_id", "source", "tokens", F.floor("copies").cast("int").alias("base"), (F.col("copies") - F.floor("copies")).alias("p"))
    schema = "doc_id long, source string, tokens long, base int, p double"
    between = (F.col("p") > EPS) & (F.col("p") < 1 - EPS)

    def flight(level: int, last: bool) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("doc_id")
            rng = random.Random(f"{seed}|{level}|{key}")
            tokens = pdf["tokens"].tolist()
            p = fly(tokens, pdf["p"].tolist(), rng)
            pdf["p"] = land(tokens, p, rng) if last else p
            return pdf[["doc_id", "source", "tokens", "base", "p"]]

        return run

    most = planned.agg(F.max("n_texts")).collect()[0][0] or 0
    done, level = [], 0
    while True:
        buckets = -(-most // bucket)
        last = buckets <= 1
        at = F.pmod(F.xxhash64("doc_id", F.lit(level)), F.lit(max(buckets, 1)))
        flown = rows.withColumn("bucket", at).groupBy("source", "bucket").applyInPandas(flight(level, last), schema)
        if last:
            done.append(flown)
            break
        flown = checkpointed(flown)
        done.append(flown.where(~between))
        rows, most, level = flown.where(between), 2 * buckets, level + 1
    whole = functools.reduce(DataFrame.unionByName, done)
    return whole.select("doc_id", "source", "tokens", (F.col("base") + F.round("p").cast("int")).alias("copies")).where("copies > 0")


def mix(documents: DataFrame, targets: DataFrame, folder: str = TOKENIZERS, seed: int = 7) -> DataFrame:
    """The training mix as (doc_id, source, tokens, copies)."""
    return draw(checkpointed(texts(documents, targets, folder)), targets, seed)


def shares(documents: DataFrame, targets: DataFrame, folder: str = TOKENIZERS, seed: int = 7) -> DataFrame:
    """A row for each source of the targets or the documents: the share wanted and the share reached."""
    units = checkpointed(texts(documents, targets, folder))
    used = (
        draw(units, targets, seed)
        .groupBy("source")
        .agg(F.count("*").alias("n_used"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens_used"), F.max("copies").alias("most_copies"))
    )
    have = units.groupBy("source").agg(F.count("*").alias("n_texts"), F.sum("tokens").alias("tokens_available"))
    wanted = targets.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    named = documents.select("source").distinct().unionByName(wanted.select("source")).distinct()
    every = named
    for part in (wanted, have, used):
        cols = [c for c in part.columns if c != "source"]
        part = part.select(F.col("source").alias("s"), *cols)
        every = every.join(F.broadcast(part), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    filled = every.select("source", *(F.coalesce(c, F.lit(0)).alias(c) for c in every.columns if c != "source"))
    total = filled.agg(F.sum("tokens_used").alias("all_tokens"))
    return filled.crossJoin(F.broadcast(total)).select(
        "source", "target_share", "max_repeats", "n_texts", "tokens_available", "n_used", "tokens_used", "most_copies", F.try_divide("tokens_used", "all_tokens").alias("share_reached")
    )
