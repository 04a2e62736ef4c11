"""Packed lexical search against brute force, over several parts and blocks."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import lexical
from ledgerloom.operators import retrieval as rt


def brute(docs, asks, k, within=False, flat=False):
    """{(query, rank): (key, score, shared)}; docs are (key, text, scope), asks (query, text, scope)."""
    bags = {d: Counter((t or "").split()) for d, t, _ in docs}
    df = Counter(w for b in bags.values() for w in b)
    raw = {w: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: lexical.EPSILON * mean if r < 0 else r for w, r in raw.items()}
    avgdl = sum(sum(b.values()) for b in bags.values()) / len(docs)
    out = {}
    for q, text, scope in asks:
        ask, rows = Counter((text or "").split()), []
        for d, _, s in docs:
            both = [w for w in ask if w in bags[d]]
            if d is None or not both or within and (s is None or s != scope):
                continue
            norm = lexical.K1 * (1 - lexical.B + lexical.B * sum(bags[d].values()) / avgdl)
            score = len(both) if flat else sum(idf[w] * bags[d][w] * (lexical.K1 + 1) / (bags[d][w] + norm) * ask[w] for w in both)
            rows.append((-round(score, 6), d, len(both)))
        for rank, (s, d, n) in enumerate(sorted(rows)[:k], 1):
            out[q, rank] = (d, pytest.approx(-s, abs=2e-6), n)
    return out


def template_tables(spark, n_docs=400, n_asks=300):
    rng = random.Random(7)
    names = [f"name{i}" for i in range(60)]
    docs = [(f"d{i:04}", f"the sum of {rng.choice(names)} in {rng.choice(names)} for year y{rng.randrange(4)} " + "was paid " * rng.randrange(3), f"y{rng.randrange(3)}") for i in range(n_docs)]
    docs += [(None, "the sum of name1", "y1"), ("empty", None, "y1"), ("unscoped", "the sum of name2 was name3", None)]
    asks = [(i, f"what was the sum of {rng.choice(names)} for year y{rng.randrange(4)} of {rng.choice(names)}", f"y{rng.randrange(4)}") for i in range(n_asks)]
    asks += [(900, None, "y1"), (901, "unseen", "y1"), (902, "the of", "y1"), (903, "name1 name2", None)]
    d = spark.createDataFrame(docs, "id string, t string, fy string").repartition(3)
    return docs, asks, d, spark.createDataFrame(asks, "q_id int, ask string, fy string")


def ranked(df, score="score"):
    return {(r.q_id, r["rank"]): (r.id, r[score], r.shared) for r in df.collect()}


@pytest.mark.parametrize("k", [1, 7, 100])
def test_template_texts(spark, k):
    docs, asks, d, q = template_tables(spark)
    assert ranked(rt.bm25_top_k(d, "id", "t", q, "q_id", "ask", k, shared=True)) == brute(docs, asks, k)


def test_parts_of_zero_and_less(spark):
    # Two of four documents hold "a", which weighs 0; words in most documents weigh less than 0 here.
    docs = [("1", "a c d", "x"), ("2", "a c d", "x"), ("3", "c d", "x"), ("4", "c d e", "x")]
    asks = [(1, "a", "x"), (2, "a c e", "x"), (3, "c d", "x")]
    d, q = spark.createDataFrame(docs, "id string, t string, fy string"), spark.createDataFrame(asks, "q_id int, ask string, fy string")
    assert ranked(rt.bm25_top_k(d, "id", "t", q, "q_id", "ask", 3, shared=True)) == brute(docs, asks, 3)


def test_no_row_for_each_posting(spark):
    """Only what can be among the k best leaves the search: no exchange of its plan carries queries with postings."""
    _, asks, d, q = template_tables(spark)
    plan = rt.bm25_top_k(d, "id", "t", q, "q_id", "ask", 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "term#" not in plan and plan.count("Join Cross") == 1


def test_one_index_inside_a_scope_and_in_all(spark):
    docs, asks, d, q = template_tables(spark)
    index = rt.bm25_index(d, "id", "t", within="fy")
    assert ranked(rt.bm25_top_k(index, "id", "t", q, "q_id", "ask", 5, within="fy", shared=True)) == brute(docs, asks, 5, within=True)
    assert ranked(rt.bm25_top_k(index, "id", "t", q, "q_id", "ask", 5, shared=True)) == brute(docs, asks, 5)


def test_shared_words(spark):
    """Scores that are counts of shared words, with many ties."""
    docs, asks, d, q = template_tables(spark)
    index = lexical.indexed(d.select("id", F.array_distinct(F.split(F.trim("t"), " ")).alias("w")), "id", "w")
    asked = q.select("q_id", F.array_distinct(F.split("ask", " ")).alias("w"))
    assert ranked(lexical.search(index, asked, "q_id", "w", 2, flat=True, shared=True)) == brute(docs, asks, 2, flat=True)


def test_columns_come_along(spark):
    """Questions with equal texts keep columns of their own."""
    docs, asks, d, q = template_tables(spark, n_asks=20)
    twice = q.select(F.explode(F.array(F.lit(0), F.lit(10_000))).alias("more"), "*").select((F.col("q_id") + F.col("more")).alias("q_id"), "ask", (F.col("more") > 0).alias("copy"))
    rows = rt.bm25_top_k(d, "id", "t", twice, "q_id", "ask", 5, carry=["copy"]).collect()
    want = {(q + more, rank): (found[0], more > 0) for (q, rank), found in brute(docs, asks, 5).items() for more in (0, 10_000)}
    assert {(r.q_id, r["rank"]): (r.id, r.copy) for r in rows} == want
