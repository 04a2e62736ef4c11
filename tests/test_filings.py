"""Sections of filings, data tables of pages, derived figures, arithmetic, ranks in parts and pruned ranking."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.derive import derived_values, evaluate, near_any
from ledgerloom.operators import retrieval as rt
from ledgerloom.operators import sections as sc

BODY = "word " * 60


def lines(spark, *texts):
    rows = [("d", i, t) for i, t in enumerate(texts, 1)]
    return spark.createDataFrame(rows, "doc string, line_no int, line string")


def items(spark, *texts):
    got = sc.item_sections(lines(spark, *texts), "doc").collect()
    return {r.item: r for r in got}


def test_a_table_of_contents_gives_no_section(spark):
    got = items(spark, "Item 1. Business .... 4", "Item 1A. Risk Factors .... 9", "Item 7. MD&A .... 30", "Item 1. Business", BODY, "Item 1A. Risk Factors", BODY, "ITEM 7 — Discussion", BODY)
    assert set(got) == {"1", "1A", "7"} and got["1"].part == "I" and got["7"].part == "II"
    assert got["7"].title == "Discussion" and got["1"].text.startswith("Item 1. Business\nword")


def test_a_bare_page_header_gives_way_to_the_titled_one(spark):
    got = items(spark, "Item 1. Business", BODY, "Item 7. Discussion", BODY, "Item 7", BODY + BODY, "Item 8. Statements", BODY)
    assert got["7"].title == "Discussion"


def test_titles(spark):
    df = spark.createDataFrame([("7A", "Market Risk ..... 41"), ("8", ""), ("99", ""), ("2", "x" * 120)], "item string, raw string")
    assert [r.t for r in df.select(sc.clean_title(F.col("item"), F.col("raw")).alias("t")).collect()] == ["Market Risk", "Financial Statements and Supplementary Data", "(untitled)", "Properties"]


def test_no_headers_and_no_lines(spark):
    assert not items(spark, "just", "text") and sc.item_sections(lines(spark, "x").limit(0), "doc").count() == 0


def test_data_tables():
    page = (
        "<p>Text</p><table><tr><td>(In millions)</td></tr><tr><td>Revenue</td><td>$</td><td>130,497</td><td> $ </td><td>60,922</td></tr>"
        "<tr><td>Nested <table><tr><td>inner</td></tr></table> cell</td><td></td><td>77</td></tr></table><table><tr><td>layout</td><td>only prose</td></tr><tr><td>more</td><td>prose</td></tr></table>"
    )
    assert sc.table_lines(page) == [["(In millions)", "Revenue | $130,497 | $60,922", "Nested inner cell | 77"]]
    assert sc.table_lines(None) == [] and sc.table_lines("<table><tr><td>1") == []


def test_derived_values_against_all_pairs():
    rng = random.Random(2)
    for _ in range(20):
        numbers = [round(rng.uniform(-500, 500), 2) for _ in range(12)]
        got = derived_values(np.array(numbers))
        for i, a in enumerate(numbers):
            for b in numbers[:i]:
                low, high = sorted((abs(a), abs(b)))
                if a != b and low >= 0.01 and high / low <= 25:
                    assert near_any(abs(a - b), got) and near_any(abs(a - b) / low * 100, got) and near_any(a + b, got)
    assert not near_any(7.7, derived_values(np.array([], float)))


@pytest.mark.parametrize("text, value", [("2 + 3 * 4", 14.0), ("-(2 ** 3) / 4", -2.0), ("(52103 - 43585) / 52103 * 100", 16.348386849125767), ("1 / 0", None), ("__import__('os')", None), ("a + 1", None), ("", None), (None, None), ("True + 1", None), ("2 ** 0.5 ** -9999999", None), ("(-8) ** 0.5", None)])
def test_arithmetic(text, value):
    got = evaluate(text)
    assert got is None if value is None else abs(got - value) < 1e-9


def test_ranks_in_parts(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(g, i, float(rng.randrange(40))) for i in range(500) for g in "ab"], "g string, i int, v double")
    got = rt.numbered(df, "g", [F.desc("v"), F.asc("i")], -F.floor(F.col("v") / 7))
    for g in "ab":
        rows = sorted((r for r in got.collect() if r.g == g), key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, 501)) and rows == sorted(rows, key=lambda r: (-r.v, r.i))


def test_pruned_ranking_is_exact(spark):
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.7)) % 90}" for _ in range(6000)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(3, 40)))) for i in range(300)] + [(900, None), (901, "")]
    asks = [(q, " ".join(rng.choice(words) for _ in range(rng.randint(1, 8)))) for q in range(25)] + [(98, None), (99, "unknown")]
    d, q = spark.createDataFrame(docs, "id int, t string"), spark.createDataFrame(asks, "q_id int, ask string")
    got = {(r.q_id, r["rank"]): (r.id, r.score) for r in rt.bm25_top_k(d, "id", "t", q, "q_id", "ask", 5).collect()}
    parts = rt.weighted_postings(d, "id", "t", q.select(F.explode(F.split("ask", " ")).alias("term"))).collect()
    for qid, ask in asks[:25]:
        score = {}
        for p in parts:
            score[p.id] = score.get(p.id, 0.0) + p.part * ask.split(" ").count(p.term)
        best = sorted(((-round(v, 6), k) for k, v in score.items() if any(p.id == k and p.term in ask.split(" ") for p in parts)))[:5]
        assert [got[qid, r][0] for r in range(1, len(best) + 1)] == [k for _, k in best]
    assert not [k for k in got if k[0] in (98, 99)]
