"""Every question is asked, whatever its id."""

import datetime as dt

import duckdb
import pytest

from ledgerloom.plans import retrieval
from tests.parity import assert_same

WORDS = "alpha beta gamma delta omega sigma kappa lambda theta zeta".split()


@pytest.fixture(scope="module")
def asked(spark, tmp_path_factory):
    """Chunks of two words each and questions of which 20 divides the id of one only: (folder, DuckDB)."""
    at = tmp_path_factory.mktemp("asked")
    chunks = [(f"D{i}:c{j}", "10-K", "T", "C", 2020 + j, "1", "t", f"{w} {WORDS[(i + j + 1) % 10]} filing", dt.datetime(2024, 1, 1), None) for i, w in enumerate(WORDS) for j in range(2)]
    spark.createDataFrame(chunks, "id string, doc_type string, ticker string, company string, fiscal_year int, item string, title string, text string, ingested_at timestamp, deleted_at timestamp").write.parquet(f"{at}/chunks.parquet")
    asks = [(i, f"What of {w}?", f"s{i // 2}", [f"D{i}"]) for i, w in enumerate(WORDS)] + [(7, "Alpha, and what of alpha?", "s3", ["D0:c1", None]), (11, None, "s5", []), (12, "And what of beta?", None, ["D9"])]
    spark.createDataFrame(asks, "response_id bigint, input string, session_id string, citations array<string>").write.parquet(f"{at}/synthesis_responses.parquet")
    con = duckdb.connect()
    for name in ("chunks", "synthesis_responses"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{at}/{name}.parquet/*.parquet'")
    return str(at), con


def test_bm25_topk_of_every_question(spark, asked):
    folder, con = asked
    df = retrieval.bm25_topk(spark, folder)
    assert {r.response_id for r in df.collect()} == {*range(10), 12}
    assert_same(df, con, retrieval.SQL["bm25_topk"])


def test_hit_at_k_of_every_question_with_citations(spark, asked):
    folder, con = asked
    df = retrieval.hit_at_k_mrr(spark, folder)
    # Only 11 is without a citation.
    assert df.first().n == 11
    assert_same(df, con, retrieval.SQL["hit_at_k_mrr"])


def test_multi_query_merge_of_every_session(spark, asked):
    folder, con = asked
    df = retrieval.multi_query_merge(spark, folder)
    # Both questions of a session are asked; 12 has no session, 11 no words.
    assert {(r.session_id, r.id) for r in df.collect()} >= {("s0", "D0:c0"), ("s0", "D1:c0"), ("s4", "D8:c0"), ("s4", "D9:c0")}
    assert {r.session_id for r in df.collect()} == {f"s{i}" for i in range(5)}
    assert_same(df, con, retrieval.SQL["multi_query_merge"])
