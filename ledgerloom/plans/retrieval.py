"""Ranking queries and their SQL. Questions are those of the responses; stated query sets are the rows whose id 20 divides."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.text import tokenize
from ledgerloom.operators import retrieval as rt
from ledgerloom.session import checkpointed
from ledgerloom.tables import table

TOP = 10
POOL = 25


def _chunks(spark, sf_dir):
    """One row for each chunk that stands: its id and its text below a header."""
    c = table(spark, sf_dir, "chunks").where("deleted_at is null")
    return c.groupBy("id").agg(F.min_by(F.struct("doc_type", "ticker", "company", "fiscal_year", "item", "title", "text"), F.struct("ingested_at", "text")).alias("c")).select("id", "c.*")


def _texts(spark, sf_dir):
    """The same chunks with no more than searches read."""
    c = table(spark, sf_dir, "chunks").where("deleted_at is null")
    return c.groupBy("id").agg(F.min_by(F.struct("fiscal_year", "text"), F.struct("ingested_at", "text")).alias("c")).select("id", "c.text", F.col("c.fiscal_year").cast("string").alias("fy"))


def _questions(spark, sf_dir):
    """Every question that was asked."""
    return table(spark, sf_dir, "synthesis_responses").groupBy("response_id").agg(F.min("input").alias("input"))


def _stated(spark, sf_dir):
    """The stated query set: the questions whose id 20 divides."""
    return _questions(spark, sf_dir).where("response_id % 20 = 0")


def _lexical(spark, sf_dir, k, questions, **options):
    return rt.bm25_top_k(_texts(spark, sf_dir), "id", "text", questions, "response_id", "input", k, **options)


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def tokenize_docs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", tokenize(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_terms"), F.md5(F.array_join("t", " ")).alias("digest")).where("n_tokens >= 0")


def term_stats(spark, sf_dir):
    posts = rt.postings(_chunks(spark, sf_dir), "id", "text")
    return posts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def bm25_topk(spark, sf_dir):
    return _lexical(spark, sf_dir, TOP, _questions(spark, sf_dir)).select("response_id", "id", "score", "rank")


def dense_topk(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return rt.dense_top_k(v, "vec_id", "embedding", q, "query_id", "query", TOP).select("query_id", "vec_id", "score", "rank")


def filtered_search(spark, sf_dir):
    """Lexical search among the chunks of the years that the question names, each year by itself, then the ten best of
    all its years; a question without a hit there is searched again in all chunks."""
    from ledgerloom.functions.text import years

    index = rt.bm25_index(_texts(spark, sf_dir), "id", "text", within="fy")
    every = _stated(spark, sf_dir)
    q = every.select("response_id", "input", F.explode(F.transform(F.array_distinct(years(F.col("input"))), lambda y: y.cast("string"))).alias("fy"))
    # A question of several years is one query in each of them.
    one = q.withColumn("one", F.concat_ws("|", F.col("response_id").cast("string"), "fy"))
    hits = rt.bm25_top_k(index, "id", "text", one, "one", "input", TOP, within="fy")
    hits = hits.select(F.split("one", r"\|")[0].cast("bigint").alias("response_id"), F.split("one", r"\|")[1].alias("fy"), "id", "score")
    found = checkpointed(rt.top_k(hits, "response_id", "id", TOP).select("response_id", "id", "fy", "score", "rank"))
    again = rt.bm25_top_k(index, "id", "text", every.join(found.select("response_id").distinct(), "response_id", "left_anti"), "response_id", "input", TOP)
    return found.unionByName(again.select("response_id", "id", F.lit(None).cast("string").alias("fy"), "score", "rank"))


def hybrid_rrf(spark, sf_dir):
    """Fusion of the whole dense order with the whole lexical order of the documents that have a vector; documents without a
    word of the query come last, in the order of their ids."""
    v = _vectors(spark, sf_dir).select("vec_id", "embedding")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text").where("text is not null").join(v, "vec_id")
    q = d.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("text").alias("query_text"), F.col("embedding").alias("query"))
    dense = checkpointed(rt.inner_products(d, "vec_id", "embedding", q, "query_id", "query"))
    words = rt.weighted_postings(d, "vec_id", "text", q.select(F.explode(tokenize(F.col("query_text"))).alias("term")).distinct())
    asked = q.select("query_id", F.explode(tokenize(F.col("query_text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    sparse = words.join(asked, "term").groupBy("query_id", "vec_id").agg(F.round(F.sum(F.col("part") * F.col("qtf")), 6).alias("sparse"))
    both = dense.join(sparse, ["query_id", "vec_id"], "left").withColumn("sparse", F.coalesce("sparse", F.lit(0.0)))
    a = rt.numbered(both, "query_id", [F.desc("score"), F.asc("vec_id")], -F.floor(F.col("score") * 32), "dense_rank")
    b = rt.numbered(a, "query_id", [F.desc("sparse"), F.asc("vec_id")], -F.floor(F.log1p(F.greatest("sparse", F.lit(0.0))) * 8), "sparse_rank")
    fused = b.select("query_id", "vec_id", F.round(1.0 / (rt.RRF + F.col("dense_rank")) + 1.0 / (rt.RRF + F.col("sparse_rank")), 8).alias("rrf"))
    return rt.top_k(fused, "query_id", "vec_id", TOP, "rrf").select("query_id", "vec_id", "rrf", "rank")


def rerank_candidates(spark, sf_dir):
    """The 25 best lexical candidates, ordered again by the share of the question's words in them."""
    q = _stated(spark, sf_dir).withColumn("n_words", F.size(F.array_distinct(tokenize(F.col("input")))))
    again = _lexical(spark, sf_dir, POOL, q, shared=True, carry=["n_words"]).select("response_id", "id", F.round(F.col("shared") / F.col("n_words"), 6).alias("overlap"), "score")
    w = Window.partitionBy("response_id").orderBy(F.desc("overlap"), F.desc("score"), "id")
    return again.withColumn("rank", F.row_number().over(w)).where(f"rank <= {TOP}").select("response_id", "id", "overlap", "rank")


def multi_query_merge(spark, sf_dir):
    """Hits of the asked questions of a session: the best score of each chunk, then the ten best chunks."""
    s = table(spark, sf_dir, "synthesis_responses").groupBy("response_id").agg(F.min("session_id").alias("session_id")).where("session_id is not null")
    hits = _lexical(spark, sf_dir, TOP, _questions(spark, sf_dir).join(s, "response_id"), carry=["session_id"])
    best = hits.groupBy("session_id", "id").agg(F.max("score").alias("score"))
    return rt.top_k(best, "session_id", "id", TOP).select("session_id", "id", "score", "rank")


def confidence_gate(spark, sf_dir):
    """Vectors of which no other comes near enough to answer from."""
    v = _vectors(spark, sf_dir)
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    best = rt.dense_top_k(v, "vec_id", "embedding", q, "query_id", "query", 2).where("query_id != vec_id").groupBy("query_id").agg(F.max("score").alias("best"))
    return best.select("query_id", "best", (F.col("best") < 0.35).alias("refuse"))


def hit_at_k_mrr(spark, sf_dir):
    """How early a chunk that the answer cites comes among the lexical hits."""
    cited = table(spark, sf_dir, "synthesis_responses").select("response_id", F.explode("citations").alias("c")).where("c is not null").distinct()
    # Citations travel with the questions, so that hits are tested where they come out and not exploded.
    q = _questions(spark, sf_dir).join(cited.groupBy("response_id").agg(F.collect_set("c").alias("cs")), "response_id")
    hits = _lexical(spark, sf_dir, 100, q, carry=["cs"]).where(F.exists("cs", lambda c: F.startswith(F.concat("id", F.lit(":")), F.concat(c, F.lit(":")))))
    first = cited.select("response_id").distinct().join(hits.groupBy("response_id").agg(F.min("rank").alias("rank")), "response_id", "left")
    at = lambda k: F.round(F.avg(F.coalesce((F.col("rank") <= k).cast("int"), F.lit(0))), 6)
    return first.agg(F.count("*").alias("n"), at(1).alias("hit_1"), at(5).alias("hit_5"), at(10).alias("hit_10"), at(100).alias("hit_100"), F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


def context_header(spark, sf_dir):
    c = _chunks(spark, sf_dir)
    filing = F.concat(F.coalesce("company", F.lit("")), F.lit(" ("), F.coalesce("ticker", F.lit("")), F.lit(") FY"), F.coalesce(F.col("fiscal_year").cast("string"), F.lit("None")), F.lit(" 10-K — Item "), F.coalesce("item", F.lit("")), F.lit(": "), F.coalesce("title", F.lit("")))
    contract = F.concat(F.lit("Contract "), F.coalesce("company", F.lit("")), F.lit(": "), F.coalesce("title", F.lit("")))
    article = F.concat(F.lit("PMID "), F.regexp_extract("id", r"^PMID:(\d+)", 1), F.lit(" — "), F.coalesce("title", F.lit("")), F.lit(" — Section: "), F.coalesce("item", F.lit("")))
    return c.select("id", F.when(F.col("doc_type") == "contract", contract).when(F.col("doc_type") == "biomedical", article).otherwise(filing).alias("header"))


def corpus_inventory(spark, sf_dir):
    c = table(spark, sf_dir, "chunks").where("ticker is not null").groupBy("ticker").agg(F.array_sort(F.collect_set("fiscal_year")).alias("y"), F.countDistinct("doc_id").alias("n_docs"))
    return c.select("ticker", "n_docs", F.concat_ws(", ", F.transform("y", lambda x: x.cast("string"))).alias("years"))


_BASE = """
WITH chunk1 AS (SELECT id, doc_type, ticker, company, fiscal_year, item, title, text FROM chunks WHERE deleted_at IS NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at, text) = 1),
q AS (SELECT response_id, min(input) AS input FROM synthesis_responses WHERE response_id % 20 = 0 GROUP BY response_id),
asked AS (SELECT response_id, term, count(*) AS qtf FROM (SELECT response_id, unnest(regexp_extract_all(replace(lower(input), ',', ''), '[a-z0-9]+')) AS term FROM q) GROUP BY ALL)
"""


def _bm25_sql(name: str, source: str) -> str:
    return f""",
{name}_post AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(replace(lower(body), ',', ''), '[a-z0-9]+')) AS term FROM ({source})) GROUP BY ALL),
{name}_len AS (SELECT id, sum(tf) AS dl FROM {name}_post GROUP BY id),
{name}_one AS (SELECT (SELECT count(*) FROM chunk1)::DOUBLE AS n, (SELECT sum(dl) FROM {name}_len)::DOUBLE / (SELECT count(*) FROM chunk1) AS avgdl),
{name}_raw AS (SELECT term, ln(n - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw FROM {name}_post, {name}_one GROUP BY term, n),
{name}_idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM {name}_raw) ELSE raw END AS idf FROM {name}_raw),
{name} AS (
  SELECT response_id, id, round(sum(idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) * qtf), 6) AS score
  FROM asked JOIN {name}_post USING (term) JOIN {name}_len USING (id) JOIN {name}_idf USING (term), {name}_one GROUP BY response_id, id)"""


_LEX = _BASE + _bm25_sql("lex", "SELECT id, text AS body FROM chunk1")
#: The same for every question.
_LEX_ALL = _LEX.replace(" WHERE response_id % 20 = 0", "")
_DENSE = """
WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
"""


def _top(source: str, by: str, k: int, score: str = "score") -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {score} DESC, id) AS rank FROM {source} QUALIFY rank <= {k})"


QUERIES = {
    "tokenize": tokenize_docs,
    **{f.__name__: f for f in (term_stats, bm25_topk, dense_topk, filtered_search, hybrid_rrf, rerank_candidates, multi_query_merge, confidence_gate, hit_at_k_mrr, context_header, corpus_inventory)},
}
SQL = {
    "tokenize": "SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_terms, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, regexp_extract_all(replace(lower(text), ',', ''), '[a-z0-9]+') AS t FROM documents) WHERE t IS NOT NULL",
    "term_stats": _LEX + "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM lex_post GROUP BY term",
    "bm25_topk": _LEX_ALL + f"SELECT response_id, id, score, rank FROM {_top('lex', 'response_id', TOP)}",
    "dense_topk": _DENSE + f"SELECT query_id, vec_id, score, rank FROM r WHERE rank <= {TOP}",
    "filtered_search": _LEX
    + r""", y0 AS (SELECT response_id, list_distinct(list_concat(list_transform(regexp_extract_all(input, '\b(?:19[6-9]\d|20[0-4]\d)\b'), lambda y: CAST(y AS INT)), list_transform(regexp_extract_all(input, '(?i)\bFY\s?''?(\d\d)\b', 1), lambda y: CAST(y AS INT) + CASE WHEN CAST(y AS INT) < 70 THEN 2000 ELSE 1900 END))) AS ys FROM q),
y AS (SELECT response_id, CAST(unnest(ys) AS VARCHAR) AS fy FROM y0),
f AS (SELECT l.*, CAST(c.fiscal_year AS VARCHAR) AS fy FROM lex l JOIN chunk1 c USING (id) WHERE EXISTS (SELECT 1 FROM y WHERE y.response_id = l.response_id AND y.fy = CAST(c.fiscal_year AS VARCHAR)))
"""
    + f"""SELECT response_id, id, fy, score, rank FROM {_top('f', 'response_id', TOP)}
UNION ALL SELECT response_id, id, NULL, score, rank FROM {_top('(SELECT * FROM lex WHERE response_id NOT IN (SELECT response_id FROM f))', 'response_id', TOP)}""",
    "hybrid_rrf": _DENSE.split(",\nr AS")[0]
    + """, chunk1 AS (SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL AND doc_id IN (SELECT vec_id FROM embeddings)),
asked AS (SELECT response_id, term, count(*) AS qtf FROM (SELECT id AS response_id, unnest(regexp_extract_all(replace(lower(text), ',', ''), '[a-z0-9]+')) AS term FROM chunk1 WHERE id % 20 = 0) GROUP BY ALL)"""
    + _bm25_sql("lex", "SELECT id, text AS body FROM chunk1")
    + f""", b AS (SELECT s.query_id, s.vec_id, s.score AS dense, coalesce(l.score, 0) AS sparse FROM s JOIN chunk1 c ON c.id = s.vec_id JOIN chunk1 q ON q.id = s.query_id LEFT JOIN lex l ON l.response_id = s.query_id AND l.id = s.vec_id),
k AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, vec_id) AS d, row_number() OVER (PARTITION BY query_id ORDER BY sparse DESC, vec_id) AS p FROM b),
fused AS (SELECT query_id, vec_id, round(1.0::DOUBLE / (60 + d) + 1.0::DOUBLE / (60 + p), 8) AS rrf FROM k)
SELECT query_id, vec_id, rrf, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, vec_id) AS rank FROM fused QUALIFY rank <= {TOP}""",
    "rerank_candidates": _LEX
    + f""", pool AS (SELECT response_id, id, score FROM {_top('lex', 'response_id', POOL)}),
w AS (SELECT response_id, list_distinct(regexp_extract_all(replace(lower(input), ',', ''), '[a-z0-9]+')) AS ws FROM q),
o AS (SELECT p.response_id, p.id, score, round(len(list_intersect(ws, list_distinct(regexp_extract_all(replace(lower(text), ',', ''), '[a-z0-9]+'))))::DOUBLE / len(ws), 6) AS overlap FROM pool p JOIN w USING (response_id) JOIN chunk1 c USING (id))
SELECT response_id, id, overlap, row_number() OVER (PARTITION BY response_id ORDER BY overlap DESC, score DESC, id) AS rank FROM o QUALIFY rank <= {TOP}""",
    "multi_query_merge": _LEX_ALL
    + f""", s AS (SELECT response_id, min(session_id) AS session_id FROM synthesis_responses GROUP BY ALL HAVING min(session_id) IS NOT NULL),
b AS (SELECT session_id, id, max(score) AS score FROM {_top('lex', 'response_id', TOP)} JOIN s USING (response_id) GROUP BY ALL)
SELECT session_id, id, score, rank FROM {_top('b', 'session_id', TOP)}""",
    "confidence_gate": _DENSE + "SELECT query_id, max(score) AS best, max(score) < 0.35 AS refuse FROM r WHERE rank <= 2 AND query_id <> vec_id GROUP BY query_id",
    "hit_at_k_mrr": _LEX_ALL
    + f""", cited AS (SELECT DISTINCT * FROM (SELECT response_id, unnest(citations) AS c FROM synthesis_responses) WHERE c IS NOT NULL),
h0 AS (SELECT response_id, rank, string_split(id, ':') AS p FROM {_top('lex', 'response_id', 100)}),
h AS (SELECT response_id, rank, unnest(list_transform(range(1, len(p) + 1), lambda i: array_to_string(p[1:i], ':'))) AS c FROM h0),
f AS (SELECT d.response_id, min(rank) AS rank FROM (SELECT DISTINCT response_id FROM cited) d LEFT JOIN cited c ON c.response_id = d.response_id LEFT JOIN h ON h.response_id = c.response_id AND h.c = c.c GROUP BY d.response_id)
SELECT count(*) AS n, """
    + ", ".join(f"round(avg(coalesce((rank <= {k})::INT, 0)), 6) AS hit_{k}" for k in (1, 5, 10, 100))
    + ", round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr FROM f",
    "context_header": _BASE
    + r"""SELECT id, CASE WHEN doc_type = 'contract' THEN 'Contract ' || coalesce(company, '') || ': ' || coalesce(title, '')
  WHEN doc_type = 'biomedical' THEN 'PMID ' || regexp_extract(id, '^PMID:(\d+)', 1) || ' — ' || coalesce(title, '') || ' — Section: ' || coalesce(item, '')
  ELSE coalesce(company, '') || ' (' || coalesce(ticker, '') || ') FY' || coalesce(CAST(fiscal_year AS VARCHAR), 'None') || ' 10-K — Item ' || coalesce(item, '') || ': ' || coalesce(title, '') END AS header FROM chunk1""",
    "corpus_inventory": "SELECT ticker, count(DISTINCT doc_id) AS n_docs, string_agg(DISTINCT CAST(fiscal_year AS VARCHAR), ', ' ORDER BY CAST(fiscal_year AS VARCHAR)) AS years FROM chunks WHERE ticker IS NOT NULL GROUP BY ticker",
}
