"""Queries that build and check cases from the corpus, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import text as tx
from ledgerloom.operators import facts as fx
from ledgerloom.operators import lexical
from ledgerloom.operators.evaluate import prefixes
from ledgerloom.operators.graph import nodes
from ledgerloom.plans.evaluation import sql_claims, sql_prefixes
from ledgerloom.plans.facts import _FACTS, _RATIO, _facts
from ledgerloom.plans.graph import _EDGES
from ledgerloom.tables import table

#: Words of the longest alias that is looked for.
ALIAS_WORDS = 4
#: Stands for a filing without an id; comes after all others.
NO_DOC = "\U0010ffff"


def golden_cases(spark, sf_dir):
    """Questions and answers on growth and margins, made from the facts."""
    f = _facts(spark, sf_dir)
    figure = lambda c, d: F.col(c).cast(f"decimal(20,{d})").cast("string")
    growth = fx.growth(f).select(
        F.concat(F.lit("What was the annual growth of "), "metric", F.lit(" of "), "ticker", F.lit(" from "), F.col("y0").cast("string"), F.lit(" to "), F.col("y1").cast("string"), F.lit("?")).alias("input"),
        F.concat(figure("cagr_pct", 4), F.lit("%")).alias("answer"),
    )
    margin = fx.margins(f).select(
        F.concat(F.lit("What share of revenue was "), "metric", F.lit(" of "), "ticker", F.lit(" in "), F.col("fiscal_year").cast("string"), F.lit("?")).alias("input"), F.concat(figure("ratio", 4), F.lit("%")).alias("answer")
    )
    return growth.unionByName(margin)


def first_match_per_category(spark, sf_dir):
    """The first contract that speaks of each clause."""
    c = table(spark, sf_dir, "chunks").where("doc_type = 'contract'").select("doc_id", "id", F.regexp_extract("text", r"The clause on ([a-z-]+(?: [a-z-]+)*) survives", 1).alias("clause")).where("clause != ''")
    return c.groupBy("clause").agg(F.min(F.struct("doc_id", "id")).alias("f"), F.countDistinct("doc_id").alias("n_contracts")).select("clause", "f.doc_id", "f.id", "n_contracts")


def _aliases(spark, sf_dir):
    """(alias, ticker): the names, first words and tickers of companies that stand for one of them."""
    c = table(spark, sf_dir, "chunks").where("company is not null and ticker is not null").select("company", "ticker").distinct()
    name = F.trim(F.regexp_replace(F.lower("company"), "[^a-z0-9]+", " "))
    first = F.get(F.split(name, " "), F.lit(0))
    each = F.explode(F.array_distinct(F.array_compact(F.array(name, F.lower("ticker"), F.when((F.length(first) >= 4) & ~first.isin("home", "bank"), first)))))
    return c.select("ticker", each.alias("alias")).groupBy("alias").agg(F.min("ticker").alias("ticker"), F.countDistinct("ticker").alias("n")).where("n = 1").select("alias", "ticker")


def question_companies(spark, sf_dir):
    """(response_id, ticker) of the companies that a question names: runs of its words are joined with the aliases, and the longest of those that overlap counts."""
    q = table(spark, sf_dir, "synthesis_responses").select("response_id", F.split(F.trim(F.regexp_replace(F.lower("input"), "[^a-z0-9]+", " ")), " ").alias("w")).where("w is not null").distinct()
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.transform(F.sequence(F.lit(1), F.lit(ALIAS_WORDS)), lambda n: F.struct(i.alias("at"), n.alias("n"), F.array_join(F.slice("w", i, n), " ").alias("alias")))))
    runs = q.select("response_id", F.size("w").alias("words"), F.explode(runs).alias("r")).select("response_id", "words", "r.*").where("at + n - 1 <= words")
    hits = runs.join(_aliases(spark, sf_dir), "alias").select("response_id", "at", "n", "ticker")
    # A run that lies inside a longer one of the same question is used up by it.
    later = Window.partitionBy("response_id").orderBy(F.desc("n"), "at").rowsBetween(Window.unboundedPreceding, -1)
    taken = hits.withColumn("before", F.collect_list(F.struct("at", "n")).over(later))
    free = ~F.exists("before", lambda b: (b["at"] < F.col("at") + F.col("n")) & (F.col("at") < b["at"] + b["n"]) & (b["n"] > F.col("n")))
    return taken.where(free).select("response_id", "ticker").distinct()


def company_scope(spark, sf_dir):
    return question_companies(spark, sf_dir).groupBy("ticker").agg(F.countDistinct("response_id").alias("n_questions"))


def community_search(spark, sf_dir):
    """The two filings whose titles and items share most words with each distinct question."""
    words = lambda t: F.array_distinct(F.flatten(F.collect_set(tx.tokenize(t)))).alias("words")
    head = table(spark, sf_dir, "chunks").where("ticker is not null").select(F.coalesce("doc_id", F.lit(NO_DOC)).alias("doc_id"), F.concat_ws(" ", "company", "ticker", F.col("fiscal_year").cast("string"), "title").alias("head")).distinct()
    prof = lexical.indexed(head.groupBy("doc_id").agg(words(F.col("head"))), "doc_id", "words")
    q = table(spark, sf_dir, "golden_set_v1").select("id", "input").distinct().groupBy("id").agg(words(F.col("input")))
    best = lexical.search(prof, q, "id", "words", 2, flat=True)
    return best.select("id", F.nullif("doc_id", F.lit(NO_DOC)).alias("doc_id"), F.col("score").cast("bigint").alias("shared"), F.col("rank").alias("place"))


def audit_verdict(spark, sf_dir):
    """Whether the figures of each expected answer stand in a chunk that the case cites."""
    g = table(spark, sf_dir, "golden_set_v1").select("id", F.col("expected.answer").alias("a"), F.col("expected.citations").alias("c")).distinct().where("a is not null")
    raws = F.array_distinct(F.transform(tx.claims(F.col("a")), lambda x: F.regexp_replace(x["raw"], r"^\$\s?|\s?%$| (?:million|billion|thousand|trillion)$", "")))
    want = g.select("id", F.explode_outer(raws).alias("figure"))
    # Only keys of chunks travel below the cited prefixes; a text meets the cases once they are known.
    chunk = table(spark, sf_dir, "chunks").select(F.col("id").alias("chunk"), F.xxhash64("text").alias("body"), "text")
    cited = g.select("id", F.explode(F.array_distinct("c")).alias("cite"))
    keys = chunk.select("chunk", "body", F.explode(prefixes(F.col("chunk"))).alias("cite")).distinct()
    near = cited.join(keys, "cite").select("id", "body").distinct()
    texts = chunk.groupBy("body").agg(F.first("text").alias("text"))
    hit = want.where("figure is not null").join(near, "id").join(texts, "body").where(F.contains(F.col("text"), F.col("figure"))).select("id", "figure").distinct().withColumn("hit", F.lit(1))
    per = want.join(hit, ["id", "figure"], "left").groupBy("id").agg(F.count("figure").alias("n"), F.count("hit").alias("n_hit"))
    verdict = F.when(F.col("n") == 0, "no figures").when(F.col("n_hit") == F.col("n"), "all found").when(F.col("n_hit") > 0, "some found").otherwise("none found")
    return per.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n_cases"))


def node_labels(spark, sf_dir):
    """Graph nodes with a label for people to read."""
    n = nodes(_facts(spark, sf_dir))
    body = F.regexp_extract("id", r"^[a-z]+:(.*)$", 1)
    shown = F.when(F.col("label") == "FinancialMetric", F.initcap(F.replace(body, F.lit("_"), F.lit(" ")))).when(F.col("label") == "Filing", F.concat(F.lit("FY"), F.regexp_extract("id", r"(\d+)$", 1), F.lit(" "), F.regexp_extract("id", r"^filing:([^:]+)", 1))).otherwise(body)
    return n.select("id", "label", shown.alias("shown")).where("label != 'FinancialMetric'")


def term_lookup(spark, sf_dir):
    """Questions on a defined term with the number of contracts that define it, whatever its case."""
    q = table(spark, sf_dir, "synthesis_responses").select("response_id", F.lower(F.regexp_extract("input", r"the term '([^']+)' mean", 1)).alias("term")).distinct().where("term != ''")
    t = table(spark, sf_dir, "chunks").where("doc_type = 'contract'").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\"([A-Z][^\"\n]{1,60})\" means"), F.lit(1))).alias("t"))
    d = t.select(F.lower("t").alias("term"), "doc_id").groupBy("term").agg(F.countDistinct("doc_id").alias("n_contracts"))
    return q.groupBy("term").agg(F.count("*").alias("n_questions")).join(d, "term", "left").select("term", "n_questions", F.coalesce("n_contracts", F.lit(0)).alias("n_contracts"))


#: Tables up to companies(response_id, ticker).
COMPANIES = f"""
c AS (SELECT DISTINCT ticker, trim(regexp_replace(lower(company), '[^a-z0-9]+', ' ', 'g')) AS name FROM chunks WHERE company IS NOT NULL AND ticker IS NOT NULL),
a0 AS (SELECT ticker, name AS alias FROM c UNION SELECT ticker, lower(ticker) FROM c UNION SELECT ticker, string_split(name, ' ')[1] FROM c WHERE length(string_split(name, ' ')[1]) >= 4 AND string_split(name, ' ')[1] NOT IN ('home', 'bank')),
a AS (SELECT alias, min(ticker) AS ticker FROM a0 GROUP BY alias HAVING count(DISTINCT ticker) = 1),
q AS (SELECT DISTINCT response_id, string_split(trim(regexp_replace(lower(input), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM synthesis_responses WHERE input IS NOT NULL),
i AS (SELECT response_id, w, unnest(range(1, len(w) + 1)) AS pos FROM q),
r AS (SELECT response_id, pos, n, array_to_string(w[pos:pos + n - 1], ' ') AS alias FROM i, range(1, {ALIAS_WORDS + 1}) t(n) WHERE pos + n - 1 <= len(w)),
h AS (SELECT response_id, pos, n, ticker FROM r JOIN a USING (alias)),
companies AS (SELECT DISTINCT response_id, ticker FROM h x WHERE NOT EXISTS (SELECT 1 FROM h y WHERE y.response_id = x.response_id AND y.n > x.n AND y.pos < x.pos + x.n AND x.pos < y.pos + y.n))
"""
_TOKENS = "regexp_extract_all(replace(lower({x}), ',', ''), '[a-z0-9]+')"
QUERIES = {f.__name__: f for f in (golden_cases, first_match_per_category, company_scope, community_search, audit_verdict, node_labels, term_lookup)}
SQL = {
    "golden_cases": _FACTS
    + _RATIO
    + """, g AS (SELECT ticker, metric, min(fiscal_year) AS y0, max(fiscal_year) AS y1, arg_min(usd_m, fiscal_year) AS v0, arg_max(usd_m, fiscal_year) AS v1 FROM facts GROUP BY ALL)
SELECT 'What was the annual growth of ' || metric || ' of ' || ticker || ' from ' || y0 || ' to ' || y1 || '?' AS input, CAST(CAST(round((pow(v1 / v0, 1.0::DOUBLE / (y1 - y0)) - 1) * 100, 4) AS DECIMAL(20,4)) AS VARCHAR) || '%' AS answer FROM g WHERE v0 > 0 AND v1 > 0 AND y1 > y0
UNION ALL SELECT 'What share of revenue was ' || metric || ' of ' || ticker || ' in ' || fiscal_year || '?', CAST(CAST(ratio AS DECIMAL(20,4)) AS VARCHAR) || '%' FROM margins""",
    "first_match_per_category": "WITH c AS (SELECT doc_id, id, regexp_extract(text, 'The clause on ([a-z-]+(?: [a-z-]+)*) survives', 1) AS clause FROM chunks WHERE doc_type = 'contract') SELECT clause, min(struct_pack(doc_id := doc_id, id := id)).doc_id AS doc_id, min(struct_pack(doc_id := doc_id, id := id)).id AS id, count(DISTINCT doc_id) AS n_contracts FROM c WHERE clause <> '' GROUP BY clause",
    "company_scope": "WITH " + COMPANIES + "SELECT ticker, count(*) AS n_questions FROM companies GROUP BY ticker",
    "community_search": f"WITH p AS (SELECT DISTINCT doc_id, unnest({_TOKENS.format(x='''concat_ws(' ', company, ticker, CAST(fiscal_year AS VARCHAR), title)''')}) AS w FROM chunks WHERE ticker IS NOT NULL), q AS (SELECT DISTINCT id, unnest({_TOKENS.format(x='input')}) AS w FROM golden_set_v1), s AS (SELECT id, doc_id, count(*) AS shared FROM q JOIN p USING (w) GROUP BY ALL) SELECT id, doc_id, shared, row_number() OVER (PARTITION BY id ORDER BY shared DESC, doc_id) AS place FROM s QUALIFY place <= 2",
    "audit_verdict": f"""
WITH g AS (SELECT DISTINCT id, expected.answer AS a, expected.citations AS c FROM golden_set_v1 WHERE expected.answer IS NOT NULL),
f AS (SELECT id, list_distinct(list_transform({sql_claims("a")}, lambda x: regexp_replace(x.raw, '^\\$\\s?|\\s?%$| (?:million|billion|thousand|trillion)$', '', 'g'))) AS fs FROM g),
w AS (SELECT id, unnest(fs) AS figure FROM f),
k AS (SELECT DISTINCT unnest({sql_prefixes("id")}) AS cite, text FROM chunks),
t AS (SELECT id, cite, text FROM (SELECT id, unnest(list_distinct(c)) AS cite FROM g) JOIN k USING (cite)),
h AS (SELECT DISTINCT w.id, w.figure FROM w JOIN t USING (id) WHERE contains(t.text, w.figure)),
p AS (SELECT f.id, len(fs) AS n, (SELECT count(*) FROM h WHERE h.id = f.id) AS n_hit FROM f)
SELECT CASE WHEN n = 0 THEN 'no figures' WHEN n_hit = n THEN 'all found' WHEN n_hit > 0 THEN 'some found' ELSE 'none found' END AS verdict, count(*) AS n_cases FROM p GROUP BY 1""",
    "node_labels": _EDGES + r"""SELECT DISTINCT * FROM (SELECT c AS id, 'Company' AS label, regexp_extract(c, '^[a-z]+:(.*)$', 1) AS shown FROM i UNION ALL SELECT f, 'Filing', 'FY' || regexp_extract(f, '(\d+)$', 1) || ' ' || regexp_extract(f, '^filing:([^:]+)', 1) FROM i
UNION ALL SELECT v, 'MetricValue', regexp_extract(v, '^[a-z]+:(.*)$', 1) FROM i UNION ALL SELECT k, 'Chunk', regexp_extract(k, '^[a-z]+:(.*)$', 1) FROM i)""",
    "term_lookup": r"""WITH q AS (SELECT DISTINCT response_id, lower(regexp_extract(input, 'the term ''([^'']+)'' mean', 1)) AS term FROM synthesis_responses),
d AS (SELECT lower(t) AS term, count(DISTINCT doc_id) AS n_contracts FROM (SELECT doc_id, unnest(regexp_extract_all(text, '"([A-Z][^"\n]{1,60})" means', 1)) AS t FROM chunks WHERE doc_type = 'contract') GROUP BY 1)
SELECT term, count(*) AS n_questions, coalesce(max(n_contracts), 0) AS n_contracts FROM q LEFT JOIN d USING (term) WHERE term <> '' GROUP BY term""",
}
