"""Queries on texts: ingestion, claims and their verification, citations, triage; and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import derive as dv
from ledgerloom.functions import text as tx
from ledgerloom.functions.once import once
from ledgerloom.operators import ingest as ig
from ledgerloom.operators.evaluate import prefixes
from ledgerloom.operators.facts import lines
from ledgerloom.plans.evaluation import sql_claims, sql_prefixes
from ledgerloom.tables import table


def section_pack(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ig.pack_sections(d, "doc_id", "text").select("doc_id", "no", F.length("section").alias("n_chars"), F.md5("section").alias("digest"))


def contract_chunks(spark, sf_dir):
    """Chunks of whole lines of the contract sections."""
    s = table(spark, sf_dir, "sections").where("doc_type = 'contract'").select("section_key", "text").distinct()
    return ig.pack_sections(s, "section_key", "text", ig.CHUNK_CHARS).select("section_key", "no", F.length("section").alias("n_chars"), F.md5("section").alias("digest"))


def chunk_documents(spark, sf_dir):
    """Chunks of the filing sections, tables kept whole or cut between rows."""
    s = table(spark, sf_dir, "sections").where("doc_type = '10-K'").select("section_key", "text").distinct()
    c = ig.chunk_sections(s, "section_key", "text")
    return c.select("section_key", "no", F.length("chunk").alias("n_chars"), "has_table", "table_continuation", F.array_join(F.transform("note_refs", lambda x: x.cast("string")), ",").alias("note_refs"))


def line_prefix_sum(spark, sf_dir):
    s = table(spark, sf_dir, "sections").select("section_key", "text").distinct()
    w = Window.partitionBy("section_key").orderBy("line_no")
    t = lines(s, "section_key").withColumn("upto", F.sum(F.length("line") + 1).over(w))
    return t.groupBy("section_key").agg(F.max("line_no").alias("n_lines"), F.max("upto").alias("n_chars"), F.sum("upto").alias("sum_of_prefixes"))


def subtables(spark, sf_dir):
    """Runs of table lines in the sections, a new one at every header of years."""
    s = table(spark, sf_dir, "sections").where("text like '%|%'").select("section_key", "text").distinct()
    w = Window.partitionBy("section_key").orderBy("line_no")
    t = lines(s, "section_key").where(F.col("line").contains("|"))
    t = t.withColumn("new", (F.col("line").rlike(r"\|\s*(?:19|20)\d\d\s*(?:\||$)") | (F.lag("line_no", 1, -9).over(w) != F.col("line_no") - 1)).cast("int"))
    t = t.withColumn("sub", F.sum("new").over(w))
    return t.groupBy("section_key", "sub").agg(F.min("line_no").alias("first_line"), F.count("*").alias("n_rows"), F.max(F.size(F.split("line", r"\|"))).alias("n_columns"))


def fiscal_year(spark, sf_dir):
    """The year of each filing: as given, else from its id, else from the filing date, of the year before up to June."""
    c = table(spark, sf_dir, "chunks").where("doc_type = '10-K'").select("doc_id", "fiscal_year", "filing_date").distinct()
    by_id = F.regexp_extract("doc_id", r"_(\d{4})_", 1).try_cast("int")
    d = F.substring("filing_date", 1, 4).try_cast("int") - F.when(F.substring("filing_date", 6, 2).try_cast("int") <= 6, 1).otherwise(0)
    return c.groupBy("doc_id").agg(F.max("fiscal_year").alias("given"), F.max(by_id).alias("by_id"), F.max(d).alias("by_date")).select("doc_id", "given", "by_id", "by_date", F.coalesce("given", "by_id", "by_date").alias("resolved"))


def stable_codes(spark, sf_dir):
    """A code for every company: its first word in capitals, numbered where several share it."""
    c = table(spark, sf_dir, "chunks").where("company is not null").select("company").distinct()
    base = F.upper(F.regexp_replace(F.get(F.split("company", " "), F.lit(0)), "[^A-Za-z0-9]", ""))
    w = Window.partitionBy("base").orderBy("company")
    return c.withColumn("base", base).withColumn("k", F.row_number().over(w)).select("company", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), F.col("k").cast("string"))).alias("code"))


def coverage_status(spark, sf_dir):
    """Of every filing: its sections, the largest of them, and whether a core item is missing."""
    s = table(spark, sf_dir, "sections").where("doc_type = '10-K'").select("section_key", "doc_id", "item", "text", "resolved_from").distinct()
    n = F.length(F.coalesce("text", F.lit("")))
    g = s.groupBy("doc_id").agg(
        F.count("*").alias("n_sections"), F.max_by("item", F.struct(n, F.col("section_key"))).alias("largest"), F.max(n).alias("largest_chars"), F.collect_set("item").alias("items"), F.count("resolved_from").alias("n_resolved")
    )
    missing = ~(F.array_contains("items", "7") & F.array_contains("items", "8"))
    status = F.when(missing, "missing core").when(F.col("n_resolved") > 0, "resolved").otherwise("clean")
    return g.select("doc_id", "n_sections", "largest", "largest_chars", "n_resolved", status.alias("status"))


def extract_claims(spark, sf_dir):
    """Every figure that an answer claims."""
    r = table(spark, sf_dir, "synthesis_responses").select("response_id", "answer").distinct()
    c = r.select("response_id", F.posexplode(tx.claims(F.col("answer"))).alias("no", "c"))
    return c.select("response_id", "no", "c.raw", F.round("c.value", 6).alias("value"), "c.is_pct")


def find_years(spark, sf_dir):
    r = table(spark, sf_dir, "synthesis_responses").select("response_id", "input").distinct()
    return r.select("response_id", F.array_join(F.transform(tx.years(F.col("input")), lambda y: y.cast("string")), ",").alias("years")).where("years != ''")


def claim_verify(spark, sf_dir):
    """Which answers claim only figures of the chunks that they cite, of the question, or derived from two of these; an
    answer without claims is verified."""
    r = table(spark, sf_dir, "synthesis_responses").select("response_id", "input", "answer", "citations").distinct().where("answer is not null")
    c = table(spark, sf_dir, "chunks").select("id", F.explode(F.array_distinct(tx.numbers(F.col("text")))).alias("n")).where("n is not null").distinct()
    keys = table(spark, sf_dir, "chunks").select("id", F.explode(prefixes(F.col("id"))).alias("cited")).distinct()
    cited = r.select("response_id", F.explode(F.array_distinct("citations")).alias("cited")).join(keys, "cited").select("response_id", "id").distinct()
    known = cited.join(c, "id").select("response_id", "n")
    asked = r.select("response_id", F.explode(tx.numbers(F.col("input"))).alias("n")).where("n is not null")
    numbers = known.unionByName(asked).groupBy("response_id").agg(F.array_sort(F.collect_set("n")).alias("known"))
    rows = r.select("response_id", tx.claims(F.col("answer")).alias("c")).join(numbers, "response_id", "left").withColumn("known", F.coalesce("known", F.array().cast("array<double>")))
    found = rows.select("response_id", "known", F.transform("c", lambda x: F.struct(x["value"].alias("value"), x["is_pct"].alias("is_pct"), tx.supported(x, F.col("known")).alias("found"))).alias("c"))
    found = once(found, "response_id", "known", n=F.size("c"), n_found=F.size(F.filter("c", lambda x: x["found"])), left=F.transform(F.filter("c", lambda x: ~x["found"]), lambda x: F.struct(x["value"].alias("value"), x["is_pct"].alias("is_pct"))))
    derived = found.select("response_id", "n", "n_found", F.when(F.size("left") > 0, dv.derived("left", "known")).otherwise(F.lit(0)).alias("n_derived"))
    every = F.col("n_found") + F.col("n_derived")
    return derived.select("response_id", F.col("n").alias("n_claims"), every.alias("n_found"), (F.col("n") == every).alias("verified"))


def legal_claims(spark, sf_dir):
    """Amounts, dates and quotations in the answers on contracts."""
    r = table(spark, sf_dir, "synthesis_responses").select("response_id", "answer").distinct().where("answer is not null")
    kinds = (("money", tx.MONEY, 0), ("date", tx.MONTH_DATE, 0), ("quote", tx.QUOTE, 1))
    every = [r.select("response_id", F.lit(k).alias("kind"), F.explode(F.regexp_extract_all("answer", F.lit(p), F.lit(g))).alias("raw")) for k, p, g in kinds]
    return every[0].unionByName(every[1]).unionByName(every[2]).groupBy("response_id", "kind").agg(F.count("*").alias("n"), F.countDistinct("raw").alias("n_distinct"))


def bio_claims(spark, sf_dir):
    """Doses, shares and test values that the abstracts' chunks state."""
    c = table(spark, sf_dir, "chunks").where("doc_type = 'biomedical'").select("id", "text").distinct()
    raw = c.select("id", F.explode(F.regexp_extract_all("text", F.lit(tx.CLINICAL), F.lit(0))).alias("raw")).select("id", F.trim("raw").alias("raw"))
    return raw.where((F.length("raw") <= 8) & ~F.col("raw").rlike(r"^(?:[1-5]|10|100|199[5-9]|20[01]\d|202[0-6])$")).groupBy("id").agg(F.countDistinct("raw").alias("n_claims"))


def defined_terms(spark, sf_dir):
    """Terms that the contracts define, with the words that follow; the first chunk's definition counts."""
    c = table(spark, sf_dir, "chunks").where("doc_type = 'contract'").select("id", "doc_id", "text").distinct()
    found = c.select("doc_id", "id", F.posexplode(F.regexp_extract_all("text", F.lit(r"\"([A-Z][^\"\n]{1,60})\" means ([^.\n]{1,700})"), F.lit(1))).alias("no", "term"), F.regexp_extract_all("text", F.lit(r"\"([A-Z][^\"\n]{1,60})\" means ([^.\n]{1,700})"), F.lit(2)).alias("d"))
    return found.select("doc_id", "term", "id", "no", F.get("d", F.col("no")).alias("definition")).groupBy("doc_id", "term").agg(F.min_by("definition", F.struct("id", "no")).alias("definition"), F.min("id").alias("chunk_id"))


def refusal_markers(spark, sf_dir):
    t = table(spark, sf_dir, "traces").select("trace_id", "model", "final_output").distinct()
    return t.groupBy("model").agg(F.count("*").alias("n"), F.count_if(tx.refuses(F.col("final_output"))).alias("n_refused"))


def intent_flags(spark, sf_dir):
    """What the questions ask for: change, comparison, share, reason, date, notice."""
    r = table(spark, sf_dir, "synthesis_responses").select("response_id", F.lower("input").alias("q")).distinct()
    flags = {"change": "change from|increase|decrease|grow", "share": "margin|percent|ratio|share", "reason": "why|warum|pourquoi|factors|driver", "date": "which date|when ", "notice": "notice|kündigungsfrist|préavis|preaviso"}
    return r.select("response_id", *(F.col("q").rlike(p).alias(n) for n, p in flags.items())).groupBy(*flags).agg(F.count("*").alias("n"))


def binary_decision(spark, sf_dir):
    r = table(spark, sf_dir, "synthesis_responses").select("response_id", "answer").distinct().where("answer is not null")
    word = F.lower(F.regexp_extract("answer", r"(?i)^\W*(yes|no|maybe)\b", 1))
    return r.groupBy(F.when(word != "", word).otherwise("none").alias("decision")).agg(F.count("*").alias("n"))


def tolerant_json(spark, sf_dir):
    """Payload fields of the steps, whether well formed or not, with the other names they go by."""
    t = table(spark, sf_dir, "trajectories").select("id", "agent_name", "payload").distinct()
    p = F.regexp_replace(F.regexp_replace("payload", r"^```(?:json)?|```$", ""), r",\s*([}\]])", "$1")
    f = lambda *names: F.coalesce(*[F.get_json_object(p, f"$.{n}") for n in names])
    t = t.select("agent_name", f("latency_ms", "latency").try_cast("double").alias("latency"), f("tokens", "n_tokens").try_cast("double").alias("tokens"), f("n_hits").try_cast("double").alias("hits"))
    return t.groupBy("agent_name").agg(F.count("latency").alias("n_latency"), F.round(F.sum("latency"), 3).alias("latency"), F.round(F.sum("tokens"), 3).alias("tokens"), F.round(F.sum("hits"), 3).alias("hits"))


def citation_prefix_join(spark, sf_dir):
    """Cited keys of the traces with the chunks that each stands for."""
    c = table(spark, sf_dir, "chunks").select("id").distinct().select(F.explode(prefixes(F.col("id"))).alias("cited"))
    n = c.groupBy("cited").agg(F.count("*").alias("n_chunks"))
    t = table(spark, sf_dir, "traces").select("trace_id", F.explode("citations").alias("cited")).where("cited is not null and cited != ''")
    return t.groupBy("cited").agg(F.countDistinct("trace_id").alias("n_traces")).join(n, "cited", "left").select("cited", "n_traces", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


def citation_validity(spark, sf_dir):
    """Citations of the traces that name a chunk of the corpus exactly, a part of it, or nothing."""
    ids = table(spark, sf_dir, "chunks").select(F.col("id").alias("cited")).distinct().withColumn("exact", F.lit(True))
    parts = table(spark, sf_dir, "chunks").select(F.explode(prefixes(F.col("id"))).alias("cited")).distinct().withColumn("part", F.lit(True))
    t = table(spark, sf_dir, "traces").select("trace_id", F.explode("citations").alias("cited")).where("cited is not null").distinct()
    kind = F.when(F.col("exact"), "exact").when(F.col("part"), "part").otherwise("invalid")
    return t.join(ids, "cited", "left").join(parts, "cited", "left").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("trace_id").alias("n_traces"))


def query_split(spark, sf_dir):
    """Questions that compare or join two things, cut in two."""
    r = table(spark, sf_dir, "synthesis_responses").select("response_id", "input").distinct()
    parts = F.split("input", r"(?i), and which | versus | vs\.? ")
    return r.where(F.size(parts) > 1).select("response_id", F.get(parts, F.lit(0)).alias("first"), F.get(parts, F.lit(1)).alias("second"))


def kwic_snippet(spark, sf_dir):
    """Up to 130 characters on either side of the first amount of each section."""
    s = table(spark, sf_dir, "sections").select("section_key", "text").distinct()
    amount = F.regexp_extract("text", r"\$[\d,.]+ (?:million|billion|thousand)", 0)
    at = F.instr("text", amount)
    return s.where(amount != "").select("section_key", amount.alias("amount"), F.md5(F.substring(F.col("text"), F.greatest(at - 130, F.lit(1)), F.lit(260))).alias("digest"))


def pairwise_derived(spark, sf_dir):
    """Whether the change that an answer claims follows from the two amounts that it names: no pairs beyond these are formed."""
    r = table(spark, sf_dir, "synthesis_responses").select("response_id", "answer").distinct().where("answer rlike 'from .* in fiscal year .* to .* in fiscal year '")
    c = tx.claims(F.col("answer"))
    money = F.filter(c, lambda x: ~x["is_pct"] & x["raw"].startswith("$"))
    pct = F.filter(c, lambda x: x["is_pct"])
    t = r.select("response_id", F.get(money, F.lit(0))["value"].alias("a"), F.get(money, F.lit(1))["value"].alias("b"), F.get(pct, F.lit(0))["value"].alias("claimed")).where("a is not null and b is not null and claimed is not null and a != 0")
    real = F.round(F.abs(F.col("b") - F.col("a")) / F.abs("a") * 100, 1)
    return t.select("response_id", F.round("claimed", 4).alias("claimed"), real.alias("derived"), tx.close(F.col("claimed"), real).alias("follows"))


_T = r"SELECT DISTINCT response_id, answer FROM synthesis_responses WHERE answer IS NOT NULL"
_JSON_FIX = r"regexp_replace(regexp_replace(payload, '^```(?:json)?|```$', '', 'g'), ',\s*([}\]])', '\1', 'g')"
_PACK = """
src AS ({source}),
l AS (SELECT k, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\r]')) AS ls FROM src WHERE text IS NOT NULL),
pack(k, i, no, body, ls) AS (
  SELECT k, 1, 1, ls[1], ls FROM l WHERE len(ls) > 0
  UNION ALL
  SELECT k, i + 1, CASE WHEN length(body) + 1 + length(ls[i + 1]) <= {limit} THEN no ELSE no + 1 END,
    CASE WHEN length(body) + 1 + length(ls[i + 1]) <= {limit} THEN body || chr(10) || ls[i + 1] ELSE ls[i + 1] END, ls FROM pack WHERE i < len(ls)),
packed AS (SELECT k, no, arg_max(body, i) AS body FROM pack GROUP BY k, no)
"""
_FIGURE = "list_transform(regexp_extract_all({x}, '\\d[\\d,]*(?:\\.\\d+)?'), lambda r: try_cast(replace(r, ',', '') AS DOUBLE))"
_RATIOS = "[" + ", ".join(f"{r!r}::DOUBLE" for r in tx.UNIT_RATIOS) + "]"
_CLOSE = "CASE WHEN {a} = 0 OR {b} = 0 THEN {a} = 0 AND {b} = 0 ELSE abs({a} - {b}) <= 0.005::DOUBLE * greatest(abs({a}), abs({b})) END"

QUERIES = {
    f.__name__: f
    for f in (
        section_pack, contract_chunks, chunk_documents, line_prefix_sum, subtables, fiscal_year, stable_codes, coverage_status, extract_claims, find_years, claim_verify, legal_claims, bio_claims, defined_terms,
        refusal_markers, intent_flags, binary_decision, tolerant_json, citation_prefix_join, citation_validity, query_split, kwic_snippet, pairwise_derived,
    )
}
SQL = {
    "section_pack": "WITH RECURSIVE " + _PACK.format(source="SELECT doc_id AS k, text FROM documents", limit=ig.SECTION_CHARS) + "SELECT k AS doc_id, no, length(body) AS n_chars, md5(body) AS digest FROM packed",
    "contract_chunks": "WITH RECURSIVE " + _PACK.format(source="SELECT DISTINCT section_key AS k, text FROM sections WHERE doc_type = 'contract'", limit=ig.CHUNK_CHARS) + "SELECT k AS section_key, no, length(body) AS n_chars, md5(body) AS digest FROM packed",
    "line_prefix_sum": """
WITH s AS (SELECT DISTINCT section_key, text FROM sections WHERE text IS NOT NULL), l AS (SELECT section_key, string_split(text, chr(10)) AS ls FROM s), n AS (SELECT section_key, ls, unnest(range(1, len(ls) + 1)) AS i FROM l),
p AS (SELECT section_key, i, sum(length(ls[i]) + 1) OVER (PARTITION BY section_key ORDER BY i) AS upto FROM n)
SELECT section_key, max(i) AS n_lines, CAST(max(upto) AS BIGINT) AS n_chars, CAST(sum(upto) AS BIGINT) AS sum_of_prefixes FROM p GROUP BY section_key""",
    "subtables": r"""
WITH s AS (SELECT DISTINCT section_key, text FROM sections WHERE text LIKE '%|%'), l AS (SELECT section_key, string_split(text, chr(10)) AS ls FROM s), n AS (SELECT section_key, ls, unnest(range(1, len(ls) + 1)) AS i FROM l),
t AS (SELECT section_key, i, ls[i] AS line FROM n WHERE contains(ls[i], '|')),
w AS (SELECT *, (regexp_matches(line, '\|\s*(?:19|20)\d\d\s*(?:\||$)') OR coalesce(lag(i) OVER (PARTITION BY section_key ORDER BY i), -9) <> i - 1)::INT AS new FROM t),
g AS (SELECT *, sum(new) OVER (PARTITION BY section_key ORDER BY i) AS sub FROM w)
SELECT section_key, CAST(sub AS BIGINT) AS sub, min(i) AS first_line, count(*) AS n_rows, max(len(string_split(line, '|'))) AS n_columns FROM g GROUP BY section_key, sub""",
    "fiscal_year": r"""
WITH c AS (SELECT DISTINCT doc_id, fiscal_year, filing_date FROM chunks WHERE doc_type = '10-K'),
g AS (SELECT doc_id, max(fiscal_year) AS given, max(try_cast(regexp_extract(doc_id, '_(\d{4})_', 1) AS INT)) AS by_id, max(try_cast(filing_date[1:4] AS INT) - CASE WHEN try_cast(filing_date[6:7] AS INT) <= 6 THEN 1 ELSE 0 END) AS by_date FROM c GROUP BY doc_id)
SELECT *, coalesce(given, by_id, by_date) AS resolved FROM g""",
    "stable_codes": "WITH c AS (SELECT DISTINCT company, upper(regexp_replace(string_split(company, ' ')[1], '[^A-Za-z0-9]', '', 'g')) AS base FROM chunks WHERE company IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY company) AS k FROM c) SELECT company, CASE WHEN k = 1 THEN base ELSE base || '-' || k END AS code FROM k",
    "coverage_status": """
WITH s AS (SELECT DISTINCT section_key, doc_id, item, text, resolved_from FROM sections WHERE doc_type = '10-K'),
g AS (SELECT doc_id, count(*) AS n_sections, arg_max(item, struct_pack(a := length(coalesce(text, '')), b := section_key)) AS largest, max(length(coalesce(text, ''))) AS largest_chars, bool_or(item = '7') AND bool_or(item = '8') AS core, count(resolved_from) AS n_resolved FROM s GROUP BY doc_id)
SELECT doc_id, n_sections, largest, largest_chars, n_resolved, CASE WHEN NOT coalesce(core, false) THEN 'missing core' WHEN n_resolved > 0 THEN 'resolved' ELSE 'clean' END AS status FROM g""",
    "extract_claims": f"WITH r AS (SELECT DISTINCT response_id, answer FROM synthesis_responses), c AS (SELECT response_id, {sql_claims('answer')} AS cs FROM r), n AS (SELECT response_id, cs, unnest(range(1, len(cs) + 1)) AS i FROM c) SELECT response_id, CAST(i - 1 AS INT) AS no, cs[i].raw AS raw, round(cs[i].value, 6) AS value, cs[i].is_pct AS is_pct FROM n",
    "find_years": r"SELECT response_id, array_to_string(list_concat(list_transform(regexp_extract_all(input, '\b(?:19[6-9]\d|20[0-4]\d)\b'), lambda y: CAST(y AS INT)), list_transform(regexp_extract_all(input, '(?i)\bFY\s?''?(\d\d)\b', 1), lambda y: CAST(y AS INT) + CASE WHEN CAST(y AS INT) < 70 THEN 2000 ELSE 1900 END)), ',') AS years FROM (SELECT DISTINCT response_id, input FROM synthesis_responses) WHERE years <> ''",
    "claim_verify": f"""
WITH r AS (SELECT DISTINCT response_id, input, answer, citations FROM synthesis_responses WHERE answer IS NOT NULL),
k AS (SELECT DISTINCT id, unnest({sql_prefixes("id")}) AS cited FROM chunks),
c AS (SELECT DISTINCT id, unnest({_FIGURE.format(x="text")}) AS n FROM chunks),
w AS (SELECT DISTINCT response_id, id FROM (SELECT response_id, unnest(list_distinct(citations)) AS cited FROM r) JOIN k USING (cited)),
asked AS (SELECT DISTINCT response_id, unnest({_FIGURE.format(x="coalesce(input, '')")}) AS n FROM r),
num AS (SELECT DISTINCT response_id, n FROM (SELECT response_id, n FROM w JOIN c USING (id) UNION ALL SELECT * FROM asked) WHERE n IS NOT NULL),
claims AS (SELECT response_id, unnest({sql_claims("answer")}) AS c, unnest(range(1, len({sql_claims("answer")}) + 1)) AS i FROM r),
plain AS (SELECT DISTINCT claims.response_id, i FROM claims JOIN num USING (response_id) WHERE {_CLOSE.format(a="n", b="c.value")} OR NOT c.is_pct AND len(list_filter({_RATIOS}, lambda r: {_CLOSE.format(a="n", b="(c.value / r)")})) > 0),
rest AS (SELECT * FROM claims WHERE NOT EXISTS (SELECT 1 FROM plain p WHERE p.response_id = claims.response_id AND p.i = claims.i)),
top AS (SELECT response_id, n FROM num WHERE abs(n) BETWEEN 0.01 AND 1e12 QUALIFY row_number() OVER (PARTITION BY response_id ORDER BY abs(n) DESC, n) <= {dv.MOST}),
pr AS (SELECT a.response_id, abs(a.n - b.n) AS d, a.n + b.n AS s, least(abs(a.n), abs(b.n)) AS mn, greatest(abs(a.n), abs(b.n)) AS mx FROM top a JOIN top b ON a.response_id = b.response_id AND a.n < b.n WHERE a.response_id IN (SELECT response_id FROM rest)),
v AS (SELECT response_id, unnest([d, s, d / mn * 100, round(d / mn * 100, 1), round(d / mn * 100, 2), d / mx * 100, round(d / mx * 100, 1), round(d / mx * 100, 2)]) AS n FROM pr WHERE mx / mn <= 25
  UNION ALL SELECT response_id, unnest([mn / mx * 100, round(mn / mx * 100, 1), round(mn / mx * 100, 2), mn / mx, round(mn / mx, 3)]) FROM pr WHERE mx / mn <= 200),
der AS (SELECT DISTINCT rest.response_id, i FROM rest JOIN (SELECT DISTINCT * FROM v) USING (response_id) WHERE {_CLOSE.format(a="n", b="c.value")} OR NOT c.is_pct AND len(list_filter({_RATIOS}, lambda r: {_CLOSE.format(a="n", b="(c.value / r)")})) > 0),
f AS (SELECT response_id, count(*) AS n FROM (SELECT * FROM plain UNION ALL SELECT * FROM der) GROUP BY response_id),
t AS (SELECT response_id, CAST(len({sql_claims("answer")}) AS INT) AS n_claims FROM r)
SELECT response_id, n_claims, CAST(coalesce(f.n, 0) AS INT) AS n_found, n_claims = coalesce(f.n, 0) AS verified FROM t LEFT JOIN f USING (response_id)""",
    "legal_claims": f"WITH r AS ({_T}), e AS (SELECT response_id, 'money' AS kind, unnest(regexp_extract_all(answer, '{tx.MONEY}')) AS raw FROM r UNION ALL SELECT response_id, 'date', unnest(regexp_extract_all(answer, '{tx.MONTH_DATE}')) FROM r UNION ALL SELECT response_id, 'quote', unnest(regexp_extract_all(answer, '{tx.QUOTE}', 1)) FROM r) SELECT response_id, kind, count(*) AS n, count(DISTINCT raw) AS n_distinct FROM e GROUP BY ALL",
    "bio_claims": f"WITH c AS (SELECT DISTINCT id, text FROM chunks WHERE doc_type = 'biomedical'), e AS (SELECT id, trim(unnest(regexp_extract_all(text, '{tx.CLINICAL}'))) AS raw FROM c) SELECT id, count(DISTINCT raw) AS n_claims FROM e WHERE length(raw) <= 8 AND NOT regexp_full_match(raw, '[1-5]|10|100|199[5-9]|20[01]\\d|202[0-6]') GROUP BY id",
    "defined_terms": r"""
WITH c AS (SELECT DISTINCT id, doc_id, text FROM chunks WHERE doc_type = 'contract'),
m AS (SELECT doc_id, id, regexp_extract_all(text, '"([A-Z][^"\n]{1,60})" means ([^.\n]{1,700})', 1) AS ts, regexp_extract_all(text, '"([A-Z][^"\n]{1,60})" means ([^.\n]{1,700})', 2) AS ds FROM c),
e AS (SELECT doc_id, id, unnest(range(1, len(ts) + 1)) AS i, ts, ds FROM m)
SELECT doc_id, ts[i] AS term, arg_min(ds[i], struct_pack(a := id, b := i)) AS definition, min(id) AS chunk_id FROM e GROUP BY doc_id, ts[i]""",
    "refusal_markers": "SELECT model, count(*) AS n, count(*) FILTER (WHERE " + " OR ".join(f"contains(lower(final_output), '{m}')" for m in tx.REFUSAL_MARKERS) + ") AS n_refused FROM (SELECT DISTINCT trace_id, model, final_output FROM traces) GROUP BY model",
    "intent_flags": "SELECT regexp_matches(q, 'change from|increase|decrease|grow') AS change, regexp_matches(q, 'margin|percent|ratio|share') AS share, regexp_matches(q, 'why|warum|pourquoi|factors|driver') AS reason, regexp_matches(q, 'which date|when ') AS date, regexp_matches(q, 'notice|kündigungsfrist|préavis|preaviso') AS notice, count(*) AS n FROM (SELECT DISTINCT response_id, lower(input) AS q FROM synthesis_responses) GROUP BY ALL",
    "binary_decision": rf"SELECT CASE WHEN w <> '' THEN w ELSE 'none' END AS decision, count(*) AS n FROM (SELECT lower(regexp_extract(answer, '(?i)^[^A-Za-z0-9_]*(yes|no|maybe)\b', 1)) AS w FROM ({_T})) GROUP BY 1",
    "tolerant_json": f"""
WITH t AS (SELECT DISTINCT id, agent_name, payload FROM trajectories), p AS (SELECT agent_name, {_JSON_FIX} AS p FROM t), v AS (SELECT agent_name, CASE WHEN json_valid(p) THEN p END AS p FROM p)
SELECT agent_name, count(try_cast(coalesce(p->>'$.latency_ms', p->>'$.latency') AS DOUBLE)) AS n_latency, round(sum(try_cast(coalesce(p->>'$.latency_ms', p->>'$.latency') AS DOUBLE)), 3) AS latency,
  round(sum(try_cast(coalesce(p->>'$.tokens', p->>'$.n_tokens') AS DOUBLE)), 3) AS tokens, round(sum(try_cast(p->>'$.n_hits' AS DOUBLE)), 3) AS hits FROM v GROUP BY agent_name""",
    "citation_prefix_join": f"WITH c AS (SELECT unnest({sql_prefixes('id')}) AS cited FROM (SELECT DISTINCT id FROM chunks)), n AS (SELECT cited, count(*) AS n_chunks FROM c GROUP BY cited), t AS (SELECT trace_id, unnest(citations) AS cited FROM traces) SELECT t.cited, count(DISTINCT trace_id) AS n_traces, coalesce(max(n_chunks), 0) AS n_chunks FROM t LEFT JOIN n USING (cited) WHERE t.cited IS NOT NULL AND t.cited <> '' GROUP BY t.cited",
    "citation_validity": f"WITH i AS (SELECT DISTINCT id FROM chunks), p AS (SELECT DISTINCT unnest({sql_prefixes('id')}) AS c FROM i), t AS (SELECT DISTINCT * FROM (SELECT trace_id, unnest(citations) AS c FROM traces) WHERE c IS NOT NULL) SELECT CASE WHEN c IN (SELECT id FROM i) THEN 'exact' WHEN c IN (SELECT c FROM p) THEN 'part' ELSE 'invalid' END AS kind, count(*) AS n, count(DISTINCT trace_id) AS n_traces FROM t GROUP BY 1",
    "query_split": r"SELECT response_id, p[1] AS first, p[2] AS second FROM (SELECT response_id, regexp_split_to_array(input, '(?i), and which | versus | vs\.? ') AS p FROM (SELECT DISTINCT response_id, input FROM synthesis_responses)) WHERE len(p) > 1",
    "kwic_snippet": r"WITH s AS (SELECT section_key, text, regexp_extract(text, '\$[\d,.]+ (?:million|billion|thousand)') AS amount FROM (SELECT DISTINCT section_key, text FROM sections)) SELECT section_key, amount, md5(substring(text, greatest(instr(text, amount) - 130, 1), 260)) AS digest FROM s WHERE amount <> ''",
    "pairwise_derived": f"""
WITH r AS (SELECT response_id, {sql_claims("answer")} AS c FROM ({_T}) WHERE regexp_matches(answer, 'from .* in fiscal year .* to .* in fiscal year ')),
t AS (SELECT response_id, list_filter(c, lambda x: NOT x.is_pct AND starts_with(x.raw, '$')) AS m, list_filter(c, lambda x: x.is_pct) AS p FROM r),
v AS (SELECT response_id, m[1].value AS a, m[2].value AS b, p[1].value AS claimed FROM t),
d AS (SELECT response_id, claimed, round(abs(b - a) / abs(a) * 100, 1) AS derived FROM v WHERE a IS NOT NULL AND b IS NOT NULL AND claimed IS NOT NULL AND a <> 0)
SELECT response_id, round(claimed, 4) AS claimed, derived, {_CLOSE.format(a="claimed", b="derived")} AS follows FROM d""",
}
