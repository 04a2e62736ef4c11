"""Queries on answers: scores of turns, arithmetic, evidence, runs against their baseline, scopes; and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import text as tx
from ledgerloom.functions.derive import evaluated
from ledgerloom.operators import facts as fx
from ledgerloom.operators.evaluate import graded
from ledgerloom.plans.cases import COMPANIES, question_companies
from ledgerloom.plans.evaluation import GRADED
from ledgerloom.plans.facts import _FACTS, _METRIC_ROWS, _facts
from ledgerloom.tables import table

# Fixed values. Figures of an answer, questions that ask for percentages, and words for a part of a year.
FIGURE = r"-?\$?\s?([\d,]+(?:\.\d+)?)\s?(%|million|billion|thousand)?"
PERCENT = r"(?i)\bpercent(age)?\b|\brate\b|%\s"
PERIOD = r"(?i)\bquarter(?:ly)?\b|\bq[1-4]\b|\b(?:first|second|third|fourth) quarter\b|\b(?:three|six|nine) months\b|\bhalf[- ]?year\b"
TURN_TOLERANCE, SCALES = 0.01, {"thousand": 1e3, "million": 1e6, "billion": 1e9}
LATEST = 25


def figures(text):
    """array<struct<value, is_pct>> of the figures of an answer, signed and scaled."""
    all_, num, unit = (F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(FIGURE), F.lit(g)) for g in (0, 1, 2))
    scale = lambda u: F.when(u == "thousand", 1e3).when(u == "million", 1e6).when(u == "billion", 1e9).otherwise(1.0)
    each = F.transform(F.arrays_zip(all_.alias("raw"), num.alias("num"), unit.alias("unit")), lambda x: F.struct(
        (F.replace(x["num"], F.lit(","), F.lit("")).try_cast("double") * scale(x["unit"]) * F.when(F.startswith(F.trim(x["raw"]), F.lit("-")), -1.0).otherwise(1.0)).alias("value"), (x["unit"] == "%").alias("is_pct")))
    return F.filter(each, lambda x: x["value"].isNotNull())


def turn_score(spark, sf_dir):
    """Whether an answer to a case with a figure gives it, in percent where that is asked, else in any usual unit."""
    g = table(spark, sf_dir, "golden_set_v1").select(F.col("id").alias("case_id"), F.col("input").alias("question"), F.get(figures(F.col("expected.answer")), F.lit(0)).alias("gold")).distinct().where("gold is not null")
    g = g.groupBy("case_id").agg(F.min(F.struct("question", "gold")).alias("g")).select("case_id", "g.*")
    t = table(spark, sf_dir, "traces").select("trace_id", "case_id", "final_output").distinct()
    value = F.when(F.col("gold.is_pct"), F.col("gold.value") / 100).otherwise(F.col("gold.value"))
    j = t.join(g, "case_id").select("trace_id", "final_output", F.coalesce("question", F.lit("")).rlike(PERCENT).alias("percent"), value.alias("gold"), figures(F.col("final_output")).alias("f"))
    near = lambda a, b: (a == b) | (F.abs(a - b) <= TURN_TOLERANCE * F.greatest(F.abs(a), F.abs(b)))
    same = lambda a, b: near(a, b) | near(F.abs(a), F.abs(b))
    units = F.array(*map(F.lit, (1.0, 1e3, 1e6, 1e9)))
    hit = F.exists("f", lambda x: F.when(F.col("percent") | x["is_pct"], same(x["value"], F.col("gold") * 100)).otherwise(F.exists(units, lambda r: same(x["value"], F.col("gold") * r))))
    why = F.when(hit, "match").when(F.trim(F.coalesce("final_output", F.lit(""))) == "", "refused").otherwise("wrong-number")
    return j.select("trace_id", hit.alias("correct"), why.alias("why"))


def math_results(spark, sf_dir):
    """Changes between neighbouring years as expressions and their values, shares of at most one as percentages."""
    w = Window.partitionBy("ticker", "metric").orderBy("fiscal_year")
    f = _facts(spark, sf_dir).withColumn("prev", F.lag("usd_m").over(w)).where("prev is not null and prev != 0")
    text = lambda c: F.col(c).cast("decimal(24,6)").cast("string")
    e = f.select("ticker", "metric", "fiscal_year", F.concat(F.lit("("), text("usd_m"), F.lit(" - ("), text("prev"), F.lit(")) / ("), text("prev"), F.lit(")")).alias("expression")).withColumn("value", evaluated("expression"))
    share = (F.abs("value") > 0) & (F.abs("value") <= 1)
    return e.where("value is not null").select("ticker", "metric", "fiscal_year", "expression", F.round(F.when(share, F.col("value") * 100).otherwise(F.col("value")), 4).alias("result"))


def sub_periods(spark, sf_dir):
    """Documents of each source that speak of a part of a year."""
    d = table(spark, sf_dir, "documents").select("source", "text").where("text is not null")
    return d.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("text").rlike(PERIOD)).alias("n_periods"))


def metric_canon(spark, sf_dir):
    """Row labels by their metric: the one of the label itself, else of the longest phrase in it, else the label in title case."""
    c = table(spark, sf_dir, "chunks").where("text like '%|%'")
    label = F.trim(F.get(F.split("line", r"\|"), F.lit(0)))
    rows = fx.lines(c, "id").where(F.col("line").contains("|")).groupBy(label.alias("label")).agg(F.count("*").alias("n")).where("label != ''")
    low = F.lower("label")
    found = F.initcap("label")
    for phrase, metric in sorted(fx.METRICS, key=lambda x: len(x[0])):
        found = F.when(F.contains(low, F.lit(phrase)), metric).otherwise(found)
    return rows.select("label", "n", found.alias("metric"))


def evidence_rows(spark, sf_dir):
    """Texts that stand for a case's evidence: its own, the expected answer after it, blank ones left out."""
    j = table(spark, sf_dir, "judge_calibration_v1").select("case_id", "evidence", "expected_answer").distinct()
    kept = F.filter(F.array("evidence", "expected_answer"), lambda x: x.isNotNull() & (F.trim(x) != ""))
    return j.select("case_id", F.posexplode(kept).alias("no", "text")).select("case_id", "no", "text")


def baseline_diff(spark, sf_dir):
    """Every run against the run before it, over the cases that both have: how many were fixed and broken."""
    g = graded(table(spark, sf_dir, "traces"), table(spark, sf_dir, "golden_set_v1")).where("correct is not null and run_id is not null")
    last = g.groupBy("run_id", "case_id").agg(F.max_by("correct", F.struct("created_at", "trace_id")).alias("correct"))
    runs = last.select("run_id").distinct().withColumn("base_id", F.lag("run_id").over(Window.orderBy("run_id"))).where("base_id is not null")
    base = last.select(F.col("run_id").alias("base_id"), "case_id", F.col("correct").alias("was"))
    j = last.join(F.broadcast(runs), "run_id").join(base, ["base_id", "case_id"])
    return j.groupBy("run_id", "base_id").agg(F.count("*").alias("n_common"), F.count_if(F.col("correct") & ~F.col("was")).alias("n_fixed"), F.count_if(~F.col("correct") & F.col("was")).alias("n_broken"))


def scope_guard(spark, sf_dir):
    """Years that a question asks of a company; one that the corpus has no filing of is taken out."""
    q = table(spark, sf_dir, "synthesis_responses").select("response_id", F.explode(F.array_distinct(tx.years(F.col("input")))).alias("year")).distinct()
    held = table(spark, sf_dir, "chunks").where("ticker is not null and fiscal_year is not null").select("ticker", F.col("fiscal_year").alias("year")).distinct().withColumn("held", F.lit(True))
    return question_companies(spark, sf_dir).join(q, "response_id").join(held, ["ticker", "year"], "left").select("response_id", "ticker", F.col("year").alias("asked"), F.when(F.col("held"), F.col("year")).alias("year"))


def graph_hits(spark, sf_dir):
    """Chunks that facts of the asked companies and years cite, which go behind the ranked hits with a full score."""
    q = table(spark, sf_dir, "synthesis_responses").select("response_id", F.explode(F.array_distinct(tx.years(F.col("input")))).alias("fiscal_year")).distinct()
    f = _facts(spark, sf_dir).select("ticker", "fiscal_year", F.col("chunk_id").alias("id")).distinct()
    cited = table(spark, sf_dir, "synthesis_responses").select("response_id", F.explode("citations").alias("id")).distinct()
    hits = question_companies(spark, sf_dir).join(q, "response_id").join(f, ["ticker", "fiscal_year"]).select("response_id", "id").distinct().join(cited, ["response_id", "id"], "left_anti")
    return hits.groupBy("response_id").agg(F.count("*").alias("n_added"), F.min("id").alias("first"), F.lit(1.0).alias("score"))


def latest_sessions(spark, sf_dir):
    """The latest sessions of all, as a list of recent ones shows them."""
    s = table(spark, sf_dir, "sessions").where("session_id is not null and created_at is not null and deleted_at is null").groupBy("session_id").agg(F.max("created_at").alias("created_at"))
    return s.orderBy(F.desc("created_at"), "session_id").limit(LATEST).select("session_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


def answer_texts(spark, sf_dir):
    """Facts as sentences: the possessive of the company, dollars in millions or billions."""
    names = table(spark, sf_dir, "chunks").where("ticker is not null and company is not null").groupBy("ticker").agg(F.min("company").alias("company"))
    f = _facts(spark, sf_dir).where("metric not in ('Gross Margin', 'Diluted EPS')").join(names, "ticker")
    owner = F.concat("company", F.when(F.col("company").endswith("s"), "'").otherwise("'s"))
    big = F.abs("usd_m") >= 1000
    figure = F.concat(F.when(F.col("usd_m") < 0, "-").otherwise(""), F.lit("$"), F.format_number(F.when(big, F.floor(F.abs("usd_m")) / 1000).otherwise(F.floor(F.abs("usd_m"))), 3), F.when(big, " billion").otherwise(" million"))
    return f.select("ticker", "metric", "fiscal_year", F.concat(owner, F.lit(" "), "metric", F.lit(" for fiscal year "), F.col("fiscal_year").cast("string"), F.lit(" was "), figure, F.lit(".")).alias("text"))


_FIG = "list_filter(list_transform(range(1, len({n}) + 1), lambda i: {{'value': try_cast(replace({n}[i], ',', '') AS DOUBLE) * CASE {u}[i] WHEN 'thousand' THEN 1e3 WHEN 'million' THEN 1e6 WHEN 'billion' THEN 1e9 ELSE 1 END * CASE WHEN starts_with(trim({a}[i]), '-') THEN -1 ELSE 1 END, 'is_pct': {u}[i] = '%'}}), lambda x: x.value IS NOT NULL)"


def _figures(x: str) -> str:
    pull = lambda g: f"regexp_extract_all(coalesce({x}, ''), '{FIGURE}', {g})"
    return _FIG.format(a=pull(0), n=pull(1), u=pull(2))


_YEARS = r"list_distinct(list_concat(list_transform(regexp_extract_all(input, '\b(?:19[6-9]\d|20[0-4]\d)\b'), lambda y: CAST(y AS INT)), list_transform(regexp_extract_all(input, '(?i)\bFY\s?''?(\d\d)\b', 1), lambda y: CAST(y AS INT) + CASE WHEN CAST(y AS INT) < 70 THEN 2000 ELSE 1900 END)))"
_SAME = "({a} = {b} OR abs({a} - {b}) <= 0.01::DOUBLE * greatest(abs({a}), abs({b})) OR abs(abs({a}) - abs({b})) <= 0.01::DOUBLE * greatest(abs({a}), abs({b})))"
_CASE_METRIC = f"(SELECT m FROM (VALUES {_METRIC_ROWS}) v(p, m) WHERE contains(lower(label), p) ORDER BY length(p) DESC LIMIT 1)"
QUERIES = {f.__name__: f for f in (turn_score, math_results, sub_periods, metric_canon, evidence_rows, baseline_diff, scope_guard, graph_hits, latest_sessions, answer_texts)}
SQL = {
    "turn_score": f"""
WITH g0 AS (SELECT DISTINCT id AS case_id, input AS question, {_figures("expected.answer")} AS f FROM golden_set_v1), g AS (SELECT case_id, question, f[1] AS gold FROM g0 WHERE len(f) > 0 QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY question NULLS FIRST, f[1]) = 1),
t AS (SELECT DISTINCT trace_id, case_id, final_output FROM traces),
j AS (SELECT trace_id, final_output, regexp_matches(coalesce(question, ''), '{PERCENT}') AS percent, CASE WHEN gold.is_pct THEN gold.value / 100 ELSE gold.value END AS gold, {_figures("final_output")} AS f FROM t JOIN g USING (case_id)),
h AS (SELECT *, len(list_filter(f, lambda x: CASE WHEN percent OR x.is_pct THEN {_SAME.format(a="x.value", b="(gold * 100)")} ELSE {" OR ".join(_SAME.format(a="x.value", b=f"(gold * {r})") for r in ("1", "1e3", "1e6", "1e9"))} END)) > 0 AS correct FROM j)
SELECT trace_id, correct, CASE WHEN correct THEN 'match' WHEN trim(coalesce(final_output, '')) = '' THEN 'refused' ELSE 'wrong-number' END AS why FROM h""",
    "math_results": _FACTS
    + """, p AS (SELECT *, lag(usd_m) OVER (PARTITION BY ticker, metric ORDER BY fiscal_year) AS prev FROM facts), e AS (SELECT *, CAST(usd_m AS DECIMAL(24,6)) AS a, CAST(prev AS DECIMAL(24,6)) AS b, (usd_m - prev) / prev AS v FROM p WHERE prev IS NOT NULL AND prev <> 0)
SELECT ticker, metric, fiscal_year, '(' || a || ' - (' || b || ')) / (' || b || ')' AS expression, round(CASE WHEN abs(v) > 0 AND abs(v) <= 1 THEN v * 100 ELSE v END, 4) AS result FROM e""",
    "sub_periods": f"SELECT source, count(*) AS n, count(*) FILTER (WHERE regexp_matches(text, '{PERIOD}')) AS n_periods FROM documents WHERE text IS NOT NULL GROUP BY source",
    "metric_canon": f"WITH labels AS (SELECT trim(string_split(line, '|')[1]) AS label, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM chunks WHERE text LIKE '%|%') WHERE contains(line, '|') GROUP BY 1) SELECT label, n, coalesce({_CASE_METRIC}, array_to_string(list_transform(string_split(label, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')) AS metric FROM labels WHERE label <> ''",
    "evidence_rows": "WITH j AS (SELECT DISTINCT case_id, evidence, expected_answer FROM judge_calibration_v1), k AS (SELECT case_id, list_filter([evidence, expected_answer], lambda x: x IS NOT NULL AND trim(x) <> '') AS l FROM j) SELECT case_id, CAST(i - 1 AS INT) AS no, l[i] AS text FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM k)",
    "baseline_diff": GRADED
    + """, l AS (SELECT run_id, case_id, arg_max(correct, struct_pack(a := created_at, b := trace_id)) AS correct FROM graded WHERE correct IS NOT NULL AND run_id IS NOT NULL GROUP BY ALL),
r AS (SELECT run_id, lag(run_id) OVER (ORDER BY run_id) AS base_id FROM (SELECT DISTINCT run_id FROM l))
SELECT l.run_id, r.base_id, count(*) AS n_common, count(*) FILTER (WHERE l.correct AND NOT b.correct) AS n_fixed, count(*) FILTER (WHERE NOT l.correct AND b.correct) AS n_broken FROM l JOIN r ON r.run_id = l.run_id JOIN l b ON b.run_id = r.base_id AND b.case_id = l.case_id GROUP BY l.run_id, r.base_id""",
    "scope_guard": "WITH " + COMPANIES + f", y AS (SELECT DISTINCT response_id, unnest({_YEARS}) AS year FROM synthesis_responses), held AS (SELECT DISTINCT ticker, fiscal_year AS year FROM chunks WHERE ticker IS NOT NULL AND fiscal_year IS NOT NULL) SELECT response_id, ticker, year AS asked, CASE WHEN held.year IS NOT NULL THEN y.year END AS year FROM companies JOIN y USING (response_id) LEFT JOIN held USING (ticker, year)",
    "graph_hits": _FACTS + ", " + COMPANIES.lstrip() + f", y AS (SELECT DISTINCT response_id, unnest({_YEARS}) AS fiscal_year FROM synthesis_responses), cited AS (SELECT DISTINCT response_id, unnest(citations) AS id FROM synthesis_responses), hit AS (SELECT DISTINCT response_id, chunk_id AS id FROM companies JOIN y USING (response_id) JOIN facts USING (ticker, fiscal_year)) SELECT response_id, count(*) AS n_added, min(id) AS first, 1.0::DOUBLE AS score FROM hit WHERE NOT EXISTS (SELECT 1 FROM cited c WHERE c.response_id = hit.response_id AND c.id = hit.id) GROUP BY response_id",
    "latest_sessions": f"SELECT session_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM (SELECT session_id, max(created_at) AS created_at FROM sessions WHERE session_id IS NOT NULL AND created_at IS NOT NULL AND deleted_at IS NULL GROUP BY session_id) ORDER BY created_at DESC, session_id LIMIT {LATEST}",
    "answer_texts": _FACTS
    + """, n AS (SELECT ticker, min(company) AS company FROM chunks WHERE ticker IS NOT NULL AND company IS NOT NULL GROUP BY ticker)
SELECT ticker, metric, fiscal_year, company || chr(39) || CASE WHEN company LIKE '%s' THEN '' ELSE 's' END || ' ' || metric || ' for fiscal year ' || fiscal_year || ' was ' || CASE WHEN usd_m < 0 THEN '-' ELSE '' END || '$' || CASE WHEN abs(usd_m) >= 1000 THEN format('{:,.3f}', floor(abs(usd_m)) / 1000) || ' billion' ELSE format('{:,.3f}', floor(abs(usd_m))) || ' million' END || '.' AS text
FROM facts JOIN n USING (ticker) WHERE metric NOT IN ('Gross Margin', 'Diluted EPS')""",
}
