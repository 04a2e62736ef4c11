"""Queries that score and compare runs, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import text as tx
from ledgerloom.operators import evaluate as ev
from ledgerloom.operators.retrieval import numbered
from ledgerloom.tables import table


def _graded(spark, sf_dir):
    return ev.graded(table(spark, sf_dir, "traces"), table(spark, sf_dir, "golden_set_v1"))


def outcome_matrix(spark, sf_dir):
    return _graded(spark, sf_dir).groupBy("category", "outcome").agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct"))


def graded_traces(spark, sf_dir):
    return _graded(spark, sf_dir).select("trace_id", "category", "outcome", "refused", "cited", "correct")


def run_aggregate(spark, sf_dir):
    return ev.run_metrics(_graded(spark, sf_dir), "run_id")


def hallucination_rate(spark, sf_dir):
    g = _graded(spark, sf_dir).groupBy("model")
    return g.agg(
        F.count_if(F.col("category") == "unanswerable").alias("n_unanswerable"),
        ev.rate(F.when(F.col("category") == "unanswerable", F.col("outcome") == "hallucination")).alias("hallucination_rate"),
        ev.rate(F.when(F.col("refused"), F.col("outcome") == "correct_refusal")).alias("refusal_correctness"),
    )


def latency_percentiles(spark, sf_dir):
    t = table(spark, sf_dir, "traces").select("trace_id", "model", "latency_ms").distinct().where("latency_ms is not null and not isnan(latency_ms)")
    return t.groupBy("model").agg(F.count("*").alias("n"), *[F.round(F.percentile("latency_ms", q), 4).alias(f"p{int(q * 100)}") for q in (0.25, 0.5, 0.9, 0.95, 0.99)])


def latency_p95_variants(spark, sf_dir):
    """p95 by linear interpolation, by the element at floor(0.95 n), and with exclusive quantiles, without gathering a group."""
    t = table(spark, sf_dir, "traces").select("trace_id", "model", "latency_ms").distinct().where("latency_ms is not null and not isnan(latency_ms)").withColumn("model", F.coalesce("model", F.lit("(none)")))
    # Equal latencies, and those of a like size, share a part; larger ones have larger parts.
    part = F.floor(F.when(F.col("latency_ms") > 0, F.log("latency_ms") * 16).otherwise(F.col("latency_ms") - 100_000))
    r = numbered(t, "model", [F.asc("latency_ms"), F.asc("trace_id")], part, "i").join(F.broadcast(t.groupBy("model").agg(F.count("*").alias("n"))), "model")
    n = F.col("n")
    at, below, part = F.least(F.floor(n * 0.95) + 1, n), F.floor(0.95 * (n + 1)), 0.95 * (n + 1) - F.floor(0.95 * (n + 1))
    low, share = F.floor(0.95 * (n - 1)), 0.95 * (n - 1) - F.floor(0.95 * (n - 1))
    pick = lambda k: F.max(F.when(F.col("i") == F.least(F.greatest(k, F.lit(1)), n), F.col("latency_ms")))
    g = r.groupBy("model", "n").agg(pick(at).alias("by_index"), pick(below).alias("lo"), pick(below + 1).alias("hi"), pick(low + 1).alias("a"), pick(low + 2).alias("b"))
    linear = F.col("a") + share * (F.col("b") - F.col("a"))
    return g.select(F.nullif("model", F.lit("(none)")).alias("model"), "n", F.round(linear, 4).alias("linear"), F.round("by_index", 4).alias("by_index"), F.round(F.col("lo") + part * (F.col("hi") - F.col("lo")), 4).alias("exclusive"))


def by_category_rollup(spark, sf_dir):
    return _graded(spark, sf_dir).rollup("category", "difficulty").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.count_if("correct").alias("n_correct"), ev.rate(F.col("correct")).alias("accuracy"))


def metric_coverage(spark, sf_dir):
    g = _graded(spark, sf_dir).select(
        F.explode(
            F.array(
                F.struct(F.lit("correct").alias("metric"), F.lit(True).alias("eligible"), F.col("correct").cast("double").alias("v")),
                F.struct(F.lit("cited").alias("metric"), (F.col("outcome") == "answered").alias("eligible"), F.col("cited").cast("double").alias("v")),
                F.struct(F.lit("cost").alias("metric"), F.lit(True).alias("eligible"), F.when(F.col("cost_usd").isNotNull(), 1.0).alias("v")),
            )
        ).alias("m")
    ).select("m.*")
    e, v = F.col("eligible"), F.col("v")
    return g.groupBy("metric").agg(
        F.count_if(e).alias("eligible"), F.count_if(e & v.isNotNull()).alias("evaluated"), F.count_if(e & (v >= 0.5)).alias("successful"), F.count_if(e & (v < 0.5)).alias("failed"), F.count_if(e & v.isNull()).alias("skipped")
    )


def kappa(spark, sf_dir):
    """Human labels against the figures rule, per category."""
    j = table(spark, sf_dir, "judge_calibration_v1").select("case_id", "failure_category", "human_label", "expected_answer", "actual_output").distinct()
    judge = tx.figures_match(F.col("expected_answer"), F.col("actual_output"), F.array().cast("array<string>"))
    human = F.when(F.col("human_label").isNotNull(), F.col("human_label") == "correct")
    return ev.agreement(j.where("expected_answer is not null"), human, judge, "failure_category")


def run_diff(spark, sf_dir):
    """Cases whose citations hit in only one of their first and their last trace."""
    g = _graded(spark, sf_dir).where("cited is not null")
    order = F.struct("created_at", "trace_id")
    d = g.groupBy("case_id").agg(F.count("*").alias("n"), F.min_by("cited", order).alias("was"), F.max_by("cited", order).alias("now"))
    return d.where("n > 1 and was != now").select("case_id", "n", F.when(F.col("now"), "fixed").otherwise("regressed").alias("change"))


def run_manifest(spark, sf_dir):
    """Of every run: cases attempted, answered, refused, and cases of the golden set that it left out."""
    g = _graded(spark, sf_dir)
    total = table(spark, sf_dir, "golden_set_v1").agg(F.countDistinct("id").alias("total"))
    m = g.groupBy("run_id").agg(F.countDistinct("case_id").alias("attempted"), F.count_if(F.col("outcome") == "answered").alias("answered"), F.count_if("refused").alias("refused"))
    return m.crossJoin(F.broadcast(total)).select("run_id", "attempted", "answered", "refused", (F.col("total") - F.col("attempted")).alias("unattempted"))


def unattempted_cases(spark, sf_dir):
    g = table(spark, sf_dir, "golden_set_v1").select("id", "failure_category", "domain").distinct()
    return g.join(table(spark, sf_dir, "traces").select(F.col("case_id").alias("id")), "id", "left_anti")


def error_streak(spark, sf_dir):
    """Longest run of rejected or redrafted steps of each agent and session."""
    t = table(spark, sf_dir, "trajectories").select("id", "session_id", "step_index", "action", "logged_at").distinct().where("session_id is not null and session_id != ''")
    return ev.streaks(t, "session_id", ["logged_at", "step_index", "id"], F.col("action").isin("reject", "redraft", "clarify"), F.to_date("logged_at"))


def conv_all_correct(spark, sf_dir):
    g = _graded(spark, sf_dir).where("correct is not null").groupBy("run_id").agg(F.count("*").alias("n"), F.bool_and("correct").alias("all_correct"), F.bool_or("correct").alias("any_correct"))
    return g


def scorecard_pivot(spark, sf_dir):
    g = _graded(spark, sf_dir).where("model is not null").groupBy("category").pivot("model", ["model-s", "model-m", "model-l"]).agg(ev.rate(F.col("correct")).alias("acc"))
    return g.select("category", *(F.col(f"`{c}`").alias(c.replace("-", "_")) for c in g.columns if c != "category"))


def usage_ledger(spark, sf_dir):
    u = table(spark, sf_dir, "traces").select("trace_id", "model", "usage", F.format_string("%04d-%02d", F.year("created_at"), F.month("created_at")).alias("month")).distinct()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return u.groupBy("month", "model").agg(
        F.count("*").alias("calls"), F.sum(zero("usage.input_tokens")).alias("input_tokens"), F.sum(zero("usage.output_tokens")).alias("output_tokens"), F.round(F.sum(zero("usage.cost_usd")), 6).alias("cost_usd")
    )


def golden_violations(spark, sf_dir):
    """Cases that break the rules of the golden set: values outside their lists, answers that must or mustn't be there, ids used twice."""
    g = table(spark, sf_dir, "golden_set_v1").select("id", F.col("expected.answer").alias("a"), F.col("expected.type").alias("type"), "difficulty", "failure_category", "input").distinct()
    free = F.col("failure_category").isin("unanswerable", "ambiguous")
    found = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col("type").isin("exact", "contains", "judge"), F.lit(False)), "type"),
            F.when(~F.coalesce(F.col("difficulty").isin("easy", "medium", "hard"), F.lit(False)), "difficulty"),
            F.when(~F.coalesce(F.col("failure_category").isin("lookup", "synthesis", "table", "unanswerable", "ambiguous"), F.lit(False)), "category"),
            F.when(free & F.col("a").isNotNull(), "answer not null"),
            F.when(~free & F.col("a").isNull(), "answer null"),
            F.when(F.col("input").isNull() | (F.trim("input") == ""), "input"),
        )
    )
    single = g.select("id", F.explode(found).alias("violation"))
    twice = g.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("id used twice").alias("violation"))
    return single.unionByName(twice).groupBy("violation").agg(F.countDistinct("id").alias("n_cases"))


def first_per_key(spark, sf_dir):
    t = table(spark, sf_dir, "traces").groupBy("case_id").agg(F.min_by("trace_id", F.struct("created_at", "trace_id")).alias("first_trace"), F.countDistinct("trace_id").alias("n"))
    return t.where("case_id is not null")


def parse_rules(spark, sf_dir):
    g = table(spark, sf_dir, "golden_set_v1").select("id", "variation_rules").distinct()
    return g.groupBy(F.round(tx.tolerance_of(F.col("variation_rules")), 6).alias("tolerance"), tx.allows_units(F.col("variation_rules")).alias("unit_equivalence")).agg(F.count("*").alias("n"))


def any_all_coverage(spark, sf_dir):
    """Whether any and whether all expected citations of a case were produced by its trace."""
    g = table(spark, sf_dir, "golden_set_v1").select(F.col("id").alias("case_id"), F.explode("expected.citations").alias("want")).where("want is not null and want != ''").distinct()
    t = table(spark, sf_dir, "traces").select("trace_id", "case_id", F.explode("citations").alias("c")).where("c is not null and c != ''").select("trace_id", "case_id", F.explode(ev.prefixes(F.col("c"))).alias("c")).distinct()
    traces = t.select("trace_id", "case_id").distinct()
    need = traces.join(g, "case_id")
    hit = need.join(t.select("trace_id", F.col("c").alias("want"), F.lit(1).alias("hit")), ["trace_id", "want"], "left")
    return hit.groupBy("trace_id").agg(F.max(F.coalesce("hit", F.lit(0))).alias("any_hit"), F.min(F.coalesce("hit", F.lit(0))).alias("all_hit"), F.count("*").alias("n_expected"))


_MARKS = " OR ".join(f"contains(lower(coalesce(final_output, '')), '{m}')" for m in tx.REFUSAL_MARKERS)
_CLAIM = tx.CLAIM.replace("'", "''")


def sql_claims(col: str) -> str:
    scale = " * ".join(f"CASE WHEN contains(lower(r), '{w}') THEN {f!r}::DOUBLE ELSE 1.0::DOUBLE END" for w, f in tx.SCALES)
    value = f"coalesce(try_cast(replace(regexp_extract(r, '{tx.NUMBER}'), ',', '') AS DOUBLE), 0.0::DOUBLE) * {scale}"
    return f"list_transform(regexp_extract_all(regexp_replace(coalesce({col}, ''), '[\\p{{Han}}\\p{{Hiragana}}\\p{{Katakana}}\\p{{Greek}}µ]', 'x', 'g'), '{_CLAIM}'), lambda r: {{'raw': trim(r), 'value': {value}, 'is_pct': contains(r, '%')}})"


def sql_scale_word(x: str) -> str:
    return f"CASE WHEN contains(lower({x}), 'trillion') THEN 'trillion' WHEN contains(lower({x}), 'billion') THEN 'billion' WHEN contains(lower({x}), 'million') THEN 'million' WHEN contains(lower({x}), 'thousand') THEN 'thousand' ELSE '' END"


def sql_squeezed(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '^[ .]+|[ .]+$', '', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))"


def sql_figures_match(e: str, a: str, tol: str, units: str) -> str:
    ratios = "[" + ", ".join(f"{r!r}::DOUBLE" for r in tx.UNIT_RATIOS) + "]"
    near = f"len(list_filter(CASE WHEN {units} AND NOT x.is_pct THEN {ratios} ELSE [1.0::DOUBLE] END, lambda r: CASE WHEN x.value = 0 THEN y.value = 0 ELSE abs(y.value * r - x.value) <= greatest({tol}, 1e-9) * abs(x.value) END)) > 0"
    same = f"y.is_pct = x.is_pct AND {near} AND ({units} OR x.value = 0 OR {sql_scale_word('y.raw')} = {sql_scale_word('x.raw')})"
    word = f"list_contains(string_split(regexp_replace({sql_squeezed(a)}, '[^a-z0-9_]+', ' ', 'g'), ' '), {sql_squeezed(e)})"
    in_text = f"CASE WHEN length({sql_squeezed(e)}) <= 5 AND regexp_full_match({sql_squeezed(e)}, '[a-z]+') THEN {word} ELSE contains({sql_squeezed(a)}, {sql_squeezed(e)}) END"
    return f"CASE WHEN len({sql_claims(e)}) = 0 THEN {in_text} ELSE len(list_filter({sql_claims(e)}, lambda x: len(list_filter({sql_claims(a)}, lambda y: {same})) = 0)) = 0 END"


_TOL = r"coalesce(list_max(list_transform(variation_rules, lambda r: try_cast(nullif(regexp_extract(trim(r), '^numeric_tolerance:\s*(\d+(?:\.\d+)?)%$', 1), '') AS DOUBLE))), 0.0::DOUBLE) / 100"
_UNITS = "coalesce(len(list_filter(variation_rules, lambda r: trim(r) = 'unit_equivalence')) > 0, false)"


def sql_prefixes(x: str) -> str:
    return f"list_transform(range(1, len(string_split({x}, ':')) + 1), lambda i: array_to_string(string_split({x}, ':')[1:i], ':'))"


def _clean(x: str) -> str:
    return f"list_filter(coalesce({x}, []), lambda c: c IS NOT NULL AND c <> '')"


_HIT = f"""CASE WHEN len({_clean("wanted")}) > 0 THEN
  list_has_any(flatten(list_transform({_clean("citations")}, lambda c: {sql_prefixes("c")})), {_clean("wanted")})
  OR list_has_any({_clean("citations")}, flatten(list_transform({_clean("wanted")}, lambda c: {sql_prefixes("c")}))) END"""
GRADED = f"""
WITH g AS (SELECT DISTINCT id, failure_category, difficulty, variation_rules, expected.answer AS expected, expected.citations AS wanted, expected.type AS type FROM golden_set_v1),
t AS (SELECT DISTINCT trace_id, run_id, case_id, final_output, citations, latency_ms, model, usage.cost_usd AS cost_usd, usage.input_tokens AS input_tokens, created_at FROM traces),
j AS (SELECT *, ({_MARKS}) AS refused, {_TOL} AS tol, {_UNITS} AS units FROM t JOIN g ON case_id = id),
s AS (SELECT *, CASE WHEN expected IS NULL AND refused THEN 'correct_refusal' WHEN expected IS NULL AND failure_category = 'ambiguous' THEN 'answered' WHEN expected IS NULL THEN 'hallucination' WHEN refused THEN 'incorrect_refusal' ELSE 'answered' END AS outcome,
  {_HIT} AS hit FROM j),
graded AS (
  SELECT trace_id, run_id, case_id, failure_category AS category, difficulty, type, model, latency_ms, cost_usd, input_tokens, refused, outcome, CASE WHEN NOT refused THEN hit END AS cited,
    CASE WHEN outcome = 'correct_refusal' THEN true WHEN outcome <> 'answered' THEN false WHEN expected IS NULL THEN NULL ELSE {sql_figures_match("expected", "final_output", "tol", "units")} END AS correct, created_at
  FROM s)
"""
_T = "WITH t AS (SELECT DISTINCT trace_id, model, latency_ms FROM traces WHERE latency_ms IS NOT NULL AND NOT isnan(latency_ms))\n"

QUERIES = {
    f.__name__: f
    for f in (
        outcome_matrix, graded_traces, run_aggregate, hallucination_rate, latency_percentiles, latency_p95_variants, by_category_rollup, metric_coverage, kappa, run_diff, run_manifest, unattempted_cases, error_streak,
        conv_all_correct, scorecard_pivot, usage_ledger, golden_violations, first_per_key, parse_rules, any_all_coverage,
    )
}
SQL = {
    "outcome_matrix": GRADED + "SELECT category, outcome, count(*) AS n, count(*) FILTER (WHERE correct) AS n_correct FROM graded GROUP BY ALL",
    "graded_traces": GRADED + "SELECT trace_id, category, outcome, refused, cited, correct FROM graded",
    "run_aggregate": GRADED
    + """SELECT run_id, count(*) AS n, round(avg(correct::INT), 6) AS accuracy, round(avg(cited::INT), 6) AS citation_hit, round(avg(refused::INT), 6) AS refusal_rate,
  round(avg((outcome = 'hallucination')::INT) FILTER (WHERE category = 'unanswerable'), 6) AS hallucination_rate, round(avg((outcome = 'correct_refusal')::INT) FILTER (WHERE refused), 6) AS refusal_correctness,
  round(quantile_cont(latency_ms, 0.5) FILTER (WHERE NOT isnan(latency_ms)), 4) AS p50_ms, round(quantile_cont(latency_ms, 0.95) FILTER (WHERE NOT isnan(latency_ms)), 4) AS p95_ms, round(avg(cost_usd), 10) AS mean_cost_usd
FROM graded GROUP BY run_id""",
    "hallucination_rate": GRADED
    + "SELECT model, count(*) FILTER (WHERE category = 'unanswerable') AS n_unanswerable, round(avg((outcome = 'hallucination')::INT) FILTER (WHERE category = 'unanswerable'), 6) AS hallucination_rate, round(avg((outcome = 'correct_refusal')::INT) FILTER (WHERE refused), 6) AS refusal_correctness FROM graded GROUP BY model",
    "latency_percentiles": _T + "SELECT model, count(*) AS n, " + ", ".join(f"round(quantile_cont(latency_ms, {q}), 4) AS p{int(q * 100)}" for q in (0.25, 0.5, 0.9, 0.95, 0.99)) + " FROM t GROUP BY model",
    "latency_p95_variants": _T
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY latency_ms, trace_id) AS i, count(*) OVER (PARTITION BY model) AS n FROM t),
g AS (SELECT model, n, quantile_cont(latency_ms, 0.95) AS linear, max(latency_ms) FILTER (WHERE i = least(floor(n * 0.95::DOUBLE) + 1, n)) AS by_index,
  max(latency_ms) FILTER (WHERE i = least(greatest(floor(0.95::DOUBLE * (n + 1)), 1), n)) AS lo, max(latency_ms) FILTER (WHERE i = least(greatest(floor(0.95::DOUBLE * (n + 1)) + 1, 1), n)) AS hi FROM r GROUP BY model, n)
SELECT model, n, round(linear, 4) AS linear, round(by_index, 4) AS by_index, round(lo + (0.95::DOUBLE * (n + 1) - floor(0.95::DOUBLE * (n + 1))) * (hi - lo), 4) AS exclusive FROM g""",
    "by_category_rollup": GRADED
    + "SELECT category, difficulty, CAST(grouping(category, difficulty) AS BIGINT) AS level, count(*) AS n, count(*) FILTER (WHERE correct) AS n_correct, round(avg(correct::INT), 6) AS accuracy FROM graded GROUP BY ROLLUP (category, difficulty)",
    "metric_coverage": GRADED
    + """, m AS (SELECT 'correct' AS metric, true AS e, correct::INT::DOUBLE AS v FROM graded UNION ALL SELECT 'cited', outcome = 'answered', cited::INT::DOUBLE FROM graded UNION ALL SELECT 'cost', true, CASE WHEN cost_usd IS NOT NULL THEN 1.0 END FROM graded)
SELECT metric, count(*) FILTER (WHERE e) AS eligible, count(*) FILTER (WHERE e AND v IS NOT NULL) AS evaluated, count(*) FILTER (WHERE e AND v >= 0.5) AS successful, count(*) FILTER (WHERE e AND v < 0.5) AS failed, count(*) FILTER (WHERE e AND v IS NULL) AS skipped FROM m GROUP BY metric""",
    "kappa": f"""
WITH j AS (SELECT DISTINCT case_id, failure_category, human_label, expected_answer, actual_output FROM judge_calibration_v1 WHERE expected_answer IS NOT NULL),
b AS (SELECT failure_category, human_label = 'correct' AS h, {sql_figures_match("expected_answer", "actual_output", "0.0::DOUBLE", "false")} AS j FROM j WHERE human_label IS NOT NULL),
g AS (SELECT failure_category, count(*) AS n, count(*) FILTER (WHERE h AND j) AS tp, count(*) FILTER (WHERE h AND NOT j) AS fn, count(*) FILTER (WHERE NOT h AND j) AS fp, count(*) FILTER (WHERE NOT h AND NOT j) AS tn FROM b WHERE j IS NOT NULL GROUP BY ALL),
p AS (SELECT *, (tp + tn) / n::DOUBLE AS po, ((tp + fn) * (tp + fp) + (fp + tn) * (fn + tn)) / (n * n)::DOUBLE AS pe FROM g)
SELECT failure_category, n, tp, fn, fp, tn, round(po, 6) AS agreement, round(CASE WHEN pe = 1 THEN 1.0 ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM p""",
    "run_diff": GRADED
    + "SELECT case_id, n, CASE WHEN now_ THEN 'fixed' ELSE 'regressed' END AS change FROM (SELECT case_id, count(*) AS n, arg_min(cited, struct_pack(a := created_at, b := trace_id)) AS was, arg_max(cited, struct_pack(a := created_at, b := trace_id)) AS now_ FROM graded WHERE cited IS NOT NULL GROUP BY case_id) WHERE n > 1 AND was <> now_",
    "run_manifest": GRADED
    + "SELECT run_id, count(DISTINCT case_id) AS attempted, count(*) FILTER (WHERE outcome = 'answered') AS answered, count(*) FILTER (WHERE refused) AS refused, (SELECT count(DISTINCT id) FROM golden_set_v1) - count(DISTINCT case_id) AS unattempted FROM graded GROUP BY run_id",
    "unattempted_cases": "SELECT DISTINCT id, failure_category, domain FROM golden_set_v1 g WHERE NOT EXISTS (SELECT 1 FROM traces t WHERE t.case_id = g.id)",
    "error_streak": """
WITH t AS (SELECT DISTINCT id, session_id, step_index, action, logged_at FROM trajectories WHERE session_id IS NOT NULL AND session_id <> ''),
f AS (SELECT *, (action IN ('reject', 'redraft', 'clarify'))::INT AS flag FROM t),
i AS (SELECT *, sum(1 - flag) OVER (PARTITION BY session_id ORDER BY logged_at, step_index, id) AS island FROM f),
n AS (SELECT session_id, island, count(*) AS n FROM i WHERE flag = 1 GROUP BY ALL)
SELECT session_id, max(n) AS longest, count(*) AS streaks FROM n GROUP BY session_id""",
    "conv_all_correct": GRADED + "SELECT run_id, count(*) AS n, bool_and(correct) AS all_correct, bool_or(correct) AS any_correct FROM graded WHERE correct IS NOT NULL GROUP BY run_id",
    "scorecard_pivot": GRADED
    + "SELECT category, "
    + ", ".join(f"round(avg(correct::INT) FILTER (WHERE model = 'model-{m}'), 6) AS model_{m}" for m in "sml")
    + " FROM graded WHERE model IS NOT NULL GROUP BY category",
    "usage_ledger": "WITH u AS (SELECT DISTINCT trace_id, model, usage, strftime(created_at, '%Y-%m') AS month FROM traces) SELECT month, model, count(*) AS calls, CAST(sum(coalesce(usage.input_tokens, 0)) AS BIGINT) AS input_tokens, CAST(sum(coalesce(usage.output_tokens, 0)) AS BIGINT) AS output_tokens, round(sum(coalesce(usage.cost_usd, 0)), 6) AS cost_usd FROM u GROUP BY ALL",
    "golden_violations": """
WITH g AS (SELECT DISTINCT id, expected.answer AS a, expected.type AS type, difficulty, failure_category AS c, input FROM golden_set_v1),
v AS (
  SELECT id, 'type' AS violation FROM g WHERE NOT coalesce(type IN ('exact', 'contains', 'judge'), false)
  UNION ALL SELECT id, 'difficulty' FROM g WHERE NOT coalesce(difficulty IN ('easy', 'medium', 'hard'), false)
  UNION ALL SELECT id, 'category' FROM g WHERE NOT coalesce(c IN ('lookup', 'synthesis', 'table', 'unanswerable', 'ambiguous'), false)
  UNION ALL SELECT id, 'answer not null' FROM g WHERE c IN ('unanswerable', 'ambiguous') AND a IS NOT NULL
  UNION ALL SELECT id, 'answer null' FROM g WHERE c NOT IN ('unanswerable', 'ambiguous') AND a IS NULL
  UNION ALL SELECT id, 'input' FROM g WHERE input IS NULL OR trim(input) = ''
  UNION ALL SELECT id, 'id used twice' FROM g GROUP BY id HAVING count(*) > 1)
SELECT violation, count(DISTINCT id) AS n_cases FROM v GROUP BY violation""",
    "first_per_key": "SELECT case_id, arg_min(trace_id, struct_pack(a := created_at, b := trace_id)) AS first_trace, count(DISTINCT trace_id) AS n FROM traces WHERE case_id IS NOT NULL GROUP BY case_id",
    "parse_rules": f"SELECT round({_TOL}, 6) AS tolerance, {_UNITS} AS unit_equivalence, count(*) AS n FROM (SELECT DISTINCT id, variation_rules FROM golden_set_v1) GROUP BY 1, 2",
    "any_all_coverage": f"""
WITH g AS (SELECT DISTINCT * FROM (SELECT id AS case_id, unnest(expected.citations) AS want FROM golden_set_v1) WHERE want IS NOT NULL AND want <> ''),
c AS (SELECT * FROM (SELECT trace_id, case_id, unnest(citations) AS c FROM traces) WHERE c IS NOT NULL AND c <> ''),
t AS (SELECT DISTINCT trace_id, case_id, unnest({sql_prefixes("c")}) AS c FROM c),
n AS (SELECT DISTINCT t.trace_id, t.case_id, g.want FROM (SELECT DISTINCT trace_id, case_id FROM t) t JOIN g USING (case_id)),
h AS (SELECT n.*, CASE WHEN EXISTS (SELECT 1 FROM t WHERE t.trace_id = n.trace_id AND t.c = n.want) THEN 1 ELSE 0 END AS hit FROM n)
SELECT trace_id, max(hit) AS any_hit, min(hit) AS all_hit, count(*) AS n_expected FROM h GROUP BY trace_id""",
}
