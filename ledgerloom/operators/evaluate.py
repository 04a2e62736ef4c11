"""Scoring of runs: graded traces, rates, percentiles, coverage, agreement, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.text import figures_match, refuses


def rate(flag: Column) -> Column:
    """Mean of a nullable flag; nulls don't count."""
    return F.round(F.avg(flag.cast("int")), 6)


def prefixes(key: Column) -> Column:
    """The key and all of its prefixes that end before a colon."""
    parts = F.split(key, ":")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), ":"))


def citation_hit(produced: Column, expected: Column) -> Column:
    """Whether a produced citation equals an expected one or one continues the other after a colon; null without expected ones."""
    clean = lambda a: F.filter(F.coalesce(a, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    p, e = clean(produced), clean(expected)
    below = F.arrays_overlap(F.flatten(F.transform(p, prefixes)), e)
    above = F.arrays_overlap(p, F.flatten(F.transform(e, prefixes)))
    return F.when(F.size(e) > 0, F.coalesce(below | above, F.lit(False)))


def graded(traces: DataFrame, golden: DataFrame) -> DataFrame:
    """One row for each trace of a known case, scored by its case."""
    g = golden.select("id", "failure_category", "difficulty", "variation_rules", F.col("expected.answer").alias("expected"), F.col("expected.citations").alias("wanted"), F.col("expected.type").alias("type")).distinct()
    t = traces.select("trace_id", "run_id", "case_id", "final_output", "citations", "latency_ms", "model", F.col("usage.cost_usd").alias("cost_usd"), F.col("usage.input_tokens").alias("input_tokens"), "created_at").distinct()
    j = t.join(g, F.col("case_id") == F.col("id"))
    refused = refuses(F.coalesce("final_output", F.lit("")))
    right = figures_match(F.col("expected"), F.col("final_output"), F.col("variation_rules"))
    outcome = (
        F.when(F.col("expected").isNull() & refused, "correct_refusal")
        .when(F.col("expected").isNull() & (F.col("failure_category") == "ambiguous"), "answered")
        .when(F.col("expected").isNull(), "hallucination")
        .when(refused, "incorrect_refusal")
        .otherwise("answered")
    )
    scored = j.select("*", refused.alias("refused"), outcome.alias("outcome"), citation_hit(F.col("citations"), F.col("wanted")).alias("cited"))
    correct = F.when(F.col("outcome") == "correct_refusal", True).when(F.col("outcome") != "answered", False).when(F.col("expected").isNull(), None).otherwise(right)
    return scored.select(
        "trace_id", "run_id", "case_id", F.col("failure_category").alias("category"), "difficulty", "type", "model", "latency_ms", "cost_usd", "input_tokens", "refused", "outcome",
        F.when(~F.col("refused"), F.col("cited")).alias("cited"), correct.alias("correct"), "created_at",
    )


def run_metrics(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts, rates with their own denominators, exact percentiles and cost."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        rate(F.col("correct")).alias("accuracy"),
        rate(F.col("cited")).alias("citation_hit"),
        rate(F.col("refused")).alias("refusal_rate"),
        rate(F.when(F.col("category") == "unanswerable", F.col("outcome") == "hallucination")).alias("hallucination_rate"),
        rate(F.when(F.col("refused"), F.col("outcome") == "correct_refusal")).alias("refusal_correctness"),
        F.round(F.percentile(real_latency(), 0.5), 4).alias("p50_ms"),
        F.round(F.percentile(real_latency(), 0.95), 4).alias("p95_ms"),
        F.round(F.avg("cost_usd"), 10).alias("mean_cost_usd"),
    )


def real_latency() -> Column:
    return F.when(F.col("latency_ms").isNotNull() & ~F.isnan("latency_ms"), F.col("latency_ms"))


def agreement(labels: DataFrame, human: Column, judge: Column, *keys: str) -> DataFrame:
    """Confusion counts, agreement and Cohen's kappa of two boolean labels in one pass."""
    both = labels.select(*keys, human.alias("h"), judge.alias("j")).where("h is not null and j is not null")
    count = lambda c: F.count_if(c)
    h, j = F.col("h"), F.col("j")
    g = both.groupBy(*keys).agg(count(h & j).alias("tp"), count(h & ~j).alias("fn"), count(~h & j).alias("fp"), count(~h & ~j).alias("tn"), F.count("*").alias("n"))
    po = (F.col("tp") + F.col("tn")) / F.col("n")
    pe = ((F.col("tp") + F.col("fn")) * (F.col("tp") + F.col("fp")) + (F.col("fp") + F.col("tn")) * (F.col("fn") + F.col("tn"))) / (F.col("n") * F.col("n"))
    return g.select(*keys, "n", "tp", "fn", "fp", "tn", F.round(po, 6).alias("agreement"), F.round(F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe)), 6).alias("kappa"))


def streaks(rows: DataFrame, key: str, order: list[str], flag: Column, part: Column) -> DataFrame:
    """(key, longest, streaks) of neighbouring rows with the flag: gaps and islands.

    ``part`` never falls along the order; the rows of a key are counted part by part, so a hot key is spread.
    """
    runs = rows.select(key, *order, (1 - flag.cast("int")).alias("other"), part.alias("part"))
    within = F.sum("other").over(Window.partitionBy(key, "part").orderBy(*order))
    parts = runs.groupBy(key, "part").agg(F.sum("other").alias("others"))
    earlier = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select(key, "part", F.coalesce(F.sum("others").over(earlier), F.lit(0)).alias("before"))
    islands = runs.withColumn("within", within).where("other = 0").join(before, [key, "part"]).groupBy(key, (F.col("before") + F.col("within")).alias("island")).agg(F.count("*").alias("n"))
    return islands.groupBy(key).agg(F.max("n").alias("longest"), F.count("*").alias("streaks"))
