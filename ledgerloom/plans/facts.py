"""Queries on the fact table of the chunks, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.text import cell_value
from ledgerloom.operators import facts as fx
from ledgerloom.tables import table


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.merge_facts(fx.extract_facts(table(spark, sf_dir, "chunks")))


def extract_facts(spark, sf_dir):
    return fx.extract_facts(table(spark, sf_dir, "chunks"))


def fact_merge(spark, sf_dir):
    return _facts(spark, sf_dir)


def latest_fact(spark, sf_dir):
    f = _facts(spark, sf_dir)
    return f.groupBy("ticker", "metric").agg(F.max("fiscal_year").alias("fiscal_year"), F.max_by("usd_m", "fiscal_year").alias("usd_m"), F.max_by("chunk_id", "fiscal_year").alias("chunk_id"))


def metric_history(spark, sf_dir):
    f = _facts(spark, sf_dir)
    points = F.array_sort(F.collect_list(F.struct("fiscal_year", "usd_m")))
    text = F.array_join(F.transform(points, lambda p: F.concat(p["fiscal_year"].cast("string"), F.lit("="), p["usd_m"].cast("decimal(24,6)").cast("string"))), "; ")
    return f.groupBy("ticker", "metric").agg(F.count("*").alias("n_years"), text.alias("history"))


def compare_metrics(spark, sf_dir):
    w = Window.partitionBy("metric", "fiscal_year").orderBy(F.desc("usd_m"), "ticker")
    return _facts(spark, sf_dir).select("metric", "fiscal_year", "ticker", "usd_m", F.row_number().over(w).alias("place"))


def top_bottom_company(spark, sf_dir):
    f = _facts(spark, sf_dir).groupBy("metric", "fiscal_year")
    g = f.agg(F.count("*").alias("n"), F.min_by("ticker", F.struct(-F.col("usd_m"), F.col("ticker"))).alias("top"), F.min_by("ticker", F.struct("usd_m", "ticker")).alias("bottom"))
    return g.where("n >= 3")


def ratio_margin(spark, sf_dir):
    return fx.margins(_facts(spark, sf_dir))


def margin_change(spark, sf_dir):
    w = Window.partitionBy("ticker", "metric").orderBy("fiscal_year")
    m = fx.margins(_facts(spark, sf_dir)).withColumn("prev_year", F.lag("fiscal_year").over(w)).withColumn("prev", F.lag("ratio").over(w))
    return m.where("prev_year is not null").select("ticker", "metric", "prev_year", "fiscal_year", F.round(F.col("ratio") - F.col("prev"), 3).alias("points"))


def cagr(spark, sf_dir):
    return fx.growth(_facts(spark, sf_dir))


def yoy_change(spark, sf_dir):
    return fx.year_on_year(_facts(spark, sf_dir))


def yoy_plausibility(spark, sf_dir):
    return fx.implausible_series(_facts(spark, sf_dir))


def pairwise_gap(spark, sf_dir):
    return fx.peer_gaps(_facts(spark, sf_dir))


def trend_series(spark, sf_dir):
    return fx.trend(_facts(spark, sf_dir))


def per_group_cap(spark, sf_dir):
    """At most two facts of a company: the largest ones."""
    w = Window.partitionBy("ticker").orderBy(F.desc(F.abs("usd_m")), "metric", "fiscal_year")
    return _facts(spark, sf_dir).withColumn("n", F.row_number().over(w)).where("n <= 2").select("ticker", "n", "metric", "fiscal_year", "usd_m")


def chart_series(spark, sf_dir):
    """Revenue by year of companies with two points or more, net sales where revenue is missing."""
    f = _facts(spark, sf_dir).where("metric in ('Total Revenue', 'Net Sales')")
    g = f.groupBy("ticker", "fiscal_year").agg(F.max(F.when(F.col("metric") == "Total Revenue", F.col("usd_m"))).alias("rev"), F.max(F.when(F.col("metric") == "Net Sales", F.col("usd_m"))).alias("sales"))
    g = g.select("ticker", "fiscal_year", F.coalesce("rev", "sales").alias("usd_m"), F.when(F.col("rev").isNull(), "Net Sales").otherwise("Total Revenue").alias("label"))
    return g.withColumn("points", F.count("*").over(Window.partitionBy("ticker"))).where("points >= 2")


def format_fact(spark, sf_dir):
    return _facts(spark, sf_dir).select("ticker", "metric", "fiscal_year", fx.format_fact(F.col("value"), F.col("unit")).alias("shown"))


def fact_provenance_join(spark, sf_dir):
    """Facts with the document, item and title of the chunk that they come from."""
    c = table(spark, sf_dir, "chunks").groupBy(F.col("id").alias("chunk_id")).agg(F.min("doc_id").alias("doc_id"), F.min("item").alias("item"), F.min("title").alias("title"))
    return _facts(spark, sf_dir).join(c, "chunk_id").select("ticker", "metric", "fiscal_year", "chunk_id", "doc_id", "item", "title")


def exclude_facts(spark, sf_dir):
    """Facts whose chunk still stands."""
    gone = table(spark, sf_dir, "chunks").groupBy(F.col("id").alias("chunk_id")).agg(F.bool_or(F.col("deleted_at").isNull()).alias("stands")).where("not stands")
    return _facts(spark, sf_dir).join(gone, "chunk_id", "left_anti").select("ticker", "metric", "fiscal_year", "usd_m")


def facts_block(spark, sf_dir):
    f = _facts(spark, sf_dir)
    rows = F.array_sort(F.collect_list(F.struct("metric", F.concat(F.col("metric"), F.lit(": "), fx.format_fact(F.col("value"), F.col("unit"))).alias("t"))))
    return f.groupBy("ticker", "fiscal_year").agg(F.array_join(F.transform(rows, lambda r: r["t"]), "\n").alias("block"))


def fact_screens(spark, sf_dir):
    """Facts that stand in their chunk as written, from a floor of one million on."""
    c = table(spark, sf_dir, "chunks").select(F.col("id").alias("chunk_id"), "text").distinct()
    shown = F.format_number(F.abs("value"), 0)
    j = _facts(spark, sf_dir).join(c, "chunk_id").where(F.contains(F.col("text"), shown) & (F.abs("usd_m") >= 1.0))
    return j.select("ticker", "metric", "fiscal_year", "usd_m").distinct()


def scope_cross_lookup(spark, sf_dir):
    """The years of a company that a metric of its own has no fact for."""
    f = _facts(spark, sf_dir)
    grid = f.select("ticker", "metric").distinct().join(f.select("ticker", "fiscal_year").distinct(), "ticker")
    return grid.join(f, ["ticker", "metric", "fiscal_year"], "left_anti")


def clarify_missing_year(spark, sf_dir):
    """For each series with a gap: the years that are missing, and those that are held."""
    f = _facts(spark, sf_dir).groupBy("ticker", "metric").agg(F.array_sort(F.collect_set("fiscal_year")).alias("held"))
    gap = F.array_except(F.sequence(F.array_min("held"), F.array_max("held")), F.col("held"))
    text = lambda a: F.array_join(F.transform(a, lambda y: y.cast("string")), ", ")
    return f.where(F.size(gap) > 0).select("ticker", "metric", text(F.array_sort(gap)).alias("missing"), text(F.col("held")).alias("held"))


def header_asof(spark, sf_dir):
    """Table lines of the sections with the header years in force."""
    s = table(spark, sf_dir, "sections").where("text like '%|%'").select("section_key", "text").distinct()
    t = fx.annotated(fx.lines(s, "section_key"), "section_key").where(F.col("line").contains("|"))
    return t.select("section_key", "line_no", F.array_join(F.transform("years", lambda y: y.cast("string")), ",").alias("years"))


def unit_asof(spark, sf_dir):
    """Table lines of the sections with the unit that stands at most 20 lines above."""
    s = table(spark, sf_dir, "sections").where("text like '%|%'").select("section_key", "text").distinct()
    t = fx.annotated(fx.lines(s, "section_key"), "section_key").where(F.col("line").contains("|"))
    return t.select("section_key", "line_no", "unit")


def parse_cell(spark, sf_dir):
    """Distinct table cells of the chunks with their figure."""
    c = table(spark, sf_dir, "chunks").where("text like '%|%'")
    cells = fx.lines(c, "id").where(F.col("line").contains("|")).select(F.explode(F.split("line", r"\|")).alias("cell")).select(F.trim("cell").alias("cell"))
    return cells.distinct().select("cell", cell_value(F.col("cell")).alias("value"), F.endswith(F.col("cell"), F.lit("%")).alias("is_pct"))


def metric_match(spark, sf_dir):
    """Row labels of the chunks, how often they stand there, and their metric."""
    c = table(spark, sf_dir, "chunks").where("text like '%|%'")
    labels = fx.lines(c, "id").where(F.col("line").contains("|")).select(F.trim(F.get(F.split("line", r"\|"), F.lit(0))).alias("label"))
    return labels.groupBy("label").agg(F.count("*").alias("n")).select("label", "n", fx.metric_of(F.col("label")).alias("metric"))


_UNIT = "CASE WHEN regexp_matches(lower(line), '\\(?(?:dollars )?in (?:thousands|millions|billions)') THEN CASE WHEN contains(lower(line), 'thousands') THEN 'USD_TH' WHEN contains(lower(line), 'billions') THEN 'USD_B' ELSE 'USD_M' END END"
_YEARS = "CASE WHEN contains(line, '|') AND len(ys) > 0 AND len(ys) >= len(cells) - 1 THEN ys END"
_CELL = r"CASE WHEN regexp_matches(trim(c), '^[$€£() %\t]*[\d,]*\d[\d,]*(?:\.\d+)?[$€£() %\t]*$') THEN try_cast(replace(regexp_extract(c, '[\d,]+(?:\.\d+)?'), ',', '') AS DOUBLE) * CASE WHEN contains(c, '(') AND contains(c, ')') THEN -1 ELSE 1 END END"
_METRIC_ROWS = ", ".join("('{}', '{}')".format(p.replace("'", "''"), m) for p, m in fx.METRICS)
_LOW = r"regexp_replace(regexp_replace(lower(trim(label)), '\s*\(\d+\)\s*$', ''), '[: ]+$', '')"
_METRIC = f"(SELECT m FROM (VALUES {_METRIC_ROWS}) v(p, m) WHERE starts_with({_LOW}, p) AND length({_LOW}) - length(p) <= 30 ORDER BY length(p) DESC LIMIT 1)"


def _lines(source: str, keys: str) -> str:
    return f"""src AS ({source}),
numbered AS (SELECT {keys}, unnest(range(1, len(ls) + 1)) AS line_no, ls FROM (SELECT {keys}, string_split(text, chr(10)) AS ls FROM src)),
ln AS (SELECT {keys}, line_no, ls[line_no] AS line FROM numbered),
cut AS (SELECT *, list_transform(string_split(line, '|'), lambda x: trim(x)) AS cells FROM ln),
marked AS (SELECT *, list_filter(cells, lambda x: regexp_full_match(x, '(?:19[6-9]\\d|20[0-4]\\d)')) AS ys FROM cut),
annotated AS (
  SELECT {keys}, line_no, line, cells, {_YEARS} AS own_years, last_value({_YEARS} IGNORE NULLS) OVER (PARTITION BY {keys} ORDER BY line_no) AS years,
    last_value({_UNIT} IGNORE NULLS) OVER (PARTITION BY {keys} ORDER BY line_no RANGE BETWEEN 20 PRECEDING AND CURRENT ROW) AS unit
  FROM marked)"""


_LABELS = r"""labels AS (SELECT DISTINCT trim(string_split(line, '|')[1]) AS label FROM annotated WHERE contains(line, '|')),
named AS (SELECT label, """ + _METRIC + r""" AS metric FROM labels)"""
_EXTRACT = (
    "WITH "
    + _lines("SELECT DISTINCT id, ticker, item, text FROM chunks WHERE ticker IS NOT NULL AND text LIKE '%|%'", "id, ticker, item")
    + ", "
    + _LABELS
    + f""",
valued AS (
  SELECT id, ticker, item, line_no, years, unit, metric, list_filter(list_transform(cells[2:], lambda c: {_CELL}), lambda v: v IS NOT NULL) AS vs
  FROM annotated a JOIN named n ON n.label = a.cells[1] WHERE years IS NOT NULL AND own_years IS NULL AND contains(line, '|') AND metric IS NOT NULL),
paired AS (SELECT *, unnest(range(1, least(len(years), len(vs)) + 1)) AS position FROM valued),
facts0 AS (
  SELECT DISTINCT ticker, metric, CAST(years[position] AS INT) AS fiscal_year, vs[position] AS value, coalesce(unit, 'USD_M') AS unit, id AS chunk_id, line_no, position, CAST(item = '8' AS INT) AS priority
  FROM paired)"""
)
_FACTS = (
    _EXTRACT
    + """,
facts AS (
  SELECT ticker, metric, fiscal_year, value, unit, chunk_id, round(value * CASE unit WHEN 'USD_TH' THEN 0.001::DOUBLE WHEN 'USD_B' THEN 1000.0::DOUBLE ELSE 1.0::DOUBLE END, 6) AS usd_m
  FROM facts0 QUALIFY row_number() OVER (PARTITION BY ticker, metric, fiscal_year ORDER BY priority DESC NULLS LAST, chunk_id, line_no, position, value) = 1)
"""
)
_SECTION_LINES = "WITH " + _lines("SELECT DISTINCT section_key, text FROM sections WHERE text LIKE '%|%'", "section_key")
_SHOWN = """CASE WHEN value < 0 THEN '-$' ELSE '$' END ||
  CASE WHEN format('{:,.2f}', abs(value)) LIKE '%.00' THEN regexp_replace(format('{:,.2f}', abs(value)), '\\.00$', '') ELSE regexp_replace(format('{:,.2f}', abs(value)), '\\.?0+$', '') END ||
  CASE unit WHEN 'USD_TH' THEN ' thousand' WHEN 'USD_B' THEN ' billion' ELSE ' million' END"""
_RATIO = """,
rev AS (SELECT ticker, fiscal_year, max(usd_m) FILTER (WHERE metric = 'Total Revenue') AS r, max(usd_m) FILTER (WHERE metric = 'Net Sales') AS s FROM facts GROUP BY ALL),
margins AS (
  SELECT f.ticker, f.fiscal_year, f.metric, round(f.usd_m / coalesce(r, s) * 100, 4) AS ratio FROM facts f JOIN rev USING (ticker, fiscal_year)
  WHERE f.metric IN ('Gross Profit', 'Operating Income', 'Net Income', 'R&D Expense', 'Free Cash Flow') AND coalesce(r, s) <> 0)
"""

QUERIES = {
    f.__name__: f
    for f in (
        extract_facts, fact_merge, latest_fact, metric_history, compare_metrics, top_bottom_company, ratio_margin, margin_change, cagr, yoy_change, yoy_plausibility, pairwise_gap, trend_series,
        per_group_cap, chart_series, format_fact, fact_provenance_join, exclude_facts, facts_block, fact_screens, scope_cross_lookup, clarify_missing_year, header_asof, unit_asof, parse_cell, metric_match,
    )
}
SQL = {
    "extract_facts": _EXTRACT + "SELECT * FROM facts0",
    "fact_merge": _FACTS + "SELECT * FROM facts",
    "latest_fact": _FACTS + "SELECT ticker, metric, fiscal_year, usd_m, chunk_id FROM facts QUALIFY row_number() OVER (PARTITION BY ticker, metric ORDER BY fiscal_year DESC) = 1",
    "metric_history": _FACTS + "SELECT ticker, metric, count(*) AS n_years, string_agg(fiscal_year || '=' || CAST(CAST(usd_m AS DECIMAL(24,6)) AS VARCHAR), '; ' ORDER BY fiscal_year) AS history FROM facts GROUP BY ALL",
    "compare_metrics": _FACTS + "SELECT metric, fiscal_year, ticker, usd_m, row_number() OVER (PARTITION BY metric, fiscal_year ORDER BY usd_m DESC, ticker) AS place FROM facts",
    "top_bottom_company": _FACTS
    + "SELECT metric, fiscal_year, count(*) AS n, arg_min(ticker, struct_pack(a := -usd_m, b := ticker)) AS top, arg_min(ticker, struct_pack(a := usd_m, b := ticker)) AS bottom FROM facts GROUP BY ALL HAVING count(*) >= 3",
    "ratio_margin": _FACTS + _RATIO + "SELECT * FROM margins",
    "margin_change": _FACTS
    + _RATIO
    + "SELECT ticker, metric, prev_year, fiscal_year, round(ratio - prev, 3) AS points FROM (SELECT *, lag(fiscal_year) OVER w AS prev_year, lag(ratio) OVER w AS prev FROM margins WINDOW w AS (PARTITION BY ticker, metric ORDER BY fiscal_year)) WHERE prev_year IS NOT NULL",
    "cagr": _FACTS
    + "SELECT ticker, metric, y0, y1, round((pow(v1 / v0, 1.0::DOUBLE / (y1 - y0)) - 1) * 100, 4) AS cagr_pct FROM (SELECT ticker, metric, min(fiscal_year) AS y0, max(fiscal_year) AS y1, arg_min(usd_m, fiscal_year) AS v0, arg_max(usd_m, fiscal_year) AS v1 FROM facts GROUP BY ALL) WHERE v0 > 0 AND v1 > 0 AND y1 > y0",
    "yoy_change": _FACTS
    + "SELECT ticker, metric, prev_year, fiscal_year, round(abs(usd_m - prev), 4) AS delta, round(abs(usd_m - prev) / nullif(abs(prev), 0) * 100, 4) AS pct FROM (SELECT *, lag(fiscal_year) OVER w AS prev_year, lag(usd_m) OVER w AS prev FROM facts WINDOW w AS (PARTITION BY ticker, metric ORDER BY fiscal_year)) WHERE prev_year IS NOT NULL",
    "yoy_plausibility": _FACTS
    + "SELECT ticker, metric, round(max(swing), 6) AS max_swing, count(*) AS n_years, coalesce(round(max(swing), 6) <= 0.75, true) AS plausible FROM (SELECT *, abs(usd_m - lag(usd_m) OVER w) / greatest(abs(usd_m), abs(lag(usd_m) OVER w), 1.0) AS swing FROM facts WINDOW w AS (PARTITION BY ticker, metric ORDER BY fiscal_year)) GROUP BY ticker, metric",
    "pairwise_gap": _FACTS
    + "SELECT metric, fiscal_year, ticker, row_number() OVER w AS place, round(first_value(usd_m) OVER w - usd_m, 4) AS gap_to_leader, round(lag(usd_m) OVER w - usd_m, 4) AS gap_to_next FROM facts WINDOW w AS (PARTITION BY metric, fiscal_year ORDER BY usd_m DESC, ticker)",
    "trend_series": _FACTS
    + ", g AS (SELECT ticker, metric, min(fiscal_year) AS y0, max(fiscal_year) AS y1, arg_min(usd_m, fiscal_year) AS v0, arg_max(usd_m, fiscal_year) AS v1 FROM facts GROUP BY ALL HAVING count(*) >= 3), y AS (SELECT ticker, metric, CASE WHEN v1 > v0 THEN 'increasing' WHEN v1 < v0 THEN 'decreasing' ELSE 'flat' END AS direction, CAST(unnest(range(y0, y1 + 1)) AS INT) AS fiscal_year FROM g) SELECT y.*, f.usd_m FROM y LEFT JOIN facts f USING (ticker, metric, fiscal_year)",
    "per_group_cap": _FACTS + "SELECT ticker, n, metric, fiscal_year, usd_m FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY abs(usd_m) DESC, metric, fiscal_year) AS n FROM facts) WHERE n <= 2",
    "chart_series": _FACTS
    + ", g AS (SELECT ticker, fiscal_year, max(usd_m) FILTER (WHERE metric = 'Total Revenue') AS r, max(usd_m) FILTER (WHERE metric = 'Net Sales') AS s FROM facts WHERE metric IN ('Total Revenue', 'Net Sales') GROUP BY ALL) SELECT ticker, fiscal_year, coalesce(r, s) AS usd_m, CASE WHEN r IS NULL THEN 'Net Sales' ELSE 'Total Revenue' END AS label, count(*) OVER (PARTITION BY ticker) AS points FROM g QUALIFY points >= 2",
    "format_fact": _FACTS + f"SELECT ticker, metric, fiscal_year, {_SHOWN} AS shown FROM facts",
    "fact_provenance_join": _FACTS
    + "SELECT ticker, metric, fiscal_year, chunk_id, doc_id, item, title FROM facts JOIN (SELECT id AS chunk_id, min(doc_id) AS doc_id, min(item) AS item, min(title) AS title FROM chunks GROUP BY id) USING (chunk_id)",
    "exclude_facts": _FACTS + "SELECT ticker, metric, fiscal_year, usd_m FROM facts WHERE chunk_id IN (SELECT id FROM chunks WHERE deleted_at IS NULL)",
    "facts_block": _FACTS + f"SELECT ticker, fiscal_year, string_agg(metric || ': ' || {_SHOWN}, chr(10) ORDER BY metric) AS block FROM facts GROUP BY ALL",
    "fact_screens": _FACTS
    + "SELECT DISTINCT ticker, metric, fiscal_year, usd_m FROM facts JOIN (SELECT DISTINCT id AS chunk_id, text FROM chunks) USING (chunk_id) WHERE contains(text, format('{:,}', CAST(round_even(abs(value), 0) AS BIGINT))) AND abs(usd_m) >= 1.0",
    "scope_cross_lookup": _FACTS
    + "SELECT * FROM (SELECT DISTINCT ticker, metric FROM facts) JOIN (SELECT DISTINCT ticker, fiscal_year FROM facts) USING (ticker) WHERE NOT EXISTS (SELECT 1 FROM facts f WHERE f.ticker = ticker AND f.metric = metric AND f.fiscal_year = fiscal_year)",
    "clarify_missing_year": _FACTS
    + ", g AS (SELECT ticker, metric, list_sort(list(DISTINCT fiscal_year)) AS held FROM facts GROUP BY ALL), m AS (SELECT *, list_filter(range(held[1], held[-1] + 1), lambda y: NOT list_contains(held, y)) AS gap FROM g) SELECT ticker, metric, array_to_string(gap, ', ') AS missing, array_to_string(held, ', ') AS held FROM m WHERE len(gap) > 0",
    "header_asof": _SECTION_LINES + "SELECT section_key, line_no, array_to_string(years, ',') AS years FROM annotated WHERE contains(line, '|')",
    "unit_asof": _SECTION_LINES + "SELECT section_key, line_no, unit FROM annotated WHERE contains(line, '|')",
    "parse_cell": f"SELECT c AS cell, {_CELL} AS value, ends_with(c, '%') AS is_pct FROM (SELECT DISTINCT trim(unnest(string_split(line, '|'))) AS c FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM chunks WHERE text LIKE '%|%') WHERE contains(line, '|'))",
    "metric_match": f"WITH labels AS (SELECT trim(string_split(line, '|')[1]) AS label, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM chunks WHERE text LIKE '%|%') WHERE contains(line, '|') GROUP BY 1) SELECT label, n, {_METRIC} AS metric FROM labels",
}
SQL["scope_cross_lookup"] = _FACTS + (
    "SELECT g.ticker, g.metric, g.fiscal_year FROM (SELECT DISTINCT a.ticker, a.metric, b.fiscal_year FROM facts a JOIN facts b USING (ticker)) g LEFT JOIN facts f USING (ticker, metric, fiscal_year) WHERE f.ticker IS NULL"
)
