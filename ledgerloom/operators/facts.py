"""The fact table: figures of table rows in chunks, with provenance, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.text import cell_value

# Fixed values. Row labels and the metrics they stand for.
METRICS = (
    ("total net sales", "Net Sales"), ("net sales", "Net Sales"), ("total net revenue", "Total Revenue"), ("total revenue", "Total Revenue"), ("net revenues", "Total Revenue"),
    ("revenue", "Total Revenue"), ("net income", "Net Income"), ("net earnings", "Net Income"), ("operating income", "Operating Income"), ("operating profit", "Operating Income"),
    ("income from operations", "Operating Income"), ("gross margin", "Gross Margin"), ("gross profit", "Gross Profit"), ("cost of sales", "Cost of Sales"),
    ("cost of revenue", "Cost of Revenue"), ("operating expenses", "Operating Expenses"), ("research and development", "R&D Expense"), ("r&d", "R&D Expense"),
    ("selling, general and administrative", "SG&A Expense"), ("total assets", "Total Assets"), ("total liabilities", "Total Liabilities"),
    ("total stockholders' equity", "Stockholders Equity"), ("total shareholders' equity", "Stockholders Equity"), ("cash and cash equivalents", "Cash & Cash Equivalents"),
    ("cash generated by operating activities", "Operating Cash Flow"), ("net cash provided by operating activities", "Operating Cash Flow"),
    ("diluted earnings per share", "Diluted EPS"), ("diluted net income per share", "Diluted EPS"), ("diluted eps", "Diluted EPS"), ("free cash flow", "Free Cash Flow"),
    ("capital expenditures", "Capital Expenditures"),
)
#: A row whose label goes on for more characters is another item.
MAX_TRAILING = 30
#: A unit line counts for rows at most so many lines below it.
UNIT_REACH = 20


def metric_of(label: Column) -> Column:
    """The metric whose phrase starts the label, longest phrase first, without footnote marks."""
    low = F.regexp_replace(F.regexp_replace(F.lower(F.trim(label)), r"\s*\(\d+\)\s*$", ""), r"[: ]+$", "")
    found = F.lit(None).cast("string")
    for phrase, metric in sorted(METRICS, key=lambda x: len(x[0])):
        found = F.when(F.startswith(low, F.lit(phrase)) & (F.length(low) - len(phrase) <= MAX_TRAILING), metric).otherwise(found)
    return found


def lines(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, line_no, line), numbered from 1."""
    return df.select(*keys, F.posexplode(F.split(text, "\n"))).select(*keys, (F.col("pos") + 1).alias("line_no"), F.col("col").alias("line"))


def header_years(line: Column) -> Column:
    """The years of a header row; null for any other line."""
    cells = F.transform(F.split(line, r"\|"), lambda c: F.trim(c))
    found = F.filter(cells, lambda c: c.rlike(r"^(?:19[6-9]\d|20[0-4]\d)$"))
    return F.when(line.contains("|") & (F.size(found) > 0) & (F.size(found) >= F.size(cells) - 1), F.transform(found, lambda c: c.cast("int")))


def unit_of(line: Column) -> Column:
    low = F.lower(line)
    marked = low.rlike(r"\(?(?:dollars )?in (?:thousands|millions|billions)")
    return F.when(marked & low.contains("thousands"), "USD_TH").when(marked & low.contains("billions"), "USD_B").when(marked & low.contains("millions"), "USD_M")


def annotated(rows: DataFrame, *keys: str) -> DataFrame:
    """Table and unit lines with the last year header at or above (years) and the last unit within reach (unit)."""
    order = Window.partitionBy(*keys).orderBy("line_no")
    near = order.rangeBetween(-UNIT_REACH, 0)
    useful = rows.where(F.col("line").contains("|") | unit_of(F.col("line")).isNotNull())
    return useful.withColumn("years", F.last(header_years(F.col("line")), ignorenulls=True).over(order)).withColumn("unit", F.last(unit_of(F.col("line")), ignorenulls=True).over(near))


def extract_facts(chunks: DataFrame) -> DataFrame:
    """(ticker, metric, fiscal_year, value, unit, chunk_id, line_no, position, priority) of all table rows.

    Cells without a figure are skipped before figures meet years, as the source of
    these results does; ``priority`` is 1 in the financial statements.
    """
    rows = chunks.where("ticker is not null and text like '%|%'").select("id", "ticker", "item", "text").distinct()
    t = annotated(lines(rows, "id", "ticker", "item"), "id", "ticker", "item").where("years is not null")
    cells = F.split("line", r"\|")
    values = F.filter(F.transform(F.slice(cells, F.lit(2), F.size(cells)), cell_value), lambda v: v.isNotNull())
    t = t.where(header_years(F.col("line")).isNull()).select("*", metric_of(F.get(cells, F.lit(0))).alias("metric"), values.alias("values")).where("metric is not null and size(values) > 0")
    pairs = F.posexplode(F.arrays_zip(F.slice("years", F.lit(1), F.least(F.size("years"), F.size("values"))).alias("y"), F.slice("values", F.lit(1), F.least(F.size("years"), F.size("values"))).alias("v")))
    t = t.select("ticker", "metric", "unit", "id", "item", "line_no", pairs)
    return t.select(
        "ticker", "metric", F.col("col.y").alias("fiscal_year"), F.col("col.v").alias("value"), F.coalesce("unit", F.lit("USD_M")).alias("unit"), F.col("id").alias("chunk_id"), "line_no",
        (F.col("pos") + 1).alias("position"), (F.col("item") == "8").cast("int").alias("priority"),
    ).distinct()


def merge_facts(facts: DataFrame) -> DataFrame:
    """One fact per (ticker, metric, fiscal_year): the highest priority, then the first; ``usd_m`` in millions."""
    first = F.struct(-F.col("priority"), F.col("chunk_id"), F.col("line_no"), F.col("position"), F.col("value"))
    factor = F.when(F.col("f.unit") == "USD_TH", 0.001).when(F.col("f.unit") == "USD_B", 1000.0).otherwise(1.0)
    best = facts.groupBy("ticker", "metric", "fiscal_year").agg(F.min_by(F.struct("value", "unit", "chunk_id", "priority"), first).alias("f"))
    return best.select("ticker", "metric", "fiscal_year", "f.value", "f.unit", "f.chunk_id", F.round(F.col("f.value") * factor, 6).alias("usd_m"))


SERIES = ("ticker", "metric")


def year_on_year(facts: DataFrame) -> DataFrame:
    """Change against the previous year that the series has."""
    w = Window.partitionBy(*SERIES).orderBy("fiscal_year")
    f = facts.withColumn("prev_year", F.lag("fiscal_year").over(w)).withColumn("prev", F.lag("usd_m").over(w)).where("prev_year is not null")
    return f.select(
        "ticker", "metric", "prev_year", "fiscal_year", F.round(F.abs(F.col("usd_m") - F.col("prev")), 4).alias("delta"),
        F.round(F.abs(F.col("usd_m") - F.col("prev")) / F.nullif(F.abs("prev"), F.lit(0.0)) * 100, 4).alias("pct"),
    )


def implausible_series(facts: DataFrame, limit: float = 0.75) -> DataFrame:
    """Series with a swing of more than ``limit`` between neighbouring years."""
    w = Window.partitionBy(*SERIES).orderBy("fiscal_year")
    p = F.lag("usd_m").over(w)
    swing = F.abs(F.col("usd_m") - p) / F.greatest(F.abs("usd_m"), F.abs(p), F.lit(1.0))
    return facts.withColumn("swing", swing).groupBy(*SERIES).agg(F.round(F.max("swing"), 6).alias("max_swing"), F.count("*").alias("n_years")).withColumn("plausible", F.coalesce(F.col("max_swing") <= limit, F.lit(True)))


def margins(facts: DataFrame) -> DataFrame:
    """Ratios to revenue (total revenue, else net sales) of the same company and year."""
    m = facts.groupBy("ticker", "fiscal_year").agg(*[F.max(F.when(F.col("metric") == k, F.col("usd_m"))).alias(a) for k, a in (("Total Revenue", "rev"), ("Net Sales", "sales"))])
    num = facts.where(F.col("metric").isin("Gross Profit", "Operating Income", "Net Income", "R&D Expense", "Free Cash Flow"))
    den = F.coalesce("rev", "sales")
    j = num.join(m, ["ticker", "fiscal_year"]).where(den.isNotNull() & (den != 0))
    return j.select("ticker", "fiscal_year", "metric", F.round(F.col("usd_m") / den * 100, 4).alias("ratio"))


def growth(facts: DataFrame) -> DataFrame:
    """Compound annual growth between the first and the last year of each series."""
    g = facts.groupBy(*SERIES).agg(
        F.min("fiscal_year").alias("y0"), F.max("fiscal_year").alias("y1"), F.min_by("usd_m", "fiscal_year").alias("v0"), F.max_by("usd_m", "fiscal_year").alias("v1")
    )
    return g.where("v0 > 0 and v1 > 0 and y1 > y0").select("ticker", "metric", "y0", "y1", F.round((F.pow(F.col("v1") / F.col("v0"), 1.0 / (F.col("y1") - F.col("y0"))) - 1) * 100, 4).alias("cagr_pct"))


def peer_gaps(facts: DataFrame) -> DataFrame:
    """Each company against the leader and the next larger one in its (metric, year); no pairs are formed."""
    w = Window.partitionBy("metric", "fiscal_year").orderBy(F.desc("usd_m"), "ticker")
    g = facts.withColumn("place", F.row_number().over(w)).withColumn("next_up", F.lag("usd_m").over(w)).withColumn("leader", F.first("usd_m").over(w))
    return g.select(
        "metric", "fiscal_year", "ticker", "place", F.round(F.col("leader") - F.col("usd_m"), 4).alias("gap_to_leader"), F.round(F.col("next_up") - F.col("usd_m"), 4).alias("gap_to_next")
    )


def trend(facts: DataFrame) -> DataFrame:
    """A row for each year from the first to the last of series of three or more, with their direction."""
    g = facts.groupBy(*SERIES).agg(
        F.count("*").alias("n"), F.min("fiscal_year").alias("y0"), F.max("fiscal_year").alias("y1"), F.min_by("usd_m", "fiscal_year").alias("v0"), F.max_by("usd_m", "fiscal_year").alias("v1")
    ).where("n >= 3")
    word = F.when(F.col("v1") > F.col("v0"), "increasing").when(F.col("v1") < F.col("v0"), "decreasing").otherwise("flat")
    years = g.select(*SERIES, word.alias("direction"), F.explode(F.sequence("y0", "y1")).alias("fiscal_year"))
    return years.join(facts.select(*SERIES, "fiscal_year", "usd_m"), [*SERIES, "fiscal_year"], "left")


def format_fact(value: Column, unit: Column) -> Column:
    """$1,234.5 million without idle zeros; a minus stands before the sign."""
    figure = F.regexp_replace(F.format_number(F.abs(value), 2), r"\.?0+$", "")
    figure = F.when(F.format_number(F.abs(value), 2).endswith(".00"), F.regexp_replace(F.format_number(F.abs(value), 2), r"\.00$", "")).otherwise(figure)
    word = F.when(unit == "USD_TH", " thousand").when(unit == "USD_B", " billion").otherwise(" million")
    return F.concat(F.when(value < 0, "-$").otherwise("$"), figure, word)
