"""Queries on filings: sections from lines, outlines, data tables, periods and the filing of a period; and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.operators import sections as sc
from ledgerloom.tables import table

#: Days after the end of a period by which a filing is looked for, and by which it may be off.
FILED_AFTER, NEAR_DAYS = 60, 20


def _filing_lines(spark, sf_dir):
    """The lines of each filing, put together from its sections: a table of contents, then each item's header and text."""
    s = table(spark, sf_dir, "sections").where("doc_type = '10-K' and item is not null and text is not null")
    s = s.groupBy("doc_id", "item").agg(F.min_by(F.struct(F.coalesce("title", F.lit("")).alias("title"), "text"), F.struct("section_key", "text")).alias("s")).select("doc_id", "item", "s.*")
    place = F.struct(sc.item_number(F.col("item")).alias("n"), "item")
    head = F.concat(F.lit("Item "), "item", F.lit(". "), "title")
    contents = s.select("doc_id", F.lit(0).alias("half"), place.alias("place"), F.lit(0).alias("i"), F.concat(head, F.lit(" ..... "), F.length("text").cast("string")).alias("line"))
    lines = F.concat(F.array(head), F.split("text", "\n"))
    body = s.select("doc_id", F.lit(1).alias("half"), place.alias("place"), F.posexplode(lines).alias("i", "line"))
    order = Window.partitionBy("doc_id").orderBy("half", "place", "i")
    return contents.unionByName(body).withColumn("line_no", F.row_number().over(order)).select("doc_id", "line_no", "line")


def item_headers(spark, sf_dir):
    return sc.headers(_filing_lines(spark, sf_dir), "doc_id").select("doc_id", "line_no", "item", F.md5("rest").alias("rest"), "body")


def item_spine(spark, sf_dir):
    return sc.spine(_filing_lines(spark, sf_dir), "doc_id").select("doc_id", "line_no", "item")


def section_items(spark, sf_dir):
    s = sc.item_sections(_filing_lines(spark, sf_dir), "doc_id")
    return s.select("doc_id", "item", "part", "title", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def section_tree(spark, sf_dir):
    return sc.outline(sc.item_sections(_filing_lines(spark, sf_dir), "doc_id"), "doc_id")


def data_table_lines(spark, sf_dir):
    """Tables of the sections written as pages and read back: the rows that a data table keeps."""
    s = table(spark, sf_dir, "sections").where("text like '%|%'").select("section_key", F.filter(F.split("text", "\n"), lambda x: x.contains("|")).alias("rows")).distinct()
    cell = lambda c: F.concat(F.lit("<td>"), F.replace(F.replace(F.replace(F.trim(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("$"), F.lit("$</td><td>")), F.lit("</td>"))
    row = F.transform("rows", lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(F.split(r, r"\|"), cell), ""), F.lit("</tr>")))
    pages = s.select("section_key", F.concat(F.lit("<html><table>"), F.array_join(row, "\n"), F.lit("</table></html>")).alias("html"))
    t = sc.data_tables(pages, "section_key", "html")
    return t.groupBy("section_key").agg(F.count("*").alias("n_rows"), F.sum(F.size(F.split("line", r" \| "))).alias("n_cells"))


def period_ends(spark, sf_dir):
    """The end of each quarter of the fiscal years filed, the fiscal year ending with December."""
    f = table(spark, sf_dir, "chunks").where("doc_type = '10-K' and fiscal_year is not null").select("doc_id", "fiscal_year").distinct()
    end = F.make_date("fiscal_year", F.lit(12), F.lit(31))
    return f.select("doc_id", "fiscal_year", end.alias("year_end"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("quarter")).select(
        "doc_id", "fiscal_year", "quarter", F.date_format(F.add_months("year_end", -3 * (4 - F.col("quarter"))), "yyyy-MM-dd").alias("period_end")
    )


def _filed(spark, sf_dir):
    c = table(spark, sf_dir, "chunks").where("doc_type = '10-K' and filing_date is not null and ticker is not null")
    return c.groupBy("ticker", "doc_id").agg(F.min("filing_date").alias("filing_date"), F.max("fiscal_year").alias("fiscal_year"))


def filing_match(spark, sf_dir):
    """For each company and fiscal year the filing dated nearest to the usual day, at most some days off; the earlier of two."""
    f = _filed(spark, sf_dir)
    want = f.where("fiscal_year is not null").select("ticker", "fiscal_year").distinct().withColumn("target", F.date_add(F.make_date("fiscal_year", F.lit(12), F.lit(31)), FILED_AFTER))
    near = want.join(f.select("ticker", "doc_id", "filing_date"), "ticker").withColumn("gap", F.abs(F.datediff(F.col("filing_date").try_cast("date"), "target"))).where(F.col("gap") <= NEAR_DAYS)
    return near.groupBy("ticker", "fiscal_year").agg(F.min(F.struct("gap", "filing_date", "doc_id")).alias("f")).select("ticker", "fiscal_year", "f.doc_id", "f.gap")


def latest_filing(spark, sf_dir):
    return _filed(spark, sf_dir).groupBy("ticker").agg(F.max(F.struct("filing_date", "doc_id")).alias("f")).select("ticker", "f.doc_id", "f.filing_date")


def abstract_chunks(spark, sf_dir):
    """Sections of each abstract in order, with a label for those that have none."""
    c = table(spark, sf_dir, "chunks").where("doc_type = 'biomedical' and deleted_at is null").select("doc_id", "id", "item", "text").distinct()
    g = c.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("id", "item", "text"))).alias("s"))
    zipped = F.arrays_zip(F.transform("s", lambda x: x["text"]).alias("context"), F.transform("s", lambda x: x["item"]).alias("label"))
    e = g.select("doc_id", F.posexplode(zipped)).where("col.context is not null and trim(col.context) != ''")
    return e.select("doc_id", (F.col("pos") + 1).alias("no"), F.coalesce(F.nullif(F.trim("col.label"), F.lit("")), F.lit("ABSTRACT")).alias("label"), F.md5("col.context").alias("digest"))


def dump_counts(spark, sf_dir):
    """What a dump per company holds: chunks, their characters, sections, and chunks with tables."""
    c = table(spark, sf_dir, "chunks").where("ticker is not null").select("id", "ticker", "section_id", "has_table", F.length("text").alias("n"), "doc_id").distinct()
    return c.groupBy("ticker").agg(F.count("*").alias("n_chunks"), F.sum("n").alias("n_chars"), F.countDistinct("doc_id", "section_id").alias("n_sections"), F.count_if("has_table").alias("n_tables"))


_LINES = r"""
WITH s0 AS (SELECT doc_id, item, arg_min(struct_pack(title := coalesce(title, ''), text := text), struct_pack(a := section_key, b := text)) AS s FROM sections WHERE doc_type = '10-K' AND item IS NOT NULL AND text IS NOT NULL GROUP BY ALL),
s1 AS (SELECT doc_id, item, s.title AS title, s.text AS text, CAST(regexp_extract(item, '^(\d+)', 1) AS INT) AS n, string_split('Item ' || item || '. ' || s.title || chr(10) || s.text, chr(10)) AS ls FROM s0),
u AS (SELECT doc_id, 0 AS half, n, item, 0 AS i, 'Item ' || item || '. ' || title || ' ..... ' || length(text) AS line FROM s1 UNION ALL SELECT doc_id, 1, n, item, k, ls[k + 1] FROM (SELECT *, unnest(range(0, len(ls))) AS k FROM s1)),
ln AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY half, n, item, i) AS line_no, line FROM u),
st AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - length(line) - 1 AS start, sum(length(line) + 1) OVER (PARTITION BY doc_id) AS total FROM ln),
h AS (SELECT doc_id, line_no, regexp_extract(line, '{ITEM}', 1) || upper(regexp_extract(line, '{ITEM}', 2)) AS item, regexp_extract(line, '{ITEM}', 3) AS rest, CAST(coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY line_no), total) - start AS BIGINT) AS body FROM st WHERE regexp_matches(line, '{ITEM}')),
an AS (SELECT doc_id, arg_max(line_no, struct_pack(a := body, b := -line_no)) AS anchor FROM h WHERE item = '1' GROUP BY doc_id),
hk AS (SELECT h.* FROM h LEFT JOIN an USING (doc_id) WHERE anchor IS NULL OR line_no >= anchor),
wb AS (SELECT doc_id, item, trim(arg_max(rest, struct_pack(a := body, b := -line_no))) = '' AS bare FROM hk GROUP BY ALL),
sp AS (SELECT doc_id, line_no, item, rest FROM hk JOIN wb USING (doc_id, item) QUALIFY row_number() OVER (PARTITION BY doc_id, item ORDER BY CASE WHEN bare AND trim(rest) <> '' AND body >= 200 THEN 1 ELSE 0 END DESC, body DESC, line_no) = 1),
mk AS (SELECT doc_id, line_no, line, last_value(sp.item IGNORE NULLS) OVER w AS item, last_value(sp.rest IGNORE NULLS) OVER w AS rest FROM ln LEFT JOIN sp USING (doc_id, line_no) WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
sx AS (SELECT doc_id, item, first(rest) AS rest, string_agg(line, chr(10) ORDER BY line_no) AS text, CAST(regexp_extract(item, '^(\d+)', 1) AS INT) AS n FROM mk WHERE item IS NOT NULL GROUP BY doc_id, item),
tt AS (SELECT *, regexp_replace(regexp_replace(rest, '[.\s…]{2,}\d+\s*$', ''), '^[ .:\-—]+|[ .:\-—]+$', '', 'g') AS title0, MAP {TITLES} AS std FROM sx WHERE length(text) >= 200),
sec AS (SELECT doc_id, item, n, text, CASE WHEN n <= 4 THEN 'I' WHEN n <= 9 THEN 'II' WHEN n <= 14 THEN 'III' ELSE 'IV' END AS part, CASE WHEN title0 = '' OR length(title0) > 90 THEN coalesce(std[item], CASE WHEN title0 = '' THEN '(untitled)' ELSE title0[1:90] END) ELSE title0 END AS title FROM tt)
""".replace("{ITEM}", sc.ITEM.replace("'", "''")).replace("{TITLES}", "{" + ", ".join(f"'{k}': '{v.replace(chr(39), chr(39) * 2)}'" for k, v in sc.TITLES.items()) + "}")  # fmt: skip
_FILED = "WITH f AS (SELECT ticker, doc_id, min(filing_date) AS filing_date, max(fiscal_year) AS fiscal_year FROM chunks WHERE doc_type = '10-K' AND filing_date IS NOT NULL AND ticker IS NOT NULL GROUP BY ALL)\n"

QUERIES = {f.__name__: f for f in (item_headers, item_spine, section_items, section_tree, data_table_lines, period_ends, filing_match, latest_filing, abstract_chunks, dump_counts)}
SQL = {
    "item_headers": _LINES + "SELECT doc_id, line_no, item, md5(rest) AS rest, body FROM h",
    "item_spine": _LINES + "SELECT doc_id, line_no, item FROM sp",
    "section_items": _LINES + "SELECT doc_id, item, part, title, length(text) AS n_chars, md5(text) AS digest FROM sec",
    "section_tree": _LINES
    + ", o AS (SELECT doc_id, item, part, title, row_number() OVER w AS no, lag(part) OVER w AS before FROM sec WINDOW w AS (PARTITION BY doc_id ORDER BY n, regexp_extract(item, '([A-C]?)$', 1))) SELECT doc_id, no, CASE WHEN before IS DISTINCT FROM part THEN 'Part ' || part || chr(10) ELSE '' END || '  Item ' || item || ': ' || title AS entry FROM o",
    "data_table_lines": r"""
WITH s AS (SELECT DISTINCT section_key, list_filter(string_split(text, chr(10)), lambda x: contains(x, '|')) AS rows FROM sections WHERE text LIKE '%|%'),
r AS (SELECT section_key, list_filter(list_transform(rows, lambda r: list_filter(list_transform(string_split(r, '|'), lambda c: trim(regexp_replace(c, '\s+', ' ', 'g'))), lambda c: c <> '')), lambda x: len(x) > 0) AS rows FROM s),
f AS (SELECT section_key, rows, flatten(rows) AS flat FROM r)
SELECT section_key, CAST(len(rows) AS BIGINT) AS n_rows, CAST(len(flat) AS BIGINT) AS n_cells FROM f WHERE len(list_filter(rows, lambda x: len(x) >= 2)) >= 2 AND len(list_filter(flat, lambda c: regexp_full_match(c, '[$()\d.,%\-—–]+'))) >= 0.25 * len(flat)""",
    "period_ends": "WITH f AS (SELECT DISTINCT doc_id, fiscal_year FROM chunks WHERE doc_type = '10-K' AND fiscal_year IS NOT NULL) SELECT doc_id, fiscal_year, CAST(q AS INT) AS quarter, strftime(make_date(fiscal_year, 12, 31) - to_months(CAST(3 * (4 - q) AS INT)), '%Y-%m-%d') AS period_end FROM f, range(1, 5) t(q)",
    "filing_match": _FILED
    + f"SELECT w.ticker, w.fiscal_year, arg_min(f.doc_id, struct_pack(a := gap, b := f.filing_date, c := f.doc_id)) AS doc_id, CAST(min(gap) AS INT) AS gap FROM (SELECT DISTINCT ticker, fiscal_year FROM f WHERE fiscal_year IS NOT NULL) w JOIN (SELECT *, try_cast(filing_date AS DATE) AS d FROM f) f ON f.ticker = w.ticker, LATERAL (SELECT abs(d - (make_date(w.fiscal_year, 12, 31) + {FILED_AFTER})) AS gap) g WHERE gap <= {NEAR_DAYS} GROUP BY ALL",
    "latest_filing": _FILED + "SELECT ticker, arg_max(doc_id, struct_pack(a := filing_date, b := doc_id)) AS doc_id, max(filing_date) AS filing_date FROM f GROUP BY ticker",
    "abstract_chunks": "WITH c AS (SELECT DISTINCT doc_id, id, item, text FROM chunks WHERE doc_type = 'biomedical' AND deleted_at IS NULL), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY id, item, text) AS no FROM c) SELECT doc_id, CAST(no AS INT) AS no, coalesce(nullif(trim(item), ''), 'ABSTRACT') AS label, md5(text) AS digest FROM k WHERE text IS NOT NULL AND trim(text) <> ''",
    "dump_counts": "SELECT ticker, count(*) AS n_chunks, CAST(sum(n) AS BIGINT) AS n_chars, count(DISTINCT struct_pack(a := doc_id, b := section_id)) FILTER (WHERE section_id IS NOT NULL) AS n_sections, count(*) FILTER (WHERE has_table) AS n_tables FROM (SELECT DISTINCT id, ticker, section_id, has_table, length(text) AS n, doc_id FROM chunks WHERE ticker IS NOT NULL) GROUP BY ticker",
}
