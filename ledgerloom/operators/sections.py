"""From the lines of filings to their sections, and from pages to the rows of their data tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values. The header of an item, and what ends the line of a table of contents.
ITEM = r"(?i)^item\s+(\d{1,2})\s*([A-C])?\b[.:)\s—-]*(.*)$"
LEADER = r"[.\s…]{2,}\d+\s*$"
# Fixed values. Usual titles of the items.
TITLES = {
    "1": "Business", "1A": "Risk Factors", "1B": "Unresolved Staff Comments", "1C": "Cybersecurity", "2": "Properties", "3": "Legal Proceedings", "4": "Mine Safety Disclosures",
    "5": "Market for Registrant's Common Equity", "6": "[Reserved] / Selected Financial Data", "7": "Management's Discussion and Analysis", "7A": "Quantitative and Qualitative Disclosures About Market Risk",
    "8": "Financial Statements and Supplementary Data", "9": "Changes in and Disagreements with Accountants", "9A": "Controls and Procedures", "9B": "Other Information", "9C": "Foreign Jurisdiction Inspections",
    "10": "Directors, Executive Officers and Corporate Governance", "11": "Executive Compensation", "12": "Security Ownership", "13": "Certain Relationships and Related Transactions", "14": "Principal Accountant Fees",
    "15": "Exhibits, Financial Statement Schedules", "16": "Form 10-K Summary",
}
MIN_CHARS, TITLE_CHARS = 200, 90


def item_number(item: Column) -> Column:
    return F.regexp_extract(item, r"^(\d+)", 1).try_cast("int")


def part_of(item: Column) -> Column:
    n = item_number(item)
    return F.when(n <= 4, "I").when(n <= 9, "II").when(n <= 14, "III").otherwise("IV")


def clean_title(item: Column, raw: Column) -> Column:
    """A title without dot leaders; a missing or too long one gives way to the usual title of its item."""
    title = F.regexp_replace(F.regexp_replace(raw, LEADER, ""), r"^[ .:\-—]+|[ .:\-—]+$", "")
    usual = F.try_element_at(F.create_map(*[F.lit(x) for kv in TITLES.items() for x in kv]), item)
    short = F.when(title == "", "(untitled)").otherwise(F.substring(title, 1, TITLE_CHARS))
    return F.when((title == "") | (F.length(title) > TITLE_CHARS), F.coalesce(usual, short)).otherwise(title)


def headers(lines: DataFrame, doc: str) -> DataFrame:
    """(doc, line_no, item, rest, body) of the lines that look like an item's header; ``body`` is the number of characters up to the next one."""
    w = Window.partitionBy(doc).orderBy("line_no")
    upto = F.sum(F.length("line") + 1).over(w)
    t = lines.select(doc, "line_no", "line", (upto - F.length("line") - 1).alias("start"))
    total = F.max(F.col("start") + F.length("line") + 1).over(Window.partitionBy(doc))
    t = t.withColumn("total", total).where(F.col("line").rlike(ITEM))
    item = F.concat(F.regexp_extract("line", ITEM, 1), F.upper(F.regexp_extract("line", ITEM, 2)))
    body = F.coalesce(F.lead("start").over(w), F.col("total")) - F.col("start")
    return t.select(doc, "line_no", item.alias("item"), F.regexp_extract("line", ITEM, 3).alias("rest"), body.alias("body"))


def spine(lines: DataFrame, doc: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, line_no, item, rest): the header chosen for each item.

    What stands before the Item 1 with the longest body is front matter. Of each item the header with the longest body
    is chosen; where that one is bare, the one with the longest body of at least ``min_chars`` among the titled ones.
    """
    h = headers(lines, doc)
    order = F.struct("body", -F.col("line_no"))
    anchor = F.max_by(F.when(F.col("item") == "1", F.col("line_no")), F.when(F.col("item") == "1", order)).over(Window.partitionBy(doc))
    h = h.withColumn("anchor", anchor).where(F.col("anchor").isNull() | (F.col("line_no") >= F.col("anchor")))
    of_item = Window.partitionBy(doc, "item")
    bare = F.trim(F.max_by("rest", order).over(of_item)) == ""
    owns = (F.trim("rest") != "") & (F.col("body") >= min_chars)
    h = h.withColumn("first", (bare & owns).cast("int"))
    place = F.row_number().over(of_item.orderBy(F.desc("first"), F.desc("body"), "line_no"))
    return h.withColumn("place", place).where("place = 1").select(doc, "line_no", "item", "rest")


def item_sections(lines: DataFrame, doc: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, item, part, title, text): from each chosen header to the next; shorter sections than ``min_chars`` are stubs."""
    marked = lines.select(doc, "line_no", "line").join(spine(lines, doc, min_chars), [doc, "line_no"], "left")
    w = Window.partitionBy(doc).orderBy("line_no")
    own = F.last(F.when(F.col("item").isNotNull(), F.struct("item", "rest")), ignorenulls=True).over(w)
    rows = marked.select(doc, "line_no", "line", own.alias("own")).where("own is not null")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    s = rows.groupBy(doc, "own.item").agg(F.first("own.rest").alias("rest"), text.alias("text")).where(F.length("text") >= min_chars)
    return s.select(doc, "item", part_of(F.col("item")).alias("part"), clean_title(F.col("item"), F.col("rest")).alias("title"), "text")


def outline(sections: DataFrame, doc: str) -> DataFrame:
    """(doc, no, entry): the items in their order, with a line for a part where it changes."""
    w = Window.partitionBy(doc).orderBy(item_number(F.col("item")), F.regexp_extract("item", r"([A-C]?)$", 1))
    t = sections.select(doc, "item", "part", "title").withColumn("no", F.row_number().over(w))
    change = F.lag("part").over(w).isNull() | (F.lag("part").over(w) != F.col("part"))
    entry = F.concat(F.lit("  Item "), "item", F.lit(": "), "title")
    return t.select(doc, "no", F.when(change, F.concat(F.lit("Part "), "part", F.lit("\n"), entry)).otherwise(entry).alias("entry"))


class _Tables(HTMLParser):
    """Rows of the outermost tables; text of inner ones belongs to the cell around them."""

    def __init__(self) -> None:
        super().__init__()
        self.depth, self.tables, self.cell = 0, [], None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.tables.append([])
        elif self.depth == 1 and tag == "tr":
            self.tables[-1].append([])
        elif self.depth == 1 and tag in ("td", "th") and self.tables[-1]:
            self.cell = []
            self.tables[-1][-1].append(self.cell)
        elif self.cell is not None:
            self.cell.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag == "table":
            self.depth = max(0, self.depth - 1)
        if self.depth == 1 and tag in ("td", "th"):
            self.cell = None

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)


FIGURE = re.compile(r"[$()\d.,%\-—–]+")


def table_lines(html: str | None) -> list[list[str]]:
    """The lines of each data table of a page: cells joined by bars, a currency sign joined to its figure. A data table has
    two rows of several cells and figures in a quarter of its cells."""
    parser = _Tables()
    parser.feed(html or "")
    parser.close()
    out = []
    for table in parser.tables:
        rows = []
        for row in table:
            cells: list[str] = []
            for cell in ("".join(c).replace("\xa0", " ") for c in row):
                text = " ".join(cell.split())
                if text and cells and cells[-1] == "$":
                    cells[-1] = "$" + text
                elif text:
                    cells.append(text)
            if cells:
                rows.append(cells)
        flat = [c for r in rows for c in r]
        if sum(len(r) >= 2 for r in rows) >= 2 and sum(bool(FIGURE.fullmatch(c)) for c in flat) >= 0.25 * len(flat):
            out.append([" | ".join(r) for r in rows])
    return out


def data_tables(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, table_no, row_no, line) of the data tables of each page."""
    kind = pages.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, t, r, line) for k, h in zip(f[key], f[html], strict=True) for t, lines in enumerate(table_lines(h), 1) for r, line in enumerate(lines, 1)]
            yield pd.DataFrame(rows, columns=[key, "table_no", "row_no", "line"])

    return pages.select(key, html).mapInPandas(run, f"{key} {kind}, table_no int, row_no int, line string")
