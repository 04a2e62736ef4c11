"""From documents to sections and chunks: line packing, chunking, splitting tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Sizes of sections and chunks in characters.
SECTION_CHARS, CHUNK_CHARS = 6000, 1800
TABLE = r"\|"
NOTE = r"(?i)^\s*(?:note\s+\d+\b|\d{1,2}\.\s+\p{Lu})"


def packed(lines: Column, limit: int | Column) -> Column:
    """Greedy packing of an array of lines: array of strings joined by line ends, each within the limit unless a line alone is longer."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def add(acc: Column, line: Column) -> Column:
        fits = acc["open"].isNotNull() & (F.length(acc["open"]) + 1 + F.length(line) <= limit)
        return F.when(fits, F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.lit("\n"), line).alias("open"))).otherwise(
            F.struct(F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))).alias("done"), line.alias("open"))
        )

    return F.aggregate(lines, empty, add, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def pack_sections(docs: DataFrame, key: str, text: str, limit: int = SECTION_CHARS) -> DataFrame:
    """(key, no, section) with the blank lines left out; a section is a run of whole lines."""
    rows = F.filter(F.split(F.col(text), "\n"), lambda x: x.rlike(r"[^ \t\r]"))
    return docs.select(key, F.posexplode(packed(rows, limit))).select(key, (F.col("pos") + 1).alias("no"), F.col("col").alias("section"))


def chunk_sections(sections: DataFrame, key: str, text: str, limit: int = CHUNK_CHARS) -> DataFrame:
    """(key, no, chunk, has_table, table_continuation, note_refs).

    Lines fall into blocks: a note's heading starts a block, a table's lines are one. The
    blocks are packed in order; a table above the limit is cut between rows, and each
    part after the first begins with its two header rows.
    """
    lines = sections.select(key, F.posexplode(F.split(F.col(text), "\n"))).select(key, F.col("pos").alias("i"), F.col("col").alias("line")).where(F.trim("line") != "")
    w = Window.partitionBy(key).orderBy("i")
    t = lines.withColumn("is_table", F.col("line").contains("|"))
    starts = F.lag("is_table").over(w).isNull() | (F.lag("is_table").over(w) != F.col("is_table")) | (~F.col("is_table") & F.col("line").rlike(NOTE)) | ~F.col("is_table")
    t = t.withColumn("block", F.sum(starts.cast("int")).over(w))
    blocks = t.groupBy(key, "block").agg(F.first("is_table").alias("is_table"), F.array_sort(F.collect_list(F.struct("i", "line"))).alias("rows"))
    rows = F.transform("rows", lambda r: r["line"])
    whole = F.array_join(rows, "\n")
    head = F.array_join(F.slice(rows, 1, 2), "\n")
    room = F.greatest(F.lit(limit) - F.length(head) - 1, F.lit(1))
    below = F.slice(rows, F.lit(3), F.greatest(F.size("rows") - 2, F.lit(1)))
    cut = F.transform(packed(below, room), lambda p: F.concat(head, F.lit("\n"), p))
    big = F.col("is_table") & (F.length(whole) > limit) & (F.size("rows") > 3)
    parts = blocks.select(key, "block", "is_table", F.posexplode(F.when(big, cut).otherwise(F.array(whole))), F.col("rows")[0]["line"].rlike(NOTE).alias("note"))
    parts = parts.select(key, "block", F.col("pos").alias("part"), F.col("col").alias("body"), "is_table", "note")
    seq = F.array_sort(F.collect_list(F.struct("block", "part", "body", "is_table", "note")))
    doc = parts.groupBy(key).agg(seq.alias("s"))
    start = F.struct(
        F.array().cast("array<struct<body:string,is_table:boolean,again:boolean>>").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(False).alias("tab"), F.lit(False).alias("again")
    )

    def push(acc: Column) -> Column:
        return F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(F.struct(acc["open"].alias("body"), acc["tab"].alias("is_table"), acc["again"].alias("again")))))

    def add(acc: Column, p: Column) -> Column:
        fits = acc["open"].isNotNull() & ~p["note"] & (p["part"] == 0) & (F.length(acc["open"]) + 1 + F.length(p["body"]) <= limit)
        joined = F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.lit("\n"), p["body"]).alias("open"), (acc["tab"] | p["is_table"]).alias("tab"), acc["again"].alias("again"))
        fresh = F.struct(push(acc).alias("done"), p["body"].alias("open"), p["is_table"].alias("tab"), (p["part"] > 0).alias("again"))
        return F.when(fits, joined).otherwise(fresh)

    made = doc.select(key, F.posexplode(F.aggregate("s", start, add, push))).select(key, (F.col("pos") + 1).alias("no"), "col.*")
    refs = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("body", F.lit(r"(?i)\bnote\s+(\d+)"), F.lit(1)), lambda x: x.try_cast("int"))))
    return made.select(key, "no", F.col("body").alias("chunk"), F.col("is_table").alias("has_table"), F.col("again").alias("table_continuation"), refs.alias("note_refs"))


def html_lines(html: Column) -> Column:
    """The text lines of a page: without scripts, styles, comments and tags, white space collapsed."""
    t = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<[^>]*>", "\n"), r"&nbsp;| ", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
