"""Sources and sinks: typed CSV and JSON lines, text and pages, append and latest-wins writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.operators.ingest import html_lines

MANIFEST = "ticker string, company string, cik bigint, filing_date string, source_url string, local_file string"
GOLDEN = (
    "id string, input string, expected struct<answer: string, citations: array<string>, type: string>, variation_rules array<string>, difficulty string, failure_category string, domain string, notes string"
)
RESULT = "case_id string, category string, refused boolean, citation_hit boolean, correct boolean, outcome string, latency_ms double, cost_usd double, answer string, citations array<string>"
VECTOR = "id string, embedding array<float>"


def read_csv(spark: SparkSession, path: str, schema: str = MANIFEST) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE")


def read_json_lines(spark: SparkSession, path: str | list[str], schema: str = GOLDEN, skip: str | None = None) -> DataFrame:
    """JSON lines under a schema that is given, not inferred; files whose name contains ``skip`` are left out."""
    df = spark.read.schema(schema).json(path)
    return df.where(~F.contains(F.input_file_name(), F.lit(skip))) if skip else df


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) of HTML files, one row for each line of text."""
    pages = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(html_lines(F.col("value"))))
    return pages.select("path", (F.col("pos") + 1).alias("line_no"), F.col("col").alias("line"))


def read_columns(df: DataFrame, *names: str) -> DataFrame:
    """Rows of a reply that holds parallel arrays."""
    zipped = F.arrays_zip(*[F.col(n) for n in names])
    return df.select(F.explode(zipped).alias("z")).select("z.*")


def append_rows(df: DataFrame, path: str) -> None:
    """Append as JSON lines, so that a run can go on where it stopped."""
    df.write.mode("append").json(path)


def remaining(cases: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The cases that no row of an earlier run covers."""
    return cases.join(done.select(key).distinct(), key, "left_anti")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last version of each key: what an upsert leaves."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def write_index(vectors: DataFrame, path: str, key: str) -> None:
    """Vectors with an ordinal that follows the order of their keys, without sorting in one task."""
    spark = vectors.sparkSession
    ranged = vectors.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), key).sortWithinPartitions(key)
    parts = ranged.withColumn("_part", F.spark_partition_id())
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b._part") < F.col("a._part"), "left").groupBy("a._part").agg(F.coalesce(F.sum("b._n"), F.lit(0)).alias("_before"))
    row = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    out = parts.withColumn("_row", row).join(F.broadcast(before.select(F.col("_part").alias("_p"), "_before")), F.col("_part") == F.col("_p"))
    out.withColumn("ordinal", F.col("_before") + F.col("_row") - 1).drop("_part", "_row", "_p", "_before").write.mode("overwrite").parquet(path)


