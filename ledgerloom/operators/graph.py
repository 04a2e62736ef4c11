"""The property graph of companies, filings, metrics and values, and walks on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.session import checkpointed


def _ids() -> dict[str, Column]:
    t = F.col("ticker")
    metric = F.replace(F.lower("metric"), F.lit(" "), F.lit("_"))
    return {
        "company": F.concat(F.lit("comp:"), t),
        "filing": F.concat(F.lit("filing:"), t, F.lit(":"), F.col("fiscal_year").cast("string")),
        "metric": F.concat(F.lit("metric:"), F.replace(metric, F.lit("&"), F.lit("and"))),
        "value": F.concat(F.lit("val:"), t, F.lit(":"), metric, F.lit(":"), F.col("fiscal_year").cast("string")),
        "chunk": F.concat(F.lit("chunk:"), F.col("chunk_id")),
    }


def nodes(facts: DataFrame) -> DataFrame:
    """(id, label): a node once, however many facts name it."""
    i = _ids()
    labels = {"company": "Company", "filing": "Filing", "metric": "FinancialMetric", "value": "MetricValue", "chunk": "Chunk"}
    each = F.explode(F.array(*[F.struct(i[k].alias("id"), F.lit(v).alias("label")) for k, v in labels.items()]))
    return facts.select(each.alias("n")).select("n.*").distinct()


def edges(facts: DataFrame) -> DataFrame:
    """(src, dst, relation) of the final facts, each edge once."""
    i = _ids()
    e = (("company", "filing", "REPORTED_IN"), ("filing", "value", "CONTAINS_METRIC"), ("metric", "value", "RECORDED_VALUE"), ("value", "chunk", "CITES_CHUNK"))
    each = F.explode(F.array(*[F.struct(i[a].alias("src"), i[b].alias("dst"), F.lit(r).alias("relation")) for a, b, r in e]))
    return facts.select(each.alias("e")).select("e.*").distinct()


def ego(edge_table: DataFrame, seeds: DataFrame, radius: int) -> DataFrame:
    """(seed, id, hops): the nodes within ``radius`` undirected steps of each seed; one join for each step."""
    both = checkpointed(edge_table.select("src", "dst").unionByName(edge_table.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    reached = seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("hops"))
    edge_of = reached
    for hop in range(1, radius + 1):
        step = edge_of.join(both, F.col("id") == F.col("src")).select("seed", F.col("dst").alias("id"), F.lit(hop).alias("hops")).distinct()
        edge_of = checkpointed(step.join(reached.select("seed", "id"), ["seed", "id"], "left_anti"))
        reached = reached.unionByName(edge_of)
    return reached


def components(edge_table: DataFrame) -> DataFrame:
    """(id, component): the least id of the connected component, by rounds of least labels until none changes."""
    both = checkpointed(edge_table.select("src", "dst").unionByName(edge_table.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    label = both.select(F.col("src").alias("id")).distinct().withColumn("component", F.col("id"))
    while True:
        near = both.join(label, F.col("dst") == F.col("id")).groupBy("src").agg(F.min("component").alias("near"))
        low = label.join(near, F.col("id") == F.col("src"), "left").select("id", "component", F.least("component", F.coalesce("near", "component")).alias("new"))
        # the label's own label: halves the way that is left
        jump = low.select(F.col("id").alias("rep"), F.col("new").alias("rep_new"))
        nxt = checkpointed(low.join(jump, F.col("new") == F.col("rep"), "left").select("id", "component", F.least("new", F.coalesce("rep_new", "new")).alias("new")))
        label = nxt.select("id", F.col("new").alias("component"))
        if nxt.where("component != new").isEmpty():
            return label


def neighbour_pairs(mentions: DataFrame, group: str, item: str) -> DataFrame:
    """(a, b, n): items that follow each other in the sorted distinct items of a group; a chain, not all pairs."""
    w = Window.partitionBy(group).orderBy(item)
    return mentions.select(group, item).distinct().select(F.lag(item).over(w).alias("a"), F.col(item).alias("b")).where("a is not null").groupBy("a", "b").agg(F.count("*").alias("n"))
