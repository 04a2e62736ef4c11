"""Queries on the graph, the sessions and their steps, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.operators import graph as gr
from ledgerloom.plans.facts import _FACTS, _facts
from ledgerloom.tables import table


def graph_nodes(spark, sf_dir):
    return gr.nodes(_facts(spark, sf_dir))


def graph_edges(spark, sf_dir):
    return gr.edges(_facts(spark, sf_dir))


def ego_graph(spark, sf_dir):
    """The nodes within two steps of every company."""
    f = _facts(spark, sf_dir)
    seeds = gr.nodes(f).where("label = 'Company'").select("id")
    return gr.ego(gr.edges(f), seeds, 2)


def graph_view(spark, sf_dir):
    """For each company its three latest filings and their six largest values."""
    f = _facts(spark, sf_dir)
    years = f.select("ticker", "fiscal_year").distinct().withColumn("k", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("fiscal_year")))).where("k <= 3").drop("k")
    w = Window.partitionBy("ticker", "fiscal_year").orderBy(F.desc("usd_m"), "metric")
    return f.join(years, ["ticker", "fiscal_year"], "left_semi").withColumn("place", F.row_number().over(w)).where("place <= 6").select("ticker", "fiscal_year", "metric", "place")


def chunk_components(spark, sf_dir):
    """Connected components of chunks that are cited together."""
    t = table(spark, sf_dir, "traces").select("trace_id", F.explode("citations").alias("c")).where("c is not null and c != ''").distinct()
    pairs = gr.neighbour_pairs(t, "trace_id", "c")
    comp = gr.components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return comp.groupBy("component").agg(F.count("*").alias("n"))


def cooccurrence_edges(spark, sf_dir):
    """Citations that stand next to each other in the sorted citations of a trace, with how often."""
    t = table(spark, sf_dir, "traces").select("trace_id", F.explode("citations").alias("c")).where("c is not null and c != ''")
    return gr.neighbour_pairs(t, "trace_id", "c")


def entity_mentions(spark, sf_dir):
    """Chunks whose text names the company that they belong to."""
    c = table(spark, sf_dir, "chunks").where("company is not null").select("id", "company", "text").distinct()
    return c.where(F.contains(F.lower("text"), F.lower("company"))).groupBy("company").agg(F.countDistinct("id").alias("n_chunks"))


def company_aliases(spark, sf_dir):
    c = table(spark, sf_dir, "chunks").where("company is not null").select("company").distinct()
    name = F.trim(F.regexp_replace(F.lower("company"), "[^a-z0-9]+", " "))
    first = F.get(F.split(name, " "), F.lit(0))
    alias = F.array_distinct(F.array_compact(F.array(name, F.when((F.length(first) >= 4) & ~first.isin("home", "bank"), first))))
    return c.select("company", F.explode(alias).alias("alias"))


def session_upsert(spark, sf_dir):
    """The latest save of every session."""
    s = table(spark, sf_dir, "sessions").where("session_id is not null")
    last = s.groupBy("session_id").agg(F.max_by(F.struct("strategy", F.nanvl("latency_ms", F.lit(None).cast("double")).alias("latency_ms"), "verified", "loaded_at"), F.struct("loaded_at", "latency_ms", "cost_usd")).alias("s"), F.countDistinct("loaded_at").alias("n_saves"))
    return last.select("session_id", "n_saves", "s.strategy", "s.latency_ms", "s.verified", F.date_format("s.loaded_at", "yyyy-MM-dd HH:mm:ss").alias("loaded_at"))


def session_history(spark, sf_dir):
    """The three latest sessions of every strategy."""
    s = table(spark, sf_dir, "sessions").where("session_id is not null").groupBy("session_id").agg(F.max_by("strategy", "loaded_at").alias("strategy"), F.max("created_at").alias("created_at"))
    w = Window.partitionBy("strategy").orderBy(F.desc("created_at"), "session_id")
    return s.withColumn("place", F.row_number().over(w)).where("place <= 3").select("strategy", "place", "session_id")


def transcript_window(spark, sf_dir):
    """The last six steps of every session as text, each cut to 400 characters."""
    t = table(spark, sf_dir, "trajectories").select("id", "session_id", "agent_name", "action", "payload", "logged_at").distinct().where("session_id is not null and session_id != ''")
    order = (F.desc("logged_at"), F.desc("id"))
    # A hot session is first cut to six steps in each of its parts.
    part = t.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64)))
    near = part.withColumn("k", F.row_number().over(Window.partitionBy("session_id", "part").orderBy(*order))).where("k <= 6")
    last = near.withColumn("k", F.row_number().over(Window.partitionBy("session_id").orderBy(*order))).where("k <= 6")
    steps = F.array_sort(F.collect_list(F.struct(-F.col("k"), F.substring(F.concat_ws(": ", "agent_name", "action", "payload"), 1, 400).alias("t"))))
    return last.groupBy("session_id").agg(F.array_join(F.transform(steps, lambda x: x["t"]), " > ").alias("transcript"))


def trajectory_steps(spark, sf_dir):
    """Steps of each session by agent, with the time since the step before."""
    t = table(spark, sf_dir, "trajectories").select("id", "session_id", "agent_name", "logged_at").distinct().where("session_id is not null and session_id != ''")
    # Day by day, so that a hot session is spread; the first step of a day follows the last one of an earlier day.
    t = t.select("id", "session_id", "agent_name", F.to_date("logged_at").alias("day"), F.unix_micros(F.col("logged_at").cast("timestamp")).alias("us"))
    days = t.groupBy("session_id", "day").agg(F.max("us").alias("last"))
    before = days.select("session_id", "day", F.lag("last").over(Window.partitionBy("session_id").orderBy("day")).alias("before"))
    step = F.lag("us").over(Window.partitionBy("session_id", "day").orderBy("us", "id"))
    d = t.withColumn("prev", step).join(before, ["session_id", "day"]).withColumn("gap", F.col("us") - F.coalesce("prev", "before"))
    return d.groupBy("agent_name").agg(F.count("*").alias("n"), F.count("gap").alias("n_gaps"), F.max("gap").alias("max_gap_us"))


def nearest_date_join(spark, sf_dir):
    """For each chunk that was deleted, the first ingestion of the same id after it, at most 60 days later."""
    c = table(spark, sf_dir, "chunks").select("id", "ingested_at", "deleted_at").distinct()
    gone = c.where("deleted_at is not null").select("id", "deleted_at")
    back = c.select("id", F.col("ingested_at").alias("again_at"))
    j = gone.join(back, "id").where((F.col("again_at") > F.col("deleted_at")) & (F.datediff("again_at", "deleted_at") <= 60))
    return j.groupBy("id", "deleted_at").agg(F.min("again_at").alias("again_at")).select("id", F.datediff("again_at", "deleted_at").alias("days"))


def citation_enrich(spark, sf_dir):
    """Citations of the responses with the item and title of the chunk, else a default."""
    c = table(spark, sf_dir, "chunks").groupBy(F.col("id").alias("cited")).agg(F.min("item").alias("item"), F.min("title").alias("title"))
    r = table(spark, sf_dir, "synthesis_responses").select("response_id", F.explode("citations").alias("cited")).where("cited is not null").distinct()
    return r.join(c, "cited", "left").groupBy(F.coalesce("item", F.lit("?")).alias("item"), F.coalesce("title", F.lit("untitled")).alias("title")).agg(F.count("*").alias("n"))


def error_class(spark, sf_dir):
    """Steps by whether their payload is well formed, cut short, or no JSON at all."""
    t = table(spark, sf_dir, "trajectories").select("id", "agent_name", "payload").distinct()
    kind = F.when(F.col("payload").isNull(), "null").when(F.get_json_object("payload", "$").isNotNull(), "valid").when(F.col("payload").startswith("{"), "cut").otherwise("other")
    return t.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


_EDGES = _FACTS + """,
i AS (SELECT DISTINCT 'comp:' || ticker AS c, 'filing:' || ticker || ':' || fiscal_year AS f, 'metric:' || replace(replace(lower(metric), ' ', '_'), '&', 'and') AS m, 'val:' || ticker || ':' || replace(lower(metric), ' ', '_') || ':' || fiscal_year AS v, 'chunk:' || chunk_id AS k FROM facts),
e AS (SELECT DISTINCT * FROM (SELECT c AS src, f AS dst, 'REPORTED_IN' AS relation FROM i UNION ALL SELECT f, v, 'CONTAINS_METRIC' FROM i UNION ALL SELECT m, v, 'RECORDED_VALUE' FROM i UNION ALL SELECT v, k, 'CITES_CHUNK' FROM i))
"""
_STEPS = "WITH t AS (SELECT DISTINCT id, session_id, agent_name, action, payload, logged_at FROM trajectories WHERE session_id IS NOT NULL AND session_id <> '')\n"
_NEXT = "WITH t AS (SELECT DISTINCT trace_id, c FROM (SELECT trace_id, unnest(citations) AS c FROM traces) WHERE c IS NOT NULL AND c <> ''), l AS (SELECT lag(c) OVER (PARTITION BY trace_id ORDER BY c) AS a, c AS b FROM t), p AS (SELECT a, b, count(*) AS n FROM l WHERE a IS NOT NULL GROUP BY ALL)\n"

QUERIES = {
    f.__name__: f
    for f in (
        graph_nodes, graph_edges, ego_graph, graph_view, chunk_components, cooccurrence_edges, entity_mentions, company_aliases, session_upsert, session_history, transcript_window, trajectory_steps, nearest_date_join,
        citation_enrich, error_class,
    )
}
SQL = {
    "graph_nodes": _EDGES + "SELECT DISTINCT * FROM (SELECT c AS id, 'Company' AS label FROM i UNION ALL SELECT f, 'Filing' FROM i UNION ALL SELECT m, 'FinancialMetric' FROM i UNION ALL SELECT v, 'MetricValue' FROM i UNION ALL SELECT k, 'Chunk' FROM i)",
    "graph_edges": _EDGES + "SELECT * FROM e",
    "ego_graph": _EDGES
    + """, b AS (SELECT DISTINCT * FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)),
h0 AS (SELECT DISTINCT c AS seed, c AS id FROM i), h1 AS (SELECT DISTINCT seed, dst AS id FROM h0 JOIN b ON id = src), h2 AS (SELECT DISTINCT seed, dst AS id FROM h1 JOIN b ON id = src)
SELECT seed, id, min(hops) AS hops FROM (SELECT *, 0 AS hops FROM h0 UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2) GROUP BY seed, id""",
    "graph_view": _FACTS
    + """, y AS (SELECT * FROM (SELECT DISTINCT ticker, fiscal_year FROM facts) QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY fiscal_year DESC) <= 3)
SELECT ticker, fiscal_year, metric, row_number() OVER (PARTITION BY ticker, fiscal_year ORDER BY usd_m DESC, metric) AS place FROM facts JOIN y USING (ticker, fiscal_year) QUALIFY place <= 6""",
    "cooccurrence_edges": _NEXT + "SELECT * FROM p",
    "entity_mentions": "SELECT company, count(DISTINCT id) AS n_chunks FROM chunks WHERE company IS NOT NULL AND contains(lower(text), lower(company)) GROUP BY company",
    "company_aliases": "WITH c AS (SELECT DISTINCT company, trim(regexp_replace(lower(company), '[^a-z0-9]+', ' ', 'g')) AS name FROM chunks WHERE company IS NOT NULL), f AS (SELECT *, string_split(name, ' ')[1] AS w FROM c) SELECT DISTINCT company, alias FROM (SELECT company, name AS alias FROM f UNION ALL SELECT company, w FROM f WHERE length(w) >= 4 AND w NOT IN ('home', 'bank'))",
    "session_upsert": "SELECT session_id, n_saves, strategy, CASE WHEN isnan(latency_ms) THEN NULL ELSE latency_ms END AS latency_ms, verified, strftime(loaded_at, '%Y-%m-%d %H:%M:%S') AS loaded_at FROM (SELECT *, count(DISTINCT loaded_at) OVER (PARTITION BY session_id) AS n_saves FROM sessions WHERE session_id IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY loaded_at DESC, latency_ms DESC NULLS LAST, cost_usd DESC NULLS LAST) = 1",
    "session_history": "WITH s AS (SELECT session_id, arg_max(strategy, loaded_at) AS strategy, max(created_at) AS created_at FROM sessions WHERE session_id IS NOT NULL GROUP BY session_id) SELECT strategy, row_number() OVER (PARTITION BY strategy ORDER BY created_at DESC, session_id) AS place, session_id FROM s QUALIFY place <= 3",
    "transcript_window": _STEPS + "SELECT session_id, string_agg(concat_ws(': ', agent_name, action, payload)[1:400], ' > ' ORDER BY k DESC) AS transcript FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY logged_at DESC, id DESC) AS k FROM t) WHERE k <= 6 GROUP BY session_id",
    "trajectory_steps": "WITH t AS (SELECT DISTINCT id, session_id, agent_name, logged_at FROM trajectories WHERE session_id IS NOT NULL AND session_id <> ''), d AS (SELECT agent_name, epoch_us(logged_at) - lag(epoch_us(logged_at)) OVER (PARTITION BY session_id ORDER BY logged_at, id) AS gap FROM t) SELECT agent_name, count(*) AS n, count(gap) AS n_gaps, max(gap) AS max_gap_us FROM d GROUP BY agent_name",
    "nearest_date_join": "WITH c AS (SELECT DISTINCT id, ingested_at, deleted_at FROM chunks), j AS (SELECT g.id, g.deleted_at, min(b.ingested_at) AS again_at FROM c g JOIN c b ON g.id = b.id AND b.ingested_at > g.deleted_at AND CAST(b.ingested_at AS DATE) - CAST(g.deleted_at AS DATE) <= 60 WHERE g.deleted_at IS NOT NULL GROUP BY ALL) SELECT id, CAST(CAST(again_at AS DATE) - CAST(deleted_at AS DATE) AS INT) AS days FROM j",
    "citation_enrich": "WITH c AS (SELECT id AS cited, min(item) AS item, min(title) AS title FROM chunks GROUP BY id), r AS (SELECT DISTINCT response_id, cited FROM (SELECT response_id, unnest(citations) AS cited FROM synthesis_responses) WHERE cited IS NOT NULL) SELECT coalesce(item, '?') AS item, coalesce(title, 'untitled') AS title, count(*) AS n FROM r LEFT JOIN c USING (cited) GROUP BY ALL",
    "error_class": "SELECT CASE WHEN payload IS NULL THEN 'null' WHEN json_valid(payload) THEN 'valid' WHEN starts_with(payload, '{') THEN 'cut' ELSE 'other' END AS kind, count(*) AS n FROM (SELECT DISTINCT id, agent_name, payload FROM trajectories) GROUP BY 1",
}
