"""Sources, sinks and streams round trips on small files."""

import datetime as dt
import json

from pyspark.sql import functions as F

from ledgerloom.sources import files
from ledgerloom.streaming import telemetry


def test_csv_and_json_lines(spark, tmp_path):
    (tmp_path / "m.csv").write_text("ticker,company,cik,filing_date,source_url,local_file\nAB,Alpha Beta,12,2024-01-02,u,f\nCD,,x,,,\n")
    rows = files.read_csv(spark, str(tmp_path / "m.csv")).collect()
    assert [(r.ticker, r.cik) for r in rows] == [("AB", 12), ("CD", None)]
    case = {"id": "1", "input": "q", "expected": {"answer": None, "citations": ["a"], "type": "exact"}, "variation_rules": [], "difficulty": "easy"}
    (tmp_path / "golden.jsonl").write_text(json.dumps(case) + "\n")
    (tmp_path / "golden_skeleton.jsonl").write_text(json.dumps(case | {"id": "2"}) + "\n")
    got = files.read_json_lines(spark, [str(tmp_path / "golden.jsonl"), str(tmp_path / "golden_skeleton.jsonl")], skip="skeleton").collect()
    assert [(r.id, r.expected.citations) for r in got] == [("1", ["a"])]


def test_append_and_resume(spark, tmp_path):
    out = str(tmp_path / "rows")
    cases = spark.createDataFrame([(str(i),) for i in range(5)], "case_id string")
    files.append_rows(cases.where("case_id < '2'"), out)
    files.append_rows(cases.where("case_id = '3'"), out)
    done = files.read_json_lines(spark, out, "case_id string")
    assert sorted(r.case_id for r in files.remaining(cases, done, "case_id").collect()) == ["2", "4"]


def test_latest_and_columns(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, t int, v string")
    assert sorted((r.k, r.v) for r in files.latest(df, ["k"], ["t"]).collect()) == [("a", "y"), ("b", "z")]
    reply = spark.createDataFrame([([1, 2], ["p", "q"])], "form array<int>, day array<string>")
    assert [tuple(r) for r in files.read_columns(reply, "form", "day").collect()] == [(1, "p"), (2, "q")]


def test_index_ordinals(spark, tmp_path):
    df = spark.createDataFrame([(f"k{i:03d}", [float(i)]) for i in range(57)], "id string, embedding array<float>")
    files.write_index(df, str(tmp_path / "ix"), "id")
    rows = spark.read.parquet(str(tmp_path / "ix")).orderBy("ordinal").collect()
    assert [r.id for r in rows] == [f"k{i:03d}" for i in range(57)] and [r.ordinal for r in rows] == list(range(57))


def test_pages(spark, tmp_path):
    (tmp_path / "a.html").write_text("<html><style>p{}</style><script>var x='<p>no</p>';</script><h1>Item&nbsp;7</h1><p>A &amp; B<br>next</p><!-- gone --></html>")
    assert [(r.line_no, r.line) for r in files.read_pages(spark, str(tmp_path / "a.html")).orderBy("line_no").collect()] == [(1, "Item 7"), (2, "A & B"), (3, "next")]


T0 = dt.datetime(2024, 1, 1)


def _stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def _run(df, tmp_path, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.sql(f"select * from {name}").collect()


def test_windows_as_a_stream(spark, tmp_path):
    rows = [(T0 + dt.timedelta(minutes=10 * i), "m", float(i)) for i in range(30)]
    s = _stream(spark, tmp_path, rows, "at timestamp, model string, latency double")
    out = _run(telemetry.windowed(s, "at", "latency", "model"), tmp_path, "w", "complete")
    assert sum(r.n for r in out) == 30 and len(out) == 5


def test_first_seen_as_a_stream(spark, tmp_path):
    rows = [(T0 + dt.timedelta(minutes=i // 2), f"k{i // 2}") for i in range(10)]
    s = _stream(spark, tmp_path, rows, "at timestamp, key string")
    assert len(_run(telemetry.first_seen(s, ["key"], "at"), tmp_path, "d")) == 5


def test_breaker_as_a_stream(spark, tmp_path):
    rows = [("a", True)] * 6 + [("b", True)] * 4 + [("b", False)] + [("b", True)] * 2
    s = _stream(spark, tmp_path, rows, "agent string, failed boolean")
    assert [(r.agent, r.streak) for r in _run(telemetry.breaker(s, "agent", "failed"), tmp_path, "b")] == [("a", 5)]


def test_sessions_as_a_stream(spark, tmp_path):
    rows = [(T0 + dt.timedelta(minutes=m), "u") for m in (0, 5, 20, 90, 95)] + [(T0 + dt.timedelta(days=2), "u")]
    s = _stream(spark, tmp_path, rows, "at timestamp, user string")
    out = _run(telemetry.sessions(s, "at", "user"), tmp_path, "s", "complete")
    assert sorted(r.n for r in out) == [1, 2, 3]


def test_packing_keeps_lines_whole(spark):
    from ledgerloom.operators.ingest import chunk_sections, pack_sections

    text = "\n".join(f"line {i} " + "x" * (i % 40) for i in range(200))
    rows = spark.createDataFrame([(1, text), (2, ""), (3, None)], "k int, text string")
    got = pack_sections(rows, "k", "text", 300).orderBy("k", "no").collect()
    assert "\n".join(r.section for r in got) == text and all(len(r.section) <= 300 for r in got)
    table = "Head | 2024 | 2023\nUnits | $ | $\n" + "\n".join(f"Row {i} | {i} | {i}" for i in range(60))
    chunks = chunk_sections(spark.createDataFrame([(1, "Note 5 Debt\nAs in Note 7.\n" + table)], "k int, text string"), "k", "text", 400).orderBy("no").collect()
    assert len(chunks) > 2 and all(len(c.chunk) <= 400 for c in chunks)
    assert all(c.chunk.startswith("Head | 2024 | 2023\nUnits") for c in chunks if c.table_continuation)
    assert sum(c.chunk.count("Row ") for c in chunks) == 60 and any(5 in c.note_refs for c in chunks)


def test_kappa_of_a_known_matrix(spark):
    from ledgerloom.operators.evaluate import agreement

    rows = [(True, True)] * 34 + [(True, False)] * 6 + [(False, True)] + [(False, False)] * 11 + [(None, True)]
    r = agreement(spark.createDataFrame(rows, "h boolean, j boolean"), F.col("h"), F.col("j")).first()
    assert round(r.agreement, 4) == 0.8654 and round(r.kappa, 3) == 0.669
