"""Orphan references against a brute-force version."""

import datetime as dt
import random

from ledgerloom.operators.orphan_refs import BLOCK, dictionary, find_orphans, references

T0 = dt.datetime(2024, 1, 1)
TRACE = "trace_id long, citations array<string>, created_at timestamp_ntz, space string, key string"
GOLD = "id string, expected struct<answer:string, citations:array<string>, type:string>, created_at timestamp_ntz"
STEP = "id long, session_id string, logged_at timestamp_ntz"
CHUNK = "id string, ingested_at timestamp_ntz, deleted_at timestamp_ntz, period int"
SESS = "session_id string, loaded_at timestamp_ntz, deleted_at timestamp_ntz"


def brute(traces, golden, steps, chunks, sessions):
    norm = lambda v: v.lower().strip(" \t\r\n[]() ") if v else ""
    out = set()
    spans = {}
    for i, a, b, _ in chunks:
        if i and a:
            parts = norm(i).split(":")
            for n in range(1, len(parts) + 1):
                spans.setdefault(("c", ":".join(parts[:n])), set()).add((a, b))
    for s in {r[0] for r in sessions if r[0]}:
        rows = [r for r in sessions if r[0] == s]
        ends = [r[2] for r in rows if r[2]]
        spans[("s", norm(s))] = {(min(r[1] for r in rows), max(ends) if ends else None)}
    refs = [("traces", str(t[0]), c, t[2], "c") for t in traces for c in t[1] or []]
    refs += [("golden_set_v1", g[0], c, g[2], "c") for g in golden for c in (g[1][1] or [])]
    refs += [("trajectories", str(s[0]), s[1], s[2], "s") for s in steps]
    for tab, key, value, at, space in refs:
        k = norm(value)
        if not k:
            continue
        lives = spans.get((space, k), set())
        if at is None:
            if not lives:
                out.add((tab, None, key, value, "missing"))
            continue
        if any(a <= at and (b is None or b > at) for a, b in lives):
            continue
        reason = "missing" if not lives else "late" if min(a for a, _ in lives) > at else "deleted"
        out.add((tab, f"{at:%Y-%m}", key, value, reason))
    return out


def run(spark, traces, golden, steps, chunks, sessions, ranges=3):
    rows = find_orphans(
        spark.createDataFrame(traces, TRACE), spark.createDataFrame(golden, GOLD), spark.createDataFrame(steps, STEP), spark.createDataFrame(chunks, CHUNK), spark.createDataFrame(sessions, SESS), ranges
    ).collect()
    assert len({tuple(r) for r in rows}) == len(rows)
    return {tuple(r) for r in rows}


def test_random_histories(spark):
    rng = random.Random(3)
    day = lambda: T0 + dt.timedelta(days=rng.randrange(200), seconds=rng.choice((0, 0, 5)))
    ids = [f"D{i}:S{j}:c{k:03d}" for i in range(4) for j in range(2) for k in range(2)] + ["PMID:7:R:c000"]
    chunks = []
    for i in ids * 2:
        a = day()
        chunks.append((i, a, rng.choice((None, a + dt.timedelta(days=rng.randrange(1, 60)))), 1))
    chunks += [chunks[0], (None, T0, None, 1), ("X:y", None, None, None)]
    names = [*ids, "D1", "D1:S0", "PMID:7", " [D2:S1:C000] ", "(d3)", "nowhere:1", "", " ", "[]", None, "D1:S", "D1:S0:c0"]
    traces = [(n, [rng.choice(names) for _ in range(rng.randrange(4))], day(), "x", "y") for n in range(150)]
    traces += [(900, None, T0, None, None), (901, ["D1", "nowhere"], None, None, None), traces[0]]
    golden = [(f"g{n}", ("a", [rng.choice(names)], "exact"), day()) for n in range(40)] + [("g-null", ("a", None, None), T0)]
    sessions = [("s1", T0, None), ("s1", T0 + dt.timedelta(days=3), None), ("s2", T0 + dt.timedelta(days=90), None), ("s3", T0, T0 + dt.timedelta(days=31)), (None, T0, None)]
    steps = [(n, rng.choice(("s1", " S2", "s3\t", "s4", "", None)), day()) for n in range(120)]
    assert run(spark, traces, golden, steps, chunks, sessions) == brute(traces, golden, steps, chunks, sessions)


def test_boundaries(spark):
    t = T0 + dt.timedelta(days=10)
    chunks = [("a:b", t, t + dt.timedelta(days=1), 0)]
    traces = [(1, ["a:b"], t, "", ""), (2, ["a"], t + dt.timedelta(days=1), "", ""), (3, ["A:B"], t - dt.timedelta(microseconds=1), "", "")]
    assert {(r[2], r[4]) for r in run(spark, traces, [], [], chunks, [])} == {("2", "deleted"), ("3", "late")}


def test_empty_tables(spark):
    assert run(spark, [], [], [], [], []) == set()
    assert {r[4] for r in run(spark, [(1, ["a"], T0, "", "")], [], [(1, "s", T0)], [], [])} == {"missing"}


def test_dictionary_goes_on_in_the_next_block(spark):
    from pyspark.sql import functions as F

    df = spark.range(BLOCK + 50).select("id", F.concat(F.lit("k"), "id").alias("v"), F.lit(T0).cast("timestamp_ntz").alias("t"))
    d = dictionary(references(df, "traces", F.col("id"), F.col("v"), F.col("t"), "chunk"), 1)
    assert d.select("range", "block", "pos").distinct().count() == BLOCK + 50
    assert d.agg(F.max("block")).first()[0] == 1


def test_containers_of_both_kinds(spark):
    import pandas as pd

    from ledgerloom.operators.orphan_refs import LISTED, and_not, container

    rng = random.Random(9)
    for na, nb in ((5, 9), (5, 20_000), (20_000, 7), (20_000, 21_000), (LISTED, LISTED + 1)):
        a, b = rng.sample(range(BLOCK), na), rng.sample(range(BLOCK), nb)
        packed = container.func(pd.Series([pd.array(a).to_numpy(), pd.array(b).to_numpy()]))
        assert len(packed[0]) == (1 + 2 * na if na <= LISTED else 1 + BLOCK // 8)
        both = and_not.func(pd.Series([packed[0], packed[0]]), pd.Series([packed[1], None]))
        assert list(both[0]) == sorted(set(a) - set(b)) and list(both[1]) == sorted(a)
