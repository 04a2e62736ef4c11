"""The mix: shares, caps, copies of equal texts, and the cube's constraints."""

import os
import random

import pytest

from ledgerloom.llm.bpe import TOKENIZERS
from ledgerloom.llm.mix import draw, fly, land, mix, plan, shares

pytestmark = pytest.mark.skipif(not os.path.exists(os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken")), reason="no vocabulary files")
DOC = "doc_id long, text string, source string, tokens long, p double"
TARGET = "source string, target_share double, max_repeats int"
TARGETS = [("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.1, 2), ("missing", 0.1, 2)]


def test_flight_keeps_the_totals():
    rng = random.Random(4)
    for trial in range(30):
        n = rng.randrange(3, 400)
        tokens = [rng.choice((10, 200, 250, 251, 30_000)) for _ in range(n)]
        probs = [rng.choice((0.0, 0.3, 0.62, 1.0)) for _ in range(n)]
        out = fly(tokens, probs, random.Random(trial))
        assert all(0 <= p <= 1 for p in out)
        assert sum(1 for p in out if 1e-9 < p < 1 - 1e-9) <= 2
        assert abs(sum(p * t for p, t in zip(out, tokens, strict=True)) - sum(p * t for p, t in zip(probs, tokens, strict=True))) < 1e-3
        landed = land(tokens, out, random.Random(trial))
        assert set(landed) <= {0.0, 1.0}
        off = abs(sum(p * t for p, t in zip(landed, tokens, strict=True)) - sum(p * t for p, t in zip(probs, tokens, strict=True)))
        assert off < sum(sorted(tokens)[-2:]) and abs(sum(landed) - sum(probs)) < 2


@pytest.mark.parametrize("p", [0.4, 0.13, 0.75])
def test_every_text_keeps_its_probability(p):
    tokens, draws = [5, 7, 9, 11, 400, 12], 6000
    total = [0.0] * 6
    for seed in range(draws):
        rng = random.Random(seed)
        for i, x in enumerate(land(tokens, fly(tokens, [p] * 6, rng), rng)):
            total[i] += x
    assert all(abs(t / draws - p) <= 0.02 for t in total), total


def test_totals_of_a_long_tail():
    rng = random.Random(8)
    tokens = [int(rng.lognormvariate(5, 1.2)) + 1 for _ in range(3000)]
    top = sum(sorted(tokens)[-2:])
    for seed in range(20):
        draw = random.Random(seed)
        out = land(tokens, fly(tokens, [0.4] * 3000, draw), draw)
        assert abs(sum(out) - 1200) < 2
        assert abs(sum(x * t for x, t in zip(out, tokens, strict=True)) - 0.4 * sum(tokens)) < top


def test_levels_of_buckets_keep_the_totals(spark):
    rng = random.Random(3)
    rows = [(i, "ab"[i % 5 == 0], int(rng.lognormvariate(4, 1)) + 1) for i in range(4000)]
    units = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.7, 2)], TARGET)
    got = draw(units, targets, bucket=40).collect()
    for p in plan(units, targets).collect():
        mine = [t for _, s, t in rows if s == p.source]
        used = [r for r in got if r.source == p.source]
        assert abs(sum(r.copies for r in used) - p.copies * len(mine)) < 2
        assert abs(sum(r.copies * r.tokens for r in used) - p.copies * sum(mine)) < sum(sorted(mine)[-2:])


def corpus():
    rng = random.Random(1)
    rows = [(i, f"{i} " + "plain words here " * rng.randrange(1, 60), rng.choice("aaabbc"), 0, 0.0) for i in range(900)]
    rows += [(1000 + i, rows[i][1], rows[i][2], 0, 0.0) for i in range(50)]
    return rows + [(2000, None, "a", 0, 0.0), (2001, "  ", "a", 0, 0.0), (2002, "", "b", 0, 0.0), (2003, "text", None, 0, 0.0), (2004, "other", "d", 0, 0.0)]


def test_shares(spark):
    docs, targets = spark.createDataFrame(corpus(), DOC), spark.createDataFrame(TARGETS, TARGET)
    rows = {r.source: r for r in shares(docs, targets).collect()}
    assert set(rows) == {"a", "b", "c", "missing", "d", None}
    for s, share, cap in TARGETS[:3]:
        assert abs(rows[s].share_reached - share / 0.9) < 0.01
        assert rows[s].most_copies <= cap
    assert all(rows[s].tokens_used == 0 for s in ("missing", "d", None))
    drawn = mix(docs, targets).collect()
    assert {tuple(r) for r in drawn} == {tuple(r) for r in mix(docs.repartition(7), targets).collect()}
    assert max(r.doc_id for r in drawn) < 900 and len({r.doc_id for r in drawn}) == len(drawn)
    # the scarcest source is used up to its cap
    assert any(rows[s].tokens_used >= 0.97 * cap * rows[s].tokens_available for s, _, cap in TARGETS[:3])


def test_empty(spark):
    targets = spark.createDataFrame(TARGETS, TARGET)
    assert mix(spark.createDataFrame([], DOC), targets).count() == 0
    assert {r.source for r in shares(spark.createDataFrame([], DOC), targets).collect()} == {t[0] for t in TARGETS}
    assert mix(spark.createDataFrame(corpus()[:20], DOC), targets.limit(0)).count() == 0
