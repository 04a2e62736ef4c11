"""Pieces of oversized sections: limits, cover, boundaries, overlap."""

import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm.split import SIZE_WEIGHT, boundaries, cut_kinds, pieces, split_sections

SECTION = "section_key long, doc_type string, item string, text string, max_chars int, hard boolean"
LIMIT = "doc_type string, max_chars int, overlap_chars int"
LIMITS = [("a", 100, 10), ("b", 50, 0), ("z", 0, 0)]


def check(text, limit, overlap):
    cut = pieces(text, limit, overlap)
    assert cut[0][0] == 0 and cut[-1][1] == len(text)
    for start, end, _, _ in cut:
        assert 0 < end - start <= limit
    for (s1, e1, _, _), (s2, e2, o2, _) in zip(cut, cut[1:], strict=False):
        assert s1 < s2 <= e1 < e2 and o2 == e1 - s2
    return cut


def longest_word(text):
    best = run = 0
    for c in text:
        run = 0 if c in " \t\r\n。" else run + 1
        best = max(best, run)
    return best


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n。,\t日", min_size=61, max_size=700), st.integers(20, 60), st.integers(0, 30))
def test_any_text(text, limit, overlap):
    if overlap >= limit:
        with pytest.raises(ValueError, match="overlap"):
            pieces(text, limit, overlap)
        return
    cut = check(text, limit, overlap)
    assert any(h for *_, h in cut) == (longest_word(text) > limit)


def test_paragraphs_are_preferred():
    text = "\n\n".join("one two three four five six seven. eight nine ten." for _ in range(20))
    cut = check(text, 110, 0)
    assert all(text[e - 2 : e] == "\n\n" for _, e, _, _ in cut[:-1])


def test_overlap_is_near_the_wanted_one():
    rng = random.Random(2)
    text = " ".join("word" * rng.randrange(1, 3) for _ in range(3000))
    have = [o for _, _, o, _ in check(text, 1000, 80)][1:]
    assert all(40 <= o <= 120 for o in have)


def test_a_long_overlap_is_kept():
    text = "word and more. " * 900
    have = [o for _, _, o, _ in check(text, 900, 600)][1:]
    assert all(560 <= o <= 640 for o in have)


def test_the_cut_is_the_cheapest_of_all():
    """Against every choice of cuts, without overlap, on texts with few boundaries."""
    rng = random.Random(6)
    for _ in range(60):
        text = "".join("w" * rng.randint(2, 9) + rng.choice((" ", ", ", ". ", "\n", "\n\n")) for _ in range(rng.randint(8, 13)))
        limit = rng.randint(24, 40)
        if len(text) <= limit:
            continue
        pos, pen = boundaries(text, limit)
        even = len(text) / max(2, -(-len(text) // limit))
        cost = lambda ends: sum(pen[list(pos).index(b)] + SIZE_WEIGHT * ((b - a - even) / limit) ** 2 for a, b in zip((0, *ends), ends, strict=False))
        least = limit // 4
        every = []
        for k in range(1, 6):
            for inner in itertools.combinations([int(p) for p in pos[1:-1]], k):
                ends = (*inner, len(text))
                if all(least <= b - a <= limit for a, b in zip((0, *ends), ends, strict=False)):
                    every.append(cost(ends))
        if every:
            got = cost(tuple(e for _, e, _, _ in check(text, limit, 0)))
            assert got <= min(every) + 1e-9


def test_all_boundaries_are_offered():
    text = "a bc. " * 2000
    pos, _ = boundaries(text, 3000)
    assert len(pos) == 4001


def test_table(spark):
    rows = [
        (1, "a", "7", "word " * 60, 5, True),
        (2, "a", "7", "x" * 101, 5, True),
        (3, "a", "7", "x" * 100, 5, True),
        (4, "b", None, "日本語。" * 40, 5, True),
        (5, "a", "7", None, 5, True),
        (6, "a", "7", "", 5, True),
        (7, "nowhere", "7", "word " * 600, 5, True),
        (8, None, "7", "word " * 600, 5, True),
        (9, "z", "7", "word " * 600, 5, True),
        (10, "a", "7", " " * 150, 5, True),
        (11, "a", "8", "one two three. " * 40_000, 5, True),
    ]
    df, lim = spark.createDataFrame(rows + rows[:2], SECTION), spark.createDataFrame(LIMITS, LIMIT)
    assert {tuple(r) for r in cut_kinds(df, lim).collect()} == {(1, "soft"), (2, "hard"), (4, "soft"), (10, "soft"), (11, "soft")}
    made = split_sections(df, lim).where("section_key = 1").distinct().orderBy("piece_no").collect()
    assert [r.piece_no for r in made] == list(range(1, made[0].n_pieces + 1))
    assert all(r.piece == ("word " * 60)[r.start : r.end] and r.item == "7" for r in made)


def test_empty(spark):
    assert cut_kinds(spark.createDataFrame([], SECTION), spark.createDataFrame(LIMITS, LIMIT)).count() == 0
    assert cut_kinds(spark.createDataFrame([(1, "a", "7", "x" * 500, 5, True)], SECTION), spark.createDataFrame([], LIMIT)).count() == 0
