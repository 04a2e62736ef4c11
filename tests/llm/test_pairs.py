"""Broken pairs on a small corpus whose defects are known."""

import pytest

from ledgerloom.llm.pairs import broken_pairs

JUDGE = "case_id string, input string, actual_output string, defect string, opening string"
RESPONSE = "response_id long, input string, answer string, status string, reason string, kind string"

WHAT = "What was {n}'s gross profit for fiscal year 20{y:02d}?"
PAID = "{n}'s gross profit for fiscal year 20{y:02d} was ${v} million, as shown in the consolidated statement of operations."
WHEN = "On which date did the agreement between {a} and {b} take effect?"
BEGAN = "It took effect on March {d}, 2021, the day on which {b} received the signed copy from {a}."
NAMES = ["Norlith Foods", "Velmora Energy", "Tasquill Media", "Haxdane Water"]
PARTIES = ["Agent", "Licensor", "Supplier", "Sponsor"]


def corpus():
    rows = []
    for i in range(40):
        n, y, a, b = NAMES[i % 4], 10 + i % 10, PARTIES[i % 4], PARTIES[(i + 1) % 4]
        rows.append((WHAT.format(n=n, y=y), PAID.format(n=n, y=y, v=100 + i)))
        rows.append((WHEN.format(a=a, b=b), BEGAN.format(a=a, b=b, d=1 + i % 27)))
    return rows


Q1, Q2 = WHAT.format(n=NAMES[0], y=11), WHEN.format(a="Agent", b="Sponsor")
GOOD = PAID.format(n=NAMES[0], y=11, v=5)
PROBES = [
    (Q1, None, None, None, "empty"),
    (Q1, "", "answered", None, "empty"),
    (Q1, " ​﻿\t", "answered", None, "empty"),
    (Q1, "**  **", None, None, "empty"),
    (Q1, "<p></p>", None, None, "empty"),
    (Q1, "N/A", None, None, "empty"),
    (Q1, "```\n```", None, None, "empty"),
    (Q1, '{"answer": ""}', None, None, "empty"),
    (Q1, None, "refused", None, "refusal"),
    (Q1, None, "clarification_needed", "Which company should I look at?", None),
    (Q1, "Unfortunately, I do not have access to that filing.", "refused", None, "refusal"),
    (Q1, "I do not have access to that filing. Please consult the full filing.", None, None, "refusal"),
    (Q2, "Unfortunately, unable to determine from the available excerpts", None, None, "refusal"),
    (Q2, "Es tut mir leid, diese Frage kann ich nicht beantworten.", None, None, "refusal"),
    (Q1, Q1, None, None, "copy"),
    (Q2, "Question: " + Q2, None, None, "copy"),
    (Q2, '"' + Q2 + '"', None, None, "copy"),
    (Q1, Q1.upper(), None, None, "copy"),
    (Q1, Q1 + " " + GOOD, None, None, None),
    (Q1, "Los ingresos de la empresa fueron de 8 millones de dólares en el ejercicio, un 11 por ciento más que el año anterior.", None, None, "language"),
    (Q1, "公司认为下降主要是由于原材料成本上升和需求疲软。", None, None, "language"),
    (Q1 + " Please reply in Spanish.", "Los ingresos de la empresa fueron de 8 millones de dólares en el ejercicio, un 11 por ciento más que el año anterior.", None, None, None),
    ("Welche Frist sieht der Vertrag für den Lieferanten vor?", "It is ten days from the date on which the notice was received by the other party.", None, None, "language"),
    (Q1, GOOD[:70], None, None, "truncated"),
    (Q1, GOOD[:-4] + "…", None, None, "truncated"),
    (Q2, "It took effect on March 3, 2021, the day on which", None, None, "truncated"),
    (Q2, "It took effect on March 3, 2021, the day on which -", None, None, "truncated"),
    (Q2, "It took effect on March 3, 2021, the day on which.", None, None, "truncated"),
    (Q1, GOOD[:-1], None, None, None),
    (Q1, "$5 million", None, None, None),
    (Q2, "March 3, 2021", None, None, None),
    (Q1, "Agent declined in writing: it was sorry and could not help, and Sponsor then ended the agreement under Section 9.6.", None, None, None),
    (None, GOOD, None, None, None),
    (None, None, None, None, "empty"),
]


@pytest.fixture(scope="module")
def found(spark):
    base = corpus()
    responses = [(i, q, a, "answered", None, "k") for i, (q, a) in enumerate(base)]
    responses += [(1000 + i, q, a, s, r, "k") for i, (q, a, s, r, _) in enumerate(PROBES)]
    judged = [(f"c{i}", q, a, "d", "o") for i, (q, a) in enumerate(base[:20])] + [(None, "q", "", "d", "o"), ("c0", *base[0], "d", "o")]
    rows = broken_pairs(spark.createDataFrame(judged, JUDGE), spark.createDataFrame(responses + responses[-3:], RESPONSE)).collect()
    assert len(rows) == len({(r.pair_table, r.pair_key) for r in rows})
    return {(r.pair_table, r.pair_key): r.defect for r in rows}


@pytest.mark.parametrize("i", range(len(PROBES)))
def test_probe(found, i):
    assert found.get(("synthesis_responses", str(1000 + i))) == PROBES[i][4], PROBES[i][:3]


def test_good_pairs_have_no_defect(found):
    assert not [k for k in found if k[0] == "judge_calibration_v1" or int(k[1]) < 1000]


def test_a_chain_of_openings_is_one_cluster(spark):
    from ledgerloom.llm.pairs import refusal_openings

    words = [f"word{chr(97 + i)}" for i in range(24)]
    chain = []
    for i in range(8):
        words = words[:-1] + [f"end{i}"] if i == 0 else words[1:] + [f"end{i}"]
        chain.append(" ".join(words))
    rows = [(o, o, [f"kind{i}", "of", "prompt"], "refused" if i == 0 else "answered", False) for i, o in enumerate(chain)]
    df = spark.createDataFrame(rows, "opening string, first string, q array<string>, status string, foreign boolean")
    assert {r.opening for r in refusal_openings(df).collect()} == set(chain)


TOPICS = "harbour copper meadow ribbon anchor velvet timber lantern saddle thunder pebble orchard canyon mirror cactus falcon".split()


def unrelated(n):
    """Prompts that share no more than the words of any question."""
    return [f"{('How', 'Why', 'When', 'Where')[i % 4]} would {TOPICS[i % 16]}{i} {TOPICS[(i * 7 + 3) % 16]} meet {TOPICS[(i * 5 + 1) % 16]}{i * 3}?" for i in range(n)]


def found_in(spark, rows):
    responses = [(i, q, a, s, None, "k") for i, (q, a, s) in enumerate(rows)]
    out = broken_pairs(spark.createDataFrame([], JUDGE), spark.createDataFrame(responses, RESPONSE)).where("defect = 'refusal'")
    return {int(r.pair_key) for r in out.collect()}


def test_a_template_under_unrelated_prompts_is_a_refusal_without_any_formula(spark):
    base = [(q, a, "answered") for q, a in corpus()]
    refusals = [(q, "Our desk keeps silence on matters of this nature.", "answered") for q in unrelated(120)]
    assert found_in(spark, base + refusals) == set(range(len(base), len(base) + 120))


def test_a_template_with_names_is_one_template(spark):
    base = [(q, a, "answered") for q, a in corpus()]
    names = [f"{a}{b} Partners" for a in ("Quor", "Zan", "Mert", "Hax", "Vel", "Tib", "Nor", "Lor") for b in ("dale", "mond", "lith", "vey", "rado", "bexa", "lune", "tesk")][:60]
    refusals = [(q, f"Our desk keeps silence on matters that touch {n} today.", "refused" if i < 2 else "answered") for i, (q, n) in enumerate(zip(unrelated(60), names, strict=True))]
    assert found_in(spark, base + refusals) == set(range(len(base), len(base) + 60))


def test_a_template_that_gives_values_is_no_refusal(spark):
    rows = [(q, f"It came to {100 + 17 * i} units at the end of the period under review.", "answered") for i, q in enumerate(unrelated(60))]
    rows += [(q, a, "answered") for q, a in corpus()]
    assert not found_in(spark, rows)


def test_an_answer_after_a_refusal_is_no_refusal(spark):
    base = [(q, "Our desk keeps silence on matters of this nature.", "answered") for q in unrelated(40)]
    rows = base + [("Why would harbour meet velvet?", "Our desk keeps silence on matters of this nature. The price was 48 dollars.", "answered")]
    assert len(base) not in found_in(spark, rows)


def test_relatedness_is_the_mean_over_all_pairs(spark):
    from itertools import permutations

    from ledgerloom.llm.pairs import relatedness

    sets = [["a", "b", "c"], ["a", "d"], ["b", "c", "e", "f"], ["g"]]
    got = relatedness(spark.createDataFrame([("k", s) for s in sets], "k string, q array<string>"), ["k"]).collect()[0]
    pairs = list(permutations(sets, 2))
    want = sum(len(set(a) & set(b)) for a, b in pairs) / sum(len(a) for a, _ in pairs)
    assert got.prompts == 4 and abs(got.related - want) < 1e-12


def test_clusters_recall_the_brute_force_links(spark):
    import random

    from ledgerloom.llm.pairs import clustered

    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(20, 34))]
        texts.append(base)
        for _ in range(3):
            copy = list(base)
            copy[rng.choice((0, len(copy) - 1))] = rng.choice(words)
            texts.append(copy)
    rows = sorted({" ".join(t) for t in texts})
    got = {r.id: r.cluster for r in clustered(spark.createDataFrame(list(enumerate(rows)), "id long, opening string")).collect()}
    shingles = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j])]
    assert len(links) > 100
    assert sum(got[i] == got[j] for i, j in links) >= 0.9 * len(links)


def test_empty_tables(spark):
    assert broken_pairs(spark.createDataFrame([], JUDGE), spark.createDataFrame([], RESPONSE)).count() == 0


def test_very_long_answer(spark):
    rows = [(1, "Why?", "word " * 60_000 + "end.", "answered", None, "")]
    assert broken_pairs(spark.createDataFrame([], JUDGE), spark.createDataFrame(rows, RESPONSE)).count() == 0
