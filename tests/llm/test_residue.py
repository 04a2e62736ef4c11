"""Template residue, filler and pages on texts whose kind is known."""

import pytest

from ledgerloom.llm.residue import find_residue

DOC = "doc_id long, text string, t string, span boolean, kind string"
BODY = "Gross margin rose to 51.0% of net sales, reflecting the timing of customer renewals. We operate 27 facilities in the southern plants."
CASES = [
    ("This report covers the period ended {{fiscal_year}}.", "placeholder"),
    (BODY + "\nThe agreement is made with ${doc.Amount} on the date stated below.\n" + BODY, "placeholder"),
    ("Dear [INSERT FILING DATE], we refer to the schedule.", "placeholder"),
    ("Payment of [COUNTERPARTY EINFÜGEN] falls due.", "placeholder"),
    ("Total: %(net_sales)s", "placeholder"),
    ("The registrant is organised under the laws of [object Object].", "placeholder"),
    ("Total: $[____] million", "placeholder"),
    ("Participants in the «TrialArm» group were followed.", "placeholder"),
    ("Payment of __AMOUNT__ falls due on Monday.", "placeholder"),
    ("The agreement is made with [Net Sales] on the date stated below.", "placeholder"),
    ("The agreement is made with {0} on the date stated below.", "placeholder"),
    ("undefined reported net sales that exceeded the prior year.", "placeholder"),
    ("The agreement is made with XX/XX/20XX on the date stated below.", "placeholder"),
    ('Reviewers may see "[INSERT DATE]" in early drafts; the signed version has none.', None),
    ("The drafting tool replaces every mark such as `{{company_name}}` with the legal name.", None),
    ("The prompt registry fills {k} slots by plain replacement.", None),
    ('The system returned {"arm": "active", "visits": 37} for each participant.', None),
    ("Item 4. [Reserved].\nCertain figures marked [***] were omitted; the words \"recieve\" [sic] stand in the original.", None),
    ("IN WITNESS WHEREOF the parties have signed.\nAgent: ____________________\nDate: ____________", None),
    ("The dump separates filings with <|endoftext|> marks, which the loader drops.", None),
    ("Lorem ipsum dolor sit amet magna velit porta nulla. Amet lorem sed elit ipsum velit.", "filler"),
    (BODY + "\n\nPorta libra quam lorem dolor ipsum sit amet elit nunc.", "filler"),
    ("asdf " * 20, "filler"),
    ("Content coming soon. Text goes here. Replace this paragraph with your own content.", "filler"),
    ("Dies ist ein Blindtext, der nur das Layout zeigt.", "filler"),
    ("Designers often use lorem ipsum in mock-ups; the company was fined after one such mock-up was published.", None),
    ("404 Not Found", "error_page"),
    ("Home | News | Terms\nBad gateway (502)\nPlease try again in a few minutes.", "error_page"),
    ("The file you asked for could not be found on this server.\nReturn to the home page or use the search box.", "error_page"),
    ("Traceback (most recent call last):\n  File \"a.py\", line 3, in run\nKeyError: 'text'", "error_page"),
    ('{"error": {"code": 429, "message": "Rate limit exceeded", "retry_after": 161}}', "error_page"),
    ("upstream connect error or disconnect before headers, reset reason: 503", "error_page"),
    ("Page not found\n\n" + BODY, None),
    (BODY + "\nYour request timed out.", None),
    ("During the outage customers saw a 404 Not Found page instead of their statements, and credits of $6 million were issued.", None),
    ("Access was denied to 55 contractors under the clause on revenue sharing, and the decision was upheld.", None),
    ("The crawler log lists 6 requests that ended with error 503, and 42 that were retried with success.", None),
    ("Please enable JavaScript to view this filing.", "script_notice"),
    ("Filing viewer\nThis site relies on active scripting. Reload the page afterwards.", "script_notice"),
    ("<noscript>You must have JavaScript turned on to use this site. Loading...</noscript>", "script_notice"),
    ("Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.", "script_notice"),
    ("Our storefront depends on JavaScript; users who disable scripts can still place orders by telephone, and such orders made up 36.5% of net sales.", None),
    ("A modern browser with active scripts permitted is needed to load the document.\n" + BODY, None),
    ("Null pointer exception", "error_page"),
    ("Stack overflow", "error_page"),
    ("Der Server ist zurzeit nicht erreichbar.", "error_page"),
    ("La página no existe.", "error_page"),
    ("Oops!", "error_page"),
    ("\n".join(f"Entry {chr(65 + i % 26)}" for i in range(900)) + "\n503 Service Unavailable", "error_page"),
    ("Traceback (most recent call last):\n" + "".join(f'  File "m{i}.py", line {i}, in run\n' for i in range(400)) + "KeyError: 'text'", "error_page"),
    ("The agreement is made with <customer name> on the date stated below.", "placeholder"),
    ("Payment of {{ " + "very_long_name_" * 12 + " }} falls due.", "placeholder"),
    ("We store null in the field when a filer gives no date.", None),
    ("Jinja writes {{ user.name }} between braces to print a value.", None),
    ("foo bar " * 12, "filler"),
    ("Heading words come first. Body copy body copy body copy.", "filler"),
    (BODY, None),
    ("", None),
    ("   \n\t", None),
    (None, None),
    (BODY * 800, None),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, t, "clash", True, "clash") for i, (t, _) in enumerate(CASES)]
    got = find_residue(spark.createDataFrame(rows + rows[:3], DOC)).collect()
    assert len(got) == len({r.doc_id for r in got})
    return {r.doc_id: r.kind for r in got}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(found, i):
    assert found.get(i) == CASES[i][1], (CASES[i][0] or "")[:120]


def test_a_span_that_never_varies_is_text(spark):
    rows = [(i, f"The handbook shows {{name}} in column {i} of the sheet.", "", False, "") for i in range(6)]
    assert find_residue(spark.createDataFrame(rows, DOC)).count() == 0


def test_a_variable_is_none_the_less_one_for_its_number(spark):
    rows = [(i, f"Total of column {i}: $[____] million", "", False, "") for i in range(40)]
    assert find_residue(spark.createDataFrame(rows, DOC)).count() == 40


def test_copies_of_a_text_say_nothing_about_its_spans(spark):
    rows = [(i, "The agreement is made with {name} on the date stated below.", "", False, "") for i in range(6)]
    assert find_residue(spark.createDataFrame(rows, DOC)).count() == 6


FILLS = ("Norlith Foods", "Velmora Energy", "Tasquill Media", "Haxdane Water")


@pytest.mark.parametrize("left", ["COMPANY_NAME", "company_name", "Acme Corp", "____", " "])
def test_a_name_default_or_blank_in_a_slot_that_siblings_fill(spark, left):
    line = "The notes of this lease were signed by {} on the date stated below. It ends in {}."
    rows = [(i, line.format(FILLS[i % 4], 2000 + i), "", False, "") for i in range(20)] + [(99, line.format(left, 2030), "", False, "")]
    assert {r.doc_id for r in find_residue(spark.createDataFrame(rows, DOC)).collect()} == {99}


def test_a_name_that_no_sibling_fills_is_text(spark):
    rows = [(i, f"The value of max_tokens in this file was set to {i} by the owner.", "", False, "") for i in range(9)]
    assert find_residue(spark.createDataFrame(rows, DOC)).count() == 0


def test_a_weak_form_in_a_slot_that_siblings_fill(spark):
    line = "The notes of this lease were signed by {} on the date stated below. It ends in {}."
    rows = [(i, line.format("{name}" if i < 4 else FILLS[i % 4], 2000 + i), "", False, "") for i in range(20)]
    assert {r.doc_id for r in find_residue(spark.createDataFrame(rows, DOC)).collect()} == {0, 1, 2, 3}


def test_copies_of_one_unfilled_template_are_found_at_any_number(spark):
    for n in (4, 35, 700):
        rows = [(i, "Dear {{name}}, we thank you for your order of last week.", "", False, "") for i in range(n)]
        assert find_residue(spark.createDataFrame(rows, DOC)).count() == n


def test_sentences_that_repeat_themselves_are_filler_wherever_they_stand(spark):
    line = "Some quiet words stand in this place for now."
    rows = [(i, " ".join([line] * (3 + i)), "", False, "") for i in range(5)] + [(50, BODY + "\n" + line, "", False, ""), (60, BODY, "", False, "")]
    assert {r.doc_id: r.kind for r in find_residue(spark.createDataFrame(rows, DOC)).collect()} == dict.fromkeys([0, 1, 2, 3, 4, 50], "filler")


def test_a_sentence_that_seldom_repeats_itself_is_none(spark):
    rows = [(i, BODY if i > 2 else " ".join([BODY.split(". ")[0] + "."] * 4), "", False, "") for i in range(20)]
    assert find_residue(spark.createDataFrame(rows, DOC)).count() == 0


def test_fixed_sentences_beside_filler(spark):
    line = "Write a word or two on the firm in this frame."
    rows = [(i, "Text goes here. " + line if i < 6 else line, "", False, "") for i in range(9)] + [(99, "Text goes here.\n" + BODY, "", False, ""), (100, BODY, "", False, "")]
    assert {r.doc_id for r in find_residue(spark.createDataFrame(rows, DOC)).collect()} == {*range(9), 99}


def test_recurring_sentences_of_pages(spark):
    rows = [(i, "403 Forbidden\nZorblatt says the gate stays shut for now my friend.", "", False, "") for i in range(8)] + [(99, "403 Forbidden\n" + BODY, "", False, "")]
    assert {r.doc_id for r in find_residue(spark.createDataFrame(rows, DOC)).collect()} == set(range(8))


def test_a_page_without_a_known_sentence(spark):
    rows = [(i, ("403 Forbidden\n" if i < 8 else "") + "Zorblatt says the gate stays shut for now my friend.", "", False, "") for i in range(10)]
    got = {r.doc_id: r.kind for r in find_residue(spark.createDataFrame(rows, DOC)).collect()}
    assert got == dict.fromkeys(range(10), "error_page")


def test_a_recurring_text_is_no_page_for_an_error_at_its_edge(spark):
    rows = [(i, BODY if i < 20 else "403 Forbidden\n" + BODY, "", False, "") for i in range(26)]
    assert not {r.doc_id for r in find_residue(spark.createDataFrame(rows, DOC)).collect()} & set(range(20))


def test_wide_spaces_and_random_case_are_no_blanks(spark):
    rows = [(i, f"The notes of this lease were signed by {FILLS[i % 4]} on the date stated below.", "", False, "") for i in range(20)]
    rows += [(98, "The  notes  of  this  lease  were  signed  by  on  the  date  stated  below.", "", False, ""), (99, "tHe notes of this lease were signed by noRliTh on tHE datE STated below.", "", False, "")]
    assert find_residue(spark.createDataFrame(rows, DOC)).count() == 0


def test_empty(spark):
    assert find_residue(spark.createDataFrame([], DOC)).count() == 0
