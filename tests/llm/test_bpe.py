"""Token ids against the library of the tokenizer itself."""

import os

import pytest

from ledgerloom.llm.bpe import TOKENIZERS, count_tokens, decoded_bytes, encode

FILE = os.path.join(TOKENIZERS, "byte_bpe_50k.json")
pytestmark = pytest.mark.skipif(not os.path.exists(FILE), reason="no vocabulary files")

TEXTS = [
    "Interest expense fell because average outstanding debt moved from $80.7 billion to $20,652 million.",
    "don't they'LL I'm we've  two  spaces\n\n\nlines \t tab ",
    "公司认为下降主要是由于原材料成本上升和需求疲软。会社は減少の主な理由。",
    "<|endoftext|> is text here",
    "a" * 5000 + "=-" * 300 + " " * 777 + "_" * 65,
    "\x1c\x1d\x85 　 odd spaces \r\n é É ﬁ 🇨🇭✔️",
    "x",
    " ",
    "0123456789 ½ ² Ⅷ",
    "",
    None,
]


def want(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_ids(spark):
    rows = [(i, t, [1]) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows + rows[:2], "doc_id long, text string, ids array<int>")
    got = encode(df).collect()
    assert len(got) == len(rows) + 2
    expected = want(TEXTS)
    for r in got:
        assert r.ids == expected[r.doc_id], TEXTS[r.doc_id]


def test_more_words_than_are_kept(monkeypatch):
    from ledgerloom.llm import bpe

    monkeypatch.setattr(bpe, "KEPT_WORDS", 3)
    encoder = bpe.Encoder(FILE)
    texts = ["one two three four five", "one six", "two seven one", "one two"]
    assert [encoder.encode([t])[0] for t in texts] == want(texts)


def test_counts_and_round_trip(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    expected = want(TEXTS)
    assert {r.doc_id: r.tokens for r in count_tokens(df, ["doc_id"]).collect()} == {i: len(e) for i, e in enumerate(expected)}
    back = {r.doc_id: r.n_bytes for r in decoded_bytes(spark, encode(df)).collect()}
    assert back == {i: len(t.encode()) for i, t in enumerate(TEXTS) if t}


def test_empty(spark):
    assert encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0
