"""Slots of templates, aligned over all texts by the words around them (problem 8).

A slot stands between three tokens on its left and three on its right in one
sentence, figures and capitalised words masked. The keys of all places that may
be unfilled set bits of a fixed size; every text is read against the bits, and
each stretch of up to eight tokens, none included, between two contexts that are
set comes out as a value. Wrong bits only bring rows that the join drops.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"[^\W\d]+|\d+(?:[.,]\d+)*|[^\w\s]")
UNIT = re.compile(r"\n+|(?<=[.!?])\s+")
#: Tokens of a value, bits of the filter, characters of text read at once, tokens whose codes are kept, and words that a context needs.
VALUE_TOKENS, BITS, SLICE_CHARS, KEPT_CODES, CONTEXT_WORDS = 8, 1 << 22, 1_000_000, 200_000, 3
BEGIN, END = "\n^", "\n$"
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def _code(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big")


NAME = _code("N")


def masked(token: str) -> str:
    return "N" if token[0].isupper() else "0" if token[0].isdigit() else token.lower()


class Codes(dict):
    """The code of each token, computed once."""

    def __missing__(self, token: str) -> int:
        if len(self) > KEPT_CODES:
            self.clear()
        self[token] = code = _code(token if token in (BEGIN, END) else masked(token))
        return code


def contexts(h: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of what stands left and right of the place before each token; masked names in a row count as one."""
    at, name = np.arange(len(h)), h == np.uint64(NAME)
    joined = np.zeros(len(h), bool)
    joined[1:] = name[1:] & name[:-1]
    before = np.maximum.accumulate(np.where(joined, 0, at)) - 1
    last = np.ones(len(h), bool)
    last[:-1] = ~joined[1:]
    after = np.minimum.accumulate(np.where(last, at, len(h))[::-1])[::-1] + 1
    before, after = np.where(begin, at, before), np.where(end, at, after)
    one = np.maximum(at - 1, 0)
    two, two_r = before[one], after[at]
    a, b, c, d, e, f, g = _FACTORS
    left = h[one] * a + h[two] * b + h[before[two]] * c
    right = h[at] * d + h[two_r] * e + h[after[two_r]] * f
    return left, right * g


def _bit(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(20)) & np.uint64(BITS - 1)


def candidates(marked: DataFrame, bare: str, chars: int, noise: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """(key, body, span, bare, before, after, left, template): the marked spans of ``t`` and those of the pattern ``bare``
    outside of them, with up to ``chars`` characters around them; ``left`` is null where too few words stand around. A bare span like the first pattern of a pair of ``noise``
    is none where its second one is found within 60 characters: there it is the way the text is written."""
    key, pattern, spans = marked.columns[0], re.compile(bare), re.compile("\ue000([^\ue001]*)\ue001")
    kind = marked.schema[key].dataType.simpleString()
    odd = [(re.compile(a), re.compile(b)) for a, b in noise]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = Codes()
        for frame in frames:
            out = []
            for k, body, t in zip(frame[key], frame["body"], frame["t"], strict=True):
                places, done = [], 0
                for m in spans.finditer(t):
                    places += [(b.start(), b.end(), b.group(), True) for b in pattern.finditer(t, done, m.start())]
                    places.append((m.start(), m.end(), m.group(1), False))
                    done = m.end()
                places += [(b.start(), b.end(), b.group(), True) for b in pattern.finditer(t, done)]
                for start, end, span, is_bare in places:
                    if is_bare and any(a.fullmatch(span) and (b.search(t[max(0, start - 60) : start + 1]) or b.search(t[end - 1 : end + 60])) for a, b in odd):
                        continue
                    near, far = re.search("[^\n\ue000\ue001]*$", t[max(0, start - chars) : start]).group(), re.match("[^\n\ue000]*", t[end : end + chars]).group()
                    plain = [re.sub("[\ue000\ue001]", "", x) for x in (t[max(0, start - 400) : start], t[end : end + 400])]
                    lw, rw = TOKEN.findall(UNIT.split(plain[0])[-1]), TOKEN.findall(UNIT.split(plain[1])[0])
                    # The slot parts the names on its sides, so each side is read by itself.
                    keys = []
                    for side in ([BEGIN, *lw, END], [BEGIN, *rw, END]):
                        h, edge = np.array([codes[w] for w in side], np.uint64), np.zeros((2, len(side)), bool)
                        edge[0, 0] = edge[1, -1] = True
                        keys.append(contexts(h, *edge))
                    left, right = keys[0][0][-1], keys[1][1][1]
                    known = sum(w[0].islower() for w in lw[-3:] + rw[:3]) >= CONTEXT_WORDS
                    template = left ^ right ^ np.uint64(0 if known else 1)
                    out.append((k, body, span, is_bare, near, far, left.astype(np.int64) if known else None, template.astype(np.int64)))
            yield pd.DataFrame(out, columns=[key, "body", "span", "bare", "before", "after", "left", "template"]).astype({"left": "Int64"})

    return marked.select(key, "body", "t").mapInPandas(run, f"{key} {kind}, body long, span string, bare boolean, before string, after string, left long, template long")


def key_bits(spans: DataFrame) -> np.ndarray:
    """The bits of the keys, of fixed size however many there are."""
    key = F.explode(F.array("left", "template"))
    at = spans.where("left is not null").select(key.alias("key")).select((F.shiftrightunsigned("key", 20).bitwiseAND(BITS - 1) + 1).alias("at"))
    blocks = at.groupBy(F.bitmap_bucket_number("at").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    bits = np.zeros(BITS, bool)
    for block, held in blocks:
        part = np.unpackbits(np.frombuffer(held, np.uint8), bitorder="little")
        bits[(block - 1) * len(part) : block * len(part)] = part
    return bits


def values(texts: DataFrame, bits: np.ndarray) -> DataFrame:
    """(template, body, value) of each stretch between contexts that are set in ``bits``; the value of none is 0."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def windows(texts: list[tuple[int, str]], codes: Codes) -> Iterator[tuple[int, int, int]]:
        held, units = shared.value, []
        tokens: list[str] = []
        for body, t in texts:
            for unit in UNIT.split(t):
                words = TOKEN.findall(unit)
                if len(words) >= CONTEXT_WORDS:
                    units.append((len(tokens), body))
                    tokens += [BEGIN, *words, END]
        if not tokens:
            return
        h = np.fromiter((codes[w] for w in tokens), np.uint64, len(tokens))
        starts = np.array([s for s, _ in units])
        ends = np.append(starts[1:], len(tokens)) - 1
        begin, end = np.zeros(len(h), bool), np.zeros(len(h), bool)
        begin[starts], end[ends] = True, True
        left, right = contexts(h, begin, end)
        hits = np.nonzero(held[_bit(left)] & ~begin)[0]
        for i, u in zip(hits, np.searchsorted(starts, hits, "right") - 1, strict=True):
            keys = left[i] ^ right[i : min(i + VALUE_TOKENS, ends[u]) + 1]
            met = set()
            for j in np.nonzero(held[_bit(keys)])[0]:
                if int(keys[j]) not in met:
                    met.add(int(keys[j]))
                    value = _code(" ".join(tokens[i : i + j])) if j else 0
                    yield int(keys[j].astype(np.int64)), units[u][1], value - (1 << 64) if value >> 63 else value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        if not shared.value.any():
            return
        for batch in batches:
            some, chars = [], 0
            for n, row in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), 1):
                some.append(row)
                chars += len(row[1])
                if chars >= SLICE_CHARS or n == batch.num_rows:
                    rows = list(set(windows(some, codes)))
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], names=["template", "body", "value"])
                    some, chars = [], 0

    return texts.select("body", "t").mapInArrow(run, "template long, body long, value long")
