"""Splitting oversized items at natural boundaries (problem 3).

Dynamic programming over all boundary positions, on both sides of an overlap: a piece
starts at one boundary and ends at a later one, is never longer than the limit, and
repeats about the wanted overlap of the piece before. The cost of a cut is the penalty
of its boundary (paragraph, line, sentence, clause, word, none), that of a piece the
square of its distance from the even size, and that of an overlap its distance from
the wanted one. Cuts inside a word are offered only where no boundary is within
reach, so a text has one exactly if it must have one.

Defined results: null texts, unknown kinds of document and texts within the limit
give no pieces; blanks count as characters; repeated rows count once; a limit
below one character gives no pieces; an overlap that is not shorter than the limit is an error; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.once import spread

# Fixed values. Penalty of a cut by the pause it is made at, of one before blanks, and of one inside a word.
PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, EARLY, HARD = 0.0, 0.1, 0.2, 0.6, 1.0, 0.3, 25.0
BLANKS, STOP, ENDS, PAUSES, CLOSERS = " \t\r\n", "。", ".!?", ";:,", "\"'”’)]"
#: Weights of the size of a piece and of its overlap against the penalty of its cut.
SIZE_WEIGHT, OVERLAP_WEIGHT = 4.0, 10.0
SCHEMA = "section_key long, item string, piece_no int, n_pieces int, start int, end int, overlap int, hard boolean, piece string"


def _is(codes: np.ndarray, chars: str) -> np.ndarray:
    return np.isin(codes, np.array([ord(c) for c in chars], np.uint32))


def boundaries(text: str, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a text can be cut, and their penalties; 0 and its length are among them.

    Every run of blanks ends in a boundary, and so does every ideographic full stop. Where two neighbours are
    further apart than the limit, the places before and inside of blanks are added, and then cuts inside words.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes)
    blank = _is(codes, BLANKS)
    edge = np.diff(np.concatenate(([0], blank.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    lines = np.concatenate(([0], np.cumsum(codes == 10)))
    returns = np.concatenate(([0], np.cumsum(codes == 13)))
    breaks = lines[ends] - lines[starts]
    before, two = codes[np.maximum(starts - 1, 0)], codes[np.maximum(starts - 2, 0)]
    last = np.where(_is(before, CLOSERS), two, before)
    words = np.select([_is(last, ENDS + STOP), _is(before, PAUSES)], [SENTENCE, CLAUSE], WORD)
    penalty = np.where(breaks >= 2, PARAGRAPH, np.where((breaks == 1) | (returns[ends] > returns[starts]), LINE, words))
    stops = np.flatnonzero(codes == ord(STOP)) + 1
    pos = np.concatenate((ends, stops, [0, n]))
    pen = np.concatenate((penalty, np.full(len(stops), SENTENCE), [0.0, 0.0]))
    pos, pen = _sorted(pos, pen)
    wide = np.flatnonzero(np.diff(pos) > limit)
    if len(wide):
        early = np.concatenate((np.flatnonzero(blank), stops - 1))
        inside = early[np.isin(np.searchsorted(pos, early, "right") - 1, wide) & (early > 0)]
        pos, pen = _sorted(np.concatenate((pos, inside)), np.concatenate((pen, np.full(len(inside), WORD + EARLY))))
        for k in np.flatnonzero(np.diff(pos) > limit):
            parts = -(-int(pos[k + 1] - pos[k]) // max(1, limit // 2))
            cuts = pos[k] + (pos[k + 1] - pos[k]) * np.arange(1, parts) // parts
            pos, pen = np.concatenate((pos, cuts)), np.concatenate((pen, np.full(len(cuts), HARD)))
        pos, pen = _sorted(pos, pen)
    return pos, pen


def _sorted(pos: np.ndarray, pen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each position once, under its least penalty."""
    order = np.lexsort((pen, pos))
    pos, pen = pos[order], pen[order]
    first = np.concatenate(([True], pos[1:] != pos[:-1]))
    return pos[first], pen[first]


def _windows(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices lo..hi-1 of each row, and which of them are real."""
    at = lo[:, None] + np.arange(max(1, int((hi - lo).max())))
    real = at < hi[:, None]
    return np.where(real, at, lo[:, None]), real


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, bool]]:
    """(start, end, overlap with the piece before, cut inside a word) of each piece of a text.

    A piece may start at every boundary that repeats between half and one and a half of the wanted overlap, or at the
    end of the piece before, and end at every boundary up to the limit. ``begin[s]`` is the least cost of starting at s,
    ``cost[j]`` that of ending at j. A piece has a least length where the text allows it, so that a whole block of ends
    depends on starts that are known.
    """
    if not 0 <= overlap < limit:
        raise ValueError(f"an overlap of {overlap} is not between 0 and the limit of {limit}")
    pos, pen = boundaries(text, limit)
    # Where the text has no cuts for the wanted overlap, and for pieces of some length, shorter ones are tried.
    for reach, spare in ((overlap, max(1, limit // 8)), (overlap, 1), (overlap // 2, 1), (overlap // 4, 1), (0, 1)):
        far = min(reach + reach // 2, (reach + limit) // 2)
        cut = _best(pos, pen, limit, reach, far, overlap, min(limit, max(limit // 4 if spare > 1 else 1, far + spare if reach else 1)))
        if cut:
            return cut
    raise AssertionError("boundaries are never further apart than the limit")


def _best(pos: np.ndarray, pen: np.ndarray, limit: int, reach: int, far: int, overlap: int, least: int) -> list[tuple[int, int, int, bool]]:
    n = int(pos[-1])
    count = max(2, -(-(n - overlap) // max(1, limit - overlap)))
    even = (n + (count - 1) * overlap) / count
    cost, back = np.full(len(pos), np.inf), np.zeros(len(pos), np.int64)
    begin, ended = np.full(len(pos), np.inf), np.zeros(len(pos), np.int64)
    cost[0] = begin[0] = 0.0
    known, j = 1, 1
    while j < len(pos):
        # Starts up to pos[j] - least are used by this block; their ends lie before it.
        stop = max(j + 1, int(np.searchsorted(pos, pos[j] + max(1, least - far))))
        until = int(np.searchsorted(pos, pos[stop - 1] - least, "right"))
        if until > known:
            s = np.arange(known, until)
            begin[s], ended[s] = cost[s] + (OVERLAP_WEIGHT if overlap else 0.0), s
            if reach:
                free = s[pen[s] < HARD]
                lo, hi = np.searchsorted(pos, pos[free] + (reach + 1) // 2), np.searchsorted(pos, pos[free] + far, "right")
                free, lo, hi = free[hi > lo], lo[hi > lo], hi[hi > lo]
                if len(free):
                    at, real = _windows(lo, hi)
                    total = np.where(real, cost[at] + OVERLAP_WEIGHT * ((pos[at] - pos[free][:, None] - overlap) / overlap) ** 2, np.inf)
                    k = np.argmin(total, axis=1)
                    value = total[np.arange(len(free)), k]
                    better = value < begin[free]
                    begin[free[better]], ended[free[better]] = value[better], at[np.arange(len(free)), k][better]
            known = until
        first = int(np.searchsorted(pos, pos[j] - limit))
        if until > first:
            length = pos[j:stop, None] - pos[None, first:until]
            total = (length - even) / limit
            total *= total
            total *= SIZE_WEIGHT
            total += begin[first:until]
            total[(length > limit) | (length < least)] = np.inf
            k = np.argmin(total, axis=1)
            cost[j:stop], back[j:stop] = total[np.arange(stop - j), k] + pen[j:stop], first + k
        j = stop
    if not np.isfinite(cost[-1]):
        return []
    out, j = [], len(pos) - 1
    while j > 0:
        s = int(back[j])
        i = int(ended[s])
        out.append((int(pos[s]), int(pos[j]), int(pos[i] - pos[s]), bool(pen[j] >= HARD and j != len(pos) - 1)))
        j = i
    return out[::-1]


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for r in batch.itertuples(index=False):
            cut = pieces(r.text, int(r.max_chars), int(r.overlap_chars))
            rows += [(r.section_key, r.item, no, len(cut), a, b, o, h, r.text[a:b]) for no, (a, b, o, h) in enumerate(cut, 1)]
            if len(rows) > 2000:
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
                rows = []
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])


def oversized(sections: DataFrame, limits: DataFrame) -> DataFrame:
    """(section_key, item, text, max_chars, overlap_chars) of the sections over their limit; limits has a row for each kind."""
    lim = limits.where("max_chars > 0").groupBy("doc_type").agg(F.min("max_chars").alias("max_chars"), F.min(F.coalesce("overlap_chars", F.lit(0))).alias("overlap_chars"))
    rows = sections.select("section_key", "item", "doc_type", "text").join(F.broadcast(lim), "doc_type").where(F.length("text") > F.col("max_chars"))
    refused = F.raise_error(F.format_string("an overlap of %d is not between 0 and the limit of %d", "overlap_chars", "max_chars"))
    allowed = (F.col("overlap_chars") >= 0) & (F.col("overlap_chars") < F.col("max_chars"))
    return rows.select("section_key", "item", "text", "max_chars", F.when(allowed, F.col("overlap_chars")).otherwise(refused.cast("int")).alias("overlap_chars"))


def split_sections(sections: DataFrame, limits: DataFrame) -> DataFrame:
    """A row for each piece of each section over its limit; a pure map, so no row moves before it."""
    return spread(oversized(sections, limits)).mapInPandas(_split, SCHEMA)


def cut_kinds(sections: DataFrame, limits: DataFrame) -> DataFrame:
    """(section_key, cut): hard where a piece had to end inside a word, else soft."""
    made = split_sections(sections, limits).groupBy("section_key").agg(F.bool_or("hard").alias("hard"))
    return made.select("section_key", F.when(F.col("hard"), "hard").otherwise("soft").alias("cut"))
