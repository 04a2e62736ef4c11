"""Column functions on text: claims, years, table cells, rules, refusals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values. Patterns and words that results depend on.
CLAIM = r"\$\s?[\d,]+(?:\.\d+)?(?:\s?(?:million|billion|thousand|trillion))?|[\d,]*\d\.?\d*\s?%|\b\d{1,3}(?:,\d{3})+(?:\.\d+)?\b|\b\d+(?:\.\d+)?\s?(?:million|billion|thousand|trillion)\b"
NUMBER = r"\d[\d,]*(?:\.\d+)?"
TOKEN = r"[a-z0-9]+"
YEAR = r"\b(?:19[6-9]\d|20[0-4]\d)\b"
SHORT_YEAR = r"(?i)\bFY\s?'?(\d\d)\b"
MONEY = r"\$\s?[\d,]+(?:\.\d+)?(?:\s?(?:million|billion|thousand))?"
MONTH_DATE = r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},\s+\d{4}\b|\b\d{1,2}/\d{1,2}/\d{2,4}\b"
QUOTE = r'"([^"\n]{20,400})"'
CLINICAL = r"(?i)p\s*[<>=]\s*[\d\.]+|\b\d+(?:\.\d+)?\s*(?:mg(?:/kg)?|mcg|g|ml|%)\b|\b\d+\.\d+\b|\b\d{1,5}\b"
REFUSAL_MARKERS = (
    "do not contain", "does not contain", "do not include", "does not include", "not provided in", "not present in", "not directly stated", "no context chunks",
    "none of the provided", "cannot find", "could not find", "cannot answer", "unable to answer", "cannot determine", "unable to determine", "not stated in",
    "not mentioned in", "not disclosed in", "does not provide", "do not provide", "is not available", "not available in",
)
SCALES = (("thousand", 1e3), ("million", 1e6), ("billion", 1e9), ("trillion", 1e12))
UNIT_RATIOS = (1.0, 1e3, 1e6, 1e9, 1e-3, 1e-6, 1e-9)
TOLERANCE = 5e-3


def tokenize(text: Column) -> Column:
    """Lower-case words and figures, thousands separators removed."""
    return F.regexp_extract_all(F.replace(F.lower(text), F.lit(","), F.lit("")), F.lit(TOKEN), F.lit(0))


def number(text: Column) -> Column:
    """The first figure of a text as a double."""
    return F.replace(F.regexp_extract(text, NUMBER, 0), F.lit(","), F.lit("")).try_cast("double")


def claim_value(raw: Column) -> Column:
    """A claim's figure times every scale word in it."""
    value = F.coalesce(number(raw), F.lit(0.0))
    for word, factor in SCALES:
        value = value * F.when(F.contains(F.lower(raw), F.lit(word)), factor).otherwise(1.0)
    return value


def claims(text: Column) -> Column:
    """array<struct<raw, value, is_pct>> of the figures that a text claims."""
    raws = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CLAIM), F.lit(0))
    return F.transform(raws, lambda r: F.struct(F.trim(r).alias("raw"), claim_value(r).alias("value"), r.contains("%").alias("is_pct")))


def numbers(text: Column) -> Column:
    """array<double> of all figures of a text."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0)), lambda r: F.replace(r, F.lit(","), F.lit("")).try_cast("double"))


def close(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    """Equal within a tolerance relative to the larger of both; zero only equals zero."""
    return F.when((a == 0) | (b == 0), (a == 0) & (b == 0)).otherwise(F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b)))


def supported(claim: Column, known: Column) -> Column:
    """Whether a claim equals a known figure, in one of the usual units unless it is a percentage."""
    plain = F.exists(known, lambda n: close(n, claim["value"]))
    scaled = F.exists(known, lambda n: F.exists(F.array(*map(F.lit, UNIT_RATIOS)), lambda r: close(n, claim["value"] / r)))
    return F.when(claim["is_pct"], plain).otherwise(scaled)


def tolerance_of(rules: Column) -> Column:
    """The share that the rule numeric_tolerance:x% allows, 0 without one."""
    found = F.transform(rules, lambda r: F.regexp_extract(F.trim(r), r"^numeric_tolerance:\s*(\d+(?:\.\d+)?)%$", 1))
    return F.coalesce(F.array_max(F.transform(found, lambda x: x.try_cast("double"))), F.lit(0.0)) / 100


def allows_units(rules: Column) -> Column:
    return F.coalesce(F.exists(rules, lambda r: F.trim(r) == "unit_equivalence"), F.lit(False))


def scale_word(raw: Column) -> Column:
    low = F.lower(raw)
    return F.when(low.contains("trillion"), "trillion").when(low.contains("billion"), "billion").when(low.contains("million"), "million").when(low.contains("thousand"), "thousand").otherwise("")


def figures_match(expected: Column, actual: Column, rules: Column) -> Column:
    """Whether every figure of the expected answer is in the actual one; without figures, whether its text is."""
    want, have = claims(expected), claims(actual)
    tol, units = F.greatest(tolerance_of(rules), F.lit(1e-9)), allows_units(rules)

    def same(e: Column, a: Column) -> Column:
        ratios = F.when(units & ~e["is_pct"], F.array(*map(F.lit, UNIT_RATIOS))).otherwise(F.array(F.lit(1.0)))
        near = F.exists(ratios, lambda r: F.when(e["value"] == 0, a["value"] == 0).otherwise(F.abs(a["value"] * r - e["value"]) <= tol * F.abs(e["value"])))
        return (a["is_pct"] == e["is_pct"]) & near & (units | (e["value"] == 0) | (scale_word(a["raw"]) == scale_word(e["raw"])))

    e_text, a_text = squeezed(expected), squeezed(actual)
    in_text = F.when((F.length(e_text) <= 5) & e_text.rlike("^[a-z]+$"), F.array_contains(F.split(F.regexp_replace(a_text, "[^a-z0-9_]+", " "), " "), e_text)).otherwise(F.contains(a_text, e_text))
    return F.when(F.size(want) == 0, in_text).otherwise(F.forall(want, lambda e: F.exists(have, lambda a: same(e, a))))


def squeezed(text: Column) -> Column:
    """Lower case, single spaces, without dots and spaces at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"^[ .]+|[ .]+$", ""), r"[ \t\r\n]+", " "))


def refuses(text: Column) -> Column:
    low = F.lower(text)
    found = F.lit(False)
    for marker in REFUSAL_MARKERS:
        found = found | low.contains(marker)
    return F.coalesce(found, F.lit(False))


def years(text: Column) -> Column:
    """array<int> of the years that a text names, FY25 and FY'25 included."""
    long = F.transform(F.regexp_extract_all(text, F.lit(YEAR), F.lit(0)), lambda y: y.cast("int"))
    short = F.transform(F.regexp_extract_all(text, F.lit(SHORT_YEAR), F.lit(1)), lambda y: y.cast("int") + F.when(y.cast("int") < 70, 2000).otherwise(1900))
    return F.concat(long, short)


def cell_value(cell: Column) -> Column:
    """The figure of a table cell, negative in parentheses; null for dashes and prose."""
    c = F.trim(cell)
    clean = c.rlike(r"^[$€£() %\t]*[\d,]*\d[\d,]*(?:\.\d+)?[$€£() %\t]*$")
    value = F.replace(F.regexp_extract(c, r"[\d,]+(?:\.\d+)?", 0), F.lit(","), F.lit("")).try_cast("double")
    return F.when(clean, F.when(c.contains("(") & c.contains(")"), -value).otherwise(value))
