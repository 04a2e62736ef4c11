"""Quantities recorded in different units (problem 5).

A grammar of numbers (figures, powers of ten, number words), ranges, scale words and
unit expressions is one regular expression built from the unit table; it is matched
once inside the JVM, and its parts are evaluated by rules of the grammar. Every unit
has a vector of exponents over the base dimensions (a power multiplies it, a divisor
subtracts its own), and only a vector that equals the one of a wanted kind is
converted, with the unit's scale and offset, to the common unit of that kind.

Defined results: null or empty answers, numbers without a unit anywhere, numbers
of more than 24 digits, units of no wanted kind and unknown divisors give no row;
amounts beyond a bigint come out of ``out_of_range``; repeated rows and
repeated quantities of one case give one row; other columns are ignored.
"""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.once import once

DIMENSIONS = ("money", "ratio", "mass", "time", "calendar", "length", "temperature")

# Fixed values. Unit names, dimensions, and the value in coherent units
# (dollar, basis point, microgram, minute, month, millimetre, thousandth of a
# degree Celsius) as (x * scale + offset) / divisor.
UNITS = (
    ("dollars|dollar|US dollars|US dollar|U.S. dollars|USD|US-Dollar", {"money": 1}, "1", "0", "1"),
    ("%|percent|per cent|pct|pct.|Prozent|percentage points|percentage point", {"ratio": 1}, "100", "0", "1"),
    ("‰|per mille|per mill|permille|promille", {"ratio": 1}, "10", "0", "1"),
    ("basis points|basis point|bps|bp", {"ratio": 1}, "1", "0", "1"),
    ("ng|nanograms|nanogram", {"mass": 1}, "1", "0", "1000"),
    ("µg|ug|mcg|micrograms|microgram|microgrammes", {"mass": 1}, "1", "0", "1"),
    ("mg|milligrams|milligram|milligrammes", {"mass": 1}, "1000", "0", "1"),
    ("g|grams|gram|grammes", {"mass": 1}, "1000000", "0", "1"),
    ("kg|kilograms|kilogram|kilos|kilogrammes", {"mass": 1}, "1000000000", "0", "1"),
    ("tonnes|tonne|metric tons", {"mass": 1}, "1000000000000", "0", "1"),
    ("lb|lbs|pounds|pound", {"mass": 1}, "453592370", "0", "1"),
    ("oz|ounces|ounce", {"mass": 1}, "453592370", "0", "16"),
    ("s|sec|secs|seconds|second", {"time": 1}, "1", "0", "60"),
    ("min|mins|minutes|minute", {"time": 1}, "1", "0", "1"),
    ("h|hr|hrs|hours|hour", {"time": 1}, "60", "0", "1"),
    ("d|days|day", {"time": 1}, "1440", "0", "1"),
    ("wk|wks|weeks|week", {"time": 1}, "10080", "0", "1"),
    ("mo|months|month", {"calendar": 1}, "1", "0", "1"),
    ("quarters|quarter", {"calendar": 1}, "3", "0", "1"),
    ("yr|yrs|years|year", {"calendar": 1}, "12", "0", "1"),
    ("µm|um|micrometres|micrometers", {"length": 1}, "1", "0", "1000"),
    ("mm|millimetres|millimeters|millimetre|millimeter", {"length": 1}, "1", "0", "1"),
    ("cm|centimetres|centimeters|centimetre|centimeter", {"length": 1}, "10", "0", "1"),
    ("dm|decimetres|decimeters", {"length": 1}, "100", "0", "1"),
    ("m|metres|meters|metre|meter", {"length": 1}, "1000", "0", "1"),
    ("km|kilometres|kilometers|kilometre|kilometer", {"length": 1}, "1000000", "0", "1"),
    ("in|inches|inch", {"length": 1}, "25.4", "0", "1"),
    ("ft|feet|foot", {"length": 1}, "304.8", "0", "1"),
    ("yd|yards|yard", {"length": 1}, "914.4", "0", "1"),
    ("miles|mile", {"length": 1}, "1609344", "0", "1"),
    ("µL|µl|uL|ul|microlitres|microliters|microlitre|microliter", {"length": 3}, "1", "0", "1"),
    ("mL|ml|millilitres|milliliters|millilitre|milliliter", {"length": 3}, "1000", "0", "1"),
    ("cL|cl|centilitres|centiliters", {"length": 3}, "10000", "0", "1"),
    ("dL|dl|decilitres|deciliters|decilitre|deciliter", {"length": 3}, "100000", "0", "1"),
    ("L|l|litres|liters|litre|liter", {"length": 3}, "1000000", "0", "1"),
    ("sqm", {"length": 2}, "1000000", "0", "1"),
    ("sqft", {"length": 2}, "92903.04", "0", "1"),
    ("ha|hectares|hectare", {"length": 2}, "10000000000", "0", "1"),
    ("acres|acre", {"length": 2}, "4046856422.4", "0", "1"),
    ("°C|degC|degrees Celsius|degree Celsius|Celsius", {"temperature": 1}, "1000", "0", "1"),
    ("°F|degF|degrees Fahrenheit|degree Fahrenheit|Fahrenheit", {"temperature": 1}, "5000", "-160000", "9"),
    ("K|kelvins|kelvin", {"temperature": 1}, "1000", "-273150", "1"),
)
# Fixed values. The wanted kinds: common unit, dimensions, coherent units in one common unit.
KINDS = (
    ("USD", {"money": 1}, 1),
    ("bp", {"ratio": 1}, 1),
    ("ug", {"mass": 1}, 1),
    ("min", {"time": 1}, 1),
    ("month", {"calendar": 1}, 1),
    ("mm", {"length": 1}, 1),
    ("ul", {"length": 3}, 1),
    ("cm2", {"length": 2}, 100),
    ("mdegC", {"temperature": 1}, 1),
)
# Fixed values. Scale words.
SCALES = {
    "whole": 1, "hundred": 10**2, "thousand": 10**3, "tsd": 10**3, "k": 10**3, "million": 10**6, "mn": 10**6, "mln": 10**6, "mm": 10**6, "m": 10**6, "mio": 10**6,
    "billion": 10**9, "bn": 10**9, "b": 10**9, "mrd": 10**9, "trillion": 10**12, "tn": 10**12, "t": 10**12,
}
# Fixed values. Codes of the rule "unit:CODE" as (scale word, unit).
RULE_CODES = {
    "USD": ("", "dollars"), "USD_TH": ("thousand", "dollars"), "USD_M": ("million", "dollars"), "USD_B": ("billion", "dollars"), "USD_T": ("trillion", "dollars"),
    "PCT": ("", "percent"), "BPS": ("", "bps"), "PERMILLE": ("", "permille"),
}
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"

SUPERSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹⁻"
POWER_OF_TEN = rf"(?:[eE][+-]?\d{{1,2}}(?!\w)|\s*[x×·]\s*10(?:\s*(?:\^|\*\*)\s*[-−]?\d{{1,2}}(?!\d)|[{SUPERSCRIPTS}]+))"
NUMBER = rf"(?:\d{{1,3}}(?:[,.\u00a0\u202f'’]\d{{3}})+(?!\d)(?:[.,]\d+)?|\d+(?:[.,]\d+)?){POWER_OF_TEN}?"
# Fixed values. Number words are put together from these.
ONES = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
TEENS = ("ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen")
TENS = ("twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")
NUMBER_WORDS = {w: i for i, w in enumerate(ONES, 1)} | {w: i for i, w in enumerate(TEENS, 10)} | {w: 10 * i for i, w in enumerate(TENS, 2)}
MULTIPLIERS = {"hundred": 10**2, "thousand": 10**3, "million": 10**6, "billion": 10**9, "trillion": 10**12}
_WORD = "|".join((*TEENS, *TENS, *ONES))
WORDS = rf"(?i:(?:{_WORD})(?:[\s-]+(?:and\s+)?(?:{_WORD}|{'|'.join(MULTIPLIERS)})\b)*)\b"
LONG_SCALE = r"thousands?|millions?|billions?|trillions?|mn|mln|bn|tn|Mio\.?|Mrd\.?|Tsd\.?"
NOT_INCH = r"(?!\s+(?:fiscal|the|total|all|each|every|an?|order|comparison|line|\d|[A-Z]|" + LONG_SCALE + r"|whole)\b)"


def _names() -> list[str]:
    return sorted((n for names, *_ in UNITS for n in names.split("|")), key=len, reverse=True)


def _unit_pattern() -> str:
    """Group: the unit name. Words end at a word's end, short symbols keep their case."""
    parts = []
    for n in _names():
        p = re.escape(n).replace(r"\ ", r"\s+")
        if len(n) > 3:
            p = f"(?i:{p})"
        parts.append(p + (r"(?!\p{L}|[014-9]|[23]\d)" if n[-1].isalpha() else "") + (NOT_INCH if n == "in" else ""))
    return "(" + "|".join(parts) + ")"


#: The parts of a token, in the order of the groups of the pattern.
PARTS = ("neg_a", "par", "cur", "neg_b", "num_a", "scale_a", "both", "neg_c", "num_b", "scale_b", "pow_word", "unit", "pow_sign", "per_pow", "per", "per_sign", "range", "next")


def token_pattern() -> str:
    """A quantity: money [sign] currency number [scale], or [sign] number [scale] [unit [/ unit]], with what follows it."""
    unit, power, sign = _unit_pattern(), r"(?:((?i:square|sq\.?|cubic|cu\.?)\s+)?", r"(²|³|\^?[23](?!\d))?"
    minus = r"((?i:negative\s+|minus\s+)|(?<![\p{L}\d])[-−–]\s?)?"
    scale = rf"((?:{LONG_SCALE})(?:[\s-]+(?:{LONG_SCALE}))?"
    money = rf"{minus}(\(\s*)?(US-Dollar|US\$|USD|\$)\s*([(−–-]\s*)?({NUMBER})\)?(?:[\s-]*{scale}|MM|[KkMmBbTt])(?![\p{{L}}\d]))?"
    over = rf"(?:\s*(?:/|\bper\b)\s*{power}{unit[:-1]}|(?!(?:the|this|that|its|our|their|his|her|your)\b)\p{{Ll}}[\p{{L}}-]*){sign}))?"
    plain = (
        rf"((?i:between|both|either)\s+)?{minus}(?<![\p{{L}}\d.,$_])(?<![\p{{L}}_]-)({NUMBER}|{WORDS})(?![\d\p{{Lu}}]*\p{{Lu}}\d)\)?(?:[\s-]*{scale})(?![\p{{L}}\d]))?"
        rf"(?:[\s-]*{power}{unit}{sign}){over})?"
        r"(?:(?=\s*(to|and|or|-|–|—)\s*[-−]?\d)|)"
        r"(?:(?=\s*([¶.,;:)—]|(?:in|for|as|at|according|under|after|before|over|on|see)\b))|)"
    )
    return f"(?:{money}|{plain})"


def hint_pattern() -> str:
    """Groups: scale word and unit name of a statement like 'figures in thousands of dollars'."""
    long = [n for n in _names() if len(n) > 3 or n in ("pct",)]
    names = "|".join(re.escape(n).replace(r"\ ", r"\s+") for n in long)
    return rf"(?i)\b(?:in|units?:?|is|are)\s+(?:(whole|hundreds?|thousands?|millions?|billions?|trillions?)\s+(?:of\s+)?)?((?:square\s+|cubic\s+)?(?:{names}))(?![\p{{L}}\d])"


def _vector(dims: dict[str, int], power: int = 1) -> list[int]:
    return [dims.get(d, 0) * power for d in DIMENSIONS]


def unit_table(spark: SparkSession) -> DataFrame:
    """(unit, power, vector, num, off, den): a fixed table of a few hundred rows."""
    rows = []
    for names, dims, num, off, den in UNITS:
        for name in names.split("|"):
            for power in (1, 2, 3) if dims == {"length": 1} else (1,):
                rows.append((name.lower() if len(name) > 3 else name, power, _vector(dims, power), str(Decimal(num) ** power), off, str(Decimal(den) ** power)))
    df = spark.createDataFrame(rows, "unit string, power int, vector array<int>, num string, off string, den string").dropDuplicates(["unit", "power"])
    return df.select("unit", "power", "vector", *(F.col(c).cast("decimal(24,4)").alias(c) for c in ("num", "off", "den")))


def kind_table(spark: SparkSession, common_units: DataFrame) -> DataFrame:
    """The wanted kinds that stand in common_units, keyed by their vector."""
    kinds = spark.createDataFrame([(u, _vector(v), d) for u, v, d in KINDS], "common_unit string, vector array<int>, per_common int")
    return kinds.join(F.broadcast(common_units.select("quantity", "common_unit").distinct()), "common_unit").select(
        F.array_join(F.col("vector").cast("array<string>"), ",").alias("dims"), "quantity", "common_unit", "per_common"
    )


def _scale(words: Column) -> Column:
    """The product of one or two scale words."""
    table = F.create_map(*[F.lit(x) for kv in SCALES.items() for x in kv])
    value = lambda w: F.coalesce(F.try_element_at(table, F.regexp_replace(w, r"\.|(?<=[dn])s$", "")), F.lit(1))
    word = F.split(F.lower(F.trim(words)), r"[\s-]+")
    return (value(F.get(word, F.lit(0))).cast("decimal(13,0)") * F.coalesce(value(F.get(word, F.lit(1))), F.lit(1)).cast("decimal(13,0)")).cast("decimal(25,0)")


def _unit_key(name: Column) -> Column:
    plain = F.regexp_replace(F.translate(name, "μ", "µ"), r"\s+", " ")
    return F.when(F.length(plain) > 3, F.lower(plain)).otherwise(plain)


def _number(text: Column, scale: Column, currency: Column) -> Column:
    """Its value: a decimal comma in German notation, else a decimal point, times a power of ten; or a number in words."""
    power = F.translate(F.regexp_extract(text, POWER_OF_TEN + "$", 0), SUPERSCRIPTS + "−", "0123456789--")
    exponent = F.regexp_extract(F.regexp_replace(power, r"^\s*[x×·]\s*10", ""), r"([+-]?\d+)$", 1)
    text = F.regexp_replace(text, POWER_OF_TEN + "$", "")
    german = (
        (currency == "US-Dollar") | scale.rlike("^(Mio|Mrd|Tsd)") | text.rlike(r"^\d{1,3}(\.\d{3})+,\d+$") | text.rlike(r"^\d{1,3}(\.\d{3}){2,}$") | text.rlike(r"^\d+,(\d{1,2}|\d{4,})$")
    )
    bare = F.regexp_replace(text, r"[\u00a0\u202f'’]", "")
    digits = F.when(german, F.translate(F.translate(bare, ".", ""), ",", ".")).otherwise(F.translate(bare, ",", ""))
    digits = F.when(exponent != "", F.concat(digits, F.lit("E"), exponent)).otherwise(digits).try_cast("decimal(24,8)")
    ones, many = (F.create_map(*[F.lit(x) for k, v in t.items() for x in (k, F.lit(v).cast("bigint"))]) for t in (NUMBER_WORDS, MULTIPLIERS))

    def add(acc: Column, w: Column) -> Column:
        # acc: what is complete, and what the next multiplier takes
        times, unit = F.try_element_at(many, w), F.coalesce(F.try_element_at(ones, w), F.lit(0).cast("bigint"))
        whole = times > 100
        return F.struct(
            F.when(whole, acc["sum"] + acc["part"] * times).otherwise(acc["sum"]).alias("sum"),
            F.when(whole, F.lit(0).cast("bigint")).when(times == 100, acc["part"] * 100).otherwise(acc["part"] + unit).alias("part"),
        )

    zero = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(0).cast("bigint").alias("part"))
    spoken = F.aggregate(F.split(F.lower(text), r"[\s-]+"), zero, add, lambda acc: acc["sum"] + acc["part"])
    return F.when(text.rlike(r"^\d"), digits).otherwise(spoken.cast("decimal(24,8)"))


def tokens(cases: DataFrame) -> DataFrame:
    """A row for each quantity of an answer: (id, rule, hint_scale, hint_unit, its parts, after: the parts of the next one).

    The pattern is matched once: it puts marks around the tokens of a text and between their parts.
    """
    where = (
        r"(?i)\b(?:notes?|sections?|items?|tables?|pages?|parts?|chapters?|exhibits?|clauses?|schedules?|phases?|fy|fiscal\s+years?|no\.)\s*\d+[A-Z]?(?:\.\d+)*(?!\d)"
        rf"|\b(?:{MONTHS})\s+\d{{1,2}},?\s+\d{{4}}|\b\d{{1,2}}\s+(?:{MONTHS})\s+\d{{4}}|\b\d{{4}}-\d\d-\d\d\b"
    )
    text = F.concat(F.regexp_replace(F.translate("answer", "μ\ue000\ue001\ue002", "µ"), where, " § "), F.lit(" ¶"))
    marks = "\ue000" + "\ue001".join(f"${i}" for i in range(1, len(PARTS) + 1)) + "\ue002"
    marked = F.split(F.regexp_replace(text, token_pattern(), marks), "\ue000")
    parts = F.transform(F.slice(marked, 2, 1 << 30), lambda t: F.split(F.substring_index(t, "\ue002", 1), "\ue001"))
    rule = F.get(F.filter("variation_rules", lambda r: r.startswith("unit:")), F.lit(0))
    said = F.concat_ws(" ¶ ", "input", "notes")
    read = cases.select("id", "answer", F.substring(rule, 6, 100).alias("rule"), said.alias("said")).where(F.col("answer").isNotNull()).distinct()
    read = once(read, "id", "rule", hint_scale=F.regexp_extract("said", hint_pattern(), 1), hint_unit=F.regexp_extract("said", hint_pattern(), 2), parts=parts)
    each = F.explode(F.transform("parts", lambda t, i: F.struct(t.alias("t"), F.get("parts", i + 1).alias("after"))))
    t = read.select("id", "rule", "hint_scale", "hint_unit", each.alias("x"))
    named = lambda array, prefix="": [F.get(array, F.lit(i)).alias(prefix + n) for i, n in enumerate(PARTS)]
    return t.select("id", "rule", "hint_scale", "hint_unit", *named(F.col("x.t")), F.struct(*named(F.col("x.after"))).alias("after"))


def _ranges(t: DataFrame) -> DataFrame:
    """The first number of a range ("between 5 and 10 kg", "5 to 10 kg") with the scale and the unit of the second one."""
    open_ = (F.col("range") != "") & (F.col("cur") == "") & (F.col("unit") == "") & F.col("num_b").rlike(r"^\d") & (F.coalesce("after.unit", F.lit("")) != "")
    t = t.withColumn("first", open_ & ((F.col("both") != "") | ~F.col("range").isin("and", "or")))
    taken = {c: F.when(F.col("first"), F.col(f"after.{c}")).otherwise(F.col(c)) for c in ("pow_word", "unit", "pow_sign", "per_pow", "per", "per_sign")}
    scale = F.when(F.col("first") & (F.col("scale_b") == ""), F.col("after.scale_b")).otherwise(F.col("scale_b"))
    return t.withColumns(taken | {"scale_b": scale})


def _power(words: Column) -> Column:
    return F.when(words.rlike("(?i)^sq|²|2"), 2).when(words.rlike("(?i)^cu|³|3"), 3).otherwise(1)


def converted(cases: DataFrame, common_units: DataFrame) -> DataFrame:
    """(id, quantity, common_unit, amount) of cases (id, input, answer, variation_rules, notes), whatever the size of the amount."""
    spark = cases.sparkSession
    t = _ranges(tokens(cases))
    codes = F.create_map(*[F.lit(x) for k, (s, u) in RULE_CODES.items() for x in (k, f"{s}|{u}")])
    code = F.split(F.coalesce(F.try_element_at(codes, F.col("rule")), F.concat(F.lit("|"), F.col("rule"))), r"\|")
    hint_scale = F.when(F.col("rule").isNotNull(), F.get(code, F.lit(0))).otherwise(F.col("hint_scale"))
    hint_unit = F.when(F.col("rule").isNotNull(), F.get(code, F.lit(1))).when(F.col("hint_unit") != "", F.col("hint_unit"))
    t = t.withColumn("hint_s", hint_scale).withColumn("hint_u", hint_unit)

    money = F.col("cur") != ""
    written = F.col("unit") != ""
    own_scale = F.when(money, F.col("scale_a")).otherwise(F.col("scale_b"))
    hinted_money = F.lower("hint_u").isin("dollars", "dollar", "us dollars", "usd")
    bare = ~money & ~written
    t = t.where(money | written | (F.col("hint_u").isNotNull() & (F.col("next") != "") & F.col("num_b").rlike(r"^\d")))
    unit_text = F.when(money, F.lit("dollars")).when(written, F.col("unit")).otherwise(F.regexp_replace("hint_u", r"(?i)^(square|cubic)\s+", ""))
    power_text = F.when(written, F.concat("pow_word", "pow_sign")).when(bare, F.regexp_extract("hint_u", r"(?i)^(square|cubic)\s", 1)).otherwise(F.lit(""))
    scale = F.when((own_scale == "") & (bare | (money & hinted_money)), _scale(F.col("hint_s"))).otherwise(_scale(own_scale))
    value = F.when(money, _number(F.col("num_a"), F.col("scale_a"), F.col("cur"))).otherwise(_number(F.col("num_b"), F.col("scale_b"), F.lit("")))
    t = t.select(
        "id",
        _unit_key(unit_text).alias("unit"),
        _power(power_text).alias("power"),
        _unit_key(F.col("per")).alias("per"),
        _power(F.concat("per_pow", "per_sign")).alias("per_power"),
        (value * scale).try_cast("decimal(38,8)").alias("value"),
        (F.concat("neg_a", "par", "neg_b", "neg_c") != "").alias("negative"),
    ).where(F.col("value").isNotNull())

    units = unit_table(spark)
    over = units.select(F.col("unit").alias("per"), F.col("power").alias("per_power"), F.col("vector").alias("per_vector"), F.col("num").alias("per_num"), F.col("den").alias("per_den"))
    t = t.join(F.broadcast(units), ["unit", "power"]).join(F.broadcast(over), ["per", "per_power"], "left").where((F.col("per") == "") | F.col("per_vector").isNotNull())
    dims = F.when(F.col("per") == "", F.col("vector")).otherwise(F.zip_with("vector", "per_vector", lambda a, b: a - b))
    t = t.withColumn("dims", F.array_join(dims.cast("array<string>"), ",")).join(F.broadcast(kind_table(spark, common_units)), "dims")
    # Only a temperature has an offset, which a sign stands before; other amounts are converted by their size.
    sign = F.when(F.col("negative"), -1).otherwise(1)
    inner = F.when(F.col("common_unit") == "mdegC", sign).otherwise(1)
    coherent = (inner * F.col("value") * F.col("num") + F.col("off")) / F.col("den")
    coherent = F.when(F.col("per") == "", coherent).otherwise(coherent * F.col("per_den") / F.col("per_num"))
    outer = F.when(F.col("common_unit") == "mdegC", 1).otherwise(sign)
    return t.select("id", "quantity", "common_unit", (outer * F.round(coherent / F.col("per_common"), 0)).try_cast("decimal(38,0)").alias("amount")).where(F.col("amount").isNotNull()).distinct()


def convert(cases: DataFrame, common_units: DataFrame) -> DataFrame:
    """(id, quantity, common_unit, amount): the amounts that a bigint holds; ``out_of_range`` has the others."""
    rows = converted(cases, common_units)
    return rows.withColumn("amount", F.col("amount").try_cast("bigint")).where(F.col("amount").isNotNull())


def out_of_range(cases: DataFrame, common_units: DataFrame) -> DataFrame:
    """(id, quantity, common_unit, amount) of the amounts beyond a bigint, as decimals."""
    return converted(cases, common_units).where(F.col("amount").try_cast("bigint").isNull())


def golden_quantities(golden: DataFrame, common_units: DataFrame) -> DataFrame:
    """The quantities of golden_set_v1.expected.answer in the common units."""
    return convert(golden.select("id", "input", F.col("expected.answer").alias("answer"), "variation_rules", "notes"), common_units)
