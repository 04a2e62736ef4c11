"""Unit conversion against exact values worked out by hand and by fractions."""

from fractions import Fraction

import pytest

from ledgerloom.operators.units import convert, out_of_range

CASE = "id string, input string, answer string, variation_rules array<string>, notes string, unit string, power int"
KINDS = [("money", "USD"), ("ratio", "bp"), ("mass", "ug"), ("duration", "min"), ("term", "month"), ("length", "mm"), ("volume", "ul"), ("area", "cm2"), ("temperature", "mdegC")]


def half_up(x):
    x = Fraction(x)
    n = (abs(x) + Fraction(1, 2)).__floor__()
    return n if x >= 0 else -n


CASES = [
    ("$34.4M", "", None, None, {("USD", 34_400_000)}),
    ("It went from $48.2038 bn to US$ 0.0566-billion, a change of 24.3 percent.", "", None, None, {("USD", 48_203_800_000), ("USD", 56_600_000), ("bp", 2430)}),
    ("US-Dollar 712.164,4 Mio.", "", None, None, {("USD", 712_164_400_000)}),
    ("US-Dollar 48,9 Mio. in fiscal year 2022, per Note 16.", "", None, None, {("USD", 48_900_000)}),
    ("It came to $(62.18) billion in fiscal year 2025", "", None, None, {("USD", -62_180_000_000)}),
    ("negative USD 5,670M", "", None, None, {("USD", -5_670_000_000)}),
    ("−$7,247 mn", "", None, None, {("USD", -7_247_000_000)}),
    ("8,212,000,000 dollars", "", None, None, {("USD", 8_212_000_000)}),
    ("$60.31", "State it in billions of dollars.", None, None, {("USD", 60_310_000_000)}),
    ("$0.8502", "", ["unit:USD_B"], None, {("USD", 850_200_000)}),
    ("20,600,000,000", "Give the figure in whole dollars.", ["unit_equivalence"], None, {("USD", 20_600_000_000)}),
    ("76.2", "", None, "v1 builder; figures in percent", {("bp", 7620)}),
    ("2,307", "", ["unit:BPS"], None, {("bp", 2307)}),
    ("80.2‰", "", None, None, {("bp", 802)}),
    ("Margin stood at 3 per mille, see Note 15.", "", None, None, {("bp", 30)}),
    ("865 mg", "", None, None, {("ug", 865_000)}),
    ("5,154", "how much was given? (in micrograms)", None, None, {("ug", 5154)}),
    ("6 lb", "", None, None, {("ug", half_up(6 * Fraction("453592370")))}),
    ("Participants received 116,000 µg of farextidine.", "", None, None, {("ug", 116_000)}),
    ("Under Section 6.4, 113 hrs must pass.", "", None, None, {("min", 6780)}),
    ("thirty (30) days", "", None, None, {("min", 43_200)}),
    ("The waiting time is forty-five weeks.", "", None, None, {("min", 453_600)}),
    ("It binds Agent for 5 quarters after signing.", "", None, None, {("month", 15)}),
    ("2 yrs", "", None, None, {("month", 24)}),
    ("The mean was 49.4 cm.", "", None, None, {("mm", 494)}),
    ("71.1 in according to Section 11.6", "", None, None, {("mm", half_up(Fraction("71.1") * Fraction("25.4")))}),
    ("7 ft", "", None, None, {("mm", half_up(7 * Fraction("304.8")))}),
    ("5,366 µL", "", None, None, {("ul", 5366)}),
    ("89.5 dL over the study period", "", None, None, {("ul", 8_950_000)}),
    ("Falkova Water leases 8,391 acres in Marrow Bay.", "", None, None, {("cm2", half_up(8391 * Fraction("40468564.224")))}),
    ("The site covers 12 sq. ft. (Item 2, fiscal year 2020).", "", None, None, {("cm2", half_up(12 * Fraction("929.0304")))}),
    ("15 m²", "", None, None, {("cm2", 150_000)}),
    ("98", "", None, "Source value is in degrees Fahrenheit.", {("mdegC", half_up((98 - 32) * Fraction(5000, 9)))}),
    ("310.15 K", "", None, None, {("mdegC", 37_000)}),
    ("36.6 °C", "", None, None, {("mdegC", 36_600)}),
    ("4390 basis points", "", None, "source table in thousands.", {("bp", 4390)}),
    ("5 mg/dL", "", None, None, set()),
    ("81,578", "", ["unit_equivalence"], "source table in thousands.", set()),
    ("5 of 52,327", "", None, None, set()),
    ("8 reportable segments", "", None, None, set()),
    ("Note 6", "", None, None, set()),
    ("C45H57ClO3", "", None, None, set()),
    ("February 3, 2020", "", None, None, set()),
    ("Margin stood at 0.7, see Note 13", "", ["unit:PCT"], None, {("bp", 70)}),
    ("two hundred and fifty kg", "", None, None, {("ug", 250_000_000_000)}),
    ("one hundred kilograms", "", None, None, {("ug", 100_000_000_000)}),
    ("one hundred twenty minutes", "", None, None, {("min", 120)}),
    ("three million four hundred thousand and five dollars", "", None, None, {("USD", 3_400_005)}),
    ("3.5 x 10^3 mg", "", None, None, {("ug", 3_500_000)}),
    ("2.5×10⁻³ g", "", None, None, {("ug", 2500)}),
    ("1e3 g", "", None, None, {("ug", 1_000_000_000)}),
    ("5 thousand million dollars", "", None, None, {("USD", 5_000_000_000)}),
    ("2 kg per cubic metre", "", None, None, set()),
    ("2 m3 per metre", "", None, None, {("cm2", 20_000)}),
    ("12 mg per tablet", "", None, None, set()),
    ("12 mg per the label", "", None, None, {("ug", 12_000)}),
    ("between 5 and 10 kg", "", None, None, {("ug", 5_000_000_000), ("ug", 10_000_000_000)}),
    ("5-10 kg", "", None, None, {("ug", 5_000_000_000), ("ug", 10_000_000_000)}),
    ("3 to 4 million dollars", "", None, None, {("USD", 3_000_000), ("USD", 4_000_000)}),
    ("clauses and 10 kg", "", None, None, {("ug", 10_000_000_000)}),
    ("900000000 tonnes", "", None, None, set()),
    ("", "", None, None, set()),
    (None, None, None, None, set()),
    ("9" * 400 + " kg", "", None, None, set()),
    ("no " * 50_000 + "7 kg", "", None, None, {("ug", 7_000_000_000)}),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(str(i), q, a, r, n, "clash", 1) for i, (a, q, r, n, _) in enumerate(CASES)]
    kinds = spark.createDataFrame(KINDS, "quantity string, common_unit string")
    got = convert(spark.createDataFrame(rows + rows[:3], CASE), kinds).collect()
    assert len(got) == len({tuple(g) for g in got})
    assert {(g.quantity, g.common_unit) for g in got} <= set(KINDS)
    out = {}
    for g in got:
        out.setdefault(int(g.id), set()).add((g.common_unit, g.amount))
    return out


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(found, i):
    assert found.get(i, set()) == CASES[i][4], CASES[i][:4]


def test_empty(spark):
    kinds = spark.createDataFrame(KINDS, "quantity string, common_unit string")
    assert convert(spark.createDataFrame([], CASE), kinds).count() == 0
    assert convert(spark.createDataFrame([("1", "", "5 kg", None, None, "", 0)], CASE), kinds.limit(0)).count() == 0


def test_amounts_beyond_a_bigint_are_reported(spark):
    kinds = spark.createDataFrame(KINDS, "quantity string, common_unit string")
    rows = [("a", None, "900000000 tonnes", None, None, "", 1), ("b", None, "9 tonnes", None, None, "", 1)]
    got = out_of_range(spark.createDataFrame(rows, CASE), kinds).collect()
    assert [(r.id, r.common_unit, int(r.amount)) for r in got] == [("a", "ug", 9 * 10**20)]
