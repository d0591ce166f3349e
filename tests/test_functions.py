import pytest
from pyspark.sql import functions as F

from tidemill.functions import numbers, text, times, values


def outcomes(spark, cells, step):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string").select("i", step(F.col("c")).cell.alias("o"))
    return [(r["o"]["v"], r["o"]["code"], r["o"]["warn"]) for r in rows.orderBy("i").collect()]


MONEY = {"$1,234.56": "1234.56", "(500)": "-500.00", "1000": "1000.00", "12.345": "TYP-08", "5-": "-5.00", "-$5": "TYP-01", "$-5": "-5.00", "": "TYP-01", "1e3": "1000.00", ".5": "0.50", "NaN": "TYP-08", "١٢": "12.00", "0012.30": "12.30", "1.230": "1.23"}


def test_to_decimal_with_scale_never_rounds(spark):
    got = outcomes(spark, MONEY, lambda c: numbers.to_decimal(c, ",", True, True, scale=2))
    assert [v or code for v, code, _ in got] == list(MONEY.values())


def test_to_decimal_percent_and_magnitude(spark):
    cells = {"5%": "0.05", "12.50%": "0.125", "1.5K": "1500", "2.0M": "2000000", "1E+3": "1000", "-0.10": "-0.10", "7": "7"}
    assert [x[0] for x in outcomes(spark, cells, lambda c: numbers.to_decimal(c, percent=True, magnitude=True))] == list(cells.values())


def test_to_int(spark):
    cells = {"1_000": "1000", "+5": "5", "-007": "-7", "5.0": None, "x": None, "-0": "0"}
    assert [x[0] for x in outcomes(spark, cells, numbers.to_int)] == list(cells.values())


def test_to_date_takes_the_first_format_that_fits(spark):
    cells = {"1/2/2026": "2026-01-02", "01/02/26": None, "001/02/2026": None, " 1/2/2026": None, "2/29/2024": "2024-02-29", "2/29/2023": None, "31.12.2025": "2025-12-31"}
    got = outcomes(spark, cells, lambda c: times.to_date(c, ["%m/%d/%Y", "%d.%m.%Y"]))
    assert [x[0] for x in got] == list(cells.values())
    assert {x[1] for x in got if x[0] is None} == {"TYP-03"}


def test_to_datetime_needs_a_zone(spark):
    formats = ["%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S%z", "%d %b %Y %I:%M %p"]
    cells = ["2026-01-02 03:04:05", "2026-01-02T03:04:05+05:30", "2 jan 2026 3:04 PM", "bad"]
    assert outcomes(spark, cells, lambda c: times.to_datetime(c, formats)) == [(None, "TYP-04", False), ("2026-01-01T21:34:05+0000", None, False), (None, "TYP-04", False), (None, "TYP-03", False)]
    assert outcomes(spark, cells, lambda c: times.to_datetime(c, formats, "+05:30"))[2][0] == "2026-01-02T09:34:00+0000"
    with pytest.raises(ValueError):
        times.to_datetime(F.lit("x"), formats, "Mars")


def test_to_bool_counts_loose_matches(spark):
    got = outcomes(spark, ["Y", "y", "N", "maybe", None], lambda c: values.to_bool(c, {"Y": True, "N": False}))
    assert got == [("true", None, False), ("true", None, True), ("false", None, False), (None, "TYP-06", False), (None, None, False)]


def test_mojibake_and_formulas(spark):
    broken = "José".encode().decode("latin-1")
    assert outcomes(spark, [broken, "AÑO", "Ã☃", "ok", None], text.repair_mojibake) == [("José", None, True), ("AÑO", None, False), ("Ã☃", None, False), ("ok", None, False), (None, None, False)]
    got = outcomes(spark, ["=1", "@x", "-5", "+", "-a", "-2.00E-02", "\tz", ""], text.neutralize_formula)
    assert [x[0] for x in got] == ["'=1", "'@x", "-5", "+", "'-a", "-2.00E-02", "'\tz", ""]


def test_cleaning_matches_python(spark):
    import unicodedata

    cells = ["e\u0301x", "\u00a0 a\u200bb\u3000\x07 ", "plain", "\u2028x\x85", "", "日本"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    got = df.select("i", text.normalize(F.col("c")).alias("n"), text.trim(F.col("c")).alias("t"), text.map_spaces(F.col("c")).alias("m")).orderBy("i").collect()
    assert [r["n"] for r in got] == [unicodedata.normalize("NFC", c) for c in cells]
    assert [r["t"] for r in got] == [c.strip() for c in cells]
    assert got[1]["m"] == "  ab \x07 "


def test_constraints(spark):
    assert outcomes(spark, [None, "abc", "abcdef"], lambda c: values.check_length(c, 4)) == [(None, None, False), ("abc", None, False), (None, "TYP-11", False)]
    assert outcomes(spark, [None, "a"], values.not_null) == [(None, "NUL-04", False), ("a", None, False)]
    assert [x[1] for x in outcomes(spark, ["5", "50", None], lambda c: numbers.check_range(c, "1", "10"))] == [None, "TYP-09", None]
