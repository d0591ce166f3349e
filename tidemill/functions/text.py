"""Text cleaning: normalization, control characters, spaces, trimming, mojibake, formulas."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions.outcome import Outcome, let

# The code points of each class.
SPACES = "  " + "".join(chr(c) for c in range(0x2000, 0x200B)) + "  　"
ZERO_WIDTH = "​‌‍⁠﻿"
CONTROL = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]"
TRIMMED = "\\t\\n\\x0b\\f\\r\\x1c-\\x1f \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
MOJIBAKE = ("Ã", "Â", "â€", "Ð", "Ñ")
SIGNED_NUMBER = "^[+-][0-9.,]*[0-9]([eE][+-]?[0-9]+)?$"


def normalize(c: Column, form: str = "NFC") -> Column:
    """Unicode normalization over Arrow batches; texts that NFC can't change never leave the JVM."""

    def of(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else x if unicodedata.is_normalized(form, x) else unicodedata.normalize(form, x) for x in texts.to_pylist()], pa.string())

    # so marked, the planner neither repeats it nor moves it into expressions that run in the JVM
    udf = F.arrow_udf(of, "string").asNondeterministic()
    if form != "NFC":
        return udf(c)
    # below U+0300 everything is in NFC and nothing combines
    return F.coalesce(udf(F.when(c.rlike("[^\\x00-\\u02ff]"), c)), c)


def strip_control(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL, "")


def map_spaces(c: Column) -> Column:
    """Unicode spaces become plain ones, zero-width characters go."""
    return F.translate(c, SPACES + ZERO_WIDTH, " " * len(SPACES))


def trim(c: Column) -> Column:
    """Strips every character that counts as white space, not just U+0020."""
    return F.regexp_replace(c, f"^[{TRIMMED}]+|[{TRIMMED}]+\\z", "")


def is_blank(c: Column) -> Column:
    return trim(c) == ""


def repair_mojibake(c: Column) -> Outcome:
    """UTF-8 that was read as Latin-1, read again; unchanged where that fails (ENC-06 counted)."""
    signed = F.lit(False)
    for s in MOJIBAKE:
        signed = signed | F.contains(c, F.lit(s))
    raw = F.when(signed & c.rlike("(?s)^[\\x00-\\xff]*\\z"), F.encode(c, "ISO-8859-1"))
    again = raw.cast("string")

    def checked(again: Column) -> Column:
        return F.when(F.is_valid_utf8(again) & ~F.contains(again, F.lit("�")) & (again != c), again)

    return Outcome.bound(let(again, checked), lambda fixed: Outcome.of(F.coalesce(fixed, c), warn=fixed.isNotNull()), "ENC-06")


def formula_leading(c: Column, lead: str = "=@") -> Column:
    """Whether a spreadsheet would run the cell: signs count only before something that is no number."""
    plain = F.substring(c, 1, 1).isin(*lead)
    signed = F.substring(c, 1, 1).isin("+", "-") & (F.length(c) > 1) & ~c.rlike(SIGNED_NUMBER)
    return plain | signed


def neutralize_formula(c: Column) -> Outcome:
    """An apostrophe before cells that a spreadsheet would run (ENC-08 counted)."""
    risky = formula_leading(c, "=@\t\r")
    return Outcome.bound(risky, lambda risky: Outcome.of(F.when(risky, F.concat(F.lit("'"), c)).otherwise(c), warn=risky), "ENC-08")
