"""Booleans, concatenation and constraints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions.outcome import Outcome, fails


def folded(c: Column) -> Column:
    """Case-folded text: lower case, with the letter that folds to two."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def to_bool(c: Column, mapping: dict[str, bool]) -> Outcome:
    """Only the confirmed vocabulary (TYP-06); a match by case folding alone is counted (TYP-10)."""
    exact = loose = F.lit(None).cast("boolean")
    for k, v in reversed(list(mapping.items())):
        exact = F.when(c == str(k), F.lit(v)).otherwise(exact)
        loose = F.when(folded(c) == str(k).casefold(), F.lit(v)).otherwise(loose)
    both = F.struct(exact.alias("exact"), loose.alias("loose"))

    def told(x: Column) -> Outcome:
        value = F.coalesce(x["exact"], x["loose"])
        text = F.when(value, F.lit("true")).when(~value, F.lit("false"))
        return Outcome.of(text, fails(value.isNull() & c.isNotNull(), "TYP-06"), f"not in the vocabulary {sorted(map(str, mapping))}", x["exact"].isNull() & x["loose"].isNotNull())

    return Outcome.bound(both, told, "TYP-10")


def concat(columns: list[Column], sep: str = "") -> Outcome:
    """Any null makes the whole null."""
    whole = F.lit(True)
    for c in columns:
        whole = whole & c.isNotNull()
    return Outcome.of(F.when(whole, F.concat_ws(sep, *columns)))


def check_length(c: Column, max_length: int) -> Outcome:
    message = F.concat(F.lit("length "), F.length(c).cast("string"), F.lit(f" exceeds {max_length}"))
    return Outcome.of(c, fails(F.length(c) > max_length, "TYP-11"), message)


def not_null(c: Column) -> Outcome:
    return Outcome.of(c, F.when(c.isNull(), F.lit("NUL-04")), "null in a non-nullable column")


def keep(c: Column) -> Outcome:
    return Outcome.of(c)
