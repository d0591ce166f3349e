"""Numbers from formatted text, on digits alone: nothing is rounded and no float appears."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions.outcome import Outcome, fails, let
from tidemill.functions.text import trim

# Suffixes and their powers of ten, currency signs, other decimal digits.
MAGNITUDE = {"k": 3, "m": 6, "b": 9, "g": 9, "t": 12}
CURRENCY = "[$€£¥₹]"
OTHER_DIGITS = "０１２３４５６７８９٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹०१२३४५६७८९"
#: Digits that fit a decimal value of the engine.
PRECISION = 28


def _less(s: Column) -> Column:
    """The text without its last character, trimmed."""
    return trim(F.substring(s, F.lit(1), F.length(s) - 1))


def _state(s: Column, negative: Column, share: Column, power: Column) -> Column:
    return F.struct(s.alias("s"), negative.alias("negative"), share.alias("share"), power.alias("power"))


def unformatted(c: Column, thousands_sep: str | None, currency: bool, accounting_negative: bool, percent: bool, magnitude: bool) -> Column:
    """struct<s, negative, share, power>: the bare number text, what was taken off it, and a suffix's power of ten.

    The confirmed rules apply in a fixed order: parentheses, trailing minus, currency, percent,
    magnitude, separators, sign.
    """
    x = _state(trim(c), F.lit(False), F.lit(False), F.lit(0))
    if accounting_negative:
        closed = "(?s)^\\((.*)\\)\\z"
        x = let(x, lambda x: F.when(x["s"].rlike(closed), _state(trim(F.regexp_extract(x["s"], closed, 1)), F.lit(True), x["share"], x["power"])).otherwise(x))
        x = let(x, lambda x: F.when(x["s"].endswith("-"), _state(_less(x["s"]), F.lit(True), x["share"], x["power"])).otherwise(x))
    if currency:
        x = let(x, lambda x: _state(trim(F.regexp_replace(x["s"], f"^{CURRENCY}\\s*", "")), x["negative"], x["share"], x["power"]))
    if percent:
        x = let(x, lambda x: F.when(x["s"].endswith("%"), _state(_less(x["s"]), x["negative"], F.lit(True), x["power"])).otherwise(x))
    if magnitude:
        powers = F.create_map(*[F.lit(v) for kv in MAGNITUDE.items() for v in kv])
        x = let(x, lambda x: _state(x["s"], x["negative"], x["share"], F.coalesce(F.try_element_at(powers, F.lower(F.right(x["s"], F.lit(1)))), F.lit(0))))
        x = let(x, lambda x: F.when(x["power"] > 0, _state(_less(x["s"]), x["negative"], x["share"], x["power"])).otherwise(x))

    def finish(x: Column) -> Column:
        s = F.replace(x["s"], F.lit(thousands_sep), F.lit("")) if thousands_sep else x["s"]
        s = let(s, lambda s: F.when(x["negative"] & ~s.startswith("-"), F.concat(F.lit("-"), s)).otherwise(s))
        return _state(F.translate(s, OTHER_DIGITS, "0123456789" * 4), x["negative"], x["share"], x["power"])

    return let(x, finish)


def to_int(c: Column, thousands_sep: str | None = None, currency: bool = False, accounting_negative: bool = False) -> Outcome:
    s = unformatted(c, thousands_sep, currency, accounting_negative, False, False)["s"]

    def read(s: Column) -> Column:
        bare = F.regexp_replace(F.replace(s, F.lit("_"), F.lit("")), "^[+]?(-?)0*([0-9])", "$1$2")
        return F.when(s.rlike("^[+-]?[0-9]+(_[0-9]+)*\\z"), F.when(bare == "-0", F.lit("0")).otherwise(bare))

    return Outcome.bound(let(s, read), lambda value: Outcome.of(value, fails(value.isNull() & c.isNotNull(), "TYP-01"), "not an integer"))


SHAPE = "^([+-]?)([0-9]*)(?:[.]([0-9]*))?(?:[eE]([+-]?[0-9]{1,4}))?\\z"


def to_decimal(
    c: Column, thousands_sep: str | None = None, currency: bool = False, accounting_negative: bool = False, percent: bool = False, magnitude: bool = False, scale: int | None = None
) -> Outcome:
    """Exact decimal text. With a scale, zeros fill up and more digits than it are TYP-08, never rounded."""

    def parts(x: Column) -> Column:
        s = x["s"]
        left, right = F.regexp_extract(s, SHAPE, 2), F.regexp_extract(s, SHAPE, 3)
        power = F.coalesce(F.nullif(F.regexp_extract(s, SHAPE, 4), F.lit("")).try_cast("int"), F.lit(0)) + x["power"] - F.when(x["share"], 2).otherwise(0)
        return F.struct(
            F.when(s.rlike("(?i)^[+-]?s?nan[0-9]*\\z"), F.lit("NaN")).when(s.rlike("(?i)^[+]?inf(inity)?\\z"), F.lit("Infinity")).when(s.rlike("(?i)^-inf(inity)?\\z"), F.lit("-Infinity")).alias("word"),
            (s.rlike(SHAPE) & s.rlike("^[+-]?[.]?[0-9]")).alias("good"),
            F.when(s.startswith("-"), F.lit("-")).otherwise(F.lit("")).alias("sign"),
            F.regexp_replace(F.concat(left, right), "^0+(?=[0-9])", "").alias("digits"),
            (F.length(right) - power).alias("places"),
            x["share"].alias("share"),
        )

    def moved(x: Column) -> Column:
        # the point after its move: at least one digit before it, zeros after the digits if it lies beyond
        after = F.greatest(x["places"], F.lit(0))
        wide = F.concat(x["digits"], F.repeat(F.lit("0"), F.greatest(-x["places"], F.lit(0))))
        wide = let(wide, lambda w: F.lpad(w, F.greatest(F.length(w), after + 1), F.lit("0")))
        split = let(wide, lambda w: F.struct(F.regexp_replace(F.substring(w, F.lit(1), F.length(w) - after), "^0+(?=[0-9])", "").alias("whole"), F.when(after > 0, F.right(w, after)).otherwise(F.lit("")).alias("part")))
        return F.struct(x["word"].alias("word"), x["good"].alias("good"), x["sign"].alias("sign"), split.alias("n"), x["share"].alias("share"))

    def result(x: Column) -> Column:
        whole, part = x["n"]["whole"], x["n"]["part"]
        bad = F.when(~x["good"] & x["word"].isNull(), F.lit("TYP-01"))
        if scale is None:
            # a division by 100 drops the zeros it can
            short = F.when(x["share"], F.regexp_replace(part, "0+\\z", "")).otherwise(part)
            text = F.coalesce(x["word"], F.concat(x["sign"], whole, F.when(short != "", F.concat(F.lit("."), short)).otherwise(F.lit(""))))
            return F.struct(text.alias("text"), bad.alias("code"))
        bad = bad.when(x["word"] == "NaN", F.lit("TYP-08")).when(x["word"].isNotNull(), F.lit("ERR-07"))
        bad = bad.when(F.length(F.regexp_replace(whole, "^0\\z", "")) + scale > PRECISION, F.lit("ERR-07"))
        bad = bad.when(F.substring(part, F.lit(scale + 1), F.length(part)).rlike("[1-9]"), F.lit("TYP-08"))
        text = F.concat(x["sign"], whole, F.lit("."), F.rpad(F.substring(part, 1, scale), scale, "0")) if scale else F.concat(x["sign"], whole)
        return F.struct(text.alias("text"), bad.alias("code"))

    x = unformatted(c, thousands_sep, currency, accounting_negative, percent, magnitude)
    x = let(x, lambda x: _state(F.replace(trim(x["s"]), F.lit("_"), F.lit("")), x["negative"], x["share"], x["power"]))

    def told(done: Column) -> Outcome:
        message = F.when(done["code"] == "TYP-08", F.lit(f"more digits than scale {scale}; rounding must be explicit")).when(done["code"] == "ERR-07", F.lit("beyond the decimal range")).otherwise(F.lit("not a decimal number"))
        return Outcome.of(done["text"], F.when(c.isNotNull(), done["code"]), message)

    return Outcome.bound(let(let(let(x, parts), moved), result), told)


def check_range(c: Column, low: str | None = None, high: str | None = None) -> Outcome:
    """Inclusive bounds on a number (TYP-09)."""
    n = c.try_cast("decimal(38,10)")
    outside = F.lit(False)
    if low is not None:
        outside = outside | (n < F.lit(low).cast("decimal(38,10)"))
    if high is not None:
        outside = outside | (n > F.lit(high).cast("decimal(38,10)"))
    return Outcome.of(c, fails(outside, "TYP-09"), f"outside {low} to {high}")
