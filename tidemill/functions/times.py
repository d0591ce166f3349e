"""Dates and datetimes by declared formats: a format becomes one anchored pattern of native functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions.outcome import Outcome, fails, let

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def _either(names: tuple[str, ...], short: bool) -> str:
    return "|".join(n[:3] if short else n for n in names)


#: What each directive accepts.
DIRECTIVES = {
    "Y": "[0-9]{4}", "y": "[0-9]{2}", "m": "1[0-2]|0[1-9]|[1-9]", "d": "3[01]|[12][0-9]|0[1-9]|[1-9]| [1-9]", "H": "2[0-3]|[01][0-9]|[0-9]", "I": "1[0-2]|0[1-9]|[1-9]",
    "M": "[0-5][0-9]|[0-9]", "S": "6[01]|[0-5][0-9]|[0-9]", "f": "[0-9]{1,6}", "p": "am|pm", "z": "Z|[+-][0-9]{2}:?[0-5][0-9](?::?[0-5][0-9](?:[.][0-9]{1,6})?)?",
    "b": _either(MONTHS, True), "B": _either(MONTHS, False), "a": _either(DAYS, True), "A": _either(DAYS, False), "j": "36[0-6]|3[0-5][0-9]|[12][0-9]{2}|0[1-9][0-9]|00[1-9]|[1-9][0-9]|0[1-9]|[1-9]",
}


def pattern(fmt: str) -> tuple[str, list[str]]:
    """An anchored pattern with a group for each directive, and the directives in order."""
    out, found, i = "", [], 0
    fmt = {"%F": "%Y-%m-%d"}.get(fmt, fmt).replace("%T", "%H:%M:%S").replace("%F", "%Y-%m-%d").replace("%D", "%m/%d/%y").replace("%R", "%H:%M")
    while i < len(fmt):
        ch = fmt[i]
        if ch == "%":
            i += 1
            if i >= len(fmt):
                raise ValueError("format ends in %")
            d = fmt[i]
            if d == "%":
                out += "%"
            elif d not in DIRECTIVES:
                raise ValueError(f"directive %{d} is not supported")
            elif d in found:
                raise ValueError(f"directive %{d} occurs twice")
            else:
                out += f"({DIRECTIVES[d]})"
                found.append(d)
        elif ch.isspace():
            while i + 1 < len(fmt) and fmt[i + 1].isspace():
                i += 1
            out += "\\s+"
        else:
            out += re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", ch)
        i += 1
    return f"(?i)^{out}\\z", found


def _month(name: Column, short: bool) -> Column:
    out = F.lit(None).cast("string")
    for i, n in enumerate(MONTHS):
        out = F.when(F.lower(name) == (n[:3] if short else n), F.lit(f"{i + 1:02d}")).otherwise(out)
    return out


def _parsed(c: Column, fmt: str) -> tuple[Column, Column]:
    """Local time as 'yyyy-MM-dd HH:mm:ss' text, null if it isn't one, and the offset in seconds, null if naive."""
    rule, found = pattern(fmt)

    def part(d: str) -> Column | None:
        return F.regexp_extract(c, rule, found.index(d) + 1) if d in found else None

    def two(x: Column) -> Column:
        return F.lpad(F.trim(x), 2, "0")

    year = part("Y")
    if year is None and (short := part("y")) is not None:
        year = F.concat(F.when(short >= "69", F.lit("19")).otherwise(F.lit("20")), short)
    if year is None:
        year = F.lit("1900")
    month = two(x) if (x := part("m")) is not None else _month(x, True) if (x := part("b")) is not None else _month(x, False) if (x := part("B")) is not None else F.lit("01")
    day = two(x) if (x := part("d")) is not None else F.lit("01")
    hour = two(x) if (x := part("H")) is not None else F.lit("00")
    if "H" not in found and (x := part("I")) is not None:
        late = F.lower(part("p")) == "pm" if "p" in found else F.lit(False)
        hour = two(((x.try_cast("int") % 12) + F.when(late, 12).otherwise(0)).cast("string"))
    minute = two(x) if (x := part("M")) is not None else F.lit("00")
    second = two(x) if (x := part("S")) is not None else F.lit("00")
    date = F.concat(year, F.lit("-"), month, F.lit("-"), day)
    if "j" in found:
        date = F.date_add(F.concat(year, F.lit("-01-01")).try_cast("date"), part("j").try_cast("int") - 1).cast("string")
    # parts are taken only of cells that fit the pattern
    local = F.when(c.rlike(rule), let(date, lambda date: F.when(date.try_cast("date").isNotNull() & (second < "60"), F.concat(date, F.lit(" "), hour, F.lit(":"), minute, F.lit(":"), second))))
    offset = F.lit(None).cast("int")
    if "z" in found:
        z = F.replace(part("z"), F.lit(":"), F.lit(""))
        size = F.substring(z, 2, 2).try_cast("int") * 3600 + F.substring(z, 4, 2).try_cast("int") * 60 + F.coalesce(F.substring(z, 6, 2).try_cast("int"), F.lit(0))
        offset = F.when(F.upper(z) == "Z", F.lit(0)).otherwise(F.when(z.startswith("-"), -size).otherwise(size)).cast("int")
    return local, offset


def to_date(c: Column, formats: list[str]) -> Outcome:
    """ISO date of the first format that fits (TYP-03)."""
    date = F.coalesce(*[F.substring(_parsed(c, f)[0], 1, 10) for f in formats])
    return Outcome.bound(date, lambda date: Outcome.of(date, fails(date.isNull() & c.isNotNull(), "TYP-03"), f"fits none of the formats {list(formats)}"))


def fixed_offset(tz: str) -> int:
    """Seconds of 'UTC' or a fixed offset."""
    if tz.upper() == "UTC":
        return 0
    m = re.fullmatch(r"([+-])([0-9]{2}):?([0-9]{2})", tz)
    if not m:
        raise ValueError(f"time zone {tz!r} is neither 'UTC' nor a fixed offset like '+05:30'")
    return (int(m[2]) * 3600 + int(m[3]) * 60) * (1 if m[1] == "+" else -1)


def to_datetime(c: Column, formats: list[str], assume_tz: str | None = None, to_utc: bool = True) -> Outcome:
    """ISO datetime with offset; naive values need a declared zone (TYP-04). Sub-seconds are dropped."""
    def first(found: list[tuple[Column, Column]]) -> Column:
        (local, offset), rest = found[0], found[1:]
        both = F.struct(local.alias("local"), offset.alias("offset"))
        return let(both, lambda x: F.when(x["local"].isNotNull(), x).otherwise(first(rest))) if rest else both

    def told(x: Column) -> Outcome:
        local = x["local"]
        offset = x["offset"] if assume_tz is None else F.coalesce(x["offset"], F.lit(fixed_offset(assume_tz)))
        code = F.when(c.isNotNull() & local.isNull(), F.lit("TYP-03")).when(local.isNotNull() & offset.isNull(), F.lit("TYP-04"))
        message = F.when(local.isNotNull(), F.lit("no offset and no declared time zone")).otherwise(F.lit(f"fits none of the formats {list(formats)}"))
        moment = local.try_cast("timestamp_ntz")
        if to_utc:
            moment = moment - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), offset.cast("decimal(18,6)"))
            zone = F.lit("+0000")
        else:
            size = F.abs(offset)
            hours, minutes = (F.lpad(x.cast("string"), 2, "0") for x in (F.floor(size / 3600), F.floor(size / 60) % 60))
            zone = F.concat(F.when(offset < 0, F.lit("-")).otherwise(F.lit("+")), hours, minutes)
        text = F.concat(F.replace(F.substring(moment.cast("string"), 1, 19), F.lit(" "), F.lit("T")), zone)
        return Outcome.of(text, code, message)

    return Outcome.bound(first([_parsed(c, f) for f in formats]), told)
