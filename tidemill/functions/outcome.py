"""What a step makes of a cell: a value, or a coded error, and a warning flag."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def none() -> Column:
    return F.lit(None).cast("string")


@dataclass(frozen=True)
class Outcome:
    """Cells travel as the text they would be rendered to; null is null.

    ``cell`` is struct<v, code, message, warn>. ``code`` is null where the step succeeded, ``v`` where it
    did not. ``warn`` is true where the step changed the cell in a way that is counted, under
    ``warn_code``. Whoever needs more than one part takes them from one ``cell`` column.
    """

    cell: Column
    warn_code: str = ""

    @staticmethod
    def of(value: Column, code: Column | None = None, message: Column | str = "", warn: Column | None = None, warn_code: str = "") -> Outcome:
        text = F.lit(message) if isinstance(message, str) else message
        warned = F.lit(False) if warn is None else F.coalesce(warn, F.lit(False))
        if code is None:
            return Outcome(F.struct(value.alias("v"), none().alias("code"), none().alias("message"), warned.alias("warn")), warn_code)
        whole = F.struct(value.alias("v"), code.alias("code"), text.alias("message"), warned.alias("warn"))
        return Outcome(let(whole, lambda x: F.when(x["code"].isNull(), x.withField("message", none())).otherwise(x.withField("v", none()))), warn_code)

    @staticmethod
    def bound(x: Column, make: Callable[[Column], Outcome], warn_code: str = "") -> Outcome:
        """The outcome that make builds of x, with x computed once."""
        return Outcome(let(x, lambda v: make(v).cell), warn_code)

    @property
    def value(self) -> Column:
        return self.cell["v"]

    @property
    def code(self) -> Column:
        return self.cell["code"]

    @property
    def warn(self) -> Column:
        return self.cell["warn"]


def fails(condition: Column, code: str) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.lit(code))
