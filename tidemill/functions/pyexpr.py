"""Python expressions of specs, run in workers; what they raise becomes part of the row's outcome."""

from __future__ import annotations

from collections.abc import Callable
from types import CodeType

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

RESULT = "v string, code string, message string, col string, skip string, warns array<string>"
NAMES = ("v", "code", "message", "col", "skip", "warns")


class Skipped(Exception):
    """The expression asked to leave the row out."""

    def __init__(self, code: str) -> None:
        super().__init__(code)
        self.code = code


class Toolbox:
    """What an expression can use besides its row."""

    @staticmethod
    def skip_if(value: object, condition: object, code: str = "STR-06", reason: str = "") -> object:
        if condition:
            raise Skipped(code)
        return value


class Report:
    def __init__(self) -> None:
        self.codes: list[str] = []

    def warn(self, column: str, code: str) -> None:
        self.codes.append(code)


def render(value: object) -> str | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    return format(value, "f") if type(value).__name__ == "Decimal" else str(value)


def python_expr(source: str) -> Callable[[Column], Column]:
    """A function of the struct of cleaned cells; null in, null out. Any exception is ERR-07."""

    def evaluate(code: CodeType | Exception, row: dict[str, str | None]) -> tuple:
        report = Report()
        try:
            if isinstance(code, Exception):
                raise code
            value = eval(code, {"rt": Toolbox}, {"row": row, "report": report})  # noqa: S307
            return render(value), None, None, None, None, report.codes
        except Skipped as e:
            return None, None, None, None, e.code, report.codes
        except Exception as e:  # noqa: BLE001  whatever the expression raises is the row's error
            return None, "ERR-07", f"{type(e).__name__}: {e}", "<row>", None, report.codes

    def run(rows: pa.Array) -> pa.Array:
        # compiled once for each batch
        try:
            code: CodeType | Exception = compile(source.strip(), "<string>", "eval")
        except Exception as e:  # noqa: BLE001  each row gets the error
            code = e
        found = [None if row is None else dict(zip(NAMES, evaluate(code, row), strict=True)) for row in rows.to_pylist()]
        return pa.array(found, pa.struct([*((n, pa.string()) for n in NAMES[:-1]), (NAMES[-1], pa.list_(pa.string()))]))

    return F.arrow_udf(run, RESULT).asNondeterministic()
