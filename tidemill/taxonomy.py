"""Failure modes under stable codes: what each is called and how it is handled."""

from __future__ import annotations

from dataclasses import dataclass

VERSION = "0.4"
SPEC_FORMATS = ("0.1", "0.2", "0.3", "0.4")
ENGINE_VERSION = "0.1.0"


@dataclass(frozen=True)
class Mode:
    code: str
    name: str
    kind: str  # fix, ask, row-error, run-error, warn or policy; several joined by /


# The codes, names and classes are the vocabulary of specs and reports.
_TABLE = """
ENC-01|encoding mismatch|ask/fix
ENC-02|byte order mark|fix
ENC-03|unicode normalization|fix
ENC-04|control characters|fix
ENC-05|unicode whitespace|fix
ENC-06|mojibake|ask
ENC-07|literal escapes|ask
ENC-08|formula injection|ask
STR-01|delimiter ambiguity|ask/row-error
STR-02|ragged rows|row-error
STR-03|quoting violations|row-error
STR-04|header anomalies|ask
STR-05|duplicate rows|ask
STR-06|non-data rows|fix/ask
STR-07|line endings|fix
NUL-01|empty or null|ask/fix
NUL-02|whitespace only|fix
NUL-03|sentinels|ask
NUL-04|null in a non-nullable column|row-error
NUL-05|null propagation|policy
TYP-01|formatted numerics|ask/row-error
TYP-02|decimal locale|ask
TYP-03|date ambiguity|ask/row-error
TYP-04|time zone|ask
TYP-05|datetime rendering|policy
TYP-06|booleans|ask/row-error
TYP-07|numeric-looking identifiers|ask
TYP-08|precision and scale|ask/row-error
TYP-09|domain range|row-error
TYP-10|case and whitespace|fix/ask
TYP-11|length overflow|row-error
TYP-12|magnitude suffix|ask/row-error
KEY-01|duplicate keys|run-error
KEY-02|missing columns|run-error
KEY-03|new columns|warn
ERR-01|error disposition|policy
ERR-02|error budget|policy
ERR-03|reporting|policy
ERR-04|warnings|policy
ERR-05|atomicity|policy
ERR-06|provenance|policy
ERR-07|unexpected row failure|row-error
"""

MODES: dict[str, Mode] = {x[0]: Mode(*x) for x in (line.split("|") for line in _TABLE.split("\n") if line)}
