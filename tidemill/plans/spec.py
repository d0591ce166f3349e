"""A validated spec: source, target, policies, mappings, and what was decided about them."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, field

from tidemill.functions.times import fixed_offset, pattern
from tidemill.plans.loader import SpecError, load
from tidemill.taxonomy import SPEC_FORMATS

PROVENANCE = ("explicit", "detected-confirmed", "default", "unconfirmed")
TYPES = ("string", "integer", "decimal", "date", "datetime", "boolean")
POLICIES = {
    "unicode_normalization": ("NFC", "NFD", "NFKC", "NFKD", None, False, ""),
    "strip_control_chars": (True, False),
    "normalize_unicode_whitespace": (True, False),
    "trim_whitespace": (True, False),
    "empty_string_is_null": (True, False),
    "null_propagation": ("sql",),
    "datetime_rendering": ("iso8601",),
    "error_disposition": ("quarantine", "fail-fast", "annotate"),
    "error_budget": None,
    "duplicate_rows": ("keep", "drop_exact"),
    "formula_injection": ("pass-through", "neutralize"),
}
#: Arguments of each transform; those after the bar are required.
OPS = {
    "to_int": "thousands_sep currency accounting_negative |",
    "to_decimal": "thousands_sep currency accounting_negative percent magnitude scale |",
    "to_date": "formats | formats",
    "to_datetime": "formats assume_tz to_utc | formats",
    "to_bool": "mapping | mapping",
    "format_datetime": "fmt |",
    "repair_mojibake": "|",
    "concat": "sources sep | sources",
    "constant": "value | value",
    "expr": "python sql |",
    "check_range": "low high |",
}
#: Extensions beyond the interchange format: a range check, and SQL text for expr.
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f  ]")


@dataclass(frozen=True)
class Step:
    op: str
    args: dict[str, object]


@dataclass(frozen=True)
class Field:
    target: str
    type: str
    nullable: bool = True
    scale: int | None = None
    max_length: int | None = None
    source: str | None = None
    steps: tuple[Step, ...] = ()
    filled: bool = True


@dataclass(frozen=True)
class Skip:
    column: str
    pattern: str
    code: str = "STR-06"


@dataclass(frozen=True)
class Policies:
    unicode_normalization: str | None = "NFC"
    strip_control_chars: bool = True
    normalize_unicode_whitespace: bool = True
    trim_whitespace: bool = True
    empty_string_is_null: bool = True
    error_disposition: str = "quarantine"
    budget_percent: float = 5.0
    budget_min_rows: int = 100
    duplicate_rows: str = "keep"
    formula_injection: str = "pass-through"


@dataclass(frozen=True)
class Pipeline:
    """What a spec compiles to: all that the plan over a table depends on."""

    name: str
    columns: tuple[str, ...]
    fields: tuple[Field, ...]
    policies: Policies = Policies()
    sentinels: dict[str, tuple[str, ...]] = field(default_factory=dict)
    skips: tuple[Skip, ...] = ()
    delimiter: str = ","
    quotechar: str = '"'
    encoding: str = "utf-8"
    decisions: tuple = ()
    spec_sha256: str = ""

    def canonical(self) -> str:
        """One text for one meaning, the same on every run."""
        return json.dumps(asdict(self), sort_keys=True, separators=(",", ":"), ensure_ascii=True, default=str)


def _need(ok: object, what: str) -> None:
    if not ok:
        raise SpecError(what)


def _clean(value: object, path: str) -> None:
    if isinstance(value, dict):
        for k, v in value.items():
            _clean(str(k), path)
            if not (path.endswith("expr") and k == "python"):
                _clean(v, f"{path}.{k}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            _clean(v, f"{path}[{i}]" if not path.endswith("expr") else path)
    elif isinstance(value, str):
        _need(not _CONTROL.search(value) and "\n" not in value or path.endswith("quotechar"), f"{path}: control character")


def _provenance(x: dict, what: str) -> None:
    _need(x.get("provenance") in PROVENANCE, f"{what}: provenance must be one of {', '.join(PROVENANCE)}")


def _steps(raw: object, target: str, expected: tuple[str, ...]) -> tuple[Step, ...]:
    out = []
    for item in raw or []:
        op, args = (item, {}) if isinstance(item, str) else next(iter(item.items())) if isinstance(item, dict) and len(item) == 1 else ("", {})
        if isinstance(item, dict) and "op" in item:
            op, args = item["op"], {k: v for k, v in item.items() if k != "op"}
        args = args or {}
        _need(op != "split", f"{target}: split is not supported; map each part by expr")
        _need(op in OPS, f"{target}: unknown transform {op!r}")
        allowed, _, required = OPS[op].partition("|")
        _need(isinstance(args, dict), f"{target}: {op} takes named arguments")
        for k in args:
            _need(k in allowed.split(), f"{target}: {op} has no argument {k!r}")
        for k in required.split():
            _need(args.get(k) not in (None, [], {}), f"{target}: {op} needs {k}")
        if op == "expr":
            _need(("python" in args) != ("sql" in args), f"{target}: expr needs python or sql")
        if op == "concat":
            for c in args["sources"]:
                _need(c in expected, f"{target}: concat source {c!r} is not expected")
        if op in ("to_date", "to_datetime"):
            for f in args["formats"]:
                try:
                    pattern(str(f))
                except ValueError as e:
                    raise SpecError(f"{target}: {e}") from e
        if args.get("assume_tz") is not None:
            try:
                fixed_offset(str(args["assume_tz"]))
            except ValueError as e:
                raise SpecError(f"{target}: {e}") from e
        if op in ("concat", "constant", "expr"):
            _need(not out, f"{target}: {op} must come first")
        out.append(Step(op, dict(args)))
    return tuple(out)


def compile_spec(text: str) -> Pipeline:
    """The pipeline of a spec text, or SpecError for the first thing wrong with it."""
    raw = load(text)
    _clean(raw, "spec")
    for k in ("etlspec", "name", "taxonomy_version", "source", "target", "policies", "mappings"):
        _need(k in raw, f"missing key {k!r}")
    version = str(raw["etlspec"])
    _need(version in SPEC_FORMATS, f"format {version} is not one of {', '.join(SPEC_FORMATS)}")
    _need(re.fullmatch(r"[a-z][a-z0-9_]*", str(raw["name"])), "name must be snake_case")
    _need(re.fullmatch(r"[0-9]+\.[0-9]+", str(raw["taxonomy_version"])), "taxonomy_version must be like 0.4")
    source, target = raw["source"], raw["target"]
    _need(isinstance(source, dict) and source.get("format", "csv") == "csv", "source format must be csv")
    _need(source.get("header", "present") in ("present", True), "source header must be present")
    expected = tuple(str(c) for c in source.get("expected_columns") or [])
    _need(expected and len(set(expected)) == len(expected), "expected_columns must be a list of different names")

    policies = raw["policies"]
    _need(isinstance(policies, dict), "policies must be a map")
    found: dict[str, object] = {}
    for k, values in POLICIES.items():
        if k == "formula_injection" and k not in policies and version != "0.4":
            continue
        _need(k in policies, f"missing policy {k}")
        p = policies[k]
        _need(isinstance(p, dict) and "value" in p, f"policy {k} must have value and provenance")
        _provenance(p, f"policy {k}")
        _need(values is None or p["value"] in values, f"policy {k}: {p['value']!r} is not one of {values}")
        found[k] = p["value"]
    for k in policies:
        _need(k in POLICIES, f"unknown policy {k}")
    budget = found.pop("error_budget")
    _need(isinstance(budget, dict) and {"percent", "min_rows"} <= set(budget), "error_budget needs percent and min_rows")
    kept = {k: v for k, v in found.items() if k not in ("null_propagation", "datetime_rendering")}
    kept["unicode_normalization"] = kept["unicode_normalization"] or None
    resolved = Policies(budget_percent=float(budget["percent"]), budget_min_rows=int(budget["min_rows"]), **kept)

    skips = []
    for s in source.get("skip_rows") or []:
        _need(s.get("column") in expected, f"skip_rows: column {s.get('column')!r} is not expected")
        try:
            re.compile(str(s.get("pattern")))
        except re.error as e:
            raise SpecError(f"skip_rows: {e}") from e
        _provenance(s, "skip_rows")
        skips.append(Skip(s["column"], str(s["pattern"]), str(s.get("code", "STR-06"))))

    columns: dict[str, dict] = {}
    for c in target.get("columns") or []:
        _need(isinstance(c, dict) and {"name", "type", "nullable"} <= set(c), "target columns need name, type and nullable")
        _need(c["type"] in TYPES, f"{c['name']}: unknown type {c['type']!r}")
        _need(c["name"] not in columns, f"target column {c['name']!r} occurs twice")
        columns[str(c["name"])] = c
    _need(columns, "target has no columns")

    sentinels: dict[str, tuple[str, ...]] = {}
    mapped: dict[str, Field] = {}
    decisions = []
    for m in raw["mappings"] or []:
        name = str(m.get("target"))
        _need(name in columns, f"mapping target {name!r} is not a target column")
        _need(name not in mapped, f"target {name!r} is mapped twice")
        steps = _steps(m.get("transforms"), name, expected)
        src = m.get("source")
        free = len(steps) >= 1 and steps[0].op in ("constant", "concat", "expr")
        _need(src is not None or free, f"{name}: a source is needed")
        _need(src is None or src in expected, f"{name}: source {src!r} is not expected")
        for d in m.get("decisions") or []:
            _need("id" in d, f"{name}: a decision needs an id")
            _provenance(d, f"{name}: decision {d['id']}")
            decisions.append({"target": name, **d})
        if m.get("sentinels") is not None:
            _need(isinstance(m["sentinels"], dict) and isinstance(m["sentinels"].get("values"), list), f"{name}: sentinels need a list of values")
            _provenance(m["sentinels"], f"{name}: sentinels")
            _need(src is not None, f"{name}: sentinels need a source")
            values = tuple(m["sentinels"]["values"])
            _need(all(isinstance(v, str) for v in values), f"{name}: quote sentinel values, cells are text")
            _need(sentinels.get(src, values) == values, f"{src}: two mappings name different sentinels")
            sentinels[src] = values
        c = columns[name]
        mapped[name] = Field(name, c["type"], bool(c["nullable"]), c.get("scale"), c.get("max_length"), src, steps)
    unmapped = raw.get("unmapped") or {}
    unfilled = {str(u) if not isinstance(u, dict) else str(u.get("name")) for u in unmapped.get("unfilled_target_columns") or []}
    fields = []
    for name, c in columns.items():
        _need(name in mapped or name in unfilled, f"target column {name!r} is neither mapped nor declared unfilled")
        fields.append(mapped.get(name) or Field(name, c["type"], bool(c["nullable"]), filled=False))
    if resolved.error_disposition == "annotate":
        _need(any(f.filled for f in fields), "annotate needs mapped fields")
    return Pipeline(
        str(raw["name"]), expected, tuple(fields), resolved, sentinels, tuple(skips), str(source.get("delimiter") or ","), str(source.get("quotechar") or '"'),
        str(source.get("encoding") or "utf-8"), tuple(decisions), hashlib.sha256(text.encode()).hexdigest(),
    )


def from_canonical(text: str) -> Pipeline:
    """The pipeline that canonical() wrote."""
    raw = json.loads(text)
    fields = tuple(Field(**{**f, "steps": tuple(Step(**s) for s in f["steps"])}) for f in raw["fields"])
    return Pipeline(
        **{
            **raw, "columns": tuple(raw["columns"]), "fields": fields, "policies": Policies(**raw["policies"]), "sentinels": {k: tuple(v) for k, v in raw["sentinels"].items()},
            "skips": tuple(Skip(**s) for s in raw["skips"]), "decisions": tuple(raw["decisions"]),
        }
    )
