import json

import pytest

from tidemill.operators.profile import profile, profile_file
from tidemill.operators.run import emit, run
from tidemill.plans.loader import SpecError, load
from tidemill.plans.spec import compile_spec, from_canonical
from tidemill.sources.rawcsv import read_records

POLICY = {
    "unicode_normalization": "NFC", "strip_control_chars": "true", "normalize_unicode_whitespace": "true", "trim_whitespace": "true", "empty_string_is_null": "true", "null_propagation": "sql",
    "datetime_rendering": "iso8601", "error_disposition": "quarantine", "error_budget": "{percent: 50, min_rows: 3}", "duplicate_rows": "keep", "formula_injection": "pass-through",
}


def spec(mappings=None, **policies):
    lines = "\n".join(f"  {k}: {{value: {v}, provenance: default}}" for k, v in (POLICY | policies).items())
    return f"""# a small spec
etlspec: 0.4
name: orders
taxonomy_version: 0.4
source:
  format: csv
  header: present
  expected_columns: [id, name, amt, day, ok, zip]
  skip_rows:
    - {{column: id, pattern: "Total", provenance: explicit}}
target:
  columns:
    - {{name: id, type: string, nullable: false}}
    - {{name: name, type: string, nullable: false}}
    - {{name: amount, type: decimal, scale: 2, nullable: true}}
    - {{name: day, type: date, nullable: true}}
    - {{name: ok, type: boolean, nullable: true}}
    - {{name: zip, type: string, max_length: 5, nullable: true}}
policies:
{lines}
mappings:
  - target: id
    source: id
    transforms: []
  - target: name
    source: name
    transforms: [repair_mojibake]
    sentinels: {{values: ["N/A"], provenance: explicit}}
""" + (mappings or """  - target: amount
    source: amt
    transforms:
      - to_decimal: {thousands_sep: ",", currency: true, accounting_negative: true}
  - {target: day, source: day, transforms: [{to_date: {formats: ["%m/%d/%Y"]}}]}
  - {target: ok, source: ok, transforms: [{to_bool: {mapping: {Y: true, N: false}}}]}
  - {target: zip, source: zip, transforms: []}
""")


HEAD = "id, name ,amt,day,ok,zip\n"
GOOD = '1,Ann,"$1,234.56",01/02/2026,Y,02134\n2,Bob,(75),1/5/2026,n,00001\n3,Cy,5,1/6/2026,N,1\n'


def runs(spark, tmp_path, body, text=None, head=HEAD, raw=None):
    path = tmp_path / "in.csv"
    path.write_bytes(raw if raw is not None else (head + body).encode())
    return run(spark, compile_spec(text or spec()), str(path), str(tmp_path / "out"))


def test_loader_scalars_and_errors():
    assert load("a: 02134\nb: 'x: y'\nc: [1, \"2\", true, no]\nd:\n  - e: 1\n    f: ~\n") == {"a": 2134, "b": "x: y", "c": [1, "2", True, "no"], "d": [{"e": 1, "f": None}]}
    for bad in ("a: 1\na: 2", "a:\n\tb: 1", "a: &x 1", "a: |\n  x", "a: [1", "a: {b: 1, b: 2}", "", "- 1"):
        with pytest.raises(SpecError):
            load(bad)


@pytest.mark.parametrize("old,new", [("etlspec: 0.4", "etlspec: 9.9"), ("name: orders", "name: Orders"), ("type: date", "type: dates"), ("value: quarantine", "value: ignore"), ("[repair_mojibake]", "[split]"), ("[repair_mojibake]", "[to_date]"), ('["N/A"]', "[9999]"), ("provenance: explicit}", "provenance: guessed}"), ("%m/%d/%Y", "%Q"), ("source: amt", "source: amount")])
def test_specs_that_do_not_hold_are_refused(old, new):
    with pytest.raises(SpecError):
        compile_spec(spec().replace(old, new, 1))


def test_compiling_is_deterministic():
    a, b = compile_spec(spec()), compile_spec(spec())
    assert a == b and a.canonical() == b.canonical() and emit(a) == emit(b)
    assert from_canonical(a.canonical()) == a


def test_clean_file(spark, tmp_path):
    r = runs(spark, tmp_path, GOOD)
    assert r.exit_code == 0 and r.summary["rows_out"] == 3
    rows = spark.read.parquet(str(tmp_path / "out/output_typed")).orderBy("row_number").collect()
    assert [str(x["amount"]) for x in rows] == ["1234.56", "-75.00", "5.00"] and rows[0]["zip"] == "02134"
    assert json.loads((tmp_path / "out/manifest.json").read_text())["spec_sha256"] == r.manifest["spec_sha256"]


@pytest.mark.parametrize("row,code", [("4,Di,5,1/6/2026,N", "STR-02:<row>"), ("4,Di,5,31/31/2026,N,1", "TYP-03:day"), ("4,Di,x,1/6/2026,N,1", "TYP-01:amt"), ("4,Di,5,1/6/2026,N,123456", "TYP-11:zip"), ("4,N/A,5,1/6/2026,N,1", "NUL-04:name")])
def test_one_fault_one_code(spark, tmp_path, row, code):
    r = runs(spark, tmp_path, GOOD + row + "\n")
    assert (r.exit_code, r.summary["errors_by_type"], r.summary["rows_out"]) == (2, {code: 1}, 3)


def test_accounting_identity_and_warnings(spark, tmp_path):
    raw = b"\xef\xbb\xbf" + (HEAD + GOOD + "\n , , , , , \n1,Ann,\"$1,234.56\",01/02/2026,Y,02134\nTotal 3,,,,,\n").replace("\n", "\r\n", 1).encode()
    r = runs(spark, tmp_path, "", raw=raw)
    w = r.summary["warnings_by_type"]
    assert (w["ENC-02:<file>"], w["STR-07:<file>"], w["STR-05:<row>"], w["STR-06:<row>"]) == (1, 1, 1, 3)
    assert r.summary["rows_in"] == 7 == r.summary["rows_out"] + 3


def test_annotate_budget_and_fail_fast(spark, tmp_path):
    bad = GOOD + "4,Di,x,31/31/2026,N,1\n"
    r = runs(spark, tmp_path, bad, spec(error_disposition="annotate"))
    assert r.exit_code == 2 and r.summary["annotations_by_type"] == {"TYP-01:amount": 1, "TYP-03:day": 1}
    r = runs(spark, tmp_path, bad, spec(error_budget="{percent: 10, min_rows: 3}"))
    assert r.exit_code == 1 and r.summary["run_error"]["code"] == "ERR-02" and not (tmp_path / "out/output").exists()
    r = runs(spark, tmp_path, bad, spec(error_disposition="fail-fast"))
    assert r.exit_code == 1 and r.summary["run_error"]["code"] == "TYP-01" and r.summary["errors_by_type"] == {}


def test_run_errors(spark, tmp_path):
    assert runs(spark, tmp_path, GOOD, head="id,name,amt,day,ok\n").summary["run_error"]["code"] == "KEY-02"
    assert runs(spark, tmp_path, GOOD, head="id,name,amt,day,ok,zip,id\n").summary["run_error"]["code"] == "STR-04"
    assert runs(spark, tmp_path, "", raw=b"id\xe9").summary["run_error"]["code"] == "ENC-01"
    assert runs(spark, tmp_path, "", raw=b"").summary["run_error"]["code"] == "STR-04"


def test_records_like_the_csv_module(spark, tmp_path):
    import csv
    import io

    body = 'a,b\r\n1,"x\r\ny"\n"ab"c,2\r\n\n5,"q,r",w\n'
    (tmp_path / "x.csv").write_bytes(body.encode())
    got = [r["fields"] for r in read_records(spark, str(tmp_path / "x.csv")).orderBy("row_number").collect()]
    assert got == list(csv.reader(io.StringIO(body, newline="")))
    (tmp_path / "y.csv").write_text("a,b\n1,2\n\n3,\n")
    plain = [(r["row_number"], r["fields"]) for r in read_records(spark, str(tmp_path / "y.csv"), plain=True).orderBy("row_number").collect()]
    assert plain == [(1, ["a", "b"]), (2, ["1", "2"]), (3, []), (4, ["3", ""])]


def test_profile_findings(spark, tmp_path):
    (tmp_path / "p.csv").write_text("id,when,flag,amt,note\n" + "".join(f"{i:06d},13/0{i % 9 + 1}/2025,{'yn'[i % 2]},\"$1,{i:03d}.00\",N/A\n" for i in range(20)) + "000001,13/02/2025,n,\"$1,001.00\"\nTotal,,,,\n")
    got = profile(read_records(spark, str(tmp_path / "p.csv")))
    found = {(f["id"], f["column"]) for f in got["findings"]}
    assert {("TYP-07", "id"), ("TYP-03", "when"), ("TYP-06", "flag"), ("TYP-01", "amt"), ("NUL-03", "note"), ("STR-02", None), ("STR-06", None)} <= found
    assert got["rows_profiled"] == 22


def file_findings(spark, tmp_path, data, **kw):
    path = tmp_path / "f.csv"
    path.write_bytes(data)
    got = profile_file(spark, str(path), **kw)
    return got, {(f["id"], f["kind"]): f for f in got["findings"] if f["column"] is None}


def test_profile_of_bytes(spark, tmp_path):
    body = "".join(f"{i};caf\u00e9 {i}\n" for i in range(8))
    got, found = file_findings(spark, tmp_path, b"\xef\xbb\xbf" * 2 + ("id;name\r\n" + body).encode())
    assert found["ENC-02", "fix"]["count"] == 2 and found["STR-07", "fix"]["evidence"] == {"\\r\\n": 1, "\\n": 8}
    assert got["delimiter"] == ";" and got["columns"] == ["id", "name"] and got["rows_profiled"] == 8
    got, found = file_findings(spark, tmp_path, ("id;name\n" + body).encode("cp1252"))
    assert got["encoding"] == "cp1252" and found["ENC-01", "ask"]["evidence"]["decode_error"].startswith("byte 13")
    got, found = file_findings(spark, tmp_path, ("id,name\n" + "1,\u6771\u4eac\u90fd\n2,\u5927\u962a\n" * 9).encode("shift_jis"))
    assert got["encoding"] == "shift_jis"
    got, found = file_findings(spark, tmp_path, ("id,name\n" + "1,a\n" * 5).encode("utf-16"))
    assert ("ENC-01", "ask") in found and got["columns"] == ["id", "name"]
    got, found = file_findings(spark, tmp_path, b"")
    assert got["rows_profiled"] == 0 and not got["findings"]


@pytest.mark.parametrize(
    ("lead", "width", "rows"),
    [(["Report", "made in May"], 3, 6), (["Title,CPI", "Unit,index", "Source,office", ""], 2, 9), ([], 2, 9), ([], 3, 9)],
)
def test_profile_preamble(spark, tmp_path, lead, width, rows):
    head = [",".join(["day", "value", "more"][:width])]
    if width == 2 and lead:
        head = []  # such tables have no header of their own
    data = lead + head + [",".join([str(1990 + i), f"{i}.5", "x"][:width]) for i in range(rows)]
    got, found = file_findings(spark, tmp_path, "\n".join(data).encode())
    assert found.get(("STR-06", "ask"), {}).get("count") == (len(lead) or None)
    assert got["rows_profiled"] == rows - (not head)
    assert file_findings(spark, tmp_path, "\n".join(data).encode(), max_rows=None)[0]["findings"] == got["findings"]
