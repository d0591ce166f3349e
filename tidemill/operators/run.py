"""A run of a pipeline over one file: checks, plan, reports, and data only if the run succeeds."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import reports
from tidemill.operators.classify import classify, typed
from tidemill.plans.spec import Pipeline
from tidemill.sources import rawcsv, sinks
from tidemill.taxonomy import ENGINE_VERSION, VERSION


class RunError(Exception):
    """Something that fails the run as a whole, under a code."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code, self.message = code, message


@dataclass
class RunResult:
    exit_code: int
    summary: dict[str, object]
    manifest: dict[str, object] = field(default_factory=dict)


def bind_header(header: list[str] | None, plan: Pipeline) -> tuple[list[str], bool]:
    """Trimmed header names, and whether there are columns nobody expects."""
    if header is None:
        raise RunError("STR-04", "the file is empty")
    names = [h.strip() for h in header]
    missing = [c for c in plan.columns if c not in names]
    if missing:
        raise RunError("KEY-02", f"missing columns: {', '.join(missing)}")
    double = [c for c in plan.columns if names.count(c) > 1]
    if double:
        raise RunError("STR-04", f"columns occur more than once: {', '.join(double)}")
    return names, bool(set(names) - set(plan.columns))


def summarize(classified: DataFrame, file_warnings: dict[str, int], error: RunError | None = None) -> dict[str, object]:
    n = reports.counts(classified).first().asDict()
    by_type = {f"{r['error_code']}:{r['column']}": r["n"] for r in sorted(reports.errors_by_type(classified).collect(), key=lambda r: (r["error_code"], r["column"]))}
    warned = {f"{r['code']}:{r['column']}": r["n"] for r in sorted(reports.warnings_by_type(classified).collect(), key=lambda r: (r["code"], r["column"]))}
    out = {
        "rows_in": n["rows_in"], "rows_out": 0 if error else n["rows_out"], "rows_quarantined": n["rows_quarantined"], "distinct_error_types": len(by_type), "errors_by_type": by_type,
        "warnings_by_type": dict(sorted((file_warnings | warned).items())), "rows_annotated": n["rows_annotated"],
        "annotations_by_type": {f"{r['reason']}:{r['field']}": r["n"] for r in sorted(reports.annotations_by_type(classified).collect(), key=lambda r: (r["reason"], r["field"]))},
    }
    if error:
        out["run_error"] = {"code": error.code, "message": error.message}
    return out


def run(spark: SparkSession, plan: Pipeline, path: str, out_dir: str, plain: bool = False) -> RunResult:
    """Exit code 0: clean, 1: the run failed, 2: rows were quarantined or annotated."""
    facts = None
    nothing = spark.createDataFrame([], "row_number long, fields array<string>")
    part = classify(nothing, plan)
    warned: dict[str, int] = {}
    error: RunError | None = None
    cut: DataFrame | None = None
    held: DataFrame | None = None
    try:
        facts = rawcsv.facts(spark, path)
        warned = {f"{code}:<file>": 1 for code, on in (("ENC-02", facts.has_bom), ("STR-07", facts.has_cr)) if on}
        records = rawcsv.read_records(spark, path, plan.delimiter, plan.quotechar, plan.encoding, plain)
        head = {r["row_number"]: r["fields"] for r in records.where("row_number <= 1").collect()}
        if rawcsv.BAD_ENCODING in head:
            raise RunError("ENC-01", f"not {plan.encoding}: {head[rawcsv.BAD_ENCODING][0]}")
        if rawcsv.BAD_CSV in head:
            raise RunError("ERR-05", head[rawcsv.BAD_CSV][0])
        names, extra = bind_header(head.get(1), plan)
        if extra:
            warned["KEY-03:<file>"] = 1
        held = classify(records.where("row_number > 1"), plan, names).persist(StorageLevel.MEMORY_AND_DISK)
        part = held
        n = reports.counts(held).first()
        stop = reports.abort_row(held, plan, n["rows_in"])
        if stop is not None:
            # everything up to the aborting row counts; with fail-fast that row has no record
            last = stop[0] - (plan.policies.error_disposition == "fail-fast")
            cut = held.where(F.col("row_number") <= last)
            part = cut
            raise RunError(stop[1], f"stopped at row {stop[0]}")
        if n["rows_quarantined"] and not n["rows_out"]:
            raise RunError("ERR-02", "no row reached the output")
    except RunError as e:
        error = e
    except Exception as e:  # noqa: BLE001  the reports of a failed run are written all the same
        error = RunError("ERR-05", f"{type(e).__name__}: {str(e)[:500]}")
        part = classify(nothing, plan)
    summary = summarize(part, warned, error)
    if cut is not None and held is not None:
        summary["rows_in"] = held.count()
    summary["exact_duplicate_rows"] = reports.duplicate_ledger(part).count()
    sinks.write_json_lines(reports.error_records(part, plan), f"{out_dir}/errors")
    sinks.write_json_lines(reports.duplicate_ledger(part), f"{out_dir}/duplicates")
    if summary["rows_quarantined"]:
        reports.quarantine_rows(part).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{out_dir}/quarantine")
    if summary["rows_annotated"]:
        sinks.write_json_lines(reports.change_records(part), f"{out_dir}/changes")
    if error is None:
        sinks.write_output(part, plan, f"{out_dir}/output")
        typed(part, plan).write.mode("overwrite").parquet(f"{out_dir}/output_typed")
    else:
        for name in ("output", "output_typed"):
            sinks.delete(spark, f"{out_dir}/{name}")
    code = 1 if error else 2 if summary["rows_quarantined"] or summary["rows_annotated"] else 0
    manifest = {
        "pipeline": plan.name, "engine_version": ENGINE_VERSION, "taxonomy_version": VERSION, "spec_sha256": plan.spec_sha256, "input_file": path,
        "input_sha256": facts.sha256 if facts else None, "rows_in": summary["rows_in"], "rows_out": summary["rows_out"], "rows_quarantined": summary["rows_quarantined"],
        "run_error": summary.get("run_error"), "completed_at_utc": datetime.now(UTC).isoformat(timespec="seconds"), "effective_policies": vars(plan.policies), "decisions": list(plan.decisions),
    }
    sinks.write_text(spark, f"{out_dir}/summary.json", sinks.canonical(summary))
    sinks.write_text(spark, f"{out_dir}/manifest.json", sinks.canonical(manifest))  # last: its presence ends the run
    if held is not None:
        held.unpersist()
    return RunResult(code, summary, manifest)


def emit(plan: Pipeline) -> str:
    """A deterministic program that runs the pipeline: same spec, same bytes."""
    return (
        f'"""Pipeline {plan.name}; spec sha256 {plan.spec_sha256}."""\n\nimport sys\n\nfrom pyspark.sql import SparkSession\n\nfrom tidemill.operators.run import run\n'
        f"from tidemill.plans.spec import from_canonical\n\nPLAN = {plan.canonical()!r}\n\nif __name__ == \"__main__\":\n"
        "    spark = SparkSession.builder.getOrCreate()\n    sys.exit(run(spark, from_canonical(PLAN), sys.argv[1], sys.argv[2]).exit_code)\n"
    )
