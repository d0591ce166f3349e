"""Reports: each is an aggregate over the classified rows, so it does not depend on task retries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.plans.spec import Pipeline
from tidemill.sources.sinks import csv_line


def errors_by_type(classified: DataFrame) -> DataFrame:
    rows = classified.where("status = 'quarantined'")
    return rows.groupBy(F.col("error.code").alias("error_code"), F.col("error.column").alias("column")).agg(F.count("*").alias("n"))


def warnings_by_type(classified: DataFrame) -> DataFrame:
    rows = classified.where(F.size("warns") > 0).select(F.explode("warns").alias("w"))
    return rows.groupBy(F.col("w.code").alias("code"), F.col("w.column").alias("column")).agg(F.count("*").alias("n"))


def annotations_by_type(classified: DataFrame) -> DataFrame:
    rows = classified.where(F.size("changes") > 0).select(F.explode("changes").alias("c"))
    return rows.groupBy(F.col("c.reason").alias("reason"), F.col("c.field").alias("field")).agg(F.count("*").alias("n"))


def counts(classified: DataFrame) -> DataFrame:
    return classified.agg(
        F.count("*").alias("rows_in"),
        F.count_if(F.col("status") == "out").alias("rows_out"),
        F.count_if(F.col("status") == "quarantined").alias("rows_quarantined"),
        F.count_if(F.size("changes") > 0).alias("rows_annotated"),
        F.count_if(F.col("status") == "blank").alias("rows_blank"),
        F.count_if(F.col("status") == "skipped").alias("rows_skipped"),
        F.count_if(F.col("status") == "duplicate").alias("rows_dropped"),
    )


def error_records(classified: DataFrame, plan: Pipeline) -> DataFrame:
    rows = classified.where("status = 'quarantined'")
    place = F.lit(None).cast("int")
    for i, c in enumerate(plan.columns):
        place = F.when(F.col("error.column") == c, F.lit(i)).otherwise(place)
    return rows.select(
        "row_number", F.col("error.column").alias("column"), place.alias("column_idx"), F.col("error.code").alias("error_code"), F.col("error.value").alias("offending_value"),
        F.col("error.message").alias("message"), csv_line(F.col("fields")).alias("csv_line"),
    )


def quarantine_rows(classified: DataFrame) -> DataFrame:
    return classified.where("status = 'quarantined'").select(F.col("row_number").alias("__row_number__"), F.to_json("fields").alias("__raw_row__"))


def change_records(classified: DataFrame) -> DataFrame:
    return classified.where(F.size("changes") > 0).select("row_number", "changes")


def duplicate_ledger(classified: DataFrame) -> DataFrame:
    return classified.where("first_row IS NOT NULL").select("row_number", F.col("first_row").alias("first_seen_row"))


#: Ranges of row numbers that are counted at once, and rows that one task orders.
RANGES, FEW = 1024, 4096


def abort_row(classified: DataFrame, plan: Pipeline, rows_in: int) -> tuple[int, str] | None:
    """Where the run stops and under which code: the first error with fail-fast, the first row beyond the budget.

    The budget is passed by the k-th quarantined row, k = floor(percent of rows_in) + 1. Quarantined rows are
    counted by ranges of row numbers, the range that holds the k-th is counted by smaller ranges in turn, and
    only a range of at most ``FEW`` numbers is ordered: no more than ``RANGES`` counts come to the driver at once.
    """
    bad = classified.where("status = 'quarantined'").select("row_number", "error.code")
    if plan.policies.error_disposition == "fail-fast":
        first = bad.agg(F.min_by(F.struct("row_number", "code"), "row_number")).first()[0]
        return (first["row_number"], first["code"]) if first else None
    if rows_in < plan.policies.budget_min_rows:
        return None
    k = int(plan.policies.budget_percent * rows_in / 100) + 1
    low, high, n = bad.agg(F.min("row_number"), F.max("row_number"), F.count("*")).first()
    if n < k:
        return None
    while high - low >= FEW:
        width = -(-(high - low + 1) // RANGES)
        place = F.expr(f"(row_number - {low}L) div {width}L").alias("place")
        counts = sorted(tuple(r) for r in bad.where(F.col("row_number").between(low, high)).groupBy(place).agg(F.count("*")).collect())
        for at, c in counts:
            if k <= c:
                low, high = low + at * width, min(high, low + (at + 1) * width - 1)
                break
            k -= c
    found = sorted(r[0] for r in bad.where(F.col("row_number").between(low, high)).select("row_number").collect())
    return found[k - 1], "ERR-02"
