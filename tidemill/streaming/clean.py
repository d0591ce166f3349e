"""The same plan over a stream of rows, one batch at a time.

Only what a row alone decides is defined on a stream: exact duplicates are counted within a batch, and
the error budget, which needs all rows, does not apply.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemill.operators import reports
from tidemill.operators.classify import classify, typed
from tidemill.plans.spec import Pipeline


def clean_stream(rows: DataFrame, plan: Pipeline, out_dir: str, checkpoint: str) -> StreamingQuery:
    """Appends typed rows and error records under out_dir; rows: stream of (row_number, fields)."""

    def batch(df: DataFrame, number: int) -> None:
        held = classify(df, plan).persist()
        typed(held, plan).write.mode("overwrite").parquet(f"{out_dir}/output/batch={number}")
        reports.error_records(held, plan).write.mode("overwrite").parquet(f"{out_dir}/errors/batch={number}")
        held.unpersist()

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
