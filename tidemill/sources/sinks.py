"""What a run leaves behind. Data is written by Spark; the small reports and, last, the manifest by the driver."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.plans.spec import Pipeline


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file through Spark's file systems: written beside its place and renamed into it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = jvm.org.apache.hadoop.fs.Path(path + ".part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"{path} could not be put in place")


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def csv_cell(c):  # noqa: ANN001, ANN201
    """A cell with quotes only where they are needed."""
    return F.when(c.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def csv_line(cells):  # noqa: ANN001, ANN201
    one = F.concat(F.lit('"'), F.lit('"'))
    line = F.array_join(F.transform(cells, lambda x: csv_cell(F.coalesce(x, F.lit("")))), ",")
    return F.when((F.size(cells) == 1) & (F.element_at(cells, 1) == ""), one).otherwise(line)


def write_output(classified: DataFrame, plan: Pipeline, path: str) -> None:
    """Rendered rows in input order as CSV parts; the order is by ranges, so no task holds them all."""
    names = [f.target for f in plan.fields]
    rows = classified.where("status = 'out'").select("row_number", *[F.coalesce(F.col(f"out.{n}"), F.lit("")).alias(n) for n in names])
    rows.orderBy("row_number").drop("row_number").write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(path)


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, indent=2) + "\n"
