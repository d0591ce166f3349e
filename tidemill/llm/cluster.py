"""The folder that driver and executors share, and what is kept there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, one folder of this process (local runs and tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="tidemill-"))
    spark.sparkContext.setCheckpointDir(_own[0])
    return _own[0]


def held(df: DataFrame) -> DataFrame:
    """The frame, computed once and cut from its lineage by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


#: Bytes of texts that go to a Python worker at a time.
BATCH = 2 << 20
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Cuts the session's Arrow batches at BATCH bytes from now on (Spark's own bound: 64 MB); a lower setting stays.

    A batch is held several times over: in the JVM with the rows that wait for their results, in its Arrow
    buffers, which grow by doubling, and in the worker.
    """
    have = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_BYTES))
    if have > BATCH:
        spark.conf.set(BATCH_BYTES, f"{BATCH}b")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names close to the given ones that the frame does not have in any case."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        x = f"_{name}"
        while x.lower() in have:
            x = f"_{x}"
        have.add(x.lower())
        out.append(x)
    return out


def partition_sizes(df: DataFrame) -> dict[int, int]:
    """Rows of each partition of a checkpointed frame: a number for each partition comes to the driver."""
    return {r[0]: r[1] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()}


#: Bits of a bitmap of hashes.
BITS = 1 << 26


def bitmap(hashes: DataFrame, column: str) -> np.ndarray:
    """A bit for each hash modulo BITS: at most BITS / 64 longs come to the driver, however many hashes there are."""
    place = F.pmod(F.col(column), F.lit(BITS))
    words = hashes.groupBy(F.shiftright(place, 6).cast("int").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod({column}, 64) as int))")).alias("b")).toArrow()
    out = np.zeros(BITS // 64, np.int64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return out


def maybe_in(spark: SparkSession, bits: np.ndarray) -> Callable[[Column], Column]:
    """Whether a hash may be one of the bitmap's: no false negatives."""
    sent = spark.sparkContext.broadcast(bits)

    def of(hashes: pa.Array) -> pa.Array:
        x = hashes.to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64(BITS - 1)
        return pa.array((sent.value.view(np.uint64)[x >> np.uint64(6)] >> (x & np.uint64(63))) & np.uint64(1) == 1)

    return F.arrow_udf(of, "boolean")
