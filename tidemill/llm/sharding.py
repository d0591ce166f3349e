"""A reproducible shuffle into shards: a Feistel permutation of global row numbers.

Rows get global numbers 0..N-1 in the order of (id, text checksum, size), nulls first. Only these
light columns are sorted, by ranges, and numbered within each range partition; the row counts of the
partitions, one number each, make the numbers global. Rows that agree in all sort columns are
interchangeable; they may be split over partitions, so a hot id does not gather in one task.

A balanced Feistel network over the least even number of bits that covers N permutes the numbers;
a result of N or more is put through the network again until it falls below N (cycle walking). With
the permuted number p, the shard is p mod shards and the slot p div shards, so shard counts are at
most one apart, slots have no gaps, and shard and slot of any row number can be computed alone.

Defined results: a null text has no bytes (size 16, checksum 0); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import kernel
from tidemill.llm.cluster import held, partition_sizes

ROUNDS = 6
#: Added to each text's bytes.
ROW_BYTES = 16


def feistel(x: np.ndarray, total: int, seed: int) -> np.ndarray:
    """The permutation of 0..total-1 at the points x."""
    half = max(1, (max(1, total - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = kernel.mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * kernel.BASE + np.uint64(seed & (1 << 64) - 1))
    out = x.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        y = out[todo]
        left, right = y >> np.uint64(half), y & low
        for k in keys:
            left, right = right, left ^ (kernel.mix(right + k) & low)
        y = left << np.uint64(half) | right
        out[todo] = y
        todo = todo[y >= total]
    return out.astype(np.int64)


def numbered(light: DataFrame, order: list[str], number: str) -> tuple[DataFrame, int]:
    """The rows with a global number by the order columns, and their count; lineage is cut."""
    parts = max(1, int(light.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tie = F.monotonically_increasing_id()
    held_rows = held(light.withColumn("_tie", tie).repartitionByRange(parts, *order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie"))
    sizes = partition_sizes(held_rows)
    before, seen = {}, 0
    for p in sorted(sizes):
        before[p] = seen
        seen += sizes[p]
    index = F.monotonically_increasing_id()
    within = index.bitwiseAND(F.lit((1 << 33) - 1))
    # one number for each partition, looked up by a literal map
    at = F.element_at(F.create_map(*[F.lit(x) for p in before for x in (p, before[p])]), F.shiftright(index, 33).cast("int")) if before else F.lit(0)
    return held_rows.withColumn(number, (at + within).cast("long")), seen


def shard_rows(docs: DataFrame, shards: int, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, size, text_crc32, row_number, shard, slot)`` for every row."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    light = docs.select(F.col(id_col).alias("d"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("crc"))
    rows, total = numbered(light, ["d", "crc", "size"], "r")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = feistel(b.column("r").to_numpy(), total, seed)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((p % shards).astype(np.int32)), pa.array(p // shards)], names=[*b.schema.names, "shard", "slot"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(place, f"d {kind}, size long, crc long, r long, shard int, slot long")
    return out.select(F.col("d").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.col("r").alias("row_number"), "shard", "slot")
