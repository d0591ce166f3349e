"""A corpus pipeline over the documents table, from toxicity filtering to shards.

Each stage takes (spark, docs, sf_dir) and returns a frame; it is written as Parquet to the shared
folder and read again as the next stage's docs. All but the last return the columns of documents; the
last returns the place of every row that is left. Stages that send texts to Python workers lower the
session's bound on Arrow batches (``cluster.small_batches``), which stays lowered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm.cluster import new_path, small_batches
from tidemill.llm.decontaminate import without_items
from tidemill.llm.mixing import mix, repeat_copies
from tidemill.llm.near import keep_one
from tidemill.llm.sharding import shard_rows
from tidemill.llm.toxicity import keep_clean

SHARDS = 40

#: SQL can't fit the toxicity model nor hash shingles with XXH64; the tests hold the stages against
#: brute-force versions.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model rejects go; the others stay."""
    small_batches(spark)
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays; SimHash candidates link at a Jaccard similarity of 0.8 over five-word shingles."""
    small_batches(spark)
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    small_batches(spark)
    return without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, dealt by weight; documents of later epochs repeat as rows."""
    return repeat_copies(mix(docs, share=1.0, max_epochs=2))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row."""
    return shard_rows(docs, SHARDS)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("shards", shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's frame; what the others return is kept as Parquet in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_path(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
