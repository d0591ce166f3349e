"""The registered queries of this package: each applies one operator, with production parameters,
to its whole table and derives the columns that its contract names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import languages, media, pii, toxicity
from tidemill.llm.cluster import new_path
from tidemill.llm.decontaminate import containment_pairs
from tidemill.llm.mixing import MIX_SQL, mix
from tidemill.llm.pages import main_text
from tidemill.llm.sharding import shard_rows
from tidemill.llm.simhash import simhash_components
from tidemill.llm.substrings import repeated_passages

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mix(table(spark, sf_dir, "documents"), share=0.5, max_epochs=4)
    plain = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]
    return taken.select("doc_id", F.col("_domain").alias("domain"), *plain, F.col("_tokens").alias("n_tokens"), F.col("_copies").alias("copies"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op4_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_rows(table(spark, sf_dir, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def op5_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op6_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5))
    filters = languages.fit(docs, fold != 0)
    return languages.identify(docs, filters).select("doc_id", (fold == 0).alias("held_out"), "lang_pred", "score")


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "media")
    media.store(table(spark, sf_dir, "documents"), path)
    found = media.media_features(media.read_media(spark, path))
    return found.withColumnRenamed("id", "doc_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", toxicity.severity_column(model, docs, F.col("text")).alias("x"))
    return out.select("doc_id", F.col("x.severity").alias("severity"), F.col("x.p_toxic").alias("p_toxic"), (F.col("x.p_toxic") >= toxicity.REJECT).alias("rejected"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digest(pii.find(docs, pii.train(docs)))


QUERIES: dict[str, Query] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_mix": op2_mix,
    "op3_simhash": op3_simhash,
    "op4_feistel_shards": op4_feistel_shards,
    "op5_page_text": op5_page_text,
    "op6_languages": op6_languages,
    "op7_substrings": op7_substrings,
    "op8_media": op8_media,
    "op9_toxicity": op9_toxicity,
    "op10_personal_data": op10_personal_data,
}
OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
sizes AS (SELECT DISTINCT least(len(w), 5) AS k FROM b WHERE len(w) > 0),
ds AS (SELECT DISTINCT r, doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT r, doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
bs AS (SELECT DISTINCT q, item_id, least(len(w), 5) AS k, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT q, item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT q, count(*) AS n_item FROM bs GROUP BY q),
hits AS (SELECT r, q, any_value(doc_id) AS doc_id, any_value(item_id) AS item_id, count(*) AS n_shared FROM ds JOIN bs ON ds.s = bs.s AND ds.k = bs.k GROUP BY r, q)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment FROM hits JOIN n ON hits.q = n.q WHERE n_shared >= 0.8 * n_item
"""

OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
again AS (SELECT h FROM x GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, i + k AS at FROM x JOIN again ON x.h = again.h, (SELECT unnest(range(0, 35)) AS k)),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS at FROM d),
kept AS (SELECT words.r, string_agg(word, ' ' ORDER BY words.at) AS text, count(*) AS n FROM words LEFT JOIN gone ON words.r = gone.r AND words.at = gone.at WHERE gone.at IS NULL GROUP BY words.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept ON d.r = kept.r
"""

ORACLE_SQL: dict[str, str] = {"op1_decontaminate": OP1_SQL, "op2_mix": MIX_SQL, "op7_substrings": OP7_SQL}
