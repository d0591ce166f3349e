import pyarrow as pa
import pytest

import corpus_pipeline
from tidemill.llm import cluster, decontaminate, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_do_what_they_say(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == docs.columns
        before, after = {r["doc_id"] for r in docs.collect()}, {r["doc_id"] for r in out.collect()}
        assert after <= before and out.count() == len(after)
        if name == "toxicity":
            model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            score = {r[0]: r[1]["p_toxic"] for r in docs.select("doc_id", toxicity.severity_column(model, docs, docs.text)).collect()}
            assert after == {d for d in before if score[d] < toxicity.REJECT}
        if name == "decontamination":
            items = [decontaminate.shingles(r["text"], 5) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            have = {r["doc_id"]: decontaminate.shingles(r["text"], 5) for r in docs.collect()}
            assert before - after == {d for d, s in have.items() if any(len(i & s) >= 0.8 * len(i) for i in items)}
        docs = out
        sizes.append(len(after))
    assert sizes[0] > sizes[-1] > 0.5 * sizes[0]


def test_run_places_every_row_once(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r["row_number"] for r in rows) == list(range(len(rows))) and rows
    assert len({(r["shard"], r["slot"]) for r in rows}) == len(rows)


@pytest.mark.parametrize("name", ["toxicity", "near_duplicates", "decontamination"])
def test_texts_go_to_workers_in_small_batches(spark, name):
    # 12 MB of texts in one partition
    texts = spark.range(0, 600, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 4000) AS text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.nbytes])})

    before = spark.conf.get(cluster.BATCH_BYTES)
    try:
        for given, most in (("64m", cluster.BATCH), ("1m", 1 << 20)):
            spark.conf.set(cluster.BATCH_BYTES, given)
            dict(corpus_pipeline.STAGES)[name](spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
            got = [r["n"] for r in texts.mapInArrow(sizes, "n long").collect()]
            assert sum(got) >= 12_000_000 and max(got) <= most + 100_000
    finally:
        spark.conf.set(cluster.BATCH_BYTES, before)
