"""Registered queries over texts process whole texts and return every row."""

import hashlib
import unicodedata

import duckdb
import pytest

import __spark_entry__ as entry

TAIL = "é é ñ ü ﬁ 日本 ẛ̣ Å"
TEXTS = ["plain " * 80, "x" * 300 + TAIL, "word " * 400 + TAIL, TAIL, "", None]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("texts"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    return at


def md5(x):
    return None if x is None else hashlib.md5(x.encode()).hexdigest()


def test_unicode_normalization_takes_whole_texts(spark, folder):
    got = {r["doc_id"]: r["digest"] for r in entry.queries()["unicode_normalization"](spark, folder).collect()}
    assert got == {i: md5(t and unicodedata.normalize("NFC", t)) for i, t in enumerate(TEXTS)}


def test_mojibake_repair_takes_whole_texts_and_returns_every_row(spark, folder):
    got = {r["doc_id"]: (r["digest"], r["warned"]) for r in entry.queries()["mojibake_repair"](spark, folder).collect()}
    assert got == {i: (md5(t), any(ord(c) > 127 for c in t or "")) for i, t in enumerate(TEXTS)}


def test_clean_text_returns_every_row(spark, folder):
    got = {r["doc_id"]: r["digest"] for r in entry.queries()["clean_text"](spark, folder).collect()}
    assert got == {i: md5(unicodedata.normalize("NFC", t).strip() if t else None) for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("name", ["unicode_normalization", "mojibake_repair", "clean_text"])
def test_query_equals_its_sql_on_whole_texts(spark, tmp_path, name):
    # unlike the texts above, also ones that no repair can read again
    texts = [*TEXTS, "日本 only", "bad \ufffd é", "  padded\n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    rel = con.sql(entry.oracle_sql()[name])
    got = sorted(repr(tuple(r[c] for c in rel.columns)) for r in entry.queries()[name](spark, str(tmp_path)).collect())
    assert got == sorted(map(repr, rel.fetchall()))
