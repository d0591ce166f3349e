import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = ["clean_orders", "disposition_annotate", "warnings_by_type", "error_budget", "row_error_records", "exact_duplicates", "to_datetime_utc", "clean_text", "expressions", "profile_dates", "profile_sentinels", "null_resolution", "profile_ids", "profile_structure", "profile_odd_cells"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    names = sorted(df.columns)
    rel = con.sql(entry.oracle_sql()[name])
    at = [list(rel.columns).index(c) for c in names]
    assert sorted(repr([r[c] for c in names]) for r in df.collect()) == sorted(repr([r[i] for i in at]) for r in rel.fetchall())


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
