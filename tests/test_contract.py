"""The driver's functions, and SQL against Spark on the smallest data."""

import os

import pytest

import __spark_entry__ as entry_points

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = ("score_samples", "compare_samples", "bucket_counts", "match_resolution", "shard_assign", "value_pools", "title_clean", "zero_stats")

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, name):
    import duckdb

    found = entry_points.queries()[name](spark, DATA)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    expected = con.sql(entry_points.oracle_sql()[name])
    names = sorted(found.columns)
    assert names == sorted(expected.columns)
    at = [expected.columns.index(n) for n in names]
    assert sorted([plain(r[n]) for n in names] for r in found.collect()) == sorted([plain(r[i]) for i in at] for r in expected.fetchall())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
