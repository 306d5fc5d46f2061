"""Registered queries over whole tables, without limits of their own."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from gridmark.operators import synth
from gridmark.plans import adapters as A
from gridmark.plans.oracles import ORACLES
from gridmark.plans.queries import QUERIES
from tests.test_runs import plain_tables

DATA = "/root/testdata/sf0.001"
on_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


@on_data
def test_synthetic_tables_draw_from_all_tables(spark):
    """Places over the whole pools are drawn, not only those of the first tables."""
    tokens = synth.value_pools(A.grids(spark, DATA), "g", "name").orderBy("month", "pos").collect()
    pools = {m: [r.token for r in tokens if r.month == m] for m in range(12)}
    assert max(map(len, pools.values())) > 50 and all([r.pos for r in tokens if r.month == m] == list(range(len(pools[m]))) for m in range(12))
    found = QUERIES["synthetic_tables"](spark, DATA).collect()
    plain = plain_tables(len(found), 7, pools)
    for r in found:
        cells = {(day, m): v for (i, name, day, m), v in plain.items() if (i, name) == (r["index"], r.data_regime)}
        rows = ["D/M," + ",".join(map(str, range(1, 13)))] + [",".join([str(day), *(cells[day, m] for m in range(12))]) for day in range(1, 32)]
        assert r.digest == hashlib.md5(("\n".join(rows) + "\n").encode()).hexdigest()


@on_data
def test_every_event_has_a_shard(spark, tmp_path):
    import duckdb

    spark.range(12000).select(F.col("id").alias("event_id"), F.lit("x").alias("event_type"), F.lit(1).alias("user_id")).write.parquet(f"{tmp_path}/events.parquet")
    found = QUERIES["shard_all"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert len(found) == 12000 and sorted(map(tuple, found)) == sorted(con.sql(ORACLES["shard_all"]).fetchall())
