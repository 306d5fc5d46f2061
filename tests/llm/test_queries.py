"""Registered queries of training data against SQL and the whole job."""

import os

import pytest

from gridmark.llm import queries as Q

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


def test_trigram_scores_are_registered(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    plain = lambda r: (r[0], r[1], round(r[2], 3), r[3] if r[3] is None else round(r[3], 5))
    found = {r[0]: plain(r) for r in Q.QUERIES["op9_lm_score_trigrams"](spark, DATA).collect()}
    expected = [plain(r) for r in con.sql(Q.ORACLE_SQL["op9_lm_score_trigrams"]).fetchall()]
    assert len(found) == len(expected) and all(found[r[0]] == pytest.approx(r, abs=2e-3) for r in expected)
    assert sum(found[r.doc_id][2] != round(r.log10_score, 3) for r in Q.QUERIES["op9_lm_score"](spark, DATA).collect()) > len(found) / 2
