"""The pipeline against the plain versions of its stages, on the smallest data."""

import os
from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.helpers import UP
from tests.llm.test_dedup import expected_near

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
def test_stages(spark):
    from tokenizers import Tokenizer

    from gridmark.llm.queries import vocabulary

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, DATA).cache()
        steps[name] = (docs.collect(), after.collect(), after.columns == docs.columns)
        docs = after
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert all(steps[n][2] for n in names[:-1])

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    before, after, _ = steps["quality classifier"]
    kept = {r.doc_id for r in after}
    assert all((r.doc_id in kept) == bool(labels[r.doc_id]) for r in before if r.doc_id in labels) and len(after) < len(before)

    before, after, _ = steps["exact dedup"]
    last = {}
    for r in before:
        text = (r.text or "").translate(UP)
        last[text] = max(r.doc_id, last.get(text, r.doc_id))
    assert sorted(r.doc_id for r in after) == sorted(last.values())

    before, after, _ = steps["near dedup"]
    _, least = expected_near([(r.doc_id, r.text, None) for r in before])
    assert sorted(r.doc_id for r in after) == sorted(set(least.values()))

    before, after, _ = steps["source mix"]
    assert {r.doc_id: r for r in after} == {r.doc_id: r for r in before}

    before, after, _ = steps["BPE"]
    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    ids = {r.doc_id: tokenizer.encode(r.text or "", add_special_tokens=False).ids for r in before}
    assert all(r.ids == ids[r.doc_id] for r in after) and Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
def test_run_writes_every_stage(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 100
