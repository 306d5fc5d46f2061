"""Jobs: arguments, and what a resumed run keeps. Their results are held against SQL in the queries."""

import json

import pytest

import __spark_entry__  # noqa: F401  registers the queries
from gridmark import jobs
from gridmark.operators import runs
from gridmark.sources import files


def test_score_from_the_command_line(spark, tmp_path, capsys):
    record = {"sample_id": "a", "image_path": "i", "prediction": "x", "target_csv": "x\n"}
    (tmp_path / "p.jsonl").write_text(json.dumps(record) + "\n")
    jobs.main(["score", "--predictions", str(tmp_path / "p.jsonl"), "--output", str(tmp_path / "s.json")])
    said = json.loads(capsys.readouterr().out)
    assert said["samples"] == 1 and said["by_error_type"] == {"structure_error": 1} and json.loads((tmp_path / "s.json").read_text()) == said


def test_generate_refuses_bad_arguments(spark, tmp_path):
    for bad in ({"share": 1.5}, {"share": -0.1}, {"n": 0}):
        with pytest.raises(ValueError):
            jobs.generate(spark, str(tmp_path), str(tmp_path / "o"), **bad)


def test_a_missing_layout_is_an_error(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.csv").write_text("d,1,2\n1,3,4\n2,5,25\n")
    made = jobs.generate(spark, str(tmp_path / "t"), str(tmp_path / "o"), 4, 0.5, 3, "flow_v1").collect()
    assert sorted(r.split for r in made) == ["train", "train", "val", "val"] and all(r.target_csv.startswith("日\\月") for r in made)
    with pytest.raises(Exception, match="No layout of table"):
        jobs.generate(spark, str(tmp_path / "t"), str(tmp_path / "o"), 5, 0.5, 3, "flow_v1", manifest_only=True)


def test_infer_resumes(spark, tmp_path):
    facts = {"backend": "b", "mode": "csv", "query": "q", "device": "cpu", "dtype": "f"}
    rows = spark.createDataFrame([(k, f"s{k}", f"i{k}") for k in range(6)], "pos long, sample_id string, image_path string")
    at = str(tmp_path / "out")
    first = runs.infer(rows.filter("pos < 3"), at, lambda: lambda b: b["image_path"], facts)
    assert {r.sample_id: r.prediction for r in first.collect()} == {"s0": "i0", "s1": "i1", "s2": "i2"}
    second = runs.infer(rows, at, lambda: lambda b: b["image_path"] + "!", facts)
    assert [(r.sample_id, r.prediction) for r in second.orderBy("pos").collect()] == [("s0", "i0"), ("s1", "i1"), ("s2", "i2"), ("s3", "i3!"), ("s4", "i4!"), ("s5", "i5!")]
    assert {r.prediction for r in runs.infer(rows, at, lambda: lambda b: b["sample_id"], facts, overwrite=True).collect()} == {f"s{k}" for k in range(6)}
    shard = runs.infer(rows, str(tmp_path / "s"), lambda: lambda b: b["sample_id"], facts, shard=1, shards=4)
    assert sorted((r.sample_id, r["index"], r.num_shards) for r in shard.collect()) == [("s1", 1, 4), ("s5", 2, 4)] and not files.exists(spark, f"{at}.draft")
