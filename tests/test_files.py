import json

import pytest
from pyspark.sql import functions as F

from gridmark.operators import evaluate
from gridmark.sources import files
from gridmark.streaming import scoring


def test_json_lines(spark, tmp_path):
    source = tmp_path / "in.jsonl"
    source.write_text('{"a": "日", "n": 1}\n\n{"a": "b"}\n', encoding="utf-8")
    rows = files.read_jsonl(spark, str(source), "a string, n long")
    assert [tuple(r) for r in rows.orderBy("n").collect()] == [("b", None), ("日", 1)]
    files.write_jsonl(rows, str(tmp_path / "out"), order="a", one_file=True)
    text = next((tmp_path / "out").glob("part-*")).read_text(encoding="utf-8")
    assert text == '{"a":"b"}\n{"a":"日","n":1}\n'
    source.write_text("{broken\n", encoding="utf-8")
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(source), "a string").collect()


def test_documents_and_csv(spark, tmp_path):
    frame = spark.createDataFrame([(1, None, "日")], "n int, e string, t string").coalesce(1)
    files.write_json(frame, str(tmp_path / "d.json"))
    assert json.loads((tmp_path / "d.json").read_text(encoding="utf-8")) == {"n": 1, "e": None, "t": "日"}
    assert files.read_json(spark, str(tmp_path / "d.json")).first().t == "日"
    files.write_csv(frame, str(tmp_path / "c"), "t", "e")
    assert next((tmp_path / "c").glob("part-*")).read_text(encoding="utf-8") == "t,e\n日,\n"


def test_encodings(spark, tmp_path):
    for name, data in {"a.csv": "流量\r\n1\r2".encode(), "b.csv": b"\xef\xbb\xbfx", "c.csv": "流量".encode("gb18030"), "d.txt": b"no"}.items():
        (tmp_path / name).write_bytes(data)
    rows = {r.stem: (r.text, r.encoding) for r in files.texts(spark, str(tmp_path)).collect()}
    assert rows == {"a": ("流量\n1\n2", "utf-8-sig"), "b": ("x", "utf-8-sig"), "c": ("流量", "gb18030")}
    assert files.first_text(spark, str(tmp_path)).first().stem == "a"
    (tmp_path / "e.csv").write_bytes(b"\xff\xff")
    with pytest.raises(Exception, match="neither"):
        files.texts(spark, str(tmp_path), "e.csv").collect()


def test_raw_outputs(spark):
    predictions = spark.createDataFrame([("a",), ("b",)], "stem string")
    outputs = spark.createDataFrame([("a", "x")], "stem string, text string")
    assert files.with_raw_output(predictions.filter("stem = 'a'"), outputs).first().raw_text == "x"
    with pytest.raises(Exception, match="Missing raw output"):
        files.with_raw_output(predictions, outputs).collect()
    assert predictions.select(files.raw_path("out/", "stem").alias("p")).first().p == "out/a.txt"
    stems = spark.createDataFrame([("x/a.b.jpg",), (".hidden",), ("y",)], "p string").select(files.stem("p").alias("s")).collect()
    assert [r.s for r in stems] == ["a.b", ".hidden", "y"]


def test_write_each(spark, tmp_path):
    frame = spark.createDataFrame([("a", "1\n2")], "n string, t string")
    for _ in range(2):  # a second attempt takes the first one's place
        assert files.write_each(frame, "n", "t", str(tmp_path / "o"), "tex") == 1
    assert [p.name for p in (tmp_path / "o").iterdir()] == ["a.tex"] and (tmp_path / "o" / "a.tex").read_text() == "1\n2"
    assert files.write_each(frame.select(F.concat(F.lit("x/y/"), "n").alias("n"), "t"), "n", "t", (tmp_path / "o").as_uri()) == 1 and (tmp_path / "o/x/y/a.txt").exists()
    assert files.write_each(frame.limit(0), "n", "t", str(tmp_path / "none")) == 0
    with pytest.raises(ValueError):
        files.write_each(frame, "n", "t", str(tmp_path / "o"), "pdf")
    (tmp_path / "o" / "b.tex").write_text("")
    assert files.remove_matching(spark, str(tmp_path / "o" / "*.tex"), {"b.tex"}) == ["a.tex"]
    files.replace(spark, str(tmp_path / "o" / "b.tex"), str(tmp_path / "o" / "c.tex"))
    assert files.exists(spark, str(tmp_path / "o" / "c.tex")) and not files.exists(spark, str(tmp_path / "o" / "b.tex"))


def test_stream_scores_each_sample_once(spark, tmp_path):
    record = {"sample_id": "a", "image_path": "", "prediction": "x", "target_csv": "x\n", "arrived": "2024-01-01T00:00:00"}
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps(record) + "\n" + json.dumps(record | {"sample_id": f"b{k}"}) + "\n")
    stream = scoring.score_stream(scoring.arriving(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"))
    stream.awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.sample_id for r in rows.collect()) == ["a", "b0", "b1"]
    assert evaluate.error_histogram(rows).first().error_type == "structure_error"


def test_decode_null(spark):
    assert spark.createDataFrame([(None,)], "c binary").select(files.decode_text("c").alias("d")).select(F.col("d.text").isNull().alias("n")).first().n
