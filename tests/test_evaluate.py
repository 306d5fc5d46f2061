import json
import pytest
from pyspark.sql import functions as F

from gridmark.functions import metrics as M
from gridmark.operators import classify, compare, evaluate
from gridmark.sources import files

TARGET = "日期,一月\n1,12\n2,13\n"


def latex(*rows):
    return "\\begin{tabular}{|c|c|}\n" + "".join("\\hline\n" + " & ".join(r) + " \\\\\n" for r in rows) + "\\hline\n\\end{tabular}"


def frame(spark, predictions, target=TARGET):
    return spark.createDataFrame([(f"s{k}", p, target, k) for k, p in enumerate(predictions)], "sample_id string, prediction string, target_csv string, pos int")


HEAD = ("日期", "一月")
CASES = [
    (latex(HEAD, ("1", "12"), ("2", "99")), "value_error", 5 / 6),
    (latex(HEAD, ("1", "12")), "truncation", 0.0),
    (latex(HEAD, ("1",), ("2", "13")), "structure_error", 0.0),
    (latex(HEAD, ("1", "12"), ("2", "13")), "value_error", 1.0),
    ("日\\月\n1\n2\n", "structure_error", 0.0),
    (latex(HEAD, ("1", "12")).replace("\n", " "), "truncation", 0.0),
]


def test_scores(spark):
    rows = {r.sample_id: r for r in evaluate.score_samples(frame(spark, [c[0] for c in CASES])).collect()}
    for k, (_, kind, cells) in enumerate(CASES):
        assert (rows[f"s{k}"].error_type, rows[f"s{k}"].cell_accuracy) == (kind, pytest.approx(cells))
    perfect = rows["s3"]
    assert perfect.character_accuracy == 1.0 and perfect.weighted_score == pytest.approx(1.0)
    assert (perfect.front_25, perfect.middle_50, perfect.back_25) == (1.0, 1.0, 1.0)
    # A prediction that is cut short still scores where it reaches.
    assert (rows["s1"].front_25, rows["s1"].middle_50, rows["s1"].back_25) == (1.0, 1.0, 0.0)


def test_summary_and_empty(spark):
    scored = evaluate.score_samples(frame(spark, [c[0] for c in CASES]))
    assert evaluate.summarize(scored).first().cell_accuracy == pytest.approx((5 / 6 + 1) / 6)
    assert {r.error_type: r.n for r in evaluate.error_histogram(scored).collect()} == {"value_error": 2, "truncation": 2, "structure_error": 2}
    nothing = evaluate.summarize(scored.limit(0)).first()
    assert (nothing.samples, nothing.weighted_score) == (0, 0.0)


def test_slice_bounds(spark):
    ns = [0, 1, 2, 4, 6, 10, 32]
    rows = spark.createDataFrame([(n,) for n in ns], "n int")
    found = {r.n: [tuple(x) for x in r.b] for r in rows.select("n", F.array(*[F.array(a.cast("int"), b.cast("int")) for a, b in M.slice_bounds(F.col("n"))]).alias("b")).collect()}
    assert found[1] == [(0, 1), (1, 1), (1, 1)] and found[2] == [(0, 1), (1, 2), (2, 2)] and found[4] == [(0, 1), (1, 3), (3, 4)]
    assert found[6] == [(0, 2), (2, 4), (4, 6)] and found[10] == [(0, 2), (2, 8), (8, 10)] and found[32] == [(0, 8), (8, 24), (24, 32)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance_by_characters(spark):
    pairs = [("", ""), ("é水", "e水"), ("abc", ""), ("日月", "月日"), ("kitten", "sitting"), ("😀a", "a")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", M.edit_distance("a", "b").alias("d"), M.char_accuracy("a", "b").alias("c")).collect()
    for r in rows:
        assert r.d == distance(r.a, r.b) and r.c == pytest.approx(1 - r.d / max(len(r.a), len(r.b), 1))


def runs(spark):
    good, wrong_shape = latex(HEAD, ("1", "12"), ("2", "13")), latex(HEAD, ("1", "12"))
    ids = ("improves", "regresses", "ties")
    make = lambda ps: spark.createDataFrame([(i, p, TARGET, "") for i, p in zip(ids, ps)], "sample_id string, prediction string, target_csv string, image_path string")
    return make((wrong_shape, good, good)), make((good, wrong_shape, good))


def test_compare(spark):
    before, after = (compare.structure_metrics(x) for x in runs(spark))
    compared = compare.compare_samples(before, after)
    assert {r.transition: r.n for r in compare.transitions(compared).collect()} == {"correct -> correct": 1, "correct -> incorrect": 1, "incorrect -> correct": 1}
    assert compare.run_summary(before).first().structure_count == 2
    assert compare.summary_delta(compare.run_summary(before), compare.run_summary(after)).first().structure_count == 0
    assert {r.bin: r.n for r in classify.delta_histogram(compared).collect()} == {1: 1, 6: 1, 11: 1}


def test_keys(spark):
    before, after = runs(spark)
    with pytest.raises(compare.SampleKeyError, match="duplicate sample_id"):
        compare.require_unique(before.unionByName(before))
    with pytest.raises(compare.SampleKeyError, match="ties"):
        compare.require_parity(before, after.filter("sample_id <> 'ties'"))
    compare.require_parity(before, after)


def test_buckets(spark, tmp_path):
    before, _ = runs(spark)
    classified = classify.classify(compare.structure_metrics(before))
    assert {r.bucket: r.n for r in classify.bucket_counts(classified).collect()} == {"structure_correct__cell_correct": 2, "structure_correct__cell_error": 0, "structure_error__cell_correct": 0, "structure_error__cell_error": 1}
    out = tmp_path / "out"
    assert classify.write_buckets(classified.withColumn("raw", F.concat(F.lit("raw of "), "sample_id")), "raw", str(out), "sample_id") == 3
    assert sorted(p.name for p in out.iterdir()) == sorted(classify.BUCKETS)
    assert (out / classify.BUCKETS[3] / "improves.txt").read_text() == "raw of improves" and not list((out / classify.BUCKETS[1]).iterdir())
    summary = classify.write_summary(classified, str(out))
    assert summary == json.loads((out / "summary.json").read_text()) and summary["sample_count"] == 3 and summary["folder_counts"][classify.BUCKETS[0]] == 2
    assert spark.read.json(str(out / "samples.jsonl")).count() == 3


def test_comparison_as_files(spark, tmp_path):
    before, after = (compare.structure_metrics(x) for x in runs(spark))
    summary = compare.write_comparison(before, after, str(tmp_path / "c"), ("old", "new"))
    assert json.loads((tmp_path / "c" / "summary.json").read_text()) == summary and summary["delta"]["structure_count"] == 0
    lines = (tmp_path / "c" / "summary.csv").read_text().splitlines()
    assert lines[0].startswith("label,samples,structure_count") and [x.split(",")[0] for x in lines[1:]] == ["old", "new", "delta"] and lines[3].split(",")[1] == ""
    assert (tmp_path / "c" / "structure_transitions.csv").read_text() == "transition,count\ncorrect -> correct,1\ncorrect -> incorrect,1\nincorrect -> correct,1\n"
    assert [r.sample_id for r in spark.read.option("header", True).csv(str(tmp_path / "c" / "samples.csv")).orderBy("sample_id").collect()] == ["improves", "regresses", "ties"]
    with pytest.raises(compare.SampleKeyError):
        compare.write_comparison(before, after.unionByName(after), str(tmp_path / "d"))


def test_examples(spark):
    make = lambda scores: spark.createDataFrame([(k, v) for k, v in scores.items()], "sample_id string, weighted_score double")
    base, other = make({"a": 0.1, "b": 0.1, "c": 1.0, "d": 0.2}), make({"a": 0.6, "b": 0.6, "c": 1.0, "d": 0.1})
    found = {r.example: r.sample_id for r in classify.pick_examples(base, other).collect()}
    assert found == {"improved": "a", "both_fail": "d", "both_success": "c"}
    fallback = {r.example: r.sample_id for r in classify.pick_examples(make({"a": 0.5, "b": 1.0}), make({"a": 1.0, "b": 0.9})).collect()}
    assert fallback == {"improved": "a", "both_fail": "a", "both_success": "b"}


def test_ranks_and_shapes(spark):
    values = [5, 1, 9, 3, 3, 260]
    row = evaluate.nearest_ranks(spark.createDataFrame([(v,) for v in values], "z long"), "z").first()
    s = sorted(values)
    assert (row.least, row.middle, row.tenth, row.greatest, row.high) == (s[0], s[len(s) // 2], s[int(0.9 * len(s))], s[-1], 1)


def test_report():
    summary = lambda label, w: {"label": label, "weighted_score": w, "character_accuracy": 0.5, "cell_accuracy": 0.25, "by_error_type": {"truncation": 2}}
    text = files.report("Run", summary("base", 0.5), summary("new", 0.75), [{"example": "improved", "sample_id": "x", "base_score": 0.1, "other_score": 0.9, "target_csv": "y" * 501}])
    assert "| new | 0.7500 | 0.5000 | 0.2500 | 2 | 0 | 0 |" in text and "less that of base: +0.2500" in text and "y" * 500 + "\n..." in text
