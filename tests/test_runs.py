import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridmark.operators import compare, manifest, pages, runs, synth
from gridmark.operators.numbering import numbered


def records(spark, *pairs, columns=("sample_id", "prediction")):
    return spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "pos long, " + ", ".join(f"{c} string" for c in columns))


def ordered(frame):
    return [(r.sample_id, r.prediction) for r in frame.orderBy("pos").collect()]


def test_upsert_and_pending(spark):
    old = records(spark, ("a", "old-a"), ("b", "old-b"))
    assert ordered(runs.upsert(old, records(spark, ("a", "new-a")))) == [("a", "new-a"), ("b", "old-b")]
    assert ordered(runs.upsert(old.filter("pos = 0"), records(spark, ("b", "new-b")))) == [("a", "old-a"), ("b", "new-b")]
    assert ordered(runs.upsert(old.limit(0), records(spark, ("b", "1"), ("b", "2")))) == [("b", "1"), ("b", "2")]
    again = records(spark, ("a", "1"), ("b", "2"), ("a", "3"))
    assert ordered(runs.upsert(again, records(spark, ("c", "x")))) == [("a", "3"), ("b", "2"), ("c", "x")]
    rows = records(spark, ("a", ""), ("c", ""))
    assert [r.sample_id for r in runs.pending(rows, old).collect()] == ["c"] and runs.pending(rows, old, overwrite=True).count() == 2 and runs.pending(rows, None).count() == 2


def test_merge_shards(spark):
    merged = runs.merge_shards(records(spark, ("b", "2")), records(spark, ("a", "1")))
    assert [r.sample_id for r in merged.collect()] == ["a", "b"]
    with pytest.raises(compare.SampleKeyError):
        runs.merge_shards(records(spark, ("b", "2")), records(spark, ("b", "1")))


def test_shards(spark):
    rows = spark.range(0, 1000, 7).select((F.col("id") * 3).alias("pos")).repartition(5)
    values = [3 * k for k in range(0, 1000, 7)][:50]
    for shard in range(3):
        found = runs.shard_rows(rows, 3, shard, limit=50).orderBy("index").collect()
        assert [r.pos for r in found] == values[shard::3] and [r["index"] for r in found] == list(range(1, len(found) + 1))
    for bad in ((3, 3), (0, 0), (2, -1)):
        with pytest.raises(ValueError):
            runs.shard_rows(rows, *bad)
    with pytest.raises(ValueError):
        runs.check_shard(1, None)


def test_numbered_does_not_depend_on_partitions(spark):
    values = [random.Random(1).randint(0, 50) for _ in range(500)]
    frame = spark.createDataFrame(list(enumerate(values)), "i long, v long")
    expected = {i: n for n, (v, i) in enumerate(sorted((v, i) for i, v in enumerate(values)))}
    for n in (1, 7):
        assert {r.i: r.n for r in numbered(frame.repartition(n), "v", "n", "i").collect()} == expected
    assert numbered(frame.limit(0), "v", "n").count() == 0


def test_prompts(spark):
    turns = spark.createDataFrame([([("user", "hi"), ("bot", None)],)], "t array<struct<role:string,text:string>>")
    make = lambda style: turns.select(runs.prompt("t", style, "sys", "|", "&").alias("p")).first().p
    assert [make(s) for s in ("single", "two", "mpt")] == ["sys|\nuser: hi|bot:", "sys|user: hi|bot:", "sys|userhi|bot"]
    assert runs.image_prompt("q", "s").startswith("<|im_start|>system\ns<|im_end|><|im_start|>user\n<img><imgpad>") and runs.image_prompt("q").endswith("q<|im_end|><|im_start|>assistant\n")
    modes = spark.createDataFrame([("official_format", None), ("csv", None), ("csv", "own")], "m string, q string").select(runs.query_text("m", "q").alias("q")).collect()
    assert [m.q for m in modes] == [runs.FORMAT_PROMPT, runs.CSV_PROMPT, "own"]


def test_paths():
    assert runs.gpu_list("1, 2,3 , 7") == ["1", "2", "3", "7"] and runs.gpu_list(None) == []
    with pytest.raises(ValueError):
        runs.gpu_list(" , ")
    assert runs.eval_dir("out/run/checkpoint-45", "base") == "out/run/eval/checkpoint-45" and runs.eval_dir(None, "base") == "base/eval/checkpoint-0" and runs.eval_dir("out/run", "b") == "out/run/eval/checkpoint-0"
    assert runs.output_path("r", "local", limit=5, shard=0, shards=2) == "r/flow_real_first5_local.shard0of2.jsonl" and runs.output_path("r", "local", image="a/b.jpg") == "r/b_local.json"


def test_predict_loads_only_where_rows_are(spark):
    rows = records(spark, ("a", "x"), ("b", "y")).drop("prediction").repartition(6)

    def load():
        return lambda batch: pd.Series([f"{s}!" for s in batch["sample_id"]])

    assert sorted(r.prediction for r in runs.predict(rows, load).collect()) == ["a!", "b!"] and runs.predict(rows.limit(0), load).count() == 0
    made = runs.payload(runs.predict(rows.withColumns({"index": F.lit(1), "image_path": F.lit("p")}), load), "local", "csv", "q", "cpu", "f32")
    assert made.columns == ["index", "sample_id", "image_path", "prediction", "backend", "query_mode", "query", "device", "dtype"]


def test_manifests(spark):
    rows = spark.createDataFrame([("a", "日期,一月,\n1,2,\n.,,\n", None, "i"), ("b", "x", "kept", "j"), ("c", None, None, "k")], "sample_id string, target_csv string, target_got_format string, image_path string")
    filled = {r.sample_id: r for r in manifest.backfill(rows).collect()}
    assert filled["a"].target_got_format == "\\begin{tabular}{|c|c|}\n\\hline\n日期 & 一月 \\\\\n\\hline\n1 & 2 \\\\\n\\hline\n\\end{tabular}\n" and filled["a"].updated and not filled["b"].updated and filled["b"].target_got_format == "kept" and filled["c"].target_got_format is None
    records_ = manifest.fine_tune_records(rows.filter("sample_id <> 'c'"), "p")
    assert records_.first().asDict() == {"query": "<image>p", "response": "日期,一月,\n1,2,\n.,,\n", "images": ["i"], "sample_id": "a"}
    assert manifest.to_latex_responses(records_).first().query == "<image>OCR with format: "
    with pytest.raises(Exception, match="Missing field"):
        manifest.fine_tune_records(rows, "p").collect()
    assert manifest.refresh_targets(rows.limit(1), rows.withColumn("target_csv", F.lit("new"))).first().target_csv == "new"
    with pytest.raises(Exception, match="Not in the manifest"):
        manifest.refresh_targets(rows, rows.limit(1)).collect()


TEMPLATE = [["Day", *[str(m) for m in range(1, 13)]], *[[str(d), *["1"] * 12] for d in range(1, 32)], ["", " ", *[""] * 11]]


def pool_frame(spark, pools):
    return spark.createDataFrame([(m, k, x) for m, tokens in pools.items() for k, x in enumerate(tokens)], "month int, pos long, token string")


def plain_tables(n, seed, pools, only=None):
    """The same draws in plain Python: regime and cells by (day, month) of each table."""
    import hashlib

    out = {}
    for index in range(n):
        u = lambda name, *parts: int(hashlib.sha1(":".join(map(str, (name, seed + index, *parts))).encode()).hexdigest()[:12], 16) / 16**12  # noqa: B023, E731
        at = 100 * u("regime")
        name = only or ("normal" if at <= 45 else "zero_heavy" if at <= 70 else "zero_with_spikes" if at <= 85 else "calendar_tail_focus")
        some = lambda kind, low, high: set(sorted(range(12), key=lambda m: u(kind, m))[: low + int(u(f"{kind} count") * (high - low + 1))])  # noqa: B023, E731
        quiet = some("quiet", 6, 10) if name.startswith("zero") else set()
        wild = some("wild", 1, 3) if name == "zero_with_spikes" else set()
        for day in range(1, 32):
            for month in range(12):
                tokens, kind = pools.get(month, []), "pool"
                chance = u("cell", day, month)
                if day > synth.MONTH_DAYS[month] or name == "normal" and chance < 0.005:
                    kind = ""
                elif name == "zero_with_spikes" and u("spike", day, month) < (0.08 if month in quiet else 0.25 if month in wild else 0):
                    kind = "spike"
                    tokens = [x for x in tokens if float(x) >= 20] or tokens
                elif name != "normal" and chance < {"zero_heavy": 0.95 if month in quiet else 0.65, "zero_with_spikes": 1 if month in quiet else 0.55, "calendar_tail_focus": 0.65 if day >= 29 else 0.2}[name]:
                    kind = "0"
                value = kind if kind in ("", "0") else tokens[int(u("place", day, month) * len(tokens))] if tokens else "0"
                out[index, name, day, month] = value
    return out


def test_tables_by_seed(spark):
    pools = {m: [str(x) for x in (1.5, 25, 3, 7, 21.5)[: 1 + m % 5]] for m in range(10)} | {10: ["3"]}
    frame = pool_frame(spark, pools)
    made = {r["index"]: r for r in synth.generate(spark, 30, 5, TEMPLATE, frame).collect()}
    assert {(i, r.data_regime, d, m): r.grid[d][m + 1] for i, r in made.items() for d in range(1, 32) for m in range(12)} == plain_tables(30, 5, pools)
    assert all(r.grid[0] == TEMPLATE[0] and r.grid[32] == [""] * 13 and [x[0] for x in r.grid[1:32]] == [str(d) for d in range(1, 32)] for r in made.values())
    assert len({r.sample_id for r in made.values()}) == 30 and len({r.data_regime for r in made.values()}) == 4
    again = synth.generate(spark, 31, 5, TEMPLATE, frame.repartition(5)).filter("index = 17").first()
    assert again.grid == made[17].grid
    assert {r.data_regime for r in synth.generate(spark, 5, 5, TEMPLATE, frame, "flow_v0").collect()} == {"normal"}
    with pytest.raises(ValueError):
        synth.generate(spark, 1, 1, TEMPLATE, frame, regime_name="other")


def test_regimes_by_their_shape(spark):
    full = pool_frame(spark, {m: ["1.5", "25", "3"] for m in range(12)})
    heavy = synth.generate(spark, 1, 7, TEMPLATE, full, regime_name="zero_heavy").first().grid
    assert sum(c == "0" for row in heavy[1:32] for c in row[1:]) >= 230
    assert all(heavy[d][2] == "" for d in (29, 30, 31)) and all(heavy[31][m] == "" for m in (4, 6, 9, 11))
    tail = synth.generate(spark, 1, 7, TEMPLATE, full, regime_name="calendar_tail_focus").first().grid
    valid = [tail[d][m + 1] for d in (29, 30, 31) for m in range(12) if d <= synth.MONTH_DAYS[m]]
    assert all(valid) and "0" in valid


def test_splits(spark):
    split = synth.shuffled_split(10000, 0.2, 20260408)
    assert split.count("val") == 2000 and split == synth.shuffled_split(10000, 0.2, 20260408)
    rows = [r.split for r in synth.split_map(spark, 1000, 0.2, 3).collect()]
    assert rows.count("val") == 200 and len(rows) == 1000


def test_pools(spark):
    grid = [["D", "a", "b"], ["1", "5", "x"], ["", " ", ""], ["2", "7", "30"]]
    pools = synth.value_pools(spark.createDataFrame([("f2", grid), ("f1", [["D", "a"], ["1", "9"]])], "o string, g array<array<string>>"), "g", "o")
    assert {(r.month, r.pos): r.token for r in pools.collect()} == {(0, 0): "9", (0, 1): "5", (0, 2): "7", (1, 0): "30"}
    assert {(r.month, r.token) for r in synth.spike_pools(pools).collect()} == {(0, "9"), (0, "5"), (0, "7"), (1, "30")}


def test_geometry(spark):
    lines = spark.range(1).select(synth.grid_lines(F.lit(4), F.lit(3), 10, 20, 50, 30, 15).alias("l")).first().l
    assert [tuple(x) for x in lines] == [(10, 20, 160, 20), (10, 50, 160, 50), *[(x, 20, x, 95) for x in (10, 60, 110, 160)]]
    frame = spark.createDataFrame([("s", [["a", "b", "c"]] * 4)], "k string, g array<array<string>>")
    cells = synth.layout_cells(frame, "g", "k").filter("col_index = 0").orderBy("row_index").collect()
    assert [(c.x0, c.y0, c.x1, c.y1) for c in cells[:2]] == [(60, 35, 740, 105), (60, 105, 740, 130)] and len(cells) == 4


def test_perturbation_counts():
    counts = [len(synth.perturbations(random.Random(k))) for k in range(2000)]
    assert abs(counts.count(0) / 2000 - 0.10) < 0.03 and abs(counts.count(1) / 2000 - 0.45) < 0.04 and max(counts) == 4


def test_pages(spark):
    rows = spark.createDataFrame([("a", 3), ("b", 0)], "p string, n int")
    assert [r.page_name for r in pages.page_ids(rows, "n", "p", limit=2).collect()] == ["page_0001", "page_0002"]

    def work(row):
        if row["n"] == 0:
            raise ValueError("empty")
        return {"twice": row["n"] * 2}

    done = {r.p: (r.twice, r.error) for r in pages.each_or_error(rows, work, "twice int").collect()}
    assert done == {"a": (6, None), "b": (None, "ValueError: empty")}
