"""Queries of files, jobs and hooks: what is written is read again, and its rows are the result."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridmark import jobs
from gridmark.functions import grid as G
from gridmark.functions import layout as L
from gridmark.functions import text as T
from gridmark.operators import manifest, pages, runs
from gridmark.plans import adapters as A
from gridmark.plans.queries import query
from gridmark.sources import files


def folder(spark: SparkSession) -> str:
    """A folder of its own in the one that the cluster names in spark.checkpoint.dir; a temporary one only on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="gridmark-")
    made = f"{base}/files-{uuid.uuid4().hex}"

    def forget() -> None:
        try:
            files.remove(spark, made)
        except Exception:  # the session has ended: whoever owns the folder clears it
            return

    atexit.register(forget)
    return made


def _suppliers(spark, d) -> DataFrame:
    return A.table(spark, d, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").cast("int").alias("s_nationkey"))


@query
def jsonl_lines(spark, d):
    """Written, appended to and read again; blank lines are skipped."""
    at, s = folder(spark), _suppliers(spark, d)
    files.write_jsonl(s.filter("s_suppkey % 2 = 0"), f"{at}/x")
    files.write_jsonl(s.filter("s_suppkey % 2 = 1"), f"{at}/x", append=True)
    files.write_text(spark, "\n \n", f"{at}/x/blank.json")
    return files.read_jsonl(spark, f"{at}/x", "s_suppkey long, s_name string, s_nationkey int")


@query
def json_documents(spark, d):
    """One summary as a document, read again."""
    at = folder(spark)
    files.write_json(_suppliers(spark, d).agg(F.count(F.lit(1)).alias("n"), F.max("s_name").alias("last"), F.lit(None).cast("string").alias("none")), f"{at}/a.json")
    return files.read_json(spark, f"{at}/a.json", "n long, last string, none string").select("n", "last", F.col("none").isNull().alias("is_null"))


@query
def csv_sink(spark, d):
    """Fields in the order given, nulls as empty: the lines as they are in the files."""
    at = folder(spark)
    s = _suppliers(spark, d).withColumn("odd", F.when(F.col("s_suppkey") % 3 == 0, "x"))
    files.write_csv(s, f"{at}/c", "s_name", "odd", "s_suppkey")
    return spark.read.text(f"{at}/c").filter("value <> 's_name,odd,s_suppkey'").select(F.col("value").alias("line"))


@query
def csv_folder(spark, d):
    """A file for each table, found again by its pattern in the order of paths; the first one's shape is the template's."""
    at, grids = folder(spark), A.grids(spark, d)
    files.write_each(grids, "name", G.csv_text("g"), f"{at}/in")
    files.write_text(spark, "no", f"{at}/in/other.md")
    first = files.first_text(spark, f"{at}/in", "*.txt").select(F.col("stem").alias("first"))
    return files.texts(spark, f"{at}/in", "*.txt").crossJoin(F.broadcast(first)).select("stem", F.md5("text").alias("digest"), "encoding", (F.col("stem") == F.col("first")).alias("is_first"))  # one row


@query
def image_folder(spark, d):
    """Binary files of a pattern: stem and size."""
    at = folder(spark)
    files.write_each(_suppliers(spark, d).withColumn("name", F.concat("s_name", F.lit(".jpg"))), "name", "s_name", f"{at}/in", "tex")
    return files.files(spark, f"{at}/in", "*.jpg.tex").select(F.regexp_replace("stem", r"\.jpg$", "").alias("stem"), F.length("content").alias("size"))


@query
def raw_outputs(spark, d):
    """Predictions with the raw output that a file of their image's stem holds."""
    at, p = folder(spark), A.predictions(spark, d).withColumn("stem", files.stem("image_path"))
    files.write_each(p, "stem", "prediction", f"{at}/raw")
    found = files.with_raw_output(p.select("sample_id", "stem"), files.texts(spark, f"{at}/raw", "*.txt").select("stem", "text"))
    return found.select("sample_id", F.md5("raw_text").alias("digest"), F.regexp_replace(files.raw_path("raw/", "stem"), "^raw/", "").alias("file"))


@query
def latex_exports(spark, d):
    """A file for each image, tables with rules on lines of their own."""
    at, p = folder(spark), A.predictions(spark, d)
    files.write_each(p, "sample_id", T.pretty_latex("prediction"), runs.per_image_dir(f"{at}/out.jsonl", "latex"), "tex")
    return files.texts(spark, f"{at}/per_image_latex", "*.tex").select(F.col("stem").alias("sample_id"), F.md5("text").alias("digest"))


def _predictions(spark, d, at: str, name: str, *spoilt: int) -> str:
    files.write_jsonl(A.predictions(spark, d, *spoilt), f"{at}/{name}")
    return f"{at}/{name}"


@query
def score_job(spark, d):
    at = folder(spark)
    found = jobs.score(spark, _predictions(spark, d, at, "p"), f"{at}/score.json")
    read = files.read_json(spark, f"{at}/score.json")
    return read.select("samples", F.round("weighted_score", 6).alias("weighted_score"), F.round("cell_accuracy", 6).alias("cell_accuracy"), F.lit(len(found["by_error_type"])).alias("error_types"))


@query
def compare_job(spark, d):
    """The lines of the comparison's files for samples."""
    at = folder(spark)
    jobs.compare_runs(spark, _predictions(spark, d, at, "b", 17, 3), _predictions(spark, d, at, "a"), ("old", "new"), f"{at}/out")
    rows = spark.read.option("header", True).csv(f"{at}/out/samples.csv")
    return rows.select("sample_id", "image_path", "transition", F.round(F.col("cell_delta").cast("double"), 6).alias("cell_delta"), F.col("total_cells").cast("long").alias("total_cells"))


@query
def compare_files(spark, d):
    """Transitions and the summary's lines of the same job."""
    at = folder(spark)
    jobs.compare_runs(spark, _predictions(spark, d, at, "b", 17, 3), _predictions(spark, d, at, "a"), ("old", "new"), f"{at}/out")
    moved = spark.read.option("header", True).csv(f"{at}/out/structure_transitions.csv").select(F.col("transition").alias("line"), F.col("count").cast("long").alias("n"))
    runs_of = spark.read.option("header", True).csv(f"{at}/out/summary.csv").select(F.col("label").alias("line"), F.col("structure_count").cast("long").alias("n"))
    return moved.unionByName(runs_of)


@query
def classify_job(spark, d):
    """Which bucket's folder holds each sample's raw output, and what the summary counts there."""
    at, p = folder(spark), A.predictions(spark, d)
    files.write_each(p.withColumn("stem", files.stem("image_path")), "stem", "prediction", f"{at}/raw")
    files.write_jsonl(p, f"{at}/p")
    counts = jobs.classify_outputs(spark, f"{at}/p", f"{at}/raw", f"{at}/out")["folder_counts"]
    n = F.create_map(*[x for k, v in counts.items() for x in (F.lit(k), F.lit(v).cast("long"))])
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(f"{at}/out")
    bucket = F.element_at(F.split("path", "/"), -2)
    return found.select(files.stem("path").alias("stem"), bucket.alias("bucket"), n[bucket].alias("n"), F.md5(F.col("content")).alias("digest"))


@query
def generate_job(spark, d):
    """Manifests of generated tables: counts by split, all with a layout; made again from the layouts alone, they are the same."""
    at = folder(spark)
    files.write_each(A.grids(spark, d), F.concat("name", F.lit(".csv")), G.csv_text("g"), f"{at}/tables")
    for name in [f.path for f in spark.read.format("binaryFile").load(f"{at}/tables").select("path").collect()]:
        files.replace(spark, name, name.removesuffix(".txt"))
    n = A.table(spark, d, "supplier").count()
    read = lambda: spark.read.json(f"{at}/out/manifests").select("sample_id", "split", F.md5("target_csv").alias("digest"))
    jobs.generate(spark, f"{at}/tables", f"{at}/out", n, 0.2, 7)
    first = read().cache()
    first.count()
    jobs.generate(spark, f"{at}/tables", f"{at}/out", n, 0.2, 7, manifest_only=True)
    same = first.join(read(), ["sample_id", "split", "digest"])
    return same.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sample_id").alias("ids"))


@query
def infer_job(spark, d):
    """Every third event predicted before, the others by a model that counts letters; resumed records keep their places."""
    at, r = folder(spark), A.runs(spark, d)
    rows = r.select("pos", "sample_id", F.col("prediction").alias("image_path"))
    old = r.filter("pos % 3 = 0").select("pos", "sample_id", F.lit("old").alias("prediction"))
    files.write_jsonl(old, f"{at}/out")
    facts = {"backend": "local", "mode": "csv", "query": "q", "device": "cpu", "dtype": "float32"}
    made = runs.infer(rows, f"{at}/out", lambda: lambda batch: batch["image_path"].str.len().astype(str), facts)
    return made.select("sample_id", "prediction", F.coalesce("backend", F.lit("none")).alias("backend"))


@query
def report_lines(spark, d):
    """The lines of a report over two runs, as written."""
    at, text = folder(spark), {"truncation": 1}
    n = A.table(spark, d, "supplier").count()
    base = {"label": "base", "weighted_score": 0.25, "character_accuracy": 0.5, "cell_accuracy": 0.125, "by_error_type": text}
    files.write_report(spark, f"{at}/r.md", "Report", base, base | {"label": "new", "weighted_score": 0.75}, [], {"suppliers": n})
    return spark.read.text(f"{at}/r.md").filter("value <> ''").select(F.col("value").alias("line"))


@query
def failure_log(spark, d):
    """Rows of unlike fields in one log: what a row lacks isn't written."""
    at, s = folder(spark), _suppliers(spark, d)
    log = s.select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("details"), F.when(F.col("s_suppkey") % 3 == 0, F.lit("invalid_box")).otherwise("empty_title_roi").alias("reason"))
    files.write_jsonl(log, f"{at}/failures")
    return spark.read.text(f"{at}/failures").select(F.col("value").alias("line"))


@query
def page_driver(spark, d):
    """Pages that aren't done go through the hook; a failing one is logged, and the rest goes on. Counts as in the summary."""
    at, s = folder(spark), _suppliers(spark, d)

    def work(row):
        if row["s_suppkey"] % 7 == 0:
            raise ValueError("no table")
        return {"tables": int(row["s_suppkey"]) % 4}

    good = pages.extract(s, work, "tables int", at, s.filter("s_suppkey % 5 = 0"), "s_suppkey")
    summary = spark.read.option("multiLine", True).json(f"{at}/summary.json").select("input", "done", "failed")
    reasons = spark.read.json(f"{at}/failures.jsonl").agg(F.max("reason").alias("reason"))
    return summary.crossJoin(reasons).crossJoin(good.agg(F.sum("tables").alias("tables")))  # one row each


@query
def stale_files(spark, d):
    """Files of a page that a pattern names go, but for those to keep."""
    at, s = folder(spark), _suppliers(spark, d)
    name = F.concat(F.lit("page_"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0"), F.lit("_t"), (F.col("s_suppkey") % 3).cast("string"))
    files.write_each(s.withColumn("name", name), "name", "s_name", f"{at}/in")
    files.remove_matching(spark, f"{at}/in/page_*_t1.txt", {"page_000001_t1.txt"})
    return files.files(spark, f"{at}/in", "*.txt").select("stem")


@query
def inference_payload(spark, d):
    r = A.runs(spark, d).withColumnRenamed("prediction", "target_csv").withColumn("image_path", F.lit("i"))
    rows = runs.shard_rows(r, 3).withColumns({"num_shards": F.lit(3), "prediction": F.upper("target_csv")})
    made = runs.payload(rows, "local", "csv", "q", "cpu", "float32")
    return made.select("sample_id", "index", "shard_id", "num_shards", "prediction", "target_csv", F.lit(",".join(made.columns)).alias("fields"))


@query
def single_image(spark, d):
    return runs.single_record(spark, "a/b.c.jpg")


@query
def output_paths(spark, d):
    """Names of folders and files of results, for each nation as a shard."""
    n = A.table(spark, d, "nation").count()
    rows = [(k, runs.eval_dir(f"m/checkpoint-{k}", "base"), runs.output_path("out", "local", limit=k or None, shard=k, shards=n), runs.output_path("out", "local", image=f"i/{k}.jpg"), runs.eval_dir(None, "base")) for k in range(n)]
    return spark.createDataFrame(rows, "k int, checkpoint string, shard string, image string, base string")


@query
def shard_arguments(spark, d):
    """Which pairs of shard and count are refused."""

    def refused(*x):
        try:
            runs.check_shard(*x)
        except ValueError:
            return True
        return False

    pairs = [(a, b) for a in (None, -1, 0, 1, 2, 3) for b in (None, 0, 1, 3)]
    return spark.createDataFrame([(a, b, refused(a, b)) for a, b in pairs], "shard int, shards int, refused boolean")


@query
def score_text(spark, d):
    return A.table(spark, d, "part").select("p_partkey", T.format_score(F.col("p_size") / 7).alias("score"))


@query
def ocr_tokens(spark, d):
    """An engine's lists of unequal length, as entries and then as tokens; blank texts go."""
    s = A.table(spark, d, "supplier").select("s_suppkey", F.col("s_suppkey").cast("int").alias("k"))
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    k = F.col("k")
    boxes = F.transform(F.sequence(F.lit(0), F.pmod(k, F.lit(4))), lambda i: F.array(point(k + i, i * 10), point(k + i + 5, i * 10 + 3), point(k + i - 2, i * 10 + 8)))
    texts = F.array(F.lit(" a "), F.when(k % 2 == 0, "").otherwise("b"), F.lit("c"))
    rows = s.select("s_suppkey", L.entries(boxes, texts, F.array(F.lit(0.5), F.lit(0.25), F.lit(1.0), F.lit(1.0))).alias("e"))
    found = rows.select("s_suppkey", F.size("e").alias("entries"), F.posexplode_outer(L.tokens("e", 100.0)).alias("at", "t"))
    return found.select("s_suppkey", "entries", F.coalesce("at", F.lit(-1)).alias("at"), "t.text", "t.left", "t.top", "t.right", "t.bottom")


@query
def real_manifest(spark, d):
    """Records of matched tables: names, cleaned targets and how the match was judged."""
    from gridmark.operators import align

    csvs, images = A.labels_and_titles(spark, d)
    named = csvs.withColumns({"sample_id": F.concat(F.lit("s"), F.col("csv_pos").cast("string")), "csv_path": F.lit("c")})
    pictures = images.withColumn("image_path", F.concat(F.lit("i"), F.col("image_pos").cast("string")))
    texts = csvs.select("csv_pos", F.concat(F.lit("h,x,.\n1,"), "csv_pos", F.lit(",\n,,.\n")).alias("csv_text"), F.lit("utf-8-sig").alias("csv_encoding"))
    made = manifest.real_manifest(align.resolve_matches(csvs, images), named, pictures, texts)
    return made.select("sample_id", "station_name", "year", "image_path", "target_csv", F.md5("target_got_format").alias("latex"), "match_score", "match_status", "split", "source", "csv_encoding")


@query
def manifest_again(spark, d):
    """Records from layout documents that are there: what is missing of them is none."""
    at, s = folder(spark), _suppliers(spark, d)
    kinds = "array<struct<type:string,strength:double>>"
    layouts = s.select("s_name", F.when(F.col("s_suppkey") % 2 == 0, F.array(F.struct(F.lit("blur").alias("type"), F.lit(0.5).alias("strength")))).alias("perturbations"))
    files.write_jsonl(layouts, f"{at}/layouts")
    made = manifest.rebuilt_manifest(s, files.read_jsonl(spark, f"{at}/layouts", f"s_name string, perturbations {kinds}"), "s_name")
    return made.select("s_suppkey", "s_name", F.size("perturbations").alias("n"), F.coalesce(F.get("perturbations", F.lit(0))["type"], F.lit("none")).alias("kind"))


@query
def predict_hook(spark, d):
    """Predictions of a model that the workers load: the length of each text."""
    p = A.table(spark, d, "part").select("p_partkey", "p_name")
    return runs.predict(p, lambda: lambda batch: batch["p_name"].str.len().astype(str)).select("p_partkey", "prediction")


@query
def page_errors(spark, d):
    """A hook that fails for some rows: their messages, and the others' results."""

    def work(row):
        return {"half": {0: 5}[int(row["p_size"]) % 2]}

    return pages.each_or_error(A.table(spark, d, "part").select("p_partkey", "p_size"), work, "half int").select("p_partkey", F.coalesce("half", F.lit(-1)).alias("half"), F.coalesce("error", F.lit("")).alias("error"))

