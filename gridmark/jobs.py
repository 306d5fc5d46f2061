"""Jobs for the command line: ``python -m gridmark.jobs score|compare|classify|generate ...``; functions for the same."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridmark.functions import grid as G
from gridmark.functions.text import safe_label
from gridmark.operators import classify, compare, evaluate, manifest, synth
from gridmark.sources import files

RECORD = "sample_id string, image_path string, prediction string, target_csv string"


def score(spark: SparkSession, predictions: str, output: str | None = None) -> dict:
    """The summary of a file of predictions; with output also that document, and ``output.samples`` with a line for each sample."""
    scored = evaluate.score_samples(files.read_jsonl(spark, predictions, RECORD)).cache()
    summary = evaluate.summarize(scored).first().asDict()
    summary["by_error_type"] = {r.error_type: r.n for r in evaluate.error_histogram(scored).orderBy("error_type").collect()}  # three at most
    if output:
        files.write_text(spark, json.dumps(summary, ensure_ascii=False, indent=2) + "\n", output)
        files.write_jsonl(scored, f"{output}.samples", order="sample_id")
    scored.unpersist()
    return summary


def compare_runs(spark: SparkSession, before: str, after: str, labels: tuple[str, str] = ("before", "after"), folder: str | None = None) -> dict:
    """The comparison of two files of predictions, written to a folder named by the labels where none is given."""
    if folder is None:
        names = spark.range(1).select(*[safe_label(F.lit(x)).alias(f"l{k}") for k, x in enumerate(labels)]).first()
        folder = f"outputs/model_comparisons/{names.l0}_vs_{names.l1}"
    runs = [compare.structure_metrics(files.read_jsonl(spark, p, RECORD)) for p in (before, after)]
    return compare.write_comparison(*runs, folder, labels) | {"folder": folder}


def classify_outputs(spark: SparkSession, predictions: str, raw: str, folder: str) -> dict:
    """Raw outputs (files ``stem of the image.txt`` in raw) in a folder for each bucket, with a summary; a missing one is an error."""
    classified = classify.classify(compare.structure_metrics(files.read_jsonl(spark, predictions, RECORD)))
    named = files.with_raw_output(classified.withColumn("stem", files.stem("image_path")), files.texts(spark, raw, "*.txt").select("stem", "text"))
    classify.write_buckets(named, "raw_text", folder)
    return classify.write_summary(named.drop("raw_text"), folder)


def generate(spark: SparkSession, tables: str, folder: str, n: int = 10000, share: float = 0.1, seed: int = 20260408, version: str = "flow_v0", manifest_only: bool = False) -> DataFrame:
    """Synthetic tables from a folder of CSV tables: ``folder/layouts`` with each table and its cells' boxes, and manifests
    ``folder/manifests/split=...``. manifest_only: manifests alone, from layouts that are there; a missing one is an error.

    Pictures of the tables are left to a renderer, which gets the layouts.
    """
    if n < 1:
        raise ValueError("there must be a table at least")
    if not 0 <= share <= 1:
        raise ValueError("the share must be between 0 and 1")
    splits = synth.split_map(spark, n, share, seed)
    place = f"{folder}/layouts"
    if not manifest_only:
        grids = G.with_csv_grid(files.texts(spark, tables), "text", "g").select("path", "g")
        template = G.with_csv_grid(files.first_text(spark, tables), "text", "g").first().g
        made = synth.generate(spark, n, seed, template, synth.value_pools(grids, "g", "path"), version)
        made = made.withColumn("grid", G.with_header("grid"))
        boxes = synth.layout_cells(made, "grid", "index").groupBy(F.col("index").alias("i")).agg(F.sort_array(F.collect_list(F.struct("row_index", "col_index", "text", "cell_type", "x0", "y0", "x1", "y1"))).alias("cells"))
        files.write_jsonl(made.join(boxes, F.col("index") == F.col("i")).drop("i"), place)
    layouts = files.read_jsonl(spark, place, f"index long, sample_id string, data_regime string, grid {G.GRID}")
    clean = G.normalized("grid")
    rows = layouts.select("index", F.col("sample_id").alias("made"), "data_regime", G.csv_text(clean).alias("target_csv"), G.latex_text(clean).alias("target_got_format"))
    wanted = splits.join(rows, "index", "left")
    known = F.when(F.col("made").isNotNull(), F.col("made")).otherwise(F.raise_error(F.concat(F.lit("No layout of table "), F.col("index").cast("string"))))
    records = wanted.select("index", known.alias("sample_id"), F.concat(F.lit(f"{folder}/images/"), "made", F.lit(".jpg")).alias("image_path"), "target_csv", "target_got_format", "data_regime", F.lit("synthetic").alias("source"), "split")
    files.remove(spark, f"{folder}/manifests")
    files.write_split(records, f"{folder}/manifests", "split")
    return records


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)
    one = jobs.add_parser("score")
    one.add_argument("--predictions", required=True)
    one.add_argument("--output")
    two = jobs.add_parser("compare")
    two.add_argument("--before", required=True)
    two.add_argument("--after", required=True)
    two.add_argument("--labels", nargs=2, default=("before", "after"))
    two.add_argument("--folder")
    three = jobs.add_parser("classify")
    for name in ("--predictions", "--raw", "--folder"):
        three.add_argument(name, required=True)
    four = jobs.add_parser("generate")
    for name in ("--tables", "--folder"):
        four.add_argument(name, required=True)
    four.add_argument("--n", type=int, default=10000)
    four.add_argument("--share", type=float, default=0.1)
    four.add_argument("--seed", type=int, default=20260408)
    four.add_argument("--version", default="flow_v0")
    four.add_argument("--manifest-only", action="store_true")
    given = vars(parser.parse_args(arguments))
    job = {"score": score, "compare": compare_runs, "classify": classify_outputs, "generate": generate}[given.pop("job")]
    if "before" in given:
        given["labels"] = tuple(given["labels"])
    found = job(SparkSession.builder.getOrCreate(), **given)
    print(json.dumps(found, ensure_ascii=False, indent=2) if isinstance(found, dict) else f"{found.count()} records")


if __name__ == "__main__":
    main()
