"""Outputs by bucket of correctness, examples for reports, histograms of deltas."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gridmark.sources import files

#: The four buckets, one of which can't occur but is listed.
BUCKETS = ("structure_correct__cell_correct", "structure_correct__cell_error", "structure_error__cell_correct", "structure_error__cell_error")


def classify(metrics: DataFrame) -> DataFrame:
    """structure_metrics with their bucket."""
    cell = F.col("structure_correct") & (F.col("correct_cells") == F.col("total_cells"))
    mark = lambda ok, name: F.when(ok, f"{name}_correct").otherwise(f"{name}_error")
    return metrics.withColumn("bucket", F.concat_ws("__", mark(F.col("structure_correct"), "structure"), mark(cell, "cell")))


def bucket_counts(classified: DataFrame) -> DataFrame:
    """bucket, n for all four, 0 where none is."""
    spark: SparkSession = classified.sparkSession
    names = spark.range(1).select(F.explode(F.array(*[F.lit(b) for b in BUCKETS])).alias("bucket"))
    return names.join(classified.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def write_buckets(classified: DataFrame, text: str, folder: str, name: str = "stem") -> int:
    """The raw text of each sample as ``folder/bucket/name.txt``; all four folders are there. How many files were written."""
    files.make_folders(classified.sparkSession, *[f"{folder}/{bucket}" for bucket in BUCKETS])
    return files.write_each(classified, F.concat_ws("/", "bucket", name), text, folder)


def write_summary(classified: DataFrame, folder: str) -> dict:
    """``summary.json`` (samples, and the count of every bucket) and ``samples.jsonl`` with a line for each sample."""
    counts = {r.bucket: r.n for r in bucket_counts(classified).collect()}  # four rows
    summary = {"sample_count": sum(counts.values()), "folder_counts": {b: counts[b] for b in BUCKETS}}
    files.write_text(classified.sparkSession, json.dumps(summary, ensure_ascii=False, indent=2) + "\n", f"{folder}/summary.json")
    files.write_jsonl(classified, f"{folder}/samples.jsonl")
    return summary


def last_of_each(scored: DataFrame, key: str = "sample_id", order: str = "pos") -> DataFrame:
    """Of rows that repeat a key, the last."""
    return scored.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("__r = 1").drop("__r")


def pick_examples(base: DataFrame, other: DataFrame) -> DataFrame:
    """example, sample_id, base_score, other_score: most improved, worst of those that fail twice, first that succeeds twice.

    Ties go to the smaller id. Without such a sample: the most improved one, and the best on average.
    """
    both = base.select("sample_id", F.col("weighted_score").alias("base_score")).join(other.select("sample_id", F.col("weighted_score").alias("other_score")), "sample_id")
    delta, mean = F.col("other_score") - F.col("base_score"), (F.col("base_score") + F.col("other_score")) / 2
    failed, passed = (F.col("base_score") < 1) & (F.col("other_score") < 1), (F.col("base_score") == 1) & (F.col("other_score") == 1)
    row = F.struct("sample_id", "base_score", "other_score")

    def first(order, only=None):  # least of (order, id): combined before the shuffle
        value = F.struct(order.alias("o"), F.col("sample_id").alias("id"), row.alias("row"))
        return F.min(value if only is None else F.when(only, value))["row"]

    picked = both.agg(first(-delta).alias("improved"), first(mean, failed).alias("fail"), first(F.lit(0.0), passed).alias("success"), first(-mean).alias("best"))
    named = picked.select(F.explode(F.create_map(F.lit("improved"), F.col("improved"), F.lit("both_fail"), F.coalesce("fail", "improved"), F.lit("both_success"), F.coalesce("success", "best"))).alias("example", "row"))
    return named.select("example", "row.*").filter("sample_id IS NOT NULL")


def delta_histogram(compared: DataFrame, value: str = "cell_delta", bins: int = 11) -> DataFrame:
    """bin (from 1), n: equal bins from the least to the greatest value, the last one closed; bins without values are left out."""
    ends = compared.agg(F.min(value).alias("low"), F.max(value).alias("high"))
    width = F.col("high") - F.col("low")
    place = F.when(width == 0, bins // 2 + 1).otherwise(F.least(F.floor((F.col(value) - F.col("low")) / F.when(width != 0, width) * bins) + 1, F.lit(bins)))
    return compared.crossJoin(F.broadcast(ends)).select(place.cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))  # ends has one row
