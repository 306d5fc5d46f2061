"""Manifests: fine-tuning records, target backfill and refresh, assembly from parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridmark.functions.grid import latex_text, normalized, with_csv_grid
from gridmark.operators.runs import FORMAT_PROMPT


def _required(name: str):
    return F.when(F.col(name).isNotNull(), F.col(name)).otherwise(F.raise_error(F.lit(f"Missing field {name}")))


def with_latex_target(frame: DataFrame, text: str, out: str) -> DataFrame:
    """frame with the LaTeX form of its cleaned CSV text."""
    return with_csv_grid(frame, text, "__grid").withColumn(out, latex_text(normalized("__grid"))).drop("__grid")


def fine_tune_records(manifest: DataFrame, prompt: str, response: str = "target_csv") -> DataFrame:
    return manifest.select(F.lit("<image>" + prompt).alias("query"), _required(response).alias("response"), F.array("image_path").alias("images"), "sample_id")


def backfill(manifest: DataFrame) -> DataFrame:
    """manifest with target_got_format where only target_csv was there; updated tells which rows."""
    if "target_got_format" not in manifest.columns:
        manifest = manifest.withColumn("target_got_format", F.lit(None).cast("string"))
    updated = F.col("target_csv").isNotNull() & F.col("target_got_format").isNull()
    rows = with_latex_target(manifest.withColumn("updated", updated), "target_csv", "__made")
    return rows.withColumn("target_got_format", F.when(F.col("updated"), F.col("__made")).otherwise(F.col("target_got_format"))).drop("__made")


def to_latex_responses(records: DataFrame, prompt: str = FORMAT_PROMPT) -> DataFrame:
    """Fine-tuning records asked for LaTeX instead of CSV."""
    rows = with_latex_target(records.withColumn("response", _required("response")), "response", "__made")
    return rows.withColumns({"query": F.lit("<image>" + prompt), "response": F.col("__made")}).drop("__made")


def refresh_targets(predictions: DataFrame, manifest: DataFrame, columns: tuple[str, ...] = ("target_csv", "target_got_format")) -> DataFrame:
    """predictions with the manifest's targets; an id that it lacks is an error."""
    fresh = manifest.select("sample_id", F.lit(True).alias("__there"), *columns)
    rows = predictions.drop(*columns).join(fresh, "sample_id", "left")
    there = F.when(F.col("__there"), F.col("sample_id")).otherwise(F.raise_error(F.concat(F.lit("Not in the manifest: "), F.col("sample_id"))))
    return rows.withColumn("sample_id", there).drop("__there")


def real_manifest(resolved: DataFrame, csvs: DataFrame, images: DataFrame, texts: DataFrame) -> DataFrame:
    """The records of a test set of real pages, in need of review or not.

    texts: csv_pos, csv_text, csv_encoding. Targets are cleaned tables as CSV and as LaTeX.
    """
    from gridmark.functions.grid import csv_text

    rows = resolved.join(csvs, "csv_pos").join(images.select("image_pos", "image_path", "title_text"), "image_pos").join(texts, "csv_pos")
    rows = with_csv_grid(rows, "csv_text", "__g").withColumn("__g", normalized("__g"))
    rows = rows.withColumns({"target_csv": csv_text("__g"), "target_got_format": latex_text("__g"), "split": F.lit("test"), "source": F.lit("real"), "match_score": F.col("score")})
    return rows.select("sample_id", "station_name", "river", "year", "csv_path", "csv_encoding", "image_path", "title_text", "target_csv", "target_got_format", "match_score", "match_status", "split", "source")


def rebuilt_manifest(indexes: DataFrame, layouts: DataFrame, key: str = "sample_id") -> DataFrame:
    """indexes with what their layout documents hold; a missing one is an error, missing perturbations are none."""
    rows = indexes.join(layouts.withColumn("__there", F.lit(True)), key, "left")
    there = F.when(F.col("__there"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("No layout document for "), F.col(key))))
    return rows.withColumns({key: there, "perturbations": F.coalesce("perturbations", F.array().cast("array<struct<type:string,strength:double>>"))}).drop("__there")
