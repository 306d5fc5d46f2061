"""Two runs over the same samples, side by side."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F

from gridmark.functions.grid import cell_count, same_shape
from gridmark.functions.metrics import char_accuracy, matching_cells
from gridmark.operators.evaluate import parsed
from gridmark.sources import files


class SampleKeyError(ValueError):
    """Keys that are repeated or missing."""


def duplicate_ids(frame: DataFrame, key: str = "sample_id") -> DataFrame:
    return frame.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def require_unique(frame: DataFrame, key: str = "sample_id") -> DataFrame:
    """frame, after one job that fails if an id is repeated; the message names ten of them at most."""
    found = [r[0] for r in duplicate_ids(frame, key).orderBy(key).limit(10).collect()]
    if found:
        raise SampleKeyError(f"duplicate {key}: {found}")
    return frame


def id_parity(before: DataFrame, after: DataFrame, key: str = "sample_id") -> DataFrame:
    """key, side: ids that only one run has."""
    left, right = before.select(key).distinct(), after.select(key).distinct()
    only = lambda a, b, side: a.join(b, key, "left_anti").withColumn("side", F.lit(side))
    return only(left, right, "before").unionByName(only(right, left, "after"))


def require_parity(before: DataFrame, after: DataFrame, key: str = "sample_id") -> None:
    rows = id_parity(before, after, key)
    missing = {side: [r[0] for r in rows.filter(F.col("side") == side).orderBy(key).limit(10).collect()] for side in ("before", "after")}
    if any(missing.values()):
        raise SampleKeyError(f"sample sets differ; only before: {missing['before']}; only after: {missing['after']}")


def structure_metrics(predictions: DataFrame) -> DataFrame:
    """sample_id, image_path, structure_correct, cell_accuracy, correct_cells, total_cells, label.

    Cells count as correct only in a grid of the target's shape.
    """
    rows = parsed(predictions)
    right = F.coalesce(same_shape("p", "t"), F.lit(False))
    rows = rows.withColumns({"structure_correct": right, "total_cells": cell_count("t").cast("long"), "correct_cells": F.when(right, matching_cells(F.col("p"), F.col("t"))).otherwise(0).cast("long")})
    path = F.col("image_path") if "image_path" in predictions.columns else F.lit("")
    accuracy = F.when(F.col("structure_correct"), F.col("correct_cells") / F.greatest("total_cells", F.lit(1))).otherwise(0.0)
    return rows.select("sample_id", path.alias("image_path"), "structure_correct", accuracy.alias("cell_accuracy"), "correct_cells", "total_cells", F.when(F.col("structure_correct"), "correct").otherwise("incorrect").alias("label"))


def compare_samples(before: DataFrame, after: DataFrame) -> DataFrame:
    """A row per sample of two frames of structure_metrics."""
    b, a = before.alias("b"), after.alias("a")
    both = b.join(a, "sample_id")
    return both.select(
        "sample_id",
        F.coalesce(F.nullif(F.col("b.image_path"), F.lit("")), F.col("a.image_path")).alias("image_path"),
        F.col("b.structure_correct").alias("before_structure"),
        F.col("a.structure_correct").alias("after_structure"),
        F.concat_ws(" -> ", "b.label", "a.label").alias("transition"),
        F.col("b.cell_accuracy").alias("before_cell"),
        F.col("a.cell_accuracy").alias("after_cell"),
        (F.col("a.cell_accuracy") - F.col("b.cell_accuracy")).alias("cell_delta"),
        (F.col("a.correct_cells") - F.col("b.correct_cells")).alias("correct_delta"),
        F.col("b.total_cells").alias("total_cells"),
    )


def run_summary(metrics: DataFrame) -> DataFrame:
    """One row: shares over all cells and all samples."""
    n, right = F.count(F.lit(1)), F.coalesce(F.count_if("structure_correct"), F.lit(0))
    cells, correct = F.coalesce(F.sum("total_cells"), F.lit(0)), F.coalesce(F.sum("correct_cells"), F.lit(0))
    return metrics.agg(n.alias("samples"), right.alias("structure_count"), (right / F.greatest(n, F.lit(1))).alias("structure_accuracy"), correct.alias("correct_cells"), cells.alias("total_cells"), (correct / F.greatest(cells, F.lit(1))).alias("cell_accuracy"))


def summary_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: after less before of two run_summary rows."""
    names = ("structure_count", "structure_accuracy", "correct_cells", "cell_accuracy")
    b = before.select(*[F.col(n).alias(f"b_{n}") for n in names])
    return b.crossJoin(F.broadcast(after)).select(*[(F.col(n) - F.col(f"b_{n}")).alias(n) for n in names])  # two rows of one


def transitions(compared: DataFrame) -> DataFrame:
    return compared.groupBy("transition").agg(F.count(F.lit(1)).alias("n"))


def write_comparison(before: DataFrame, after: DataFrame, folder: str, labels: tuple[str, str] = ("before", "after")) -> dict:
    """A comparison of two runs' structure_metrics as files: ``summary.json``, ``summary.csv`` (both runs and the delta),
    ``structure_transitions.csv``, and ``samples.csv``, a folder with a line for each sample. The summary is returned.
    """
    spark = before.sparkSession
    require_parity(require_unique(before), require_unique(after))
    rows = compare_samples(before, after).cache()
    runs = {label: run_summary(frame).first().asDict() for label, frame in zip(labels, (before, after), strict=True)}
    first, second = runs.values()
    delta = {k: second[k] - first[k] for k in first if k not in ("samples", "total_cells")}
    moved = {r.transition: r.n for r in transitions(rows).orderBy("transition").collect()}  # four at most
    summary = {"runs": [{"label": k, **v} for k, v in runs.items()], "delta": delta, "structure_transitions": [{"transition": k, "count": n} for k, n in moved.items()]}
    files.write_text(spark, json.dumps(summary, ensure_ascii=False, indent=2) + "\n", f"{folder}/summary.json")
    lines = [{"label": k, **v} for k, v in (*runs.items(), ("delta", delta))]
    files.write_text(spark, files.csv_lines(["label", *first], lines), f"{folder}/summary.csv")
    files.write_text(spark, files.csv_lines(["transition", "count"], summary["structure_transitions"]), f"{folder}/structure_transitions.csv")
    files.write_csv(rows.orderBy("sample_id"), f"{folder}/samples.csv", *rows.columns)
    rows.unpersist()
    return summary


def text_accuracy(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.withColumn("character_accuracy", char_accuracy(a, b))
