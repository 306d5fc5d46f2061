"""Scores of predictions against targets, per sample and over all."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridmark.functions.grid import latex_grid, with_csv_grid
from gridmark.functions.metrics import CELL_WEIGHT, CHAR_WEIGHT, SLICES, cell_accuracy, compared_text_accuracy, error_type, slice_scores


def parsed(predictions: DataFrame) -> DataFrame:
    """predictions (sample_id, prediction, target_csv, ...) with the grids p (null without one) and t."""
    return with_csv_grid(predictions, "target_csv", "t", strict=True).withColumn("p", latex_grid("prediction"))


def score_samples(predictions: DataFrame) -> DataFrame:
    """predictions with weighted_score, character_accuracy, cell_accuracy, error_type and a score per slice."""
    rows = parsed(predictions).withColumns({"character_accuracy": compared_text_accuracy("prediction", "target_csv", "p", "t"), "cell_accuracy": cell_accuracy("p", "t"), "error_type": error_type("p", "t")})
    slices = dict(zip(SLICES, slice_scores("p", "t"), strict=True))
    weighted = CHAR_WEIGHT * F.col("character_accuracy") + CELL_WEIGHT * F.col("cell_accuracy")
    return rows.withColumns({"weighted_score": weighted, **slices}).drop("p", "t")


def summarize(scored: DataFrame) -> DataFrame:
    """One row: means over samples, 0 without any."""
    names = ("weighted_score", "character_accuracy", "cell_accuracy", *SLICES)
    return scored.agg(F.count(F.lit(1)).alias("samples"), *[F.coalesce(F.avg(n), F.lit(0.0)).alias(n) for n in names])


def error_histogram(scored: DataFrame) -> DataFrame:
    return scored.groupBy("error_type").agg(F.count(F.lit(1)).alias("n"))


def table_shapes(grids: DataFrame, grid: str) -> DataFrame:
    """How many grids have so many rows and such a widest row."""
    wide = F.coalesce(F.array_max(F.transform(grid, F.size)), F.lit(0))
    return grids.select(F.size(grid).alias("n_rows"), wide.alias("n_cols")).groupBy("n_rows", "n_cols").agg(F.count(F.lit(1)).alias("n"))


def nearest_ranks(frame: DataFrame, value: str, high: int = 250) -> DataFrame:
    """least, middle, ninth tenth and greatest by upper nearest rank, and how many reach ``high``.

    Values are counted first, so what is ordered in one place is one row per distinct value.
    """
    counts = frame.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy(value))).withColumn("all", F.sum("n").over(Window.partitionBy()))
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col(value)))
    return upto.agg(F.min(value).alias("least"), at(F.floor(F.col("all") / 2)).alias("middle"), at((F.col("all") * F.lit(0.9)).cast("long")).alias("tenth"), F.max(value).alias("greatest"), F.coalesce(F.sum(F.when(F.col(value) >= high, F.col("n"))), F.lit(0)).alias("high"))
