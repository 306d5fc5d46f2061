"""Structured Streaming over a folder of prediction files: scores append, and a sample is scored once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from gridmark.operators.evaluate import score_samples

PREDICTIONS = "sample_id string, image_path string, prediction string, target_csv string, arrived timestamp"


def arriving(spark: SparkSession, folder: str, schema: str = PREDICTIONS, per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(folder)


def score_stream(predictions: DataFrame, out: str, checkpoint: str, late: str = "1 day") -> StreamingQuery:
    """Scores to Parquet in out. Within the bound on lateness a repeated sample_id is dropped; state doesn't grow beyond it."""
    once = predictions.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["sample_id"])

    def add(batch: DataFrame, epoch: int) -> None:
        score_samples(batch).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")  # an epoch that is run again replaces itself

    return once.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(add).trigger(availableNow=True).start()
