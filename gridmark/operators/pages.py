"""Results of page extraction: skipping what is done, totals, failures. Image work itself is a hook."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gridmark.functions import layout as L

#: Reasons that count as failures of a title.
TITLE_REASONS = ("expected_keyword_missing", "empty_title_roi", "title_ocr_runtime_error")


def todo(assets: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    return assets.join(existing.select(key).distinct(), key, "left_anti")


def page_totals(pages: DataFrame) -> DataFrame:
    """pdf_path, pages, ok_pages, tables, titles, per document; pages that were skipped or failed add no tables."""
    ok = F.col("status") == "ok"
    total = lambda c: F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0)).alias(c)
    return pages.groupBy("pdf_path").agg(F.count(F.lit(1)).alias("pages"), F.count_if(ok).alias("ok_pages"), total("table_count"), total("title_ocr_success_count"))


def placed_tables(detections: DataFrame, above: int, below: int) -> tuple[DataFrame, DataFrame]:
    """Tables with their boxes and title regions, and failures: boxes of which nothing is on the page, empty regions.

    detections: pdf_path, page_image_path, table_index, box (array<double>), width, height. A table whose title
    region is empty is among both.
    """
    rows = detections.withColumn("b", L.clamped_box("box", "width", "height"))
    keys = ("pdf_path", "page_image_path", "table_index")
    good = rows.filter("b.valid").withColumn("title", L.title_region(F.col("b"), "height", above, below))
    failed = rows.filter("NOT b.valid").select(*keys, F.lit("invalid_original_box").alias("reason"))
    failed = failed.unionByName(good.filter("title.empty").select(*keys, F.lit("empty_title_roi").alias("reason")))
    buffered = F.struct(F.col("b.x1").alias("x1"), F.greatest(F.lit(0), F.col("b.y1") - above).alias("y1"), F.col("b.x2").alias("x2"), F.col("b.y2").alias("y2"))
    return good.withColumn("buffered", buffered), failed


def failure_counts(failures: DataFrame) -> DataFrame:
    return failures.agg(F.count(F.lit(1)).alias("failures"), F.count_if(F.col("reason").isin(*TITLE_REASONS)).alias("title_failures"))


def crop_summary(records: DataFrame) -> DataFrame:
    return records.agg(F.count(F.lit(1)).alias("input"), F.count_if(F.col("cut").isNotNull()).alias("cropped"), F.count_if(F.col("cut").isNull()).alias("failed"))


def page_ids(frame: DataFrame, count: str, *keys: str, limit: int | None = None) -> DataFrame:
    """keys, page_number, page_name of each page, up to the limit."""
    pages = F.col(count) if limit is None else F.least(count, F.lit(limit))
    rows = frame.filter(F.col(count) > 0).select(*keys, F.explode(F.sequence(F.lit(1), pages)).alias("page_number"))
    return rows.withColumn("page_name", F.concat(F.lit("page_"), F.lpad(F.col("page_number").cast("string"), 4, "0")))


def extract(pages: DataFrame, work: Callable[[pd.Series], dict], schema: str, folder: str, done: DataFrame | None = None, *keys: str) -> DataFrame:
    """The driver of page work: pages that aren't done (by keys) go through work; failures go to ``folder/failures.jsonl``
    with their reasons, and ``folder/summary.json`` has the counts. What succeeded is returned.
    """
    from gridmark.sources import files

    left = pages if done is None else pages.join(done.select(*keys).distinct(), list(keys), "left_anti")
    files.write_jsonl(each_or_error(left, work, schema), f"{folder}/pages.jsonl")
    rows = files.read_jsonl(pages.sparkSession, f"{folder}/pages.jsonl", each_or_error(left.limit(0), work, schema).schema)
    failed = rows.filter("error IS NOT NULL").select(*[k for k in keys if k in rows.columns], F.col("error").alias("reason"))
    files.write_jsonl(failed, f"{folder}/failures.jsonl")
    files.write_json(rows.agg(F.count(F.lit(1)).alias("input"), F.count_if(F.col("error").isNull()).alias("done"), F.count_if(F.col("error").isNotNull()).alias("failed")), f"{folder}/summary.json")
    return rows.filter("error IS NULL").drop("error")


def each_or_error(frame: DataFrame, work: Callable[[pd.Series], dict], schema: str) -> DataFrame:
    """work on each row of frame; a row whose work raises has its message in ``error``, and the others go on.

    A hook for models and image work on whole pages, whose own time is large: the only place that goes row by row.

    schema: the fields that work returns.
    """
    import pyspark.sql.types as T

    names = T._parse_datatype_string(schema).fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for _, row in batch.iterrows():
                try:
                    made.append(dict(work(row)) | {"error": None})
                except Exception as error:  # noqa: BLE001
                    made.append({"error": f"{type(error).__name__}: {error}"})
            yield pd.concat([batch.reset_index(drop=True), pd.DataFrame(made, columns=[*names, "error"])], axis=1)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)
    return frame.mapInPandas(run, f"{fields}, {schema}, error string")
