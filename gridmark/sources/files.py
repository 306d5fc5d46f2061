"""Files in and out: JSON lines and documents, CSV, text of unknown encoding, images, reports."""

from __future__ import annotations

import csv
import io
import json
import posixpath
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Encodings in the order they are tried. Valid UTF-8 always counts as the first.
UTF8, CHINESE = "utf-8-sig", "gb18030"
CLIP = 500


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A row per line; blank lines are skipped, a broken one is an error."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def write_jsonl(frame: DataFrame, path: str, order: str | None = None, one_file: bool = False, append: bool = False) -> None:
    """A folder of JSON lines without null fields. one_file is for small results."""
    frame = frame if order is None else frame.orderBy(order)
    frame = frame.coalesce(1) if one_file else frame
    frame.write.mode("append" if append else "overwrite").option("ignoreNullFields", True).json(path)


def write_split(frame: DataFrame, path: str, *by: str) -> None:
    """JSON lines in a folder for each value of by, added to those there."""
    frame.write.partitionBy(*by).mode("append").json(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A row per document."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def _filesystem(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One small file, in whatever store the path names."""
    system, where = _filesystem(spark, path)
    out = system.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_json(frame: DataFrame, path: str, indent: int = 2) -> None:
    """The one row of frame as a document."""
    rows = frame.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a document is one row")
    write_text(frame.sparkSession, json.dumps(rows[0].asDict(recursive=True), ensure_ascii=False, indent=indent) + "\n", path)


def write_csv(frame: DataFrame, path: str, *fields: str) -> None:
    """Given fields in given order, nulls as empty."""
    text = [F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in fields]
    frame.select(*text).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def csv_lines(fields: list[str], rows: list[dict]) -> str:
    """CSV text of a few rows on the driver; what a row lacks is empty."""
    out = io.StringIO()
    writer = csv.DictWriter(out, fields, restval="", extrasaction="ignore", lineterminator="\n")
    writer.writeheader()
    writer.writerows(rows)
    return out.getvalue()


def stem(path: Column | str) -> Column:
    name = F.element_at(F.split(F.col(path) if isinstance(path, str) else path, "/"), -1)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """path, content, stem of the files of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content", stem("path").alias("stem"))


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("encoding", StringType())]))
def decode_text(contents: pd.Series) -> pd.DataFrame:
    """UTF-8 without its mark, else GB 18030; all line ends as \\n. Bytes that are neither are an error."""

    def one(data):
        if data is None:
            return None, None
        for encoding in (UTF8, CHINESE):
            try:
                return bytes(data).decode(encoding).replace("\r\n", "\n").replace("\r", "\n"), encoding
            except UnicodeDecodeError:
                continue
        raise ValueError("text is neither UTF-8 nor GB 18030")

    return pd.DataFrame([one(x) for x in contents], columns=["text", "encoding"])


def _decoded(found: DataFrame) -> DataFrame:
    return found.withColumn("d", decode_text("content")).select("path", "stem", "d.text", "d.encoding")


def texts(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """path, stem, text, encoding."""
    return _decoded(files(spark, folder, pattern))


def first_text(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """The text of the file whose path comes first; the others are not read."""
    first = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path").orderBy("path").limit(1).collect()
    return _decoded(files(spark, first[0].path if first else folder, pattern))


def with_raw_output(predictions: DataFrame, outputs: DataFrame, name: str = "stem") -> DataFrame:
    """predictions with the text of their raw output file (stem, text); a missing one is an error."""
    rows = predictions.join(outputs.select(F.col("stem").alias(name), F.col("text").alias("raw_text")), name, "left")
    return rows.withColumn("raw_text", F.when(F.col("raw_text").isNotNull(), F.col("raw_text")).otherwise(F.raise_error(F.concat(F.lit("Missing raw output for "), F.col(name)))))


def raw_path(folder: str, name: Column | str) -> Column:
    return F.concat(F.lit(folder.rstrip("/") + "/"), F.col(name) if isinstance(name, str) else name, F.lit(".txt"))


def _put_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Writes each row's text to its path, through a name of its own, so that no reader sees half a file."""
    for batch in batches:
        paths, texts = batch.column("path").to_pylist(), batch.column("value").to_pylist()
        for path, text in zip(paths, texts, strict=True):
            system, place = pa_fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa_fs.LocalFileSystem(), path)
            system.create_dir(posixpath.dirname(place), recursive=True)
            draft = f"{place}.{uuid.uuid4().hex}.part"
            with system.open_output_stream(draft) as out:
                out.write((text or "").encode())
            system.move(draft, place)
        yield pa.record_batch({"n": pa.array([len(paths)], pa.int64())})


def write_each(frame: DataFrame, name: Column | str, text: Column | str, folder: str, suffix: str = "txt") -> int:
    """A file ``folder/name.suffix`` for each row, written by the executors where the folder is shared; how many there are.

    A later attempt overwrites an earlier. Names may hold folders. For exports of single samples, not for large tables.
    """
    if suffix not in ("txt", "tex"):
        raise ValueError(f"no export as {suffix}")
    name, text = (F.col(c) if isinstance(c, str) else c for c in (name, text))
    rows = frame.select(F.concat(F.lit(folder.rstrip("/") + "/"), name, F.lit(f".{suffix}")).alias("path"), text.alias("value"))
    return rows.mapInArrow(_put_files, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def make_folders(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        system, where = _filesystem(spark, path)
        system.mkdirs(where)


def remove_matching(spark: SparkSession, pattern: str, keep: set[str] | frozenset[str] = frozenset()) -> list[str]:
    """Removes files and folders that a glob pattern names, but for names in keep; the names removed."""
    system, where = _filesystem(spark, pattern)
    gone = []
    for found in system.globStatus(where) or []:
        if (name := found.getPath().getName()) not in keep:
            system.delete(found.getPath(), True)
            gone.append(name)
    return sorted(gone)


def report(label: str, base: dict, other: dict, examples: list[dict], setup: dict | None = None) -> str:
    """A Markdown report of two summaries and a few examples (example, sample_id, base_score, other_score, texts)."""
    measures = {"score": "weighted_score", "characters": "character_accuracy", "cells": "cell_accuracy"}
    errors = {"cut off": "truncation", "wrong shape": "structure_error", "right shape": "value_error"}
    lines = [f"# {label}", ""]
    if setup:
        lines += ["## Setup", "", *(f"- {k}: `{v}`" for k, v in setup.items()), ""]
    lines += ["## Runs", "", f"| run | {' | '.join([*measures, *errors])} |", "|-" * (1 + len(measures) + len(errors)) + "|"]
    for run in (base, other):
        values = [format(run[k], ".4f") for k in measures.values()] + [str(run.get("by_error_type", {}).get(k, 0)) for k in errors.values()]
        lines.append(f"| {run['label']} | {' | '.join(values)} |")
    gain = other["weighted_score"] - base["weighted_score"]
    lines += ["", f"Score of {other['label']} less that of {base['label']}: {gain:+.4f}.", ""]
    for x in examples:
        lines += [f"## Example `{x['sample_id']}` ({x['example']})", "", f"{base['label']} {x['base_score']:.4f}, {other['label']} {x['other_score']:.4f}", ""]
        for name in (n for n in ("base_prediction", "other_prediction", "target_csv") if x.get(n) is not None):
            shown = x[name] if len(x[name]) <= CLIP else x[name][:CLIP] + "\n..."
            lines += [f"{name.replace('_', ' ')}:", "", "```", shown, "```", ""]
    return "\n".join(lines) + "\n"


def write_report(spark: SparkSession, path: str, label: str, base: dict, other: dict, examples: list[dict], setup: dict | None = None) -> None:
    write_text(spark, report(label, base, other, examples, setup), path)


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _filesystem(spark, path)
    return system.exists(where)


def replace(spark: SparkSession, draft: str, path: str) -> None:
    """The draft takes the place of what is at path."""
    system, where = _filesystem(spark, path)
    system.delete(where, True)
    if not system.rename(_filesystem(spark, draft)[1], where):
        raise OSError(f"{draft} can't be moved to {path}")


def remove(spark: SparkSession, *paths: str) -> None:
    """Files and folders, where they exist."""
    for path in paths:
        system, where = _filesystem(spark, path)
        system.delete(where, True)


def join_path(*parts: str) -> str:
    return posixpath.join(*parts)
