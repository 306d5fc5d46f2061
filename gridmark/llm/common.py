"""What the operators share: the scratch folder, importability on workers, Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Rows of whole texts that go to a Python worker at once, where the session has Spark's default.
ARROW_ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000")


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package when the driver was started from another folder, and keeps batches of texts small."""
    key, default, wanted = ARROW_ROWS
    if spark.conf.get(key, default) == default:
        spark.conf.set(key, wanted)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a temporary one only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jvm.get() if jvm.isDefined() else None
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="gridmark-scratch-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


class Scratch:
    """Tables written to the shared folder, so that what follows survives lost executors and isn't computed twice.

    ``drop`` removes a table as soon as nothing reads it; the rest goes at the end of ``passing``, or of the driver process.
    """

    made: list[Scratch] = []

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark, self.base = spark, f"{scratch_dir(spark)}/{purpose}-{uuid.uuid4().hex}"
        self.made.append(self)
        atexit.register(self._delete, self.base)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    @contextmanager
    def _writing(self) -> Iterator[None]:
        """What is written needs its shuffles no more: their files go at the end of the write, as Spark offers from 4.1 on."""
        key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(key, None)
        self.spark.conf.set(key, "true")
        try:
            yield
        finally:
            if before is None:
                self.spark.conf.unset(key)
            else:
                self.spark.conf.set(key, before)

    def put(self, frame: DataFrame, name: str, files: int | None = None) -> DataFrame:
        """frame, written and read again. files: at most so many, for tables whose rows are few for their partitions."""
        frame = frame if files is None else frame.coalesce(files)
        with self._writing():
            frame.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(frame.schema).parquet(self.path(name))

    def put_dealt(self, frame: DataFrame, name: str, by: str, parts: int) -> DataFrame:
        """As put, dealt to so many parts by the hash of a column: what groups by it reads a part and needs no shuffle of it."""
        known = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
        with self._writing():
            frame.write.bucketBy(parts, by).option("path", self.path(name)).format("parquet").saveAsTable(known)
        atexit.register(self._forget, known)
        return self.spark.table(known)

    def _forget(self, known: str) -> None:
        try:
            self.spark.sql(f"DROP TABLE IF EXISTS {known}")
        except Exception:  # the session has ended, and its catalog with it
            return

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))

    @classmethod
    @contextmanager
    def passing(cls) -> Iterator[None]:
        """Tables that are made inside go at its end: whoever opens it has written what was made of them."""
        before = len(cls.made)
        try:
            yield
        finally:
            for scratch in cls.made[before:]:
                scratch._delete(scratch.base)
                atexit.unregister(scratch._delete)
            del cls.made[before:]

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # the session has ended: whoever owns the folder clears it
            return


def tidy(run: Callable) -> Callable:
    """run (from batches to batches), after which a worker that stays gives unused memory back to the system."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def lower_ascii(text):
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def row_key(text: Column) -> Column:
    """16 bytes of a text as it is, null as empty: with the id it tells rows apart that share an id."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs without the rows whose id and row_key are in gone (id, key); columns as they were, whatever their names."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select("row", F.col(f"row.`{id_col}`").cast("long").alias("id"), row_key(F.col(f"row.`{text_col}`")).alias("key")).alias("r")
    gone = gone.select("id", "key").distinct().alias("g")
    return rows.join(gone, F.col("r.id").eqNullSafe(F.col("g.id")) & (F.col("r.key") == F.col("g.key")), "left_anti").select("row.*")


def row_slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Runs of rows of about ``most`` bytes of text each (one longer row makes a run of its own); nulls as empty texts."""
    texts = batch.column(column).cast(pa.large_string()).fill_null("")
    at, n, size = 0, batch.num_rows, 0
    lengths = pa.compute.binary_length(texts).to_pylist()
    for i in range(n):
        if size and size + lengths[i] > most:
            yield batch.slice(at, i - at), texts.slice(at, i - at)
            at, size = i, 0
        size += lengths[i]
    if n > at:
        yield batch.slice(at), texts.slice(at)
