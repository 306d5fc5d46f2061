"""Exact top-k search by integer inner product: distributed histogram selection.

Each component x becomes floor(256 * x). For a block of queries, every pass scores all vectors anew against
the block (a matrix product per slice) and counts scores in bins; after each pass only the bin that holds the
k-th highest score is refined, until bins are single values. A last pass takes what is above the k-th score and,
of the rows equal to it, those with the smallest ids.

Nothing grows with the table in one place: a slice reports only bins from that of its own k-th score upwards
(what is below can't hold the global k-th), at most the missing number of its ties, and counts are summed by
Spark. Queries are handled in blocks of at most about ``block`` vectors, and only a block goes to the workers.

Defined results. Null vectors, vectors with a null, NaN or infinite component, and null ids take no part. A
shorter vector counts as if zeros followed. Fewer candidates than k: all of them. A candidate with the query's
id is the query's own row. An id that several query rows share is asked once, with the least vector.
Scores beyond 64 bits are set to the nearest long. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridmark.llm.common import Scratch, prepare

BLOCK, CELLS, LEVEL_BITS = 2048, 2_000_000, 10
_LONG = 2**63 - 1


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors that take part, as bytes of doubles that are whole, with their squared length and width."""
    for batch in batches:
        ids, made = [], []
        for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("v"), strict=True):
            values = v.values
            if i is None or values is None or values.null_count:
                continue
            x = np.asarray(values, np.float64)
            if np.isfinite(x).all():
                ids.append(i)
                made.append(np.floor(256 * x))
        yield pa.record_batch(
            {
                "vec_id": pa.array(ids, pa.int64()),
                "v": pa.array([x.tobytes() for x in made], pa.binary()),
                "square": pa.array([float(x @ x) for x in made], pa.float64()),
                "width": pa.array([len(x) for x in made], pa.int32()),
            }
        )


def _matrix(blobs: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(blobs), width))
    for row, blob in zip(out, blobs, strict=True):
        x = np.frombuffer(blob)
        row[: len(x)] = x
    return out


class _Block:
    """A block of queries and what is known of their k-th scores; goes to the workers."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, wide: bool):
        self.ids, self.vectors, self.wide = ids, vectors, wide

    def slices(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of some rows, and their scores by query; a query's own row has the score -inf."""
        rows = max(1, CELLS // max(1, len(self.ids)))
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                ids = part.column("vec_id").to_numpy()
                vectors = _matrix(part.column("v").to_pylist(), self.vectors.shape[1])
                if self.wide:  # beyond what doubles hold exactly
                    exact = np.vectorize(int, otypes=[object])
                    scores = np.clip(exact(self.vectors) @ exact(vectors).T, -_LONG, _LONG)
                else:
                    scores = self.vectors @ vectors.T
                yield ids, scores

    def own(self, ids: np.ndarray) -> np.ndarray:
        return self.ids[:, None] == ids[None, :]


def _counter(block: _Block, low: np.ndarray, high: np.ndarray, missing: np.ndarray, shift: int) -> Callable:
    """Counts bins of 2**shift scores in [low, high) of each query, from the bin of the slice's own k-th score upwards."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, scores in block.slices(batches):
            for q in range(len(block.ids)) if block.wide else ():
                own = (ids != block.ids[q]) & (scores[q] >= low[q]) & (scores[q] < high[q])
                bins = sorted(int(s - low[q]) >> shift for s in scores[q][own])
                if bins:
                    least = bins[max(0, len(bins) - int(missing[q]))]
                    found, n = np.unique(np.array([x for x in bins if x >= least], np.int64), return_counts=True)
                    yield pa.record_batch({"q": pa.array(np.full(len(found), q, np.int32)), "bin": pa.array(found), "n": pa.array(n.astype(np.int64))})
            if block.wide:
                continue
            inside = np.where((scores >= low[:, None]) & (scores < high[:, None]) & ~block.own(ids), scores - low[:, None], -1.0)
            k = min(int(missing.max()), inside.shape[1])
            kth = np.partition(inside, inside.shape[1] - k, axis=1)[:, inside.shape[1] - k]
            least = np.floor(np.maximum(kth, 0) / 2**shift) * 2**shift
            q, c = np.nonzero(inside >= least[:, None])
            keys, n = np.unique((q.astype(np.int64) << 32) + (inside[q, c].astype(np.int64) >> shift), return_counts=True)
            yield pa.record_batch({"q": pa.array((keys >> 32).astype(np.int32)), "bin": pa.array(keys & 0xFFFFFFFF), "n": pa.array(n.astype(np.int64))})

    return count


def _taker(block: _Block, kth: np.ndarray, ties: np.ndarray) -> Callable:
    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, scores in block.slices(batches):
            valid = ~block.own(ids)
            level = kth[:, None]
            q, c = np.nonzero(valid & (scores > level))
            tq, tc = np.nonzero(valid & (scores == level))
            order = np.lexsort((ids[tc], tq))
            tq, tc = tq[order], tc[order]
            place = np.arange(len(tq)) - np.searchsorted(tq, tq)
            few = place < ties[tq]
            q, c = np.concatenate([q, tq[few]]), np.concatenate([c, tc[few]])
            yield pa.record_batch({"query_id": pa.array(block.ids[q], pa.int64()), "vec_id": pa.array(ids[c], pa.int64()), "score": pa.array(scores[q, c].astype(np.int64))})

    return take


def _select(vectors: DataFrame, block: _Block, k: int, most: int) -> DataFrame:
    """The k highest of each query of the block. most: no score is farther from 0."""
    n = len(block.ids)
    kind = object if block.wide else np.float64
    bits = max(1, math.ceil(math.log2(2 * most + 2)))
    low = np.array([-most] * n, dtype=kind)
    high = np.array([most + 1] * n, dtype=kind)
    missing = np.full(n, k)
    everything = np.zeros(n, bool)
    while bits > 0:
        shift = max(0, bits - (20 if block.wide else LEVEL_BITS))
        counts = vectors.mapInArrow(_counter(block, low, high, missing, shift), "q int, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        above = Window.partitionBy("q").orderBy(F.desc("bin"))
        upto = counts.withColumn("upto", F.sum("n").over(above)).withColumn("last", F.row_number().over(Window.partitionBy("q").orderBy("bin")) == 1)
        wanted = F.element_at(F.array(*[F.lit(int(x)) for x in missing]), F.col("q") + 1) if len(set(missing.tolist())) > 1 else F.lit(int(missing[0]))
        chosen = upto.filter(((F.col("upto") >= wanted) & (F.col("upto") - F.col("n") < wanted)) | (F.col("last") & (F.col("upto") < wanted)))
        seen = np.zeros(n, bool)
        for q, b, count, total in chosen.select("q", "bin", "n", "upto").collect():  # a row for each query of the block
            seen[q] = True
            if total < missing[q]:
                everything[q] = True
            base = low[q] + b * 2**shift
            low[q], high[q] = base, min(high[q], base + 2**shift)
            missing[q] -= total - count if total >= missing[q] else 0
        everything |= ~seen
        bits = shift
    kth = np.array([-most - 1 if e else x for e, x in zip(everything, low, strict=True)], dtype=kind)
    found = vectors.mapInArrow(_taker(block, kth, np.where(everything, 0, missing)), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row that is_query holds for, the k others of highest score."""
    spark = prepare(vectors.sparkSession)
    scratch = Scratch(spark, "top-k")
    read = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    whole = scratch.put(read.mapInArrow(_integers, "vec_id long, v binary, square double, width int"), "vectors")
    square, width = whole.agg(F.max("square"), F.max("width")).first()
    asked = vectors.filter(is_query).select(F.col(id_col).cast("long").alias("asked")).distinct()
    queries = scratch.put(whole.join(asked, F.col("vec_id") == F.col("asked")).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    blocks = max(1, math.ceil(queries.count() / block))
    results = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if square is None:
        return results
    most = min(int(square) + 1, _LONG)
    for i in range(blocks):
        rows = sorted(queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).collect())  # about ``block`` rows
        if rows:
            asked_now = _Block(np.array([r[0] for r in rows], np.int64), _matrix([bytes(r[1]) for r in rows], width), square >= 2**53)
            _select(whole, asked_now, k, most).write.parquet(scratch.path(f"results/part={i}"))
    if not queries.isEmpty():
        results = spark.read.schema(results.schema).option("recursiveFileLookup", "true").parquet(scratch.path("results"))
    return results
