"""Stupid-backoff language-model scores of documents under n-gram counts of the whole corpus.

A word (A-Z lower-cased, split at white space) scores c(context, word) / c(context) if that n-gram occurs at
least ``least`` times, else 0.4 times its score in the context without its first word; at last c(word) / all
words. A document's score is the sum of log10 scores of its words. ``least`` is 2: the corpus scores itself, so with 1
every n-gram would count as seen, and no word would ever be backed off.

The count tables are partitioned by n-gram hash and joined to the documents' n-grams, both as arrays: as a row each,
n-grams would take several times the corpus on disk. Documents are packed into blocks of a few MB. (1) Each block
sends, to each hash range, the sorted distinct hashes of its n-grams and how often it has them. (2) A range adds them
up: this is its part of the count tables. It answers each block with the totals of the hashes that the block sent, in
the same order. (3) A block meets its answers, joins them to its n-grams by position, and sums per document. A frequent
n-gram is one entry per block, so no range is hot; ranges are as many as keep each in a few million entries, whatever
the corpus. Blocks are written dealt by number, so that only answers move to them. Steps 1 and 2 are done for words and
pairs, then for each longer n on its own, so that no range holds more than one of these at a time.

Defined results. Null or empty text: 0 words, score 0, mean null. Null ids and repeated rows: a row each, and counted as
often as they occur. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from gridmark.llm.common import Scratch, prepare, row_slices
from gridmark.llm.hashing import joined, raw, words

BLOCK, ENTRIES, RANGES = 4_000_000, 4_000_000, 64
PARTS, MOST_PARTS = 24, 100_000  # of the blocks; the most is what Spark allows by default
BACKOFF, LEAST = 0.4, 2
_BLOCKS = "block long, ids array<long>, ends array<long>, data binary, size long, n_words long"


def _squeeze(values: np.ndarray) -> bytes:
    """Unsigned integers by planes of bytes, so that high bytes that are mostly 0 shrink."""
    values = values.astype("<u8")
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()
    return pa.Codec("lz4_raw").compress(planes, asbytes=True)


def _unsqueeze(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.Codec("lz4_raw").decompress(blob, n * 8), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).reshape(-1).view("<u8")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts of consecutive rows, about BLOCK bytes at a time."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for rows, some in row_slices(batch, "text", BLOCK // 8):
            ids.append(rows.column("doc_id"))
            texts.append(some)
            size += pc.sum(pc.binary_length(some)).as_py()
            if size >= BLOCK:
                yield pa.concat_arrays(ids), pa.concat_arrays(texts)
                ids, texts, size = [], [], 0
    if ids:
        yield pa.concat_arrays(ids), pa.concat_arrays(texts)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents in blocks, their bytes compressed."""
    number = TaskContext.get().partitionId() << 32
    for ids, texts in _runs(batches):
        data, at = raw(texts)
        made = {
            "block": pa.array([number], pa.int64()),
            "ids": pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), ids),
            "ends": pa.array([at[1:]], pa.list_(pa.int64())),
            "data": pa.array([pa.Codec("zstd").compress(data.tobytes(), asbytes=True)], pa.binary()),
            "size": pa.array([len(data)], pa.int64()),
            "n_words": pa.array([len(words(data, at).starts)], pa.int64()),
        }
        number += 1
        yield pa.record_batch(made)


def _grams(ends: np.ndarray, data: bytes, size: int, order: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Row of each word; hashes of the n-grams of each n up to order, and the place of each one's last word."""
    plain = np.frombuffer(pa.Codec("zstd").decompress(data, size), np.uint8) if size else np.zeros(0, np.uint8)
    found = words(plain, np.concatenate([np.zeros(1, np.int64), ends]))
    out = []
    for n in range(1, order + 1):
        hashes = joined(found.hashes, n)
        inside = np.flatnonzero(found.row[: len(hashes)] == found.row[n - 1 : n - 1 + len(hashes)])
        out.append((hashes[inside], inside + n - 1))
    return found.row, out


def _bounds(ranges: int) -> np.ndarray:
    return np.arange(1, ranges, dtype=np.uint64) << np.uint64(64 - (ranges.bit_length() - 1))


def _passes(order: int) -> list[tuple[int, ...]]:
    """Which n are counted together, as places in what _grams gives."""
    return [tuple(range(min(order, 2))), *((n,) for n in range(2, order))]


def _distinct(grams: list[tuple[np.ndarray, np.ndarray]], some: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate([grams[n][0] for n in some]), return_counts=True)


def _send(some: tuple[int, ...], ranges: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            _, grams = _grams(np.array(row["ends"], np.int64), row["data"], row["size"], some[-1] + 1)
            hashes, counts = _distinct(grams, some)
            cuts = [0, *np.searchsorted(hashes, _bounds(ranges)).tolist(), len(hashes)]
            parts = [(k, a, b) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            steps = np.diff(hashes, prepend=np.uint64(0))
            steps[[a for _, a, _ in parts]] = hashes[[a for _, a, _ in parts]]
            yield pa.record_batch(
                {
                    "part": pa.array([k for k, _, _ in parts], pa.int32()),
                    "block": pa.array([row["block"]] * len(parts), pa.int64()),
                    "n": pa.array([b - a for _, a, b in parts], pa.int64()),
                    "steps": pa.array([_squeeze(steps[a:b]) for _, a, b in parts], pa.binary()),
                    "counts": pa.array([_squeeze(counts[a:b]) for _, a, b in parts], pa.binary()),
                }
            )


def _answer(table: pa.Table) -> pa.Table:
    """Totals of all that one hash range was sent."""
    rows = table.to_pylist()
    sizes = [r["n"] for r in rows]
    hashes = np.concatenate([np.cumsum(_unsqueeze(r["steps"], r["n"]), dtype=np.uint64) for r in rows])
    counts = np.concatenate([_unsqueeze(r["counts"], r["n"]) for r in rows])
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    new = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    sums = np.add.reduceat(counts[order], new)
    totals = np.empty(len(hashes), np.uint64)
    totals[order] = np.repeat(sums, np.diff(np.append(new, len(hashes))))
    at = np.cumsum([0, *sizes])
    answers = [_squeeze(totals[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    return pa.table({"block": pa.array([r["block"] for r in rows], pa.int64()), "part": pa.array([r["part"] for r in rows], pa.int32()), "n": pa.array(sizes, pa.int64()), "totals": pa.array(answers, pa.binary())})


def _score(order: int, least: int, all_words: int, blocks: pa.Table, answers: pa.Table) -> pa.Table:
    out: dict[str, list] = {"doc_id": [], "n_words": [], "log10_score": [], "mean_log10": []}
    answers = answers.to_pylist()
    for row in blocks.to_pylist():  # one, as blocks are groups
        owner, grams = _grams(np.array(row["ends"], np.int64), row["data"], row["size"], order)
        n = len(owner)
        counts = []  # of each n, by the place of the last word; 0 where the row has no such n-gram
        for number, some in enumerate(_passes(order)):
            hashes, _ = _distinct(grams, some)
            told = sorted((r for r in answers if r["pass"] == number), key=lambda r: r["part"])
            totals = np.concatenate([_unsqueeze(r["totals"], r["n"]) for r in told]).astype(float) if told else np.zeros(0)
            for k in some:
                h, last = grams[k]
                c = np.zeros(n)
                c[last] = totals[np.searchsorted(hashes, h)]
                counts.append(c)
        score = counts[0] / max(1, all_words)
        for c, context in zip(counts[1:], counts[:-1], strict=True):
            before = np.concatenate([[0.0], context[:-1]])
            seen = c >= least
            score = np.where(seen, c / np.where(seen, before, 1), BACKOFF * score)
        # A word without a longer context isn't backed off from it.
        place = np.arange(n) - np.searchsorted(owner, owner)
        for k in range(order - 1):
            score[place == k] /= BACKOFF ** (order - 1 - k)
        logs = np.log10(score)
        each = np.bincount(owner, minlength=len(row["ids"]))
        sums = np.bincount(owner, logs, len(row["ids"]))
        out["doc_id"] += row["ids"]
        out["n_words"] += each.tolist()
        out["log10_score"] += sums.tolist()
        out["mean_log10"] += [s / k if k else None for s, k in zip(sums.tolist(), each.tolist(), strict=True)]
    return pa.table({k: pa.array(v, pa.int64() if k in ("doc_id", "n_words") else pa.float64()) for k, v in out.items()})


def lm_scores(docs: DataFrame, order: int = 3, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, log10_score, mean_log10 for each row."""
    spark = prepare(docs.sparkSession)
    scratch = Scratch(spark, "lm")
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = scratch.put_dealt(read.mapInArrow(_pack, _BLOCKS), "blocks", "block", min(MOST_PARTS, max(PARTS, size // (8 * BLOCK))))
    all_words = blocks.agg(F.sum("n_words")).first()[0] or 0
    told = [scratch.put(_counted(blocks, some, all_words).withColumn("pass", F.lit(number)), f"answers-{number}") for number, some in enumerate(_passes(order))]
    answers = reduce(DataFrame.unionByName, told)
    both = blocks.groupBy("block").cogroup(answers.groupBy("block"))
    return both.applyInArrow(lambda b, a: _score(order, least, all_words, b, a), "doc_id long, n_words long, log10_score double, mean_log10 double")


def _counted(blocks: DataFrame, some: tuple[int, ...], all_words: int) -> DataFrame:
    """The totals that answer each block, by hash range."""
    ranges = max(RANGES, 1 << (all_words * len(some) // ENTRIES).bit_length())
    sent = blocks.mapInArrow(lambda b: _send(some, ranges, b), "part int, block long, n long, steps binary, counts binary")
    return sent.groupBy("part").applyInArrow(_answer, "block long, part int, n long, totals binary")
