"""Statistics of whole texts as numbers, computed for many texts at once over their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gridmark.llm.common import prepare, row_slices, tidy
from gridmark.llm.hashing import joined, raw, words

PIECE = 500_000
NAMES = (
    "n_words", "n_bytes", "word_bytes", "upper", "digit", "symbol", "mark", "exclaim", "bar", "wide", "distinct_words",
    "again_grams", "again_lines", "line_words", "one_letter", "odd_words", "stops", "longest_word", "most_common",
)


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _LETTER = _class(bytes(range(65, 91))), _class(bytes([*range(65, 91), *range(97, 123)]))
_DIGIT, _SYMBOL, _MARK, _EXCLAIM, _BAR = _class(b"0123456789"), _class(b"#$%&*@^~<>{}[]\\/=_+`|"), _class(b".,;:?!'\"()-"), _class(b"!?"), _class(b"|")
_WIDE, _STOP, _LINE = _class(bytes(range(128, 256))), _class(b"."), _class(b"\n")
_ODD = ~(_LETTER | _WIDE | _class(b".,;:?!'\"()- \n"))


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Counts of flags in the ranges between consecutive offsets."""
    total = np.concatenate([[0], np.cumsum(flags)])
    return (total[at[1:]] - total[at[:-1]]).astype(float)


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of NAMES for each text; zeros for an empty one."""
    data, at = raw(texts)
    found = words(data, at)
    n = np.diff(found.first).astype(float)
    size = np.diff(at).astype(float)
    per_word, per_byte = 1 / np.maximum(n, 1), 1 / np.maximum(size, 1)
    lengths = (found.ends - found.starts).astype(float)
    odd_upto = np.concatenate([[0], np.cumsum(_ODD[data])])
    odd = odd_upto[found.ends] > odd_upto[found.starts] if len(lengths) else np.zeros(0, bool)
    grams = joined(found.hashes, 3)
    newline = _sums(_LINE[data], at)
    out = np.zeros((len(n), len(NAMES)))
    column = dict(zip(NAMES, out.T, strict=True))
    column["n_words"][:] = n
    column["n_bytes"][:] = size
    column["word_bytes"][:] = _sums(lengths, found.first) * per_word
    column["upper"][:] = _sums(_UPPER[data], at) / np.maximum(_sums(_LETTER[data], at), 1)
    for name, flags in (("digit", _DIGIT), ("symbol", _SYMBOL), ("mark", _MARK), ("exclaim", _EXCLAIM), ("bar", _BAR), ("wide", _WIDE)):
        column[name][:] = _sums(flags[data], at) * per_byte
    column["stops"][:] = _sums(_STOP[data], at) * per_word
    column["one_letter"][:] = _sums(lengths == 1, found.first) * per_word
    column["odd_words"][:] = _sums(odd, found.first) * per_word
    column["line_words"][:] = n / (newline + 1)
    for i, (a, b) in enumerate(zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True)):
        if b == a:
            continue
        _, counts = np.unique(found.hashes[a:b], return_counts=True)
        column["distinct_words"][i] = len(counts) / (b - a)
        column["most_common"][i] = counts.max() / (b - a)
        column["longest_word"][i] = lengths[a:b].max()
        if b - a > 3:
            column["again_grams"][i] = 1 - len(np.unique(grams[a : b - 2])) / (b - a - 2)
        if newline[i]:
            lines = [x for x in data[at[i] : at[i + 1]].tobytes().split(b"\n") if x]
            column["again_lines"][i] = 1 - len(set(lines)) / max(1, len(lines))
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, texts in row_slices(batch, "text", PIECE):
            also = {k: rows.column(k) for k in rows.schema.names if k != "text"}
            yield pa.record_batch(also | {k: pa.array(v) for k, v in zip(NAMES, statistics(texts).T, strict=True)})


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: Column | None = None) -> DataFrame:
    """doc_id, row_key (a binary column) if a key is given, and NAMES for each row."""
    prepare(docs.sparkSession)
    also = {} if key is None else {"row_key": key}
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[v.alias(k) for k, v in also.items()])
    return read.mapInArrow(tidy(_measure), "doc_id long, " + "".join(f"{k} binary, " for k in also) + ", ".join(f"{k} double" for k in NAMES))
