"""Token counts of whole texts by a public tokenizer.

The library encodes batches inside an Arrow function, which gives back lengths only. Batches hold about as
many bytes each, whatever the lengths of their texts; a long text goes in pieces, cut at single spaces between
ASCII letters or digits. No token of a vocabulary whose words begin or end at white space spans such a place, and
neither normal forms nor lower-casing look across it, so the pieces' counts sum to that of the whole.

Defined results. Null or empty text: 0 bytes and 0 tokens. Null ids and repeated rows: a row each, as any other.
A long text without such a place is encoded in one piece. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from gridmark.llm.common import prepare, row_slices, tidy

BATCH, LONG = 500_000, 20_000
_SAFE = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")


@lru_cache(maxsize=4)
def _counter(path: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    """Counts of a batch, and whether its texts may be cut."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], False
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], True


def pieces(text: str, most: int = LONG) -> list[str]:
    """text in pieces of about ``most`` characters, cut where no token can span."""
    out, at = [], 0
    while len(text) - at > most:
        cut = _SAFE.search(text, at + most - 1)
        if cut is None:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    out.append(text[at:])
    return out


def _count(path: str, limit: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count, cuttable = _counter(path)
    for batch in batches:
        for rows, texts in row_slices(batch, "text", BATCH):
            parts, owner = [], []
            for i, text in enumerate(texts.to_pylist()):
                for piece in pieces(text) if cuttable else [text]:
                    parts.append(piece)
                    owner.append(i)
            n = np.bincount(owner, count(parts), len(texts)).astype(np.int64)
            size = pc.binary_length(texts).cast(pa.int64())
            yield pa.record_batch({"doc_id": rows.column("doc_id"), "n_bytes": size, "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)})


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row; path: a tokenizers .json or a sentencepiece .model on every machine."""
    prepare(docs.sparkSession)
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return read.mapInArrow(tidy(lambda batches: _count(path, limit, batches)), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
