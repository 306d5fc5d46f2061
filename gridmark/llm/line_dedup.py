"""Line dedup: a deletion-neighbourhood join over lines of all documents.

A line is compared as its words (A-Z lower-cased, split at white space). Of lines with the same words, and of
lines of at least ``near_words`` words that differ by one edit (a word put in, left out or replaced), the
earliest stays (by id of the document, then place in it); a line goes if an earlier line is that close to it.
Blank lines stay (with a higher ``min_words`` all lines of fewer words do). Lines of fewer than ``near_words`` words, as in
scripts without spaces, long addresses and code, are compared by edits of one character if they have ``near_chars``
of them (words joined by single spaces); shorter ones, in which one character is another word, go as equal lines only.

1. Each line becomes a 128-bit key of its words; equal lines are grouped, the first of each group stands for it.
2. An edit leaves the first or the last half of the shorter line as it is. Lines are indexed by their halves, and
   only lines that share one with another line, on the other side of which an edit can be, go on.
3. These emit their variants, as hashed keys: the line with one word left out, and the line itself. Equal variants
   are joined by least line, without listing pairs: two lines with the same place left out to the same effect are
   one replacement apart, a line and another's variant one word apart. Each line so gets the earliest line that
   shares a variant; the pair's edit distance is verified on the words before the line goes.

Texts are shuffled by document id, keys by hash; a frequent key is combined before the shuffle. Joins with texts
are merge joins at every size, so that a small run costs what its share of a large one does.
Defined results. Null or empty text: one empty line, which stays. Null id: its lines stay, and stand for no other.
Rows that share an id: their lines of one number share a place, and go together if any of them goes. Empty table:
no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, functions as F

from gridmark.llm.common import Scratch, prepare, row_slices, tidy
from gridmark.llm.hashing import _STEP, mix, raw, seeded, words

PIECE = 2_000_000
MIN_WORDS, NEAR_WORDS, NEAR_CHARS = 1, 4, 16
_SALT = seeded(16, 23)
HALVES = ("prefix0", "suffix0", "prefix1", "suffix1")
_KIND = {"prefix": _SALT[2], "suffix": _SALT[3]}


def _tokens(line: bytes, near_words: int, near_chars: int | None) -> bytes:
    """Words joined by single spaces; of a line compared by characters, these as words, each after a mark that keeps them apart from words."""
    split = line.lower().split()
    joined = b" ".join(split)
    if near_chars is None or len(split) >= near_words or len(joined) < near_chars or len(text := joined.decode()) < near_chars:
        return joined
    return " ".join("\x1f" + c.strip() for c in text).encode()


class _Split:
    """Lines of texts: row and number of each, index of its first word and their count."""

    def __init__(self, texts: pa.Array):
        data, at = raw(texts)
        breaks = np.flatnonzero(data == 10)
        owner = np.concatenate([np.arange(len(at) - 1), np.searchsorted(at[1:], breaks, "right")])
        starts = np.concatenate([at[:-1], breaks + 1])
        order = np.lexsort((starts, owner))
        self.row, starts = owner[order], starts[order]
        self.number = np.arange(len(starts)) - np.searchsorted(self.row, self.row)
        followed = np.append(self.row[1:] == self.row[:-1], False)
        ends = np.append(starts[1:], at[-1]) - followed
        self.data, self.starts, self.ends = data, starts, ends
        self.words = words(data, at)
        self.first = np.searchsorted(self.words.starts, starts)
        self.count = np.searchsorted(self.words.starts, ends) - self.first


class _Folds:
    """Polynomial hashes of any run of words, from sums over all words."""

    def __init__(self, hashes: np.ndarray, step: np.uint64):
        n = len(hashes)
        with np.errstate(over="ignore"):
            self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n + 1, step, np.uint64)]))
            back = np.uint64(pow(int(step), -1, 1 << 64))
            self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n + 1, back, np.uint64)]))
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * self.up[:n])])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words a to b - 1, as if the first stood at place 0."""
        with np.errstate(over="ignore"):
            return (self.sums[b] - self.sums[a]) * self.down[a]

    def without(self, a: np.ndarray, b: np.ndarray, left_out: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return self.of(a, left_out) + self.of(left_out + 1, b) * self.up[left_out - a]


_OTHER_STEP = np.uint64(0xA24BAED4963EE407)


def _finish(value: np.ndarray, count: np.ndarray, salt: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(value + salt) + count.astype(np.uint64)).view(np.int64)


def _halves(folds: _Folds, a: np.ndarray, n: np.ndarray, near: np.ndarray) -> dict[str, np.ma.MaskedArray]:
    """Keys of the halves of runs of n tokens from a; masked where there are none."""
    made = {}
    for name, half in (("0", n // 2), ("1", (n - 1) // 2)):
        for side, start in (("prefix", a), ("suffix", a + n - half)):
            made[f"{side}{name}"] = np.ma.array(_finish(folds.of(start, start + half), half, _KIND[side]), mask=~near | ((name == "1") & (n % 2 == 1)))
    return made


def _lines(min_words: int, near_words: int, near_chars: int | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per line that can go: its 128-bit key and, for near ones, the keys of its halves."""
    for batch in batches:
        for rows, texts in row_slices(batch, "text", PIECE):
            s = _Split(texts)
            some = np.flatnonzero(s.count >= min_words)
            a, n = s.first[some], s.count[some]
            one, two = _Folds(s.words.hashes, _STEP), _Folds(mix(s.words.hashes ^ _SALT[0]), _OTHER_STEP)
            made = {
                "doc_id": rows.column("doc_id").take(pa.array(s.row[some])),
                "line": pa.array(s.number[some].astype(np.int32)),
                "n": pa.array(n.astype(np.int32)),
                "h1": pa.array(_finish(one.of(a, a + n), n, _SALT[4])),
                "h2": pa.array(_finish(two.of(a, a + n), n, _SALT[5])),
            }
            halves = _halves(one, a, n, n >= near_words)
            if near_chars is not None:
                # A line's characters are no more than its bytes.
                short = np.flatnonzero((n < near_words) & (s.ends[some] - s.starts[some] >= near_chars))
                spelled = [_tokens(s.data[i:j].tobytes(), near_words, near_chars) for i, j in zip(s.starts[some[short]].tolist(), s.ends[some[short]].tolist(), strict=True)]
                marked = [k for k, x in enumerate(spelled) if x.startswith(b"\x1f")]
                if marked:
                    w = words(*raw(pa.array([spelled[k].decode() for k in marked], pa.large_string())))
                    size = np.diff(w.first)
                    for name, keys in _halves(_Folds(w.hashes, _STEP), w.first[:-1], size, size > 0).items():
                        halves[name][short[marked]] = keys
            made |= {name: pa.array(keys.data, mask=np.ma.getmaskarray(keys)) for name, keys in halves.items()}
            yield pa.record_batch(made)


_LINES = "doc_id long, line int, n int, h1 long, h2 long, prefix0 long, suffix0 long, prefix1 long, suffix1 long"


def _pick(near_words: int, near_chars: int | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tokens of the wanted lines of each text, joined by single spaces."""
    for batch in batches:
        wanted = batch.column("wanted")
        flat = wanted.flatten()
        numbers = flat.field("line").to_pylist()
        texts, at = [], 0
        for text, n in zip(batch.column("text").to_pylist(), pa.compute.list_value_length(wanted).to_pylist(), strict=True):
            lines = text.encode().split(b"\n")
            for k in numbers[at : at + n]:
                texts.append(_tokens(lines[k], near_words, near_chars).decode() if k < len(lines) else "")
            at += n
        yield pa.record_batch({"place": flat.field("place"), "words": pa.array(texts, pa.string()), "front": flat.field("front"), "back": flat.field("back")})


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of the line itself (place -1) and of the line without each word on the sides where an edit can be."""
    for batch in batches:
        for rows, texts in row_slices(batch, "words", PIECE // 8):
            w = words(*raw(texts))
            first, n = w.first[:-1], np.diff(w.first)
            one = _Folds(w.hashes, _STEP)
            in_row = np.arange(len(w.row)) - first[w.row]
            half = (n - 1) // 2
            front = rows.column("front").to_numpy(zero_copy_only=False)[w.row] & (in_row <= n[w.row] - half[w.row])
            back = rows.column("back").to_numpy(zero_copy_only=False)[w.row] & (in_row >= half[w.row])
            at = np.flatnonzero(front | back)
            r = w.row[at]
            left_out = one.without(first[r], w.first[1:][r], at)
            size = n[r]
            # Left out at one place: equal keys are one replacement apart. As a line: one word apart from the line of that key.
            with np.errstate(over="ignore"):
                placed = _finish(left_out + mix(in_row[at].astype(np.uint64)), size, _SALT[6])
            as_line = _finish(left_out, size - 1, _SALT[7])
            whole = _finish(one.of(first, w.first[1:]), n, _SALT[7])
            who = np.concatenate([r, r, np.arange(len(n))])
            kind = np.repeat(np.array([0, 1, 2], np.int8), [len(r), len(r), len(n)])
            keys = np.concatenate([placed, as_line, whole])
            yield pa.record_batch({"key": pa.array(keys), "kind": pa.array(kind), "place": rows.column("place").take(pa.array(who))})


def within_one(a: list[str], b: list[str]) -> bool:
    """Whether one edit at most (a word put in, left out or replaced) leads from a to b."""
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = [within_one(x.split(" "), y.split(" ")) for x, y in zip(batch.column("words").to_pylist(), batch.column("early_words").to_pylist(), strict=True)]
        yield batch.select(["place"]).filter(pa.array(ok, pa.bool_()))


def _place(lines: DataFrame) -> Column:
    """Orders lines by doc_id and line: one long where they fit in 63 bits together, which aggregates faster, else a struct."""
    low, high, last = lines.agg(F.min("doc_id"), F.max("doc_id"), F.max("line")).first()
    if low is None:
        return F.col("doc_id")
    bits = int(last).bit_length()
    if high - low < 1 << (63 - bits):
        return F.shiftleft(F.col("doc_id") - low, bits).bitwiseOR(F.col("line").cast("long"))
    return F.struct("doc_id", "line")


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS, near_chars: int | None = NEAR_CHARS) -> DataFrame:
    """doc_id, line (from 0): the lines that go."""
    spark = prepare(docs.sparkSession)
    scratch = Scratch(spark, "line-dedup")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    lines = scratch.put(texts.mapInArrow(tidy(lambda b: _lines(min_words, near_words, near_chars, b)), _LINES), "lines")
    lines = lines.withColumn("place", _place(lines))
    firsts = scratch.put(lines.groupBy("h1", "h2").agg(F.min("place").alias("first")), "firsts")
    standing = lines.select("doc_id", "line", "place", *HALVES, F.col("h1").alias("l1"), F.col("h2").alias("l2"))
    standing = scratch.put(standing.join(firsts, (F.col("l1") == F.col("h1")) & (F.col("l2") == F.col("h2")) & (F.col("place") == F.col("first"))).select("doc_id", "line", "place", *HALVES), "standing")

    # Lines that share a half with another line, and which.
    sides = F.array(*[F.struct(F.col(c).alias("key"), F.lit(c.startswith("prefix")).alias("front_same")) for c in HALVES])
    keyed = standing.filter("prefix0 IS NOT NULL").select("place", F.explode(sides).alias("x")).select("place", "x.key", "x.front_same").filter("key IS NOT NULL")
    shared = scratch.put(keyed.groupBy("key").agg(F.min("place").alias("low"), F.max("place").alias("high")).filter("low < high").select(F.col("key").alias("k")), "shared")
    met = keyed.join(shared, F.col("key") == F.col("k"), "left_semi")
    sharing = met.groupBy("place").agg(F.max("front_same").alias("back"), F.max(~F.col("front_same")).alias("front"))
    wanted = scratch.put(standing.select("doc_id", "line", F.col("place").alias("p")).join(sharing, F.col("p") == F.col("place")).select("doc_id", "line", "place", "back", "front"), "wanted")

    each = F.struct("line", "place", "back", "front")
    per_doc = wanted.groupBy(F.col("doc_id").alias("wd")).agg(F.collect_list(each).alias("wanted"))
    spoken = texts.join(per_doc.hint("merge"), F.col("doc_id") == F.col("wd")).select("doc_id", "text", "wanted")
    kind = wanted.schema["place"].dataType.simpleString()
    held = scratch.put(spoken.mapInArrow(tidy(lambda b: _pick(near_words, near_chars, b)), f"place {kind}, words string, front boolean, back boolean"), "held")

    variants = held.mapInArrow(tidy(_variants), f"key long, kind tinyint, place {kind}")
    least = lambda k: F.min(F.when(F.col("kind") == k, F.col("place")))
    earliest = variants.groupBy("key").agg(least(0).alias("placed"), least(1).alias("longer"), least(2).alias("whole"), F.count(F.lit(1)).alias("c"))
    met_keys = scratch.put(earliest.filter("c > 1 AND (placed IS NOT NULL OR longer IS NOT NULL AND whole IS NOT NULL)").select(F.col("key").alias("k"), "placed", "longer", "whole"), "met-keys")
    # A variant meets the earliest with the same place left out, or the whole line that it equals; a whole line the earliest longer one.
    again = variants.join(met_keys, F.col("key") == F.col("k"))
    early = F.when(F.col("kind") == 0, F.col("placed")).when(F.col("kind") == 1, F.col("whole")).otherwise(F.col("longer"))
    found = again.withColumn("early", early).filter(F.col("early") < F.col("place")).groupBy("place").agg(F.min("early").alias("early"))
    found = scratch.put(found.withColumnRenamed("place", "late"), "found")
    late_words, early_words = held.select("place", "words"), held.select(F.col("place").alias("ep"), F.col("words").alias("early_words"))
    pairs = found.join(late_words, F.col("late") == F.col("place")).join(early_words, F.col("early") == F.col("ep"))
    near = scratch.put(pairs.select("place", "words", "early_words").mapInArrow(_verify, f"place {kind}").select(F.col("place").alias("np")), "near")

    kept = standing.select(F.col("doc_id").alias("kd"), F.col("line").alias("kl"), "place").join(near, F.col("place") == F.col("np"), "left_anti")
    return lines.select("doc_id", "line").distinct().join(kept, (F.col("doc_id") == F.col("kd")) & (F.col("line") == F.col("kl")), "left_anti")


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the lines that go."""
    for batch in batches:
        texts, sizes, gone_n = [], [], []
        for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
            lines = (text or "").split("\n")
            out = {k for k in gone or () if k < len(lines)}
            texts.append(text if not out else "\n".join(x for k, x in enumerate(lines) if k not in out))
            sizes.append(len(lines))
            gone_n.append(len(out))
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string()), "n_lines": pa.array(sizes, pa.int64()), "n_dropped": pa.array(gone_n, pa.int64())})


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, text (without the lines that go), n_lines (before), n_dropped for each row."""
    gone = dropped_lines(docs, id_col, text_col, **options).groupBy(F.col("doc_id").alias("gd")).agg(F.collect_list("line").alias("gone"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(gone.hint("merge"), F.col("doc_id") == F.col("gd"), "left").select("doc_id", "text", "gone").mapInArrow(tidy(_rewrite), "doc_id long, text string, n_lines long, n_dropped long")
