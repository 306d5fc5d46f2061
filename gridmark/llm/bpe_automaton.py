"""BPE encoding and decoding with a tokenization automaton.

Compilation. The automaton accepts exactly the token sequences that applying the merges in order would give. It starts
with one state that every base symbol loops on. A merge (a, b) -> c is then installed as a gadget: a state that has an
a-arc to a state with a b-arc gets a c-arc to where the b-arc leads, and the a-arc is led to a copy of its target
without the b-arc, so that a and b can't stand side by side any more. All arcs of a token always lead to one state, and
so a state is named by the token last read. Copies are not stored arc by arc: an arc of a state is missing if and only
if a gadget took it from the state, or from a state that it was copied from before, which is a question to the gadgets
of the parts of two tokens (``_Automaton._meet``). A merge whose own two parts can't meet when it is installed has no arcs.

The arcs are then spelled out in bytes and made deterministic by the subset construction: every prefix of a word has one
accepting path at most, so a state over bytes is the set of tokens begun, each with the token before it. Entries of the
transition table are compiled when a state first meets a byte and kept up to a bound (then the table starts anew); words
of natural text share them.

Encoding. Texts are split into words (and special tokens) as the tokenizer does. A word is one look-up per byte; each
entry names the arc, if any, that ends at that byte, and the arcs that lead from the end to the start are the tokens.
No step is taken back. Paths of words are kept in a bounded table. Decoding emits the labels (bytes) of the arcs, for
whole arrays of ids.

Defined results. Null or empty text: no tokens, and the empty text. Null ids and repeated rows: a row each, as any
other. Special tokens inside a text become their ids, as is the library's default. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from gridmark.llm.common import prepare, row_slices, tidy

PIECE = 1_000_000
KEPT_WORDS, KEPT_ARCS = 120_000, 400_000
#: Fixed value: how byte-level vocabularies split texts into words.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NEVER, _START = 1 << 60, -1


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 as itself, others from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in own)
    moved = {b: chr(0x100 + k) for k, b in enumerate(others)}
    return [chr(b) if b in own else moved[b] for b in range(256)]


class _Automaton:
    """merges: pairs of tokens and the token that they make, in order; labels: bytes of each token.

    ``table`` has an entry for each state and byte that was met: the next state, the token whose path ends there and its
    length. A state is a set of places: the token last read where a place begins, and the node of the trie of labels
    that the bytes since then lead to. State 0 is the start of a word.
    """

    def __init__(self, base: dict[bytes, int], merges: list[tuple[int, int, int]], labels: list[bytes]):
        self.gadget: dict[tuple[int, int], int] = {}  # rank of the merge that parts a pair
        self.parts: dict[int, tuple[int, int, int]] = {}  # of a token: left, right, rank
        self._right: dict[int, list] = {}
        self._left: dict[int, list] = {}
        self.tokens: dict[bytes, int] = dict(base)
        for rank, (a, b, c) in enumerate(merges):
            if self._meet(a, b, rank) and labels[c] not in self.tokens:
                self.parts[c] = (a, b, rank)
                self.tokens[labels[c]] = c
            self.gadget.setdefault((a, b), rank)
        self.size = {t: len(label) for label, t in self.tokens.items()}
        self._spell()
        self._clear()

    def _spell(self) -> None:
        """The trie of labels: node 0 is its root; child by node and byte, and the token that a node spells."""
        self.child: dict[int, int] = {}
        self.spelled: list[int] = [-1]
        for label, token in self.tokens.items():
            node = 0
            for byte in label:
                key = node << 8 | byte
                if (after := self.child.get(key)) is None:
                    after = self.child[key] = len(self.spelled)
                    self.spelled.append(-1)
                node = after
            self.spelled[node] = token

    def _clear(self) -> None:
        self.states: list[tuple[tuple[int, int], ...]] = [((_START, 0),)]
        self.named: dict[tuple[tuple[int, int], ...], int] = {self.states[0]: 0}
        self.table: dict[int, tuple[int, int, int]] = {}

    def _edge(self, token: int, side: int, known: dict[int, list]) -> list[tuple[int, int]]:
        """The parts along one edge of a token, from the whole inwards, and the rank of the merge that takes each up."""
        if (found := known.get(token)) is None:
            found, t, until = [(token, _NEVER)], token, 0
            while t in self.parts:
                *pair, until = self.parts[t]
                t = pair[side]
                found.append((t, until))
            known[token] = found
        return found

    def _meet(self, t: int, u: int, before: int) -> bool:
        """Whether t and u can stand side by side once the gadgets of ranks under ``before`` are installed.

        They can't if a part x that once ended t and a part y that once began u were both there when the gadget
        of (x, y) came. Where one rank concerns all (runs of one symbol) the leftmost pair goes first.
        """
        rank_of = self.gadget.get
        for x, x_until in self._edge(t, 1, self._right):
            for y, y_until in self._edge(u, 0, self._left):
                r = rank_of((x, y))
                if r is not None and r < before and r < x_until and r <= y_until:
                    return False
        return True

    def _compile(self, state: int, byte: int) -> tuple[int, int, int]:
        """The table's entry for a state and a byte: every place moves on, and one at most ends in a token that has an arc."""
        moved, ends = [], None
        for last, node in self.states[state]:
            if (after := self.child.get(node << 8 | byte)) is None:
                continue
            moved.append((last, after))
            token = self.spelled[after]
            if token >= 0 and (last == _START or self._meet(last, token, _NEVER)):
                ends = token
        if ends is None:  # no text ends here in a whole path, though a longer one can
            after, token, size = tuple(moved), -1, 0
        else:
            after, token, size = (*moved, (ends, 0)), ends, self.size[ends]
        if (number := self.named.get(after)) is None:
            number = self.named[after] = len(self.states)
            self.states.append(after)
        found = self.table[state << 8 | byte] = (number, token, size)
        return found

    def run(self, word: bytes) -> list[int]:
        """The accepting path of a word: one step of the table for each byte, then the arcs that led to its end."""
        if (whole := self.tokens.get(word)) is not None:
            return [whole]
        if len(self.table) >= KEPT_ARCS:
            self._clear()
        table, state, ended = self.table, 0, []
        for byte in word:
            step = table.get(state << 8 | byte) or self._compile(state, byte)
            state = step[0]
            ended.append(step)
        path, at = [], len(word)
        while at:
            _, token, size = ended[at - 1]
            if token < 0:
                raise ValueError(f"no path for {word!r}")
            path.append(token)
            at -= size
        path.reverse()
        return path


class BpeCodec:
    """Encodes and decodes with the vocabulary of a byte-level tokenizers .json file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        plain = spec["normalizer"] is None and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]
        if not plain or model["type"] != "BPE" or model["unk_token"] or model["end_of_word_suffix"] or model["continuing_subword_prefix"]:
            raise ValueError("only plain byte-level BPE is supported")
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        vocab = model["vocab"]
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        labels = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for text, i in vocab.items():
            labels[i] = bytes(byte_of[c] for c in text)
        for text, i in special.items():
            labels[i] = text.encode()
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        base = {bytes([b]): vocab[c] for c, b in byte_of.items() if c in vocab}
        self.automaton = _Automaton(base, merges, labels)
        self.special = special
        self._split = regex.compile(SPLIT).findall
        self._special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        self._paths = _Paths(self.automaton)
        self._sizes = np.array([len(x) for x in labels], np.int64)
        self._ends = np.cumsum(self._sizes)
        self._flat = np.frombuffer(b"".join(labels), np.uint8)

    def encode(self, text: str) -> bytes:
        """ids as little-endian unsigned 32-bit integers."""
        path = self._paths.__getitem__
        if self._special is None or not self._special.search(text):
            return b"".join(map(path, self._split(text)))
        out = []
        for part in self._special.split(text):
            out += [self.special[part].to_bytes(4, "little")] if part in self.special else map(path, self._split(part))
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        """The labels of ids, one after the other."""
        if not len(ids):
            return b""
        size = self._sizes[ids]
        stop = np.cumsum(size)
        shift = np.repeat(self._ends[ids] - stop, size)
        shift += np.arange(len(shift))
        return self._flat[shift].tobytes()


class _Paths(dict):
    """Paths of words, as bytes of ids; starts anew when full."""

    def __init__(self, automaton: _Automaton):
        self.automaton = automaton

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KEPT_WORDS:
            self.clear()
        path = self.automaton.run(word.encode())
        found = self[word] = b"".join([i.to_bytes(4, "little") for i in path])
        return found


@lru_cache(maxsize=2)
def codec(path: str) -> BpeCodec:
    return BpeCodec(path)


def _round(path: str, ids_too: bool, texts_too: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bpe = codec(path)
    for batch in batches:
        for rows, texts in row_slices(batch, "text", PIECE):
            counts, ids_of, hashes, back, decoded = [], [], [], [], []
            for text in texts.to_pylist():
                encoded = bpe.encode(text)
                ids = np.frombuffer(encoded, "<u4")
                found = bpe.decode(ids)
                try:
                    found.decode()
                except UnicodeDecodeError:
                    found = found.decode(errors="replace").encode()
                counts.append(len(ids))
                hashes.append(hashlib.sha256(encoded).hexdigest())
                back.append(hashlib.sha256(found).hexdigest())
                if ids_too:
                    ids_of.append(ids)
                if texts_too:
                    decoded.append(found.decode())
            out = {"doc_id": rows.column("doc_id"), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(hashes, pa.string()), "decoded_sha256": pa.array(back, pa.string())}
            if ids_too:
                out["ids"] = pa.array([x.astype(np.int32) for x in ids_of], pa.list_(pa.int32()))
            if texts_too:
                out["decoded"] = pa.array(decoded, pa.string())
            yield pa.record_batch(out)


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids_too: bool = False, texts_too: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row; at wish also ids and decoded, the text from the ids."""
    prepare(docs.sparkSession)
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids_too + ", decoded string" * texts_too
    return read.mapInArrow(tidy(lambda batches: _round(path, ids_too, texts_too, batches)), schema)
