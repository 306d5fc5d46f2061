"""Longest common subsequences of many names with many titles at once.

Bit-parallel over the characters of a name, with a step for each node of the titles' prefix tree: titles that begin alike
share their steps. Names of more than 64 characters are taken in pieces, whose lengths add up to an upper bound.
"""

from __future__ import annotations

import numpy as np

WORD = 64


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and where each begins (one more: the end)."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])


class Titles:
    """Prefix tree of titles by levels: for each level the parents and characters of its nodes, and the titles that end there."""

    def __init__(self, titles: list[str]):
        order = np.array(sorted(range(len(titles)), key=titles.__getitem__), np.int64)
        flat, starts = _codes([titles[k] for k in order])
        self.letters, flat = np.unique(flat, return_inverse=True)
        self.sizes = np.array([len(t) for t in titles], np.int64)
        sizes, rows, node, level = np.diff(starts), np.arange(len(titles)), np.zeros(len(titles), np.int64), 0
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        while True:
            kept = sizes[rows] > level
            rows, node = rows[kept], node[kept]
            if not len(rows):
                break
            char = flat[starts[rows] + level]
            first = np.concatenate([[True], (node[1:] != node[:-1]) | (char[1:] != char[:-1])])
            at = np.cumsum(first) - 1
            ends = sizes[rows] == level + 1
            self.levels.append((node[first], char[first], order[rows[ends]], at[ends]))
            node, level = at, level + 1

    def common(self, keys: list[str]) -> np.ndarray:
        """A row for each key: the length of its longest common subsequence with each title, or a bound above it."""
        pieces = [(k, key[i : i + WORD]) for k, key in enumerate(keys) for i in range(0, len(key), WORD)]
        out = np.zeros((len(keys), len(self.sizes)), np.int32)
        if not pieces or not self.levels:
            return out
        word = np.uint32 if max(len(p) for _, p in pieces) <= 32 else np.uint64
        masks = np.zeros((len(self.letters), len(pieces)), word)
        flat, starts = _codes([p for _, p in pieces])
        of = np.repeat(np.arange(len(pieces)), np.diff(starts))
        letter = np.minimum(np.searchsorted(self.letters, flat), len(self.letters) - 1)
        known = self.letters[letter] == flat
        bits = np.left_shift(word(1), (np.arange(len(flat)) - starts[of]).astype(word))
        np.bitwise_or.at(masks, (letter[known], of[known]), bits[known])
        low = np.array([(1 << len(p)) - 1 for _, p in pieces], word)
        found = np.zeros((len(self.sizes), len(pieces)), np.uint8)
        state = np.full((1, len(pieces)), ~word(0), word)
        for parent, char, titles, node in self.levels:
            state, match = state[parent], masks[char]
            np.bitwise_and(state, match, out=match)
            carried = state + match
            np.subtract(state, match, out=state)
            np.bitwise_or(state, carried, out=state)
            if len(titles):
                found[titles] = np.bitwise_count(~state[node] & low)
        found = np.ascontiguousarray(found.T)
        for (k, _), row in zip(pieces, found, strict=True):
            out[k] += row
        return np.minimum(out, self.sizes)
