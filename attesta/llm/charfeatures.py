"""Character n-grams of the distinct words of a slice of texts, hashed into a fixed number of dimensions.

N-grams are over code points of the lower-cased word with a space on either side, as one word's features never depend on
its neighbours; each distinct word is taken apart once for a slice, whatever its number of uses.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from attesta.llm.textarrays import U64, keys64, mix64, text_bytes, word_hashes, words

_LETTER: np.ndarray | None = None


def letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


@dataclass
class Slice:
    """rows and word of each token; feature indices of each distinct word, words one after another."""

    n: int
    rows: np.ndarray
    word: np.ndarray
    feature: np.ndarray
    owner: np.ndarray
    n_words: int
    has_letter: np.ndarray

    def word_sums(self, table: np.ndarray) -> np.ndarray:
        """The sum of a table over the features of each distinct word."""
        return np.bincount(self.owner, weights=table[self.feature], minlength=self.n_words)

    def row_sums(self, of_word: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights=of_word[self.word], minlength=self.n)

    def distinct(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, feature), once for each feature of a row, of the features where ``chosen`` is true."""
        keep = chosen[self.feature]
        feature, owner = self.feature[keep], self.owner[keep]
        count = np.bincount(owner, minlength=self.n_words)
        first = np.cumsum(count) - count
        live = count[self.word] > 0
        pair = np.unique(self.rows[live] * np.int64(self.n_words) + self.word[live])
        row, word = pair // self.n_words, pair % self.n_words
        c = count[word]
        at = np.repeat(first[word] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))
        both = np.unique(np.repeat(row, c) * np.int64(len(chosen)) + feature[at])
        return both // len(chosen), both % len(chosen)

    def counts(self, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, feature, count)."""
        c = np.bincount(self.owner, minlength=self.n_words)
        first = np.cumsum(c) - c
        pair, uses = np.unique(self.rows * np.int64(self.n_words) + self.word, return_counts=True)
        row, word = pair // self.n_words, pair % self.n_words
        at = np.repeat(first[word] - (np.cumsum(c[word]) - c[word]), c[word]) + np.arange(int(c[word].sum()))
        key, index = np.unique(np.repeat(row, c[word]) * np.int64(dims) + self.feature[at], return_inverse=True)
        return key // dims, key % dims, np.bincount(index, weights=np.repeat(uses, c[word]))


def take_apart(texts, lengths: tuple[int, ...], bits: int) -> Slice:
    """lengths: of the n-grams. bits: features are hashes of so many bits."""
    raw, offs = text_bytes(texts)
    starts, ends, rows = words(raw, offs)
    n = len(offs) - 1
    if not len(starts):
        z = np.zeros(0, np.int64)
        return Slice(n, z, z, z, z, 0, np.zeros(0, bool))
    _, at, word = np.unique(word_hashes(raw, starts, ends), return_index=True, return_inverse=True)
    # each distinct word after a space, and one at the end; words hold no space themselves
    lens = ends[at] - starts[at]
    to = np.cumsum(lens + 1) - lens
    joined = np.full(int((lens + 1).sum()) + 1, 32, np.uint8)
    step = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
    joined[np.repeat(to, lens) + step] = raw[np.repeat(starts[at], lens) + step]
    lower = joined.tobytes().decode("utf-8", "replace").lower()
    cp = np.frombuffer(lower.encode("utf-32-le"), np.uint32)
    gap = cp == 32
    index = np.cumsum(gap) - 1
    feature, owner = [], []
    inner = index.copy()
    inner[gap] = -1
    for k in lengths:
        if len(cp) < k:
            continue
        m = len(cp) - k + 1
        key = keys64(k, 40 + k)
        h = np.zeros(m, U64)
        for j in range(k):
            h += (cp[j : j + m].astype(U64) + U64(1)) * key[j]
        # a space may only be the first or the last character
        spaces = np.cumsum(np.r_[0, gap])
        middle = spaces[k - 1 : k - 1 + m] - spaces[1 : 1 + m] if k > 1 else np.zeros(m, np.int64)
        good = (middle == 0) & ~(gap[:m] & gap[k - 1 : k - 1 + m]) if k > 1 else ~gap
        where = np.flatnonzero(good)
        own = np.where(gap[where], index[where], inner[where])
        feature.append((mix64(h[where]) >> U64(64 - bits)).astype(np.int64))
        owner.append(own)
    letter = np.bincount(inner[~gap], weights=letters()[cp[~gap]], minlength=len(at)) > 0
    owner_all = np.concatenate(owner)
    order = np.argsort(owner_all, kind="stable")
    return Slice(n, rows, word, np.concatenate(feature)[order], owner_all[order], len(at), letter)


def held_out(id_col: str, modulus: int, remainder: int):
    """Column: crc32 of the id as text, modulo."""
    from pyspark.sql import functions as F

    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))
