"""Similarity of strings and vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaro_of(a: str, b: str) -> float:
    """The mean of three shares: matches in either string, and matches in order. Characters match within a window of
    half the longer length, less one."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free, hits = [True] * len(b), []
    for i, ch in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if free[j] and b[j] == ch), None)
        if j is not None:
            free[j] = False
            hits.append(ch)
    if not hits:
        return 0.0
    other = [ch for ch, f in zip(b, free) if not f]
    swaps = sum(x != y for x, y in zip(hits, other)) / 2
    m = len(hits)
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler_of(a: str, b: str, factor: float = 0.1) -> float:
    """Jaro, raised for a common prefix of up to four characters; the boost applies to any Jaro value."""
    jaro = jaro_of(a, b)
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * min(factor, 0.25) * (1 - jaro)


class MaskedTexts:
    """Texts as arrays, for bounds on Jaro-Winkler and for scores of many pairs at once: the places of a character in a
    text are the bits of a number, so texts of up to WORD characters are scored so, and others by a function."""

    WORD, CLASSES, LEVELS, CELLS, PAIRS = 64, 64, 8, 1 << 22, 1 << 14

    def __init__(self, texts: list[str]) -> None:
        self.texts, self.length = texts, np.array([len(t) for t in texts])
        flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        known, self._rank = np.unique(flat, return_inverse=True)
        self._at = np.repeat(np.arange(len(texts)), self.length)
        self._pos = np.arange(len(flat)) - np.repeat(np.cumsum(self.length) - self.length, self.length)
        #: The first four characters; what a text has not is unlike anything in another.
        self.start = np.repeat(-1 - np.arange(len(texts))[:, None], 4, 1)
        early = self._pos < 4
        self.start[self._at[early], self._pos[early]] = self._rank[early]
        self._none = len(known)  # stands for no character
        self._chars = np.full((len(texts), min(self.WORD, max(1, self.length.max(initial=0)))), self._none, np.int32)
        short = self._pos < self.WORD
        self._chars[self._at[short], self._pos[short]] = self._rank[short]
        self._masks: np.ndarray | None = None
        if len(texts) * (self._none + 1) <= self.CELLS:
            self._masks = np.zeros(len(texts) * (self._none + 1), np.uint64)
            np.bitwise_or.at(self._masks, self._at[short] * (self._none + 1) + self._rank[short], np.uint64(1) << self._pos[short].astype(np.uint64))

    def held(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The characters of each text as bits (words of 64), one for the first, second ... of each up to LEVELS, and the
        number of further ones. Common bits and the smaller number of further ones are no fewer than the characters that
        two texts share. Beyond CLASSES characters some count as one, which only lifts this. Left out are bits that none
        of the first n texts has or none of the rest."""
        counts = np.bincount(self._at * self.CLASSES + self._rank % self.CLASSES, minlength=self.CLASSES * len(self.texts)).reshape(-1, self.CLASSES)
        low = np.minimum(counts, self.LEVELS)
        most = np.minimum(low[:n].max(0), low[n:].max(0))
        columns = np.array([(c, k) for c in range(self.CLASSES) for k in range(1, most[c] + 1)], np.int64).reshape(-1, 2)
        packed = np.packbits(low[:, columns[:, 0]] >= columns[:, 1], axis=1)
        words = np.zeros((len(self.texts), max(1, -(-packed.shape[1] // 8)) * 8), np.uint8)
        words[:, : packed.shape[1]] = packed
        return words.view(np.uint64), (counts - low).sum(1)

    def scores(self, x: np.ndarray, y: np.ndarray, floor: np.ndarray, of: Callable[[str, str], float]) -> np.ndarray:
        """Jaro-Winkler of the texts at x and y, the same double as of(); -1 may stand for one below its floor."""
        out = np.full(len(x), -1.0)
        fits = (self._masks is not None) & (np.maximum(self.length[x], self.length[y]) <= self.WORD)
        for k in np.flatnonzero(~fits).tolist():
            out[k] = of(self.texts[x[k]], self.texts[y[k]])
        at = np.flatnonzero(fits)
        for k in range(0, len(at), self.PAIRS):
            part = at[k : k + self.PAIRS]
            out[part] = self._scores(x[part], y[part], floor[part])
        return out

    def _scores(self, x: np.ndarray, y: np.ndarray, floor: np.ndarray) -> np.ndarray:
        one, la, lb = np.uint64(1), self.length[x], self.length[y]
        reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
        window = (one << (reach + 1).astype(np.uint64)) - one  # at most 32 bits
        chars, row = self._chars[x].T.copy(), y * (self._none + 1)
        mine, theirs = np.zeros(len(x), np.uint64), np.zeros(len(x), np.uint64)
        for i in range(int(la.max())):
            open_ = self._masks[row + chars[i]] & window & ~theirs
            theirs |= open_ & -open_
            mine |= (open_ != 0).astype(np.uint64) << np.uint64(i)
            window = (window << one) | (reach > i)
        m = np.bitwise_count(mine).astype(np.int64)
        prefix = np.cumprod(self.start[x] == self.start[y], axis=1).sum(1)
        score = lambda swaps: (j := np.where(la + lb == 0, 1.0, np.where(m == 0, 0.0, (m / np.maximum(la, 1) + m / np.maximum(lb, 1) + (m - swaps) / np.maximum(m, 1)) / 3))) + prefix * 0.1 * (1 - j)
        out = np.full(len(x), -1.0)
        k = np.flatnonzero(score(0) >= floor - 1e-9)
        la, lb, m, prefix, row, chars, mine, theirs = la[k], lb[k], m[k], prefix[k], row[k], chars[:, k], mine[k], theirs[k]
        swaps = np.zeros(len(k), np.int64)
        for _ in range(int(m.max(initial=0))):
            i = np.bitwise_count((mine & -mine) - one).astype(np.int64)
            char = chars[np.minimum(i, len(chars) - 1), np.arange(len(k))]
            swaps += (mine != 0) & ((self._masks[row + char] & theirs & -theirs) == 0)
            mine &= mine - one
            theirs &= theirs - one
        out[k] = score(swaps / 2)
        return out


@F.pandas_udf(T.DoubleType())
def jaro_winkler(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """jaro_winkler_of() by Arrow batches; null if either is null."""
    for a, b in pairs:
        yield pd.Series([None if x is None or y is None else jaro_winkler_of(x, y) for x, y in zip(a, b)], dtype="float64")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, in double; 0 for unlike lengths, an empty or a zero vector."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    fine = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > 0)
    return F.coalesce(F.when(fine, dot(a, b) / norms), F.lit(0.0))


def key_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays; 1 if both are empty."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / either)
