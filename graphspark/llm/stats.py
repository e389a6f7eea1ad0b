"""Counts over a whole text from which the quality operators start.

Words are maximal runs of characters other than the ASCII white space U+0009-U+000D and U+0020. A null text counts
as empty: all counts are 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphspark.llm.common import plain, small_batches, texts_of

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_lines", "n_upper", "n_digits", "n_punct", "n_top_word", "n_short", "n_adjacent", "n_long")

_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_PUNCT = b".,;:!?'\"()-"
_NOT = {name: bytes(b for b in range(256) if b not in keep) for name, keep in (("sym", _SYMBOLS), ("up", _UPPER), ("dig", _DIGITS), ("pun", _PUNCT))}
_WINDOW = 5


def repeated_words(ids: np.ndarray, window: int = _WINDOW) -> int:
    """Words that lie in a window of `window` words found twice or more, the first one included."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    distinct = int(ids.max()) + 1
    key = ids[:n].copy()
    for k in range(1, window):  # exact: pairs of (prefix, word) are numbered anew at each step
        pair = key * distinct + ids[k : k + n]
        key = np.unique(pair, return_inverse=True)[1] if k < window - 1 else pair
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    cover = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover) > 0).sum())


def text_counts(text: str) -> list[int]:
    """The counts of COUNTS, in that order."""
    raw = text.encode()
    words = raw.split()
    if not words:
        return [0, 0, len(raw.translate(None, _NOT["sym"])), *[0] * 11]
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    per = np.bincount(ids)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    chars = len(text) - sum(map(raw.count, (b" ", b"\n", b"\t", b"\r", b"\v", b"\f")))
    sizes = np.fromiter(map(len, numbers), np.int64, len(numbers))
    return [
        len(words), chars, len(raw.translate(None, _NOT["sym"])), len(lines) - len(set(lines)), repeated_words(ids) if len(numbers) < len(words) else 0,
        len(numbers), len(lines), len(raw.translate(None, _NOT["up"])), len(raw.translate(None, _NOT["dig"])), len(raw.translate(None, _NOT["pun"])),
        int(per.max()), int(per[sizes <= 3].sum()), int((ids[1:] == ids[:-1]).sum()), int(per[sizes > 14].sum()),
    ]


def with_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns `keep`, and the counts of each row's text."""
    small_batches(df.sparkSession)
    rows = plain(df, ("doc_id", id_col), ("text", text_col), *keep)
    kinds = [(f.name, f.dataType.simpleString()) for f in rows.schema.fields if f.name != "text"]
    names = [k for k, _ in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            table = np.array([text_counts(t) for t in texts_of(b)], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in names), *(pa.array(np.ascontiguousarray(table[:, i])) for i in range(len(COUNTS)))], [*names, *COUNTS])

    return rows.mapInArrow(run, ", ".join([*(f"`{k}` {t}" for k, t in kinds), *(f"{c} long" for c in COUNTS)]))


#: Statistics that are shrunk towards a usual value: counted, out of, with the weight of so many words, transformed.
SHRUNK = {
    "word_length": ("word_chars", "n_words", 20, False), "symbols": ("n_symbols", "n_words", 20, True),
    "dup_lines": ("n_dup_lines", "n_lines", 4, True), "repeats": ("n_repeat_words", "n_words", 20, True),
    "upper": ("n_upper", "n_words", 40, True), "digits": ("n_digits", "n_words", 40, True),
    "punct": ("n_punct", "n_words", 40, True), "top_word": ("n_top_word", "n_words", 60, True),
    "short": ("n_short", "n_words", 40, False), "adjacent": ("n_adjacent", "n_words", 40, True),
    "long": ("n_long", "n_words", 40, True), "variety": ("n_distinct", "n_words", 40, False),
}
#: Usual values where none are measured.
USUAL = {"word_length": 5.0, "upper": 0.07, "punct": 0.15, "top_word": 0.06, "short": 0.35, "adjacent": 0.02, "long": 0.05, "variety": 0.8}


def features(usual: dict[str, float] = USUAL) -> dict[str, Column]:
    """Scale-free statistics. The rate of a short text is shrunk towards a usual value (USUAL, or what usual_rates()
    measured; 0 for others), as it is known less well; the rest stands as it is."""
    words, out = F.col("n_words").cast("double"), {}
    for name, (count, base, weight, root) in SHRUNK.items():
        rate = (F.col(count) + F.lit(usual.get(name, 0.0) * weight)) / (F.col(base) + F.lit(float(weight)))
        out[name] = F.sqrt(rate) if root else rate
    out["variety"] = out["variety"] + F.log1p(words) * 0.06
    return out | {"size": F.log1p(words), "line_words": F.log((words + 40.0) / (F.col("n_lines") + 4.0))}


def usual_rates(counts: DataFrame, names: tuple[str, ...]) -> dict[str, float]:
    """The median rate of each statistic over all rows with words: exact, of rates in steps of 1/1000."""
    rates = {n: F.col(SHRUNK[n][0]) / F.col(SHRUNK[n][1]) for n in names}
    row = counts.where("n_words > 0").agg(*[F.median(F.round(c, 3)).alias(n) for n, c in rates.items()]).first()
    return {n: float(row[n] or 0.0) for n in names}


_BRUTE = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text: str) -> list[int]:
    """The first five counts, straight from their definitions; for tests."""
    words = _BRUTE.findall(text)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if _BRUTE.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w in windows if windows.count(w) > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(5)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)]
