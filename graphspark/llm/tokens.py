"""Token counts by byte-pair merging with a heap and a linked list.

A text is cut into pieces by the tokenizer's pattern. A piece's symbols form a linked list and the adjacent
pairs that have a merge rule wait in a heap; the pair of the lowest rank, leftmost first, is merged until none is
left. The piece's count is its initial symbols minus the merges: no identifiers are looked up or emitted.

Defined cases: a null or empty text has 0 bytes and 0 tokens; a special token's string inside a text counts as
one token, as the library does by default; repeated rows and null ids each give a row; an empty table gives no
rows; extra columns are ignored. Texts of any length are counted whole.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from graphspark.llm.common import plain, small_batches, texts_of

# Fixed value: the split pattern of byte-level BPE vocabularies of this family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Counts that a worker remembers by piece, at most; beyond that it starts afresh.
REMEMBERED = 400_000
#: Pieces longer than this are counted each time.
LONG_PIECE = 40


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte value: printable Latin-1 stands for itself, the other bytes for
    the code points from 256 on, in order."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


def load_byte_bpe(path: str) -> tuple[dict[tuple[str, str], int], list[str]]:
    """Merge ranks by pair and the added tokens' strings of a tokenizer .json file (read on the driver)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec.get("normalizer"):
        raise ValueError("only byte-level BPE vocabularies without a normalizer are supported")
    pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"])
    return {p: rank for rank, p in enumerate(pairs)}, [t["content"] for t in spec["added_tokens"]]


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many symbols remain when the pair of the lowest rank has been merged again and again."""
    n = len(symbols)
    if n < 2:
        return n
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i] if symbols[i] else n
        if j >= n or symbols[i] != left or symbols[j] != right:
            continue  # one of the two has been merged meanwhile
        symbols[i], symbols[j] = left + right, ""
        after[i] = k = after[j]
        merges += 1
        if k < n:
            before[k] = i
            if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
        if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
    return n - merges


class PieceCounts(dict):
    """Token counts by piece, filled on demand and bounded."""

    def __init__(self, ranks: dict[tuple[str, str], int]) -> None:
        super().__init__()
        self.ranks, self.symbols = ranks, byte_symbols()

    def __missing__(self, piece: str) -> int:
        raw = piece.encode()
        n = merged_length([self.symbols[b] for b in raw], self.ranks)
        if len(raw) <= LONG_PIECE:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = n
        return n


class Counter:
    """Counts the tokens of texts."""

    def __init__(self, ranks: dict[tuple[str, str], int], special: Iterable[str]) -> None:
        self.counts, self.pieces = PieceCounts(ranks), regex.compile(PATTERN)
        special = sorted(special, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def plain(self, text: str) -> int:
        if len(text) > 2_000_000:  # no list of all pieces of a huge text
            return sum(self.counts[m[0]] for m in self.pieces.finditer(text))
        return sum(map(self.counts.__getitem__, self.pieces.findall(text)))

    def __call__(self, text: str) -> int:
        if self.special is None:
            return self.plain(text)
        found = len(self.special.findall(text))
        return found + sum(map(self.plain, self.special.split(text))) if found else self.plain(text)


_counters: dict[str, Counter] = {}


def count_tokens(df: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row, with the vocabulary file at `path`.

    The ranks go to the executors as one broadcast; its size is that of the vocabulary, whatever the data's."""
    spark = df.sparkSession
    small_batches(spark)
    vocabulary = spark.sparkContext.broadcast(load_byte_bpe(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counters.get(path) or _counters.setdefault(path, Counter(*vocabulary.value))
        for b in batches:
            texts = texts_of(b)
            n = [count(t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = plain(df, ("doc_id", id_col), ("text", text_col))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
