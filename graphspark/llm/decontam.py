"""Benchmark decontamination by spaced seeds.

Fixed masks over windows of tokens ignore some positions; the tokens at the others are hashed. Hashes of the
benchmark's texts are joined with those of the training texts, so a window is found even when tokens at ignored
positions were substituted. Around each hit the two texts are compared along the hit's diagonal; any run of at least
`min_tokens` tokens (or of a shorter benchmark text's length), a share `identity` of them equal, makes a pair. Reported is
the best-scoring run (a match counts 1, a mismatch -2) where it meets both bounds, else the one with most to spare.
The masks hit every run of 12 tokens or more with 80 % equal; benchmark texts shorter than that have a shorter mask, too,
and those of fewer than 6 tokens one of their own length: they count only verbatim.

The benchmark is dealt into blocks of bounded size; each block's hash table is broadcast and meets every row of the
training table, so no training text is shuffled and no block outgrows a worker, however large the benchmark. Of several
blocks each has a job of its own, over tokens stored once, and its table is taken back before the next one.

Defined cases: null and empty texts hold nothing and are held by none; repeated rows each count; equal benchmark texts
each give a pair; null ids are kept as null; empty tables give no pairs; extra columns are ignored; texts of any
length are compared whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspark.llm.common import mix64, plain, small_batches, stored, texts_of

# The masks; 1 marks a position that counts.
MASKS = ("111111", "11011011", "110100111", "1010110011", "11001010101", "101001100101")
#: Tokens of a benchmark block, about.
BLOCK_TOKENS = 500_000
#: Only for benchmark texts of fewer tokens than SHORT: 3 tokens in a row are equal in 80 % of 6 to 11. Texts of fewer
#: than TINY tokens have a mask of their length.
SHORT, SHORT_MASK, TINY = 12, "111", 6
_MULT = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22
_OFFSETS = [np.flatnonzero(np.frombuffer(m.encode(), np.uint8) == 49) for m in (*MASKS, SHORT_MASK, *("1" * n for n in range(1, TINY)))]
# ASCII other than letters and digits separates tokens.
_ASCII = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


class _Tokens(dict):
    def __missing__(self, token: bytes) -> int:
        h = xxhash.xxh64_intdigest(token)
        if len(self) >= 60_000:
            self.clear()
        self[token] = h
        return h


_tokens = _Tokens()


def tokens(text: str) -> np.ndarray:
    """Hashes of the text's tokens: lower-cased runs between ASCII white space, punctuation and controls."""
    parts = text.lower().encode().translate(_ASCII).split()
    return np.fromiter(map(_tokens.__getitem__, parts), np.uint64, len(parts))


def seeds(a: np.ndarray, mask: int) -> np.ndarray:
    """The hash of each window of a under a mask; empty if a is shorter."""
    off = _OFFSETS[mask]
    n = len(a) - int(off[-1])
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, mask + 1, np.uint64)
    for o in off:
        h = h * _MULT + a[o : o + n]
    return mix64(h)


def _masks_of(n: int) -> list[int]:
    """The numbers of the masks for a benchmark text of n tokens."""
    if n < TINY:
        return [len(MASKS) + n]
    return list(range(len(MASKS) + (n < SHORT)))


def _share(n: int, identity: float) -> float:
    """The share of equal tokens that a benchmark text of n tokens asks for."""
    return 1.0 if n < TINY else identity


@dataclass
class Index:
    """The seeds of some benchmark texts, sorted, with where each stands."""

    items: list[int]
    texts: list[np.ndarray]
    hashes: np.ndarray
    where: np.ndarray  # text, position
    bloom: np.ndarray
    masks: list[int]

    @staticmethod
    def of(rows: list[tuple[int, str | None]]) -> Index:
        kept = [(i, t) for i, text in rows if len(t := tokens(text or ""))]
        hashes, where = [np.zeros(0, np.uint64)], [np.zeros((0, 2), np.int32)]
        for k, (_, t) in enumerate(kept):
            for m in _masks_of(len(t)):
                h = seeds(t, m)
                hashes.append(h)
                where.append(np.column_stack([np.full(len(h), k), np.arange(len(h))]).astype(np.int32))
        h, w = np.concatenate(hashes), np.concatenate(where)
        order = np.argsort(h, kind="stable")
        bloom = np.zeros(1 << _BITS, bool)
        bloom[h & np.uint64((1 << _BITS) - 1)] = True
        masks = sorted({m for _, t in kept for m in _masks_of(len(t))})
        return Index([i for i, _ in kept], [t for _, t in kept], h[order], w[order], bloom, masks)


def best_overlap(a: np.ndarray, b: np.ndarray, shift: int, least: int, identity: float) -> tuple[int, int, int] | None:
    """Along the diagonal a[i] against b[i - shift]: start in a, length and matches of a run of at least `least` tokens
    with a share `identity` equal, or None if there is none."""
    lo, hi = max(0, shift), min(len(a), len(b) + shift)
    same = a[lo:hi] == b[lo - shift : hi - shift]
    if not 0 < least <= len(same) or same.sum() < identity * least - 1e-9:
        return None
    total = np.concatenate(([0], np.cumsum(np.where(same, 1, -2))))
    end = int((total - np.minimum.accumulate(total)).argmax())
    start = int(total[: end + 1].argmin())
    n, equal = end - start, int(same[start:end].sum())
    if n < least or equal < identity * n:
        spare = np.concatenate(([0.0], np.cumsum(same - identity)))
        over = spare[least:] - np.minimum.accumulate(spare[: len(spare) - least])
        if over.max() < -1e-9:
            return None
        end = int(over.argmax()) + least
        start = int(spare[: end - least + 1].argmin())
        n, equal = end - start, int(same[start:end].sum())
    return lo + start, n, equal


def overlaps(texts: list[np.ndarray], index: Index, min_tokens: int, identity: float) -> list[tuple[int, int, int, int, int]]:
    """(number of the text, number of the benchmark text, start token, length, matches), the best of each pair."""
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    if not len(index.items):
        return []
    joined = np.concatenate([*texts, np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    begin = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    tried: set[tuple[int, int, int]] = set()

    def test(doc: int, item: int, shift: int) -> None:
        if (doc, item, shift) in tried:
            return
        tried.add((doc, item, shift))
        n = len(index.texts[item])
        found = best_overlap(texts[doc], index.texts[item], shift, min(min_tokens, n), _share(n, identity))
        if found and (found[1], found[2], -found[0]) > best.get((doc, item), (0, 0, 0)):
            best[doc, item] = (found[1], found[2], -found[0])

    for m in index.masks:
        h = seeds(joined, m)
        at = np.flatnonzero(index.bloom[h & np.uint64((1 << _BITS) - 1)])
        lo = np.searchsorted(index.hashes, h[at], side="left")
        hi = np.searchsorted(index.hashes, h[at], side="right")
        for p, x, y in zip(at[hi > lo], lo[hi > lo], hi[hi > lo]):
            doc = int(owner[p])
            for item, pos in index.where[x:y]:
                test(doc, int(item), int(p - begin[doc] - pos))
    return [(d, i, -s, n, same) for (d, i), (n, same, s) in sorted(best.items())]


def benchmark_blocks(benchmark: DataFrame, block_tokens: int = BLOCK_TOKENS, id_col: str = "item_id", text_col: str = "text") -> tuple[int, Iterator[Index]]:
    """The number of blocks of about block_tokens tokens, and the blocks, one at a time on the driver."""
    rows = plain(benchmark, ("item_id", id_col), ("text", text_col)).where("text is not null")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // (5 * block_tokens)))
    parts = (rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks)) == k) for k in range(blocks))
    return blocks, (Index.of([(r["item_id"], r["text"]) for r in part.collect()]) for part in parts)


def _tokens_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    if "tokens" in batch.schema.names:
        return [np.frombuffer(t or b"", np.uint64) for t in batch.column("tokens").to_pylist()]
    return [tokens(t) for t in texts_of(batch)]


def _tokenised(rows: DataFrame) -> DataFrame:
    """rows with their text's tokens (8 bytes each) instead of the text, stored."""
    kept = [f for f in rows.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [tokens(t).tobytes() for t in texts_of(b)]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), pa.array(ids, pa.binary())], [*(f.name for f in kept), "tokens"])

    return stored(rows.mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept), "tokens binary"])), "tokens")


def contaminations(df: DataFrame, benchmark: DataFrame, min_tokens: int = 12, identity: float = 0.8, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each pair of a row of df and a benchmark text that it holds: doc_id, item_id, start_token,
    n_tokens, n_equal, contaminated (true)."""
    spark = df.sparkSession
    small_batches(spark)
    rows = plain(df, ("doc_id", id_col), ("text", text_col))
    kind = rows.schema["doc_id"].dataType.simpleString()
    many, blocks = benchmark_blocks(benchmark, block_tokens)
    rows = rows if many == 1 else _tokenised(rows)
    out = None
    for index in blocks:
        block = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for b in batches:
                found = overlaps(_tokens_of(b), block.value, min_tokens, identity)
                if found:
                    d, i, s, n, e = zip(*found)
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(d)), pa.array([block.value.items[x] for x in i], pa.int64()), *(pa.array(x, pa.int64()) for x in (s, n, e)), pa.array([True] * len(d))], ["doc_id", "item_id", "start_token", "n_tokens", "n_equal", "contaminated"])

        part = rows.mapInArrow(run, f"doc_id {kind}, item_id long, start_token long, n_tokens long, n_equal long, contaminated boolean")
        if many > 1:
            part = stored(part, "overlaps")
            block.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def keep_clean(df: DataFrame, benchmark: DataFrame, min_tokens: int = 12, identity: float = 0.8, block_tokens: int = BLOCK_TOKENS, text_col: str = "text") -> DataFrame:
    """The rows of df that hold no benchmark text; nothing is shuffled."""
    spark = df.sparkSession
    small_batches(spark)
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    many, blocks = benchmark_blocks(benchmark, block_tokens)
    for index in blocks:
        block = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for b in batches:
                hit = {f[0] for f in overlaps(_tokens_of(b), block.value, min_tokens, identity)}
                yield b.filter(pa.array([k not in hit for k in range(b.num_rows)], pa.bool_()))

        packed = packed.mapInArrow(run, packed.schema)
        if many > 1:
            packed = stored(packed, "clean")
            block.destroy()
    return packed.select("row.*")


def brute_pairs(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], min_tokens: int = 12, identity: float = 0.8) -> set[tuple[int, int]]:
    """All pairs over all diagonals and all runs, without seeds; for tests. A run of twice the least length or more can
    be cut into shorter ones, one of which has the share if the run has it, so runs up to that length are enough."""
    out = set()
    for d, text in docs:
        a = tokens(text or "")
        for i, item in items:
            b = tokens(item or "")
            least, share = min(min_tokens, len(b)), _share(len(b), identity)
            for shift in range(-len(b) + 1, len(a)) if len(b) else ():
                lo, hi = max(0, shift), min(len(a), len(b) + shift)
                same = a[lo:hi] == b[lo - shift : hi - shift]
                if same.sum() < share * least - 1e-9:
                    continue
                count = np.concatenate(([0], np.cumsum(same)))
                if any((count[n:] - count[:-n] >= share * n - 1e-9).any() for n in range(least, min(2 * least, len(same) + 1))):
                    out.add((d, i))
                    break
    return out
