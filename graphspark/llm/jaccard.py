"""N-gram Jaccard join by PartEnum signatures, and the connected classes of its links.

A text's set holds its distinct word n-grams. Two sets with Jaccard similarity of at least t differ in at most
k = (1 - t) / (1 + t) * (|x| + |y|) elements. Sizes are dealt into bands so that similar sets lie in the same or in
neighbouring bands. For each band the feature domain is cut into n1 parts of two cells each (a fixed hash of the
feature); of the two cells every one-element subset is enumerated, and a subset's content is a signature. At most
floor(k / 2) parts can differ in both cells, so n1 = floor(k / 2) + 1 + e parts leave at least 1 + e parts in which two
similar sets share a signature. The spare parts e make empty cells harmless: a set with an empty cell in at most e
parts need not publish empty signatures, as some part with a shared, non-empty one remains; the few other sets publish
them.

Sets that are equal are grouped first by a 128-bit digest and take part once. Candidates of a signature are
first compared with the signature's smallest id only, then classes by their first and last ids; what is then not yet
in one class is compared pair by pair, in
blocks of bounded size, behind an exact filter: the XOR of one bit per element gives two bit strings whose distance
never exceeds the sets' difference. Blocks in which more pairs pass the filter than they have members tell no pairs, but
which members hang together by them; these clusters are compared once more with their sets at hand, and only links that
join two classes come out. So rows stay in proportion to members. No pair that the signatures give is left out: there is
no cap on buckets or partners. Each link is verified on the sets of 64-bit hashes of the n-grams.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspark.llm.common import mix64, plain, size_checked, small_batches, stored, texts_of

_MULT = np.uint64(0x9E3779B97F4A7C15)
_REMEMBERED = 60_000
#: Rounds in which classes that meet in a signature are compared by their first and last ids, before all pairs are.
ROUNDS = 1
#: Rows of a block in the comparison of all pairs of a bucket.
BLOCK = 2048
#: Elements of the sets of a block of a cluster, about.
ELEMENTS = 2_000_000
#: Edges whose components one task may find; more are first cut by distributed rounds.
SMALL = 500_000


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) >= _REMEMBERED:
            self.clear()
        self[word] = h
        return h


_words = _Words()


def shingles(text: str, n: int = 4) -> np.ndarray:
    """Sorted distinct hashes of the text's n-grams of words; A-Z are lower-cased, words end at ASCII white
    space. With fewer than n words, the whole sequence is the one element; without words there is none."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    a = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    m = min(n, len(words))
    h = np.full(len(words) - m + 1, m, np.uint64)
    for i in range(m):
        h = h * _MULT + a[i : len(words) - m + 1 + i]
    return np.unique(mix64(h))


class Bands:
    """Size bands and the parts of each; percent is the similarity, as a whole number of hundredths."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        edges = [1]
        while edges[-1] < 1 << 40:  # sizes s and s' >= s are similar only if 100 * s >= percent * s'
            edges.append(max(edges[-1] + 1, edges[-1] * 100 // percent + 1))
        self.edges = np.array(edges)

    def of(self, size: int) -> int:
        return int(np.searchsorted(self.edges, size, side="right")) - 1

    def most(self, x: int, y: int) -> int:
        """The largest difference of two similar sets of these sizes."""
        return (100 - self.percent) * (x + y) // (100 + self.percent)

    @functools.lru_cache(maxsize=4096)
    def parts(self, band: int) -> tuple[int, int]:
        """Number of parts and spare parts for sets up to the band's largest size."""
        k = self.most(int(self.edges[band + 1]) - 1, int(self.edges[band + 1]) - 1)
        if k == 0:
            return 0, 0  # only equal sets are similar: the digest finds them
        spare = 3 if k > 3 else 1
        return k // 2 + 1 + spare, spare

    def signatures(self, x: np.ndarray) -> np.ndarray:
        """The signatures of a set, for its own band and the next one."""
        if not len(x):
            return np.zeros(0, np.uint64)
        own, out = self.of(len(x)), []
        place, content = mix64(x, 0xD6E8FEB86659FD93), mix64(x, 0x94D049BB133111EB)
        for band in (own, own + 1):
            parts, spare = self.parts(band)
            if not parts:
                continue
            cell = (place % np.uint64(2 * parts)).astype(np.int64)
            order = np.argsort(cell, kind="stable")
            count = np.bincount(cell, minlength=2 * parts)
            there = count > 0
            starts = np.concatenate(([0], np.cumsum(count)[:-1]))
            sig = np.zeros(2 * parts, np.uint64)
            sig[there] = np.add.reduceat(content[order], starts[there])
            label = (np.uint64(band) << np.uint64(32)) + np.arange(2 * parts, dtype=np.uint64)
            sig = mix64(mix64(sig + label * _MULT) ^ label)
            out.append(sig if (~there).reshape(parts, 2).any(1).sum() > spare else sig[there])
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def width(self, size: int) -> int:
        """Bits of the sketch: four times the difference that can occur or more, a power of two. Unlike sets of k elements
        that may differ then lie at about twice k; more bits would only cost more in each signature's rows."""
        k = self.most(size, size * 100 // self.percent + 1)
        return 1 << min(16, max(7, math.ceil(math.log2(4 * k + 1))))

    def sketch(self, x: np.ndarray) -> np.ndarray:
        """One bit for each element, combined by XOR, as 64-bit words."""
        bits = np.bincount((mix64(x, 0xC2B2AE3D27D4EB4F) & np.uint64(self.width(len(x)) - 1)).astype(np.int64), minlength=self.width(len(x))) & 1
        return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """A sketch of fewer bits: halves fall upon each other."""
    while sketch.shape[-1] > words:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _rows(names: list[str], *cols: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names)


def describe(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, size of its set, 128-bit digest, sketch and signatures (both as bytes) of each text."""
    bands = Bands(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t, n) for t in texts_of(b)]
            ids = b.column("doc_id").to_pylist()
            digests = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
            first: dict[bytes, int] = {}  # row of the smallest id of each digest
            for k, d in enumerate(digests):
                if ids[k] is not None and (d not in first or ids[k] < ids[first[d]]):
                    first[d] = k
            sigs = [bands.signatures(x).tobytes() if first.get(d) == k else b"" for k, (x, d) in enumerate(zip(sets, digests))]
            yield _rows(["doc_id", "size", "digest", "sketch", "sigs"], b.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array([bands.sketch(x).tobytes() for x in sets], pa.binary()), pa.array(sigs, pa.binary()))

    return docs.mapInArrow(run, "doc_id long, size long, digest binary, sketch binary, sigs binary")


def _spread_signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each signature of each set. Of equal signatures in a batch only the smallest id goes to the
    signature's partition (head -1); the others are dealt out evenly and carry that id as their head."""
    for b in batches:
        sigs = [np.frombuffer(s, np.int64) for s in b.column("sigs").to_pylist()]
        sig = np.concatenate(sigs) if sigs else np.zeros(0, np.int64)
        doc = np.repeat(np.asarray(b.column("doc_id")), [len(s) for s in sigs])
        if not len(sig):
            continue
        order = np.lexsort((doc, sig))
        sig, doc = sig[order], doc[order]
        first = np.concatenate(([True], sig[1:] != sig[:-1]))
        head = doc[np.maximum.accumulate(np.where(first, np.arange(len(sig)), 0))]
        key = np.where(first, sig, mix64((sig ^ doc).view(np.uint64) + _MULT).view(np.int64))
        for lo in range(0, len(sig), 65536):
            s = slice(lo, lo + 65536)
            yield _rows(["key", "sig", "doc", "head"], key[s], sig[s], doc[s], np.where(first, -1, head)[s])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by signature and id: (sig, centre, doc) for all but the first id of each signature."""
    open_sig, centre = None, None
    for b in batches:
        sig, doc, head = (np.asarray(b.column(c)) for c in ("sig", "doc", "head"))
        if not len(sig):
            continue
        given = head >= 0
        if given.any():
            yield _rows(["sig", "centre", "doc"], sig[given], head[given], doc[given])
        sig, doc = sig[~given], doc[~given]
        if not len(sig):
            continue
        first = np.concatenate(([sig[0] != open_sig], sig[1:] != sig[:-1]))
        at = np.maximum.accumulate(np.where(first, np.arange(len(sig)), -1))
        middle = np.where(at >= 0, doc[at], centre if centre is not None else 0)
        open_sig, centre = sig[-1], middle[-1]
        keep = ~first & (middle != doc)
        if keep.any():
            yield _rows(["sig", "centre", "doc"], sig[keep], middle[keep], doc[keep])


def _close(bands: Bands, xs: list[bytes], ys: list[bytes], nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Pairwise: can the sets be similar, by size and sketch?"""
    ok = 100 * np.minimum(nx, ny) >= bands.percent * np.maximum(nx, ny)
    limit = (100 - bands.percent) * (nx + ny) // (100 + bands.percent)
    for i in np.flatnonzero(ok):
        a, b = np.frombuffer(xs[i], np.uint64), np.frombuffer(ys[i], np.uint64)
        w = min(len(a), len(b))
        ok[i] = int(np.bitwise_count(folded(a, w) ^ folded(b, w)).sum()) <= limit[i]
    return ok


def _prefiltered(pairs: DataFrame, sets: DataFrame, bands: Bands) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow a link."""
    side = lambda s: sets.select(F.col("doc_id").alias(s), F.col("size").alias(f"n{s}"), F.col("sketch").alias(f"k{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            ok = _close(bands, t.column("ka").to_pylist(), t.column("kb").to_pylist(), np.asarray(t.column("na")), np.asarray(t.column("nb")))
            yield t.select(["a", "b"]).filter(pa.array(ok))

    return both.mapInArrow(run, "a long, b long")


def _sets(ids: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """doc_id and set (as bytes) of these ids, made again from their texts."""
    # an id names one text; repeated rows of it would only repeat the comparison
    wanted = docs.join(size_checked(ids), "doc_id", "left_semi")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _rows(["doc_id", "set"], b.column("doc_id"), pa.array([shingles(t, n).tobytes() for t in texts_of(b)], pa.binary()))

    return wanted.mapInArrow(make, "doc_id long, set binary").dropDuplicates(["doc_id"])


def _verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) that do link. Sets are made again for the ids in pairs only."""
    made = _sets(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), docs, n)
    both = pairs.join(made.select(F.col("doc_id").alias("b"), F.col("set").alias("y")), "b").join(made.select(F.col("doc_id").alias("a"), F.col("set").alias("x")), "a")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(t.column("x").to_pylist(), t.column("y").to_pylist())]
            yield t.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(test, "a long, b long")


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From all edges (u, v) of a task: doc_id and component of every id but those that are a component's smallest."""
    held = [(np.asarray(b.column("u")), np.asarray(b.column("v"))) for b in batches if b.num_rows]
    if not held:
        return
    ids, place = np.unique(np.concatenate([np.concatenate(side) for side in zip(*held)]), return_inverse=True)
    root = np.arange(len(ids))
    u, v = np.split(place, 2)
    while len(u):  # a root goes below the smallest root that it meets
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (root != (above := root[root])).any():
            root = above
        u, v = root[u], root[v]
        u, v = u[u != v], v[u != v]
    rest = np.flatnonzero(root != np.arange(len(ids)))
    for lo in range(0, len(rest), 65536):
        s = rest[lo : lo + 65536]
        yield _rows(["doc_id", "component"], ids[s], ids[root[s]])


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """doc_id and component (its smallest reachable id) of every id in edges (a, b) that is not itself a component's
    smallest.

    While there are more than SMALL edges, large-star and small-star steps in turn: each id's neighbours are tied to the
    smallest one around, so a chain of any length shrinks by half or more in each round, and no adjacency list is ever
    collected. At most SMALL edges are one task's, without a shuffle."""
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    if edges.count() > SMALL:
        edges = stored(edges.distinct(), label)
    while edges.count() > SMALL:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        new = stored(small, label)
        if new.count() == edges.count() and new.exceptAll(edges).isEmpty():
            return new.select(F.col("u").alias("doc_id"), F.col("v").alias("component"))
        edges = new
    return stored(edges.coalesce(1).mapInArrow(_united, "doc_id long, component long"), label)


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of the rows of one key each, from batches sorted by that key."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = np.asarray(b.column(key))
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        ends = [*cuts, len(k)]
        lo = 0
        if held and held[-1].column(key)[0].as_py() != k[0]:
            yield pa.Table.from_batches(held)
            held = []
        for hi in ends:
            held.append(b.slice(lo, hi - lo))
            if hi < len(k):
                yield pa.Table.from_batches(held)
                held = []
            lo = hi
    if held:
        yield pa.Table.from_batches(held)


def _by_blocks(block: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each row of a task's lower block with the rows it is to be compared with."""
    left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
    same = block.min() == block.max()
    for i in left:
        yield i, right[right > i] if same else right


def _block_pairs(bands: Bands):  # noqa: ANN202
    """For the rows of a pair of blocks: the pairs of different classes that size and sketch allow. If they are more than
    the rows, instead of them (dense 1) each row that is in one with the first row it hangs together with by them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for a in found(batches):  # a pair may share many signatures: told once for some 100,000
            held.append(a)
            n += len(a)
            if n > 100_000:
                a = np.unique(np.concatenate(held), axis=0)
                yield _rows(["a", "b", "dense"], a[:, 0], a[:, 1], a[:, 2])
                held, n = [], 0
        if held:
            a = np.unique(np.concatenate(held), axis=0)
            yield _rows(["a", "b", "dense"], a[:, 0], a[:, 1], a[:, 2])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for t in _grouped(batches, "task"):
            doc, comp, size, block = (t.column(c).to_numpy() for c in ("doc_id", "comp", "size", "block"))
            if len(doc) < 2 or (comp == comp[0]).all():
                continue
            raw = [np.frombuffer(s, np.uint64) for s in t.column("sketch").to_pylist()]
            low = min(map(len, raw))
            bits = np.array([folded(s, low) for s in raw])
            out, tied, dense = [], np.arange(len(doc)), False
            for i, js in _by_blocks(block):
                js = js[comp[js] != comp[i]]
                js = js[100 * np.minimum(size[js], size[i]) >= bands.percent * np.maximum(size[js], size[i])]
                if dense:
                    js = js[tied[js] != tied[i]]
                if len(js):
                    limit = (100 - bands.percent) * (size[js] + size[i]) // (100 + bands.percent)
                    js = js[np.bitwise_count(bits[js] ^ bits[i]).sum(1) <= limit]
                    js = [j for j in js if len(raw[i]) == low or len(raw[j]) == low or _close(bands, [raw[i].tobytes()], [raw[j].tobytes()], size[i : i + 1], size[j : j + 1])[0]]
                if len(js):
                    meet = np.unique(tied[[i, *js]])
                    tied[np.isin(tied, meet)] = meet[0]
                    out += [] if dense else [(min(doc[i], doc[j]), max(doc[i], doc[j]), 0) for j in js]
                    dense = dense or len(out) > len(doc)
            if dense:
                out = [(min(doc[i], doc[k]), max(doc[i], doc[k]), 1) for k, i in enumerate(tied) if i != k]
            if out:
                yield np.array(out)

    return run


def _block_links(bands: Bands):  # noqa: ANN202
    """For the rows of a pair of blocks of a cluster: verified links, each of which joins two classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, "task"):
            doc, root, block = t.column("doc_id").to_numpy(), t.column("comp").to_numpy().copy(), t.column("block").to_numpy()
            if len(doc) < 2 or (root == root[0]).all():
                continue
            sets = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
            size = np.array([len(x) for x in sets])
            raw = [bands.sketch(x) for x in sets]
            low = min(map(len, raw))
            bits = np.array([folded(s, low) for s in raw])
            names, number = np.unique(np.concatenate(sets), return_inverse=True)
            held, out = np.split(number, np.cumsum(size)[:-1]), []
            there = np.zeros(len(names), bool)
            for i, js in _by_blocks(block):
                js = js[root[js] != root[i]]
                js = js[100 * np.minimum(size[js], size[i]) >= bands.percent * np.maximum(size[js], size[i])]
                js = js[np.bitwise_count(bits[js] ^ bits[i]).sum(1) <= (100 - bands.percent) * (size[js] + size[i]) // (100 + bands.percent)]
                there[held[i]] = True
                for lo in range(0, len(js), 64):
                    part = js[lo : lo + 64]
                    part = part[root[part] != root[i]]
                    if not len(part):
                        continue
                    both = np.add.reduceat(there[np.concatenate([held[j] for j in part])], np.cumsum(size[part]) - size[part], dtype=np.int64)
                    for j in part[100 * both >= bands.percent * (size[i] + size[part] - both)]:
                        if root[j] != root[i]:
                            out.append((min(doc[i], doc[j]), max(doc[i], doc[j])))
                            root[root == root[j]] = root[i]
                there[held[i]] = False
            if out:
                a = np.array(out)
                yield _rows(["a", "b"], a[:, 0], a[:, 1])

    return run


def classes(df: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of each row.

    Defined cases: a null or empty text has the empty set and links with nothing, so it is its own class; a text of
    fewer than n words has one element; repeated rows of an id are one document and each get a row; rows whose id is
    null get their size and a null class; an empty table gives no rows; extra columns are ignored; texts of any length
    count whole. Ids must be whole numbers, and an id must name one text."""
    spark, bands = df.sparkSession, Bands(percent)
    small_batches(spark)
    docs = plain(df, ("doc_id", id_col), ("text", text_col)).withColumn("doc_id", F.col("doc_id").cast("long"))
    table = stored(describe(docs, n, percent), "sets")
    named = table.where("doc_id is not null and size > 0")
    # equal sets: one row with the smallest id for each digest
    groups = stored(named.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "groups")
    # of each digest the row of the smallest id stands for all; it has its signatures, as it is the first of its batch
    doubles = named.join(groups.where("copies > 1"), "digest").where("doc_id <> rep").select("doc_id").distinct()
    sets = named.join(size_checked(stored(doubles, "doubles")), "doc_id", "left_anti").where("length(sigs) > 0")
    many = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stars = sets.select("doc_id", "sigs").mapInArrow(_spread_signatures, "key long, sig long, doc long, head long")
    stars = stars.repartition(many, "key").sortWithinPartitions("sig", "doc").mapInArrow(_stars, "sig long, centre long, doc long")
    stars = stored(stars, "stars")
    sketches = sets.select("doc_id", "size", "sketch").dropDuplicates(["doc_id"])
    pairs = stars.select(F.col("centre").alias("a"), F.col("doc").alias("b")).distinct()
    first = stored(_verified(stored(_prefiltered(pairs, sketches, bands), "pairs"), docs, n, percent), "links")
    tied = components(first)
    members = stars.select("sig", F.explode(F.array("centre", "doc")).alias("doc_id")).distinct()
    for _ in range(ROUNDS):
        members = _meeting(members, tied)
        more = stored(_verified(stored(_prefiltered(_between(members), sketches, bands), "pairs"), docs, n, percent), "links")
        first = first.union(more)
        tied = components(first)
    rest = _rest(members, sketches, tied, bands, many)
    links = first.union(stored(_verified(rest.where("dense = 0").select("a", "b"), docs, n, percent), "links"))
    dense = rest.where("dense = 1").select("a", "b")
    if not dense.isEmpty():
        links = links.union(_within(dense, sketches, tied, docs, n, bands, many))
    tied = components(links)
    by_rep = groups.join(tied.withColumnRenamed("doc_id", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    return table.select("doc_id", "digest", F.col("size").alias("n_shingles")).join(by_rep, "digest", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNull(), None).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def _named(members: DataFrame, tied: DataFrame) -> DataFrame:
    """sig, doc_id and comp (its class so far) of members."""
    return members.select("sig", "doc_id").join(size_checked(tied), "doc_id", "left").select("sig", "doc_id", F.coalesce("component", "doc_id").alias("comp"))


def _meeting(members: DataFrame, tied: DataFrame) -> DataFrame:
    """sig, doc_id, comp (its class so far) and first (the signature's smallest class) of the members of signatures in
    which classes meet. Classes only grow, so no later step needs any other signature."""
    members = _named(members, tied)
    alive = members.groupBy("sig").agg(F.min("comp").alias("first"), F.max("comp").alias("last")).where("first <> last").select("sig", "first")
    return stored(members.join(alive, "sig"), "members")


def _between(members: DataFrame) -> DataFrame:
    """Pairs of the first and last ids of the classes that meet in a signature: each class with the first one."""
    ends = members.groupBy("sig", "comp", "first").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    middle = ends.where("comp = first").select("sig", F.struct("lo", "hi").alias("c"))
    both = ends.where("comp <> first").join(middle, "sig")
    pairs = both.select(F.explode(F.array(*[F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")) for x in ("c.lo", "c.hi") for y in ("lo", "hi")])).alias("p"))
    return pairs.select("p.a", "p.b").distinct()


def _rest(members: DataFrame, sketches: DataFrame, tied: DataFrame, bands: Bands, many: int) -> DataFrame:
    """Pairs of different classes that share a signature and weren't compared as a star, after the filter (dense 0), and
    ties of members of dense blocks (dense 1)."""
    members = _named(members, tied)
    # a signature of two ids has no pair besides its star
    alive = members.groupBy("sig").agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("m > 2 and lo <> hi")
    alive = alive.select("sig", F.ceil(F.col("m") / BLOCK).cast("int").alias("g"))
    rows = members.join(alive, "sig").join(sketches, "doc_id")
    rows = _dealt(rows, "sig").select("task", "doc_id", "comp", "size", "sketch", "block").repartition(many, "task").sortWithinPartitions("task", "doc_id")
    return stored(rows.mapInArrow(_block_pairs(bands), "a long, b long, dense long").distinct(), "pairs")


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows (doc_id, g) of each key dealt into g blocks: a row for each pair of blocks that its own is in."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("g").cast("long")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    return rows.withColumn("task", F.xxhash64(key, F.least("block", "other"), F.greatest("block", "other")))


def _within(dense: DataFrame, sketches: DataFrame, tied: DataFrame, docs: DataFrame, n: int, bands: Bands, many: int) -> DataFrame:
    """Links of the clusters that the dense blocks make, each of which joins two classes in its pair of blocks."""
    found = components(dense, "clusters")
    members = found.union(found.select(F.col("component").alias("doc_id"), "component").distinct()).withColumnRenamed("component", "cluster")
    members = stored(members.join(sketches.select("doc_id", "size"), "doc_id").join(tied, "doc_id", "left").select("cluster", "doc_id", "size", F.coalesce("component", "doc_id").alias("comp")), "members")
    g = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") / ELEMENTS)).cast("int").alias("g")
    alive = members.groupBy("cluster").agg(g, F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("cluster", "g")
    rows = _dealt(members.join(alive, "cluster"), "cluster").join(_sets(members.select("doc_id"), docs, n), "doc_id")
    rows = rows.select("task", "doc_id", "comp", "set", "block").repartition(many, "task").sortWithinPartitions("task", "doc_id")
    return stored(rows.mapInArrow(_block_links(bands), "a long, b long"), "links")




def keep_one(df: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """The rows of df whose doc_id is the smallest of its class (rows with a null id stay)."""
    found = classes(df, n, percent).where("doc_id <> component_id").select("doc_id").distinct()
    return df.join(size_checked(stored(found, "others")), "doc_id", "left_anti")


def brute_classes(rows: list[tuple[int | None, str | None]], n: int = 4, percent: int = 85) -> dict[int, int]:
    """Classes by comparing all pairs; for tests."""
    import re

    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        if i is not None:
            sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


