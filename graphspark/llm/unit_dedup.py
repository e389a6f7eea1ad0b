"""Substring deduplication by hashing lines and paragraphs.

A text's units are its lines and its paragraphs (between blank lines; one of a single line counts once). Units are
normalised (lower case, white space as one space) and hashed to 128 bits. Of each digest the earliest occurrence, by
doc_id and then place, is kept, and all later ones are removed, of any length. What is kept is returned with its offsets
in the original text (code points, end exclusive).

Lines cannot see a passage that begins or ends inside a line. With `passages`, sentences of lines are hashed, too, and in
each text a run of neighbouring sentences that all occurred earlier is removed if it has that many words or more. A
sentence of few words counts as repeated only together with the words that follow it, so chance repetitions stay.

Digests are pre-aggregated before the shuffle: within a batch of rows only the earliest occurrence goes to the
digest's partition, the others are known not to be the first and are dealt out evenly. So a line that a third of all
rows hold reaches its partition once for each batch.

Defined cases: null and empty texts have no units and give an empty text; rows whose id is null are left as they
are and hide nothing; repeated rows of an id are one document and treated alike; an empty table gives no
rows; extra columns are ignored; texts of any length are cut whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspark.llm.common import mix64, plain, small_batches, stored, texts_of

_CUTS = {"paragraph": re.compile(r"\n[ \t]*\n\s*"), "line": re.compile(r"\n+"), "sentence": re.compile(r"\n+|(?<=[.!?])[ \t]+")}
#: A sentence of fewer words repeats by chance: it is hashed together with what follows, up to so many words.
CONTEXT = 8
#: Lines and paragraphs are numbered from here on, behind all sentences.
WHOLE = 1 << 30
_SPACE = re.compile(r"\s*")
_MULT = np.uint64(0x9E3779B97F4A7C15)


def units(text: str, kind: str = "sentence") -> list[tuple[int, int]]:
    """Offsets of the units that hold a word. A unit ends where the next cut begins."""
    out, lo = [], 0
    for m in _CUTS[kind].finditer(text):
        if m.start() > lo:
            out.append((lo, m.start()))
        lo = m.end()
    if len(text) > lo:
        out.append((lo, len(text)))
    return [(a, b) for a, b in out if not text[a:b].isspace()]


def normal_units(text: str, kind: str = "sentence") -> list[str]:
    """What is hashed for each unit: its words, lower-cased; for a short one also those of the units that follow."""
    own = [text[a:b].lower().split() for a, b in units(text, kind)]
    out = []
    for k, words in enumerate(own):
        j = k
        while len(words) < CONTEXT and j + 1 < len(own):
            j += 1
            words = words + own[j]
        out.append(" ".join(words if j == k else [f"{len(own[k])}:", *words[:CONTEXT]]))
    return out


def wholes(text: str) -> list[tuple[int, int, str]]:
    """Offsets and words of the lines and paragraphs, by place; a paragraph of one line is there once."""
    out = {}
    for kind in ("line", "paragraph"):
        for a, b in units(text, kind):
            part = text[a:b]
            a, b = a + len(part) - len(part.lstrip()), a + len(part.rstrip())
            if (a, b) not in out:
                out[a, b] = " ".join(part.lower().split())
    return [(a, b, out[a, b]) for a, b in sorted(out)]


def _digests(text: str, passages: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The halves of the digests of sentences (with passages) and wholes, as signed 64-bit numbers, and their numbers."""
    raw = [xxhash.xxh3_128_digest(u) for u in normal_units(text)] if passages else []
    whole = [xxhash.xxh3_128_digest("\n" + w) for _, _, w in wholes(text)]
    both = np.frombuffer(b"".join(raw + whole), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1], np.concatenate([np.arange(len(raw)), WHOLE + np.arange(len(whole))]).astype(np.int32)


def _spread(passages: int | None):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut = [_digests(t, passages) for t in texts_of(b)]
            count = [len(x) for x, _, _ in cut]
            if not sum(count):
                continue
            hi, lo, unit = (np.concatenate([c[i] for c in cut]) for i in (0, 1, 2))
            doc = np.repeat(np.asarray(b.column("doc_id")), count)
            order = np.lexsort((unit, doc, lo, hi))
            hi, lo, doc, unit = hi[order], lo[order], doc[order], unit[order]
            first = np.concatenate(([True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])))
            at = np.maximum.accumulate(np.where(first, np.arange(len(hi)), 0))
            same = ~first & (doc == doc[at]) & (unit == unit[at])  # a repeated row
            hi, lo, doc, unit, first = (x[~same] for x in (hi, lo, doc, unit, first))
            key = np.where(first, hi, mix64((hi ^ doc).view(np.uint64) + unit.astype(np.uint64) * _MULT).view(np.int64))
            for s in range(0, len(hi), 65536):
                c = slice(s, s + 65536)
                yield pa.RecordBatch.from_arrays([pa.array(x[c]) for x in (key, hi, lo, doc, unit, ~first)], ["key", "hi", "lo", "doc_id", "unit", "later"])

    return run


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by digest, id and place: all but the first occurrence of each digest."""
    held = None
    for b in batches:
        hi, lo, doc, unit, later = (np.asarray(b.column(c)) for c in ("hi", "lo", "doc_id", "unit", "later"))
        out_doc, out_unit = [doc[later]], [unit[later]]
        hi, lo, doc, unit = (x[~later] for x in (hi, lo, doc, unit))
        if len(hi):
            first = np.concatenate(([held is None or (hi[0], lo[0]) != held[:2]], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])))
            at = np.maximum.accumulate(np.where(first, np.arange(len(hi)), -1))
            d0, u0 = (np.where(at >= 0, x[at], held[i] if held else 0) for x, i in ((doc, 2), (unit, 3)))
            again = ~first & ~((doc == d0) & (unit == u0))
            out_doc.append(doc[again])
            out_unit.append(unit[again])
            held = (hi[-1], lo[-1], d0[-1], u0[-1])
        d, u = np.concatenate(out_doc), np.concatenate(out_unit)
        if len(d):
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(u)], ["doc_id", "unit"])


def removed_runs(text: str, later: set[int], passages: int | None) -> list[tuple[int, int]]:
    """Offsets of the repeated wholes and of the runs of repeated sentences with `passages` words or more, joined where
    they meet; each with the white space that follows."""
    out = [(a, _SPACE.match(text, b).end()) for k, (a, b, _) in enumerate(wholes(text)) if WHOLE + k in later]
    run: list[tuple[int, int]] = []
    for k, span in enumerate([*units(text), (len(text), len(text))] if passages and min(later) < WHOLE else []):
        if k in later:
            run.append(span)
        elif run:
            if len(text[run[0][0] : run[-1][1]].split()) >= passages:
                out.append((run[0][0], span[0]))
            run = []
    apart: list[tuple[int, int]] = []
    for a, b in sorted(out):
        if apart and a <= apart[-1][1]:
            apart[-1] = (apart[-1][0], max(b, apart[-1][1]))
        else:
            apart.append((a, b))
    return apart


def without(text: str, removed: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """What is left of the text, and the offsets of the pieces left."""
    kept, lo = [], 0
    for a, b in [*removed, (len(text), len(text))]:
        if a > lo:
            kept.append((lo, a))
        lo = b
    return "".join(text[a:b] for a, b in kept), kept


def dedup(df: DataFrame, passages: int | None = 25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (what is kept), changed, n_units (lines and paragraphs), removed and kept (arrays of struct<start,
    end>) and longest (words of the longest stretch removed) of each row. Ids must be whole numbers."""
    spark = df.sparkSession
    small_batches(spark)
    docs = plain(df, ("doc_id", id_col), ("text", text_col)).withColumn("doc_id", F.col("doc_id").cast("long"))
    many = int(spark.conf.get("spark.sql.shuffle.partitions"))
    seen = docs.where("doc_id is not null").mapInArrow(_spread(passages), "key long, hi long, lo long, doc_id long, unit int, later boolean")
    later = seen.repartition(many, "key").sortWithinPartitions("hi", "lo", "doc_id", "unit").mapInArrow(_later, "doc_id long, unit int")
    # a document's own units, so the set is bounded by its text
    per_doc = stored(later.groupBy("doc_id").agg(F.collect_set("unit").alias("later")), "later")
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("changed", pa.bool_()), ("n_units", pa.int32()), ("removed", span), ("kept", span), ("longest", pa.int32())])
    pairs = lambda x: [{"start": a, "end": b} for a, b in x]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rows = []
            for i, t, again in zip(b.column("doc_id").to_pylist(), texts_of(b), b.column("later").to_pylist()):
                runs = removed_runs(t, set(again), passages) if again else []
                rest, kept = without(t, runs)
                longest = max((len(t[x:y].split()) for x, y in runs), default=0)
                rows.append((i, rest, bool(runs), len(wholes(t)), pairs(runs), pairs(kept), longest))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    spans = "array<struct<start:int,end:int>>"
    # a shuffle at every size: what is removed grows with the corpus, so it is never broadcast
    joined = docs.join(per_doc.hint("merge"), "doc_id", "left")
    return joined.mapInArrow(cut, f"doc_id long, text string, changed boolean, n_units int, removed {spans}, kept {spans}, longest int")


def brute_dedup(rows: list[tuple[int, str]], passages: int | None = 25) -> dict[int, str]:
    """The kept text of each id, by one walk over all units in order; for tests."""
    first: dict[str, tuple[int, int]] = {}
    out = {}
    for i, t in sorted({i: t or "" for i, t in rows if i is not None}.items()):
        named = [*(enumerate(normal_units(t)) if passages else ()), *((WHOLE + k, "\n" + w) for k, (_, _, w) in enumerate(wholes(t)))]
        later = {k for k, u in named if first.setdefault(u, (i, k)) != (i, k)}
        out[i] = without(t, removed_runs(t, later, passages) if later else [])[0]
    return out
