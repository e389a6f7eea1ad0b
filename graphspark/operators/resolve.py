"""Entity resolution: candidates merged across documents, matched with a registry, and relationships resolved."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphspark.functions.names import slug
from graphspark.functions.similarity import MaskedTexts, jaro_winkler, jaro_winkler_of
from graphspark.operators.extraction import aggregated, earliest_wins, in_order
from graphspark.plans.scratch import BROADCAST_ROWS, size_checked, stored

FUZZY = 0.9
#: Rows and entries of a type that are compared in one task; in it, names at a time and entries with a bound in common.
BLOCK, CHUNK, GROUP = 8192, 128, 8


def names_of(rows: DataFrame) -> DataFrame:
    """rows exploded to name: the label and the aliases, lower-cased, each once for a row."""
    all_names = F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("label"))
    return rows.withColumn("name", F.explode(F.array_distinct(F.transform(all_names, F.lower))))


def merge_candidates(candidates: DataFrame) -> DataFrame:
    """type, ord and canonical (ord of the candidate it joins, its own if none) of each candidate: type, ord, label,
    aliases.

    One pass in order of ord within a type: a candidate joins the first one that shares a label or alias with it, and
    lends it its names. The pass depends on its order, so a type is read as one sorted stream; its state is the names
    seen so far."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        type_, owner = None, {}
        for pdf in parts:
            out = []
            for t, o, label, aliases in zip(pdf["type"], pdf["ord"], pdf["label"], pdf["aliases"]):
                if t != type_:
                    type_, owner = t, {}
                names = [str(n).lower() for n in [label, *(aliases if aliases is not None else [])]]
                hits = [owner[n] for n in names if n in owner]
                into = min(hits) if hits else o
                for n in names:
                    owner.setdefault(n, into)
                out.append((t, o, into))
            yield pd.DataFrame(out, columns=["type", "ord", "canonical"])

    rows = candidates.select("type", F.col("ord").cast("long"), "label", "aliases")
    return rows.repartition("type").sortWithinPartitions("type", "ord").mapInPandas(run, "type string, ord long, canonical long")


def connected_candidates(candidates: DataFrame) -> DataFrame:
    """As merge_candidates(), but candidates tied by any chain of shared names join, whatever their order. This is a
    distributed label propagation over names until nothing changes; each round also takes over the label of the own
    label, which shortens long chains. It may join more than the pass in order does."""
    names = stored(names_of(candidates).select("type", F.col("ord").cast("long").alias("ord"), "name"), "names")
    labels = names.select("type", "ord").distinct().withColumn("canonical", F.col("ord"))
    while True:
        by_name = names.join(labels, ["type", "ord"]).groupBy("type", "name").agg(F.min("canonical").alias("low"))
        new = stored(names.join(by_name, ["type", "name"]).groupBy("type", "ord").agg(F.min("low").alias("canonical")), "labels")
        onward = new.select("type", F.col("ord").alias("canonical"), F.col("canonical").alias("next"))
        new = stored(new.join(onward, ["type", "canonical"]).select("type", "ord", F.col("next").alias("canonical")), "labels")
        if new.join(labels, ["type", "ord", "canonical"], "left_anti").isEmpty():
            return new
        labels = new


def merged(candidates: DataFrame, assigned: DataFrame) -> DataFrame:
    """One row for each canonical candidate: its label, the longest summary, earlier properties first, all names."""
    both = candidates.join(assigned, ["type", "ord"])
    names = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "label", "aliases"))), lambda x: F.concat(F.array(x["label"]), F.coalesce(x["aliases"], F.array().cast("array<string>"))))))
    out = {
        "label": F.min_by("label", "ord"), "summary": F.max_by("summary", F.struct(F.length(F.coalesce("summary", F.lit(""))), -F.col("ord"))), "properties": earliest_wins(in_order("properties")),
        "names": names, "source_documents": F.array_sort(F.collect_set("source")), "n": F.count(F.lit(1)),
    }
    out = aggregated(both.groupBy("type", "canonical"), out)
    return out.withColumn("aliases", F.filter("names", lambda n: F.lower(n) != F.lower("label"))).drop("names")


def merge_log(candidates: DataFrame, assigned: DataFrame) -> DataFrame:
    """One row for each candidate that joined another: labels, matched_by and confidence. A shared name counts as an
    alias (0.95), also when it is the label."""
    mine = candidates.join(assigned.where("ord <> canonical"), ["type", "ord"]).select("type", "canonical", F.col("label").alias("merged_label"), F.col("source").alias("merged_source"))
    canon = candidates.select("type", F.col("ord").alias("canonical"), F.col("label").alias("canonical_label"))
    return mine.join(canon, ["type", "canonical"]).select(F.col("type").alias("entity_type"), "canonical_label", "merged_label", "merged_source", F.lit("alias").alias("matched_by"), F.lit(0.95).alias("confidence"))


def match_registry(rows: DataFrame, registry: DataFrame, threshold: float = FUZZY) -> DataFrame:
    """rows (key, type, label) with entry, matched_by and confidence of the registry (id, type, label, aliases): by
    slug (1.0), then alias (0.9), then Jaro-Winkler within the type; null if nothing matches.

    The fuzzy stage compares the labels of a type block by block, and all of them by a bound first (_best_entries()).
    Rows and registry may be large: their joins are marked as sort-merge joins, since Spark guesses sizes from files,
    which are compressed, and would build broadcasts of millions of rows on the driver."""
    rows = rows.select("key", "type", "label", F.lower("label").alias("low"), slug(F.col("label")).alias("slug"))
    reg = registry.select(F.col("id").alias("entry"), "type", F.lower("label").alias("entry_low"), slug(F.col("label")).alias("slug"), "aliases", "label")
    first = lambda f, c, how: f.groupBy("key").agg(F.min("entry").alias("entry")).select("key", "entry", F.lit(c).alias("confidence"), F.lit(how).alias("matched_by"))
    least = lambda f, name: f.groupBy("type", name).agg(F.min("entry").alias("entry")).hint("merge")
    without = lambda f, hits: f.join(hits.select("key").hint("merge"), "key", "left_anti")
    by_slug = first(rows.join(least(reg, "slug"), ["type", "slug"]), 1.0, "slug")
    names = names_of(reg).select("type", "entry", F.col("name").alias("low"))
    by_alias = first(without(rows, by_slug).join(least(names, "low"), ["type", "low"]), 0.9, "alias")
    exact = stored(by_slug.unionByName(by_alias), "registry-exact")
    by_jw = _fuzzy(without(rows, exact).select("key", "type", "low"), reg.select("entry", "type", "entry_low"), threshold)
    by_jw = by_jw.groupBy("key").agg(F.min_by("entry", F.struct(-F.col("c"), F.col("entry"))).alias("entry"), F.max("c").alias("confidence")).withColumn("matched_by", F.lit("fuzzy"))
    return rows.select("key", "type", "label").join(exact.unionByName(by_jw).hint("merge"), "key", "left")


def _fuzzy(rows: DataFrame, reg: DataFrame, threshold: float) -> DataFrame:
    """key, entry and c: for each row (key, type, low) the best of each block of the type's entries (entry, type,
    entry_low)."""
    rows, reg = stored(rows.where("low is not null"), "registry-rows"), reg.where("entry_low is not null")
    blocks = lambda df, n: df.groupBy("type").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias(n))
    both = stored(blocks(rows, "nl").join(blocks(reg, "nr").hint("merge"), "type"), "registry-blocks")
    both = F.broadcast(both) if both.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else both.hint("merge")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = rows.join(both, "type").select("key", "type", "low", F.pmod(F.xxhash64("key", "low"), "nl").alias("l"), every("nr").alias("r"))
    right = reg.join(both, "type").select("entry", "type", "entry_low", F.pmod(F.xxhash64("entry", "entry_low"), "nr").alias("r"), every("nl").alias("l"))
    kinds = rows.schema["key"].dataType.simpleString(), reg.schema["entry"].dataType.simpleString()

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        y = y.sort_by("entry")  # the smallest id goes first among equal ones
        best = _best_entries(x.column("low").to_pylist(), y.column("entry_low").to_pylist(), threshold)
        at = [i for i, b in enumerate(best) if b is not None]
        return pa.table({"key": x.column("key").take(pa.array(at, pa.int64())), "entry": y.column("entry").take(pa.array([best[i][0] for i in at], pa.int64())), "c": pa.array([best[i][1] for i in at], pa.float64())})

    # a block's work is in comparisons, not bytes: partitions of a given number are not coalesced
    many = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = (x.repartition(many, "type", "l", "r") for x in (left, right))
    return left.groupBy("type", "l", "r").cogroup(right.groupBy("type", "l", "r")).applyInArrow(run, f"key {kinds[0]}, entry {kinds[1]}, c double")


def _best_entries(names: list[str], entries: list[str], threshold: float) -> list[tuple[int, float] | None]:
    """For each name the place of the entry most like it by Jaro-Winkler, the first of equal ones, and its score, or None
    if none reaches the threshold.

    No more characters match than both hold, with repeats, so (m / |a| + m / |b| + 1) / 3 for that number m bounds the
    Jaro part, and the common prefix is known. Held characters are bits, so m is a count of common bits. It is taken
    first for groups of entries with equal starts and lengths (bits that any of them has), then for the entries of
    groups that may reach the threshold; the likeliest entry is scored, and then those whose bound reaches its score."""
    if not names or not entries:
        return [None] * len(names)
    place: dict[str, int] = {}  # equal entries: the first counts
    for j, e in enumerate(entries):
        place.setdefault(e, j)
    own = list(dict.fromkeys(names))
    texts = MaskedTexts(own + list(place))
    n = len(own)
    bits, more = texts.held(n)
    length, start = texts.length, texts.start
    order = n + np.lexsort((*bits[n:].T, length[n:], *start[n:].T))
    turn = np.ones(len(order), bool)
    turn[1:] = (start[order[1:]] != start[order[:-1]]).any(1) | (length[order[1:]] != length[order[:-1]])
    kind = np.cumsum(turn) - 1
    k_start, k_length = start[order[turn]], length[order[turn]]
    head = np.flatnonzero((np.arange(len(order)) - np.flatnonzero(turn)[kind]) % GROUP == 0)
    g_bits, g_more, g_kind, g_size = np.bitwise_or.reduceat(bits[order], head), np.maximum.reduceat(more[order], head), kind[head], np.diff(head, append=len(order))
    small = not more.any() and bits.shape[1] <= 3  # then counts fit into a byte
    found: dict[str, tuple[int, float]] = {}

    def common(x: np.ndarray, y: np.ndarray, x_more: np.ndarray, y_more: np.ndarray) -> np.ndarray:
        m = np.bitwise_count(x[..., 0] & y[..., 0])
        m = m if small else m.astype(np.int32)
        for w in range(1, x.shape[-1]):
            m += np.bitwise_count(x[..., w] & y[..., w])
        return m if small else m + np.minimum(x_more, y_more)

    for s in range(0, n, CHUNK):
        a = np.arange(s, min(n, s + CHUNK))
        boost = np.cumprod(start[a, None] == k_start, axis=2).sum(2) * 0.1
        la, lb = length[a, None], k_length[None]
        need = np.ceil((3 * (threshold - boost) / (1 - boost) - 1) / (1 / np.maximum(la, 1) + 1 / np.maximum(lb, 1)) - 1e-6)
        need = np.where(la + lb == 0, 0, need).clip(0, 255 if small else 2**31 - 1).astype(np.uint8 if small else np.int64)
        i, g = np.nonzero(common(bits[a, None], g_bits[None], more[a, None], g_more[None]) >= need[:, g_kind])
        size = g_size[g]
        i, e = np.repeat(i, size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - head[g], size)
        m = common(bits[a[i]], bits[order[e]], more[a[i]], more[order[e]])
        keep = np.flatnonzero(m >= need[i, kind[e]])
        i, e, m = i[keep], e[keep], m[keep].astype(np.int64)
        if not len(i):
            continue
        boost, x, y = boost[i, kind[e]], a[i], order[e]
        jaro = np.where(length[x] + length[y] == 0, 1.0, (m / np.maximum(length[x], 1) + m / np.maximum(length[y], 1) + 1) / 3)
        bound = jaro + boost * (1 - jaro)
        by = np.lexsort((-bound, i))
        top = by[np.flatnonzero(np.diff(i[by], prepend=-1))]
        floor = np.full(len(a), threshold)
        floor[i[top]] = np.maximum(threshold, texts.scores(x[top], y[top], floor[i[top]], jaro_winkler_of))
        near = np.flatnonzero(bound >= floor[i] - 1e-9)
        x, y, i = x[near], y[near], i[near]
        score = texts.scores(x, y, floor[i], jaro_winkler_of)
        at = np.array([place[texts.texts[j]] for j in y.tolist()])
        for k in np.lexsort((at, -score, x)).tolist():
            if score[k] >= threshold:
                found.setdefault(own[x[k]], (int(at[k]), float(score[k])))
    return [found.get(name) for name in names]


def resolve_relationships(relationships: DataFrame, entities: DataFrame, allowed: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] | None = None) -> DataFrame:
    """relationships (ord, type, source_label, target_label, properties) with source_id and target_id of entities (id,
    type, label, aliases), null if unresolved. A label may name several entities: one of a type that the relationship
    allows ({type: (sources, targets)}; empty means any) goes first, then the smallest id."""
    names = names_of(entities).select("name", F.col("id").alias("hit"), F.col("type").alias("hit_type"))
    names = names.withColumn("slug", F.lit(0)).unionByName(entities.select(slug(F.col("label")).alias("name"), F.col("id").alias("hit"), F.col("type").alias("hit_type"), F.lit(1).alias("slug")))
    out = relationships
    for k, side in enumerate(("source", "target")):
        fits = F.lit(False)
        for rtype, ends in (allowed or {}).items():
            fits = F.when(F.col("type") == rtype, F.col("hit_type").isin(*ends[k]) if ends[k] else F.lit(True)).otherwise(fits)
        wanted = relationships.select("ord", "type", F.lower(f"{side}_label").alias("name"))
        best = wanted.join(names, "name").groupBy("ord").agg(F.min_by("hit", F.struct((~fits).cast("int"), "slug", "hit")).alias(f"{side}_id"))
        out = out.join(best, "ord", "left")
    return out


def deduplicated(resolved: DataFrame) -> DataFrame:
    """One row for each type and pair of ids; earlier properties win. Unresolved rows are left out."""
    groups = resolved.where("source_id is not null and target_id is not null").groupBy("type", "source_id", "target_id")
    return aggregated(groups, {"ord": F.min("ord"), "properties": earliest_wins(in_order("properties")), "n": F.count(F.lit(1))})


def similar_names(left: DataFrame, right: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Pairs (a, b, score) of names like each other by Jaro-Winkler; right is small: a vocabulary's types."""
    names = size_checked(right.select(F.col("name").alias("b")).distinct(), 10_000)
    pairs = left.select(F.col("name").alias("a")).distinct().crossJoin(names)
    return pairs.withColumn("score", jaro_winkler("a", "b")).where(F.col("score") >= threshold)


def first_seen(rows: DataFrame, key: str = "id", order: str = "ord") -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")
