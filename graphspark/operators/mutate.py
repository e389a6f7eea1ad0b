"""Changes as functions of frames: rows in, rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphspark.functions.names import entity_slug, screaming_snake
from graphspark.functions.props import is_null
from graphspark.model import Graph, Vocabulary
from graphspark.operators.vocabulary import entity_errors, relationship_errors


def stamp(by: str, at: str, by_type: str = "user", conversation: str | None = None, message: str | None = None, previous: Column | None = None) -> Column:
    """Provenance of a creation, or, with the previous one, of a change that keeps who created it."""
    now = {"by": F.lit(by), "by_type": F.lit(by_type), "at": F.lit(at), "in_conversation": F.lit(conversation), "from_message": F.lit(message)}
    created = {f"created_{k}": (previous[f"created_{k}"] if previous is not None else v) for k, v in now.items()}
    modified = {f"modified_{k}": (now[k] if previous is not None else F.lit(None)) for k in now}
    return F.struct(*[c.cast("string").alias(k) for k, c in (created | modified).items()])


def merge_patch(old: Column, patch: Column) -> Column:
    """A bag after a patch: null deletes a key, a missing key keeps it."""
    gone = F.map_keys(F.map_filter(patch, lambda _, v: is_null(v)))
    kept = F.map_filter(old, lambda k, _: ~F.array_contains(gone, k) & ~F.array_contains(F.map_keys(patch), k))
    return F.map_concat(kept, F.map_filter(patch, lambda _, v: ~is_null(v)))


def changed_keys(old: Column, new: Column) -> Column:
    """Keys whose value differs, in order."""
    keys = F.array_union(F.map_keys(old), F.map_keys(new))
    return F.array_sort(F.filter(keys, lambda k: ~old[k].eqNullSafe(new[k])))


def numbered(rows: DataFrame, base: str, taken: DataFrame, out: str, order: str = "id") -> DataFrame:
    """rows with a free name in the column `out`: the column `base` itself, or that with a number from -2 on.

    taken: names in use (column name). Numbers go on after the largest one in use, among the taken names and the other
    rows' bases; rows of one base follow `order`."""
    bases = rows.select(F.col(base).alias("_name")).distinct()
    held = taken.select(F.col("name").alias("_name"), F.lit(True).alias("_held")).unionByName(bases.withColumn("_held", F.lit(False)))
    number = F.regexp_extract("_name", r"-(\d{1,9})$", 1)
    own = held.groupBy(F.col("_name").alias("_base")).agg(F.max("_held").cast("int").alias("_plain"))
    more = held.where(number != "").groupBy(F.regexp_replace("_name", r"-\d{1,9}$", "").alias("_base")).agg(F.max(number.cast("int")).alias("_most"))
    used = own.join(more, "_base", "left").select("_base", F.greatest("_plain", F.coalesce(F.when(F.col("_plain") == 1, F.col("_most")), F.lit(0))).alias("_used"), F.coalesce("_most", F.lit(0)).alias("_most"))
    n = F.row_number().over(Window.partitionBy(base).orderBy(order))
    # a free base goes to the first row; the others are numbered after the largest number there is, and after 1
    later = n + F.greatest(F.col("_most"), F.lit(1)) - F.when(F.col("_used") == 0, 1).otherwise(0)
    name = F.when((F.col("_used") == 0) & (n == 1), F.col(base)).otherwise(F.concat_ws("-", F.col(base), later.cast("string")))
    return rows.join(used, F.col(base) == F.col("_base"), "left").withColumn(out, name).drop("_base", "_used", "_most")


def with_slugs(new: DataFrame, taken: DataFrame) -> DataFrame:
    """new with a slug of its own for each row: type and label, numbered where that is taken (column slug)."""
    base = new.withColumn("_slug", entity_slug(F.col("type"), F.col("label")))
    return numbered(base, "_slug", taken.where("slug is not null").select(F.col("slug").alias("name")), "slug").drop("_slug")


def create_vertices(graph: Graph, new: DataFrame, vocabulary: Vocabulary, provenance: Column | None = None) -> tuple[Graph, DataFrame]:
    """The graph with the valid new rows, and the refused ones with their errors. An id that exists is refused."""
    judged = new.withColumn("errors", entity_errors(vocabulary)).join(graph.vertices.select("id", F.lit(True).alias("_there")), "id", "left")
    fine = (F.size("errors") == 0) & F.col("_there").isNull()
    good = judged.where(fine).drop("errors", "_there")
    if "slug" in graph.vertices.columns:
        good = with_slugs(good, graph.vertices)
    if provenance is not None:
        good = good.withColumn("provenance", provenance)
    return Graph(graph.vertices.unionByName(good, allowMissingColumns=True), graph.edges), judged.where(~fine).drop("_there")


def update_vertices(graph: Graph, patches: DataFrame, provenance: Column | None = None) -> Graph:
    """patches: id, and any of label, summary, properties. A null label keeps the old one; properties are merged."""
    own = [c for c in patches.columns if c != "id"]
    both = graph.vertices.join(patches.select("id", *[F.col(c).alias(f"_{c}") for c in own], F.lit(True).alias("_hit")), "id", "left")
    for c in own:
        new = merge_patch(F.col(c), F.col("_properties")) if c == "properties" else F.col(f"_{c}")
        both = both.withColumn(c, F.when(F.col(f"_{c}").isNotNull(), new).otherwise(F.col(c)))
    if provenance is not None:
        both = both.withColumn("provenance", F.when(F.col("_hit"), provenance).otherwise(F.col("provenance")))
    return Graph(both.select(graph.vertices.columns), graph.edges)


def delete_vertices(graph: Graph, ids: DataFrame) -> Graph:
    """Without the vertices of ids (column id) and the edges at them."""
    gone = ids.select(F.col("id").alias("_v")).distinct()
    edges = graph.edges.join(gone, F.col("source_id") == F.col("_v"), "left_anti").join(gone, F.col("target_id") == F.col("_v"), "left_anti")
    return Graph(graph.vertices.join(gone, F.col("id") == F.col("_v"), "left_anti"), edges)


def deletion_report(graph: Graph, ids: DataFrame) -> DataFrame:
    """id and status (deleted or not_found) of each requested id."""
    there = graph.vertices.select("id", F.lit(True).alias("_there"))
    return ids.select("id").distinct().join(there, "id", "left").select("id", F.when(F.col("_there"), "deleted").otherwise("not_found").alias("status"))


def create_relationships(graph: Graph, new: DataFrame, vocabulary: Vocabulary) -> tuple[Graph, DataFrame]:
    """The graph with the valid new edges, and the refused ones with their errors: missing ends, self-references,
    known ids, what the vocabulary forbids. Types are put in upper case; the direction is the vocabulary's."""
    end = lambda s: graph.vertices.select(F.col("id").alias(f"{s}_id"), F.col("type").alias(f"{s}_type"))
    both = new.withColumn("type", screaming_snake(F.col("type"))).join(end("source"), "source_id", "left").join(end("target"), "target_id", "left")
    both = both.join(graph.edges.select("id", F.lit(True).alias("_there")), "id", "left")
    ends = F.col("source_type").isNotNull() & F.col("target_type").isNotNull() & (F.col("source_id") != F.col("target_id"))
    judged = both.withColumn("errors", relationship_errors(vocabulary)).withColumn("_fine", ends & F.col("_there").isNull() & (F.size("errors") == 0))
    two_way = [t.type for t in vocabulary.relationship_types if t.bidirectional]
    good = judged.where("_fine").withColumn("bidirectional", F.col("type").isin(*two_way) if two_way else F.lit(False))
    return Graph(graph.vertices, graph.edges.unionByName(good.select([c for c in graph.edges.columns if c in good.columns]), allowMissingColumns=True)), judged.where("not _fine").drop("_fine", "_there")


def delete_relationships(graph: Graph, ids: DataFrame) -> Graph:
    return Graph(graph.vertices, graph.edges.join(ids.select("id").distinct(), "id", "left_anti"))


def merge_vertices(graph: Graph, incoming: DataFrame, policy: str = "skip") -> tuple[DataFrame, DataFrame]:
    """The vertices after an import, and id_in, id_out, action of each incoming row (unique by id).

    A row collides if its id exists, or else its slug (or label, without slugs). skip keeps the old row, overwrite
    takes the new one under the old id, rename adds it under a free id from "<id>-imported" on, numbered from -2 where that
    is taken, and its slug alike; rows without collision are added."""
    if policy not in ("skip", "overwrite", "rename"):
        raise ValueError(f"unknown policy {policy}")
    key = "slug" if "slug" in incoming.columns and "slug" in graph.vertices.columns else None
    by_id = graph.vertices.select("id", F.col("id").alias("_hit"))
    both = incoming.join(by_id, "id", "left")
    if key:
        by_key = graph.vertices.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("id").alias("_hit2"))
        both = both.join(by_key, key, "left").withColumn("_hit", F.coalesce("_hit", "_hit2")).drop("_hit2")
    new = F.col("_hit").isNull()
    action = F.when(new, "created").otherwise({"skip": "skipped", "overwrite": "overwritten", "rename": "renamed"}[policy])
    marked = both.withColumn("_out", F.when(new, F.col("id")).otherwise(F.col("_hit"))).withColumn("_action", action)
    if policy == "rename":
        marked = _renamed(marked, graph.vertices, key)
    log = marked.select(F.col("id").alias("id_in"), F.col("_out").alias("id_out"), F.col("_action").alias("action"))
    taken = marked.where("_action <> 'skipped'").withColumn("id", F.col("_out")).drop("_hit", "_out", "_action")
    kept = graph.vertices if policy != "overwrite" else graph.vertices.join(taken.select("id"), "id", "left_anti")
    return kept.unionByName(taken.select([c for c in graph.vertices.columns if c in taken.columns]), allowMissingColumns=True), log


def _renamed(marked: DataFrame, old: DataFrame, key: str | None) -> DataFrame:
    """marked with free ids, and slugs if there are any, for the rows that collide."""
    fresh, moved = marked.where("_action = 'created'"), marked.where("_action = 'renamed'")
    ids = old.select(F.col("id").alias("name")).unionByName(fresh.select(F.col("id").alias("name")))
    moved = numbered(moved.drop("_out").withColumn("_base_id", F.concat("id", F.lit("-imported"))), "_base_id", ids, "_out").drop("_base_id")
    if key:
        slugs = old.select(F.col(key).alias("name")).unionByName(fresh.select(F.col(key).alias("name"))).where("name is not null")
        moved = numbered(moved.withColumn("_base_slug", F.concat(key, F.lit("-imported"))).drop(key), "_base_slug", slugs, key).drop("_base_slug")
    return fresh.unionByName(moved)


def merge_edges(vertices: DataFrame, edges: DataFrame, incoming: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges after an import whose vertices went through merge_vertices(), and a warning for each refused edge:
    an end that doesn't exist (orphan), or an edge of the same type and ends (duplicate)."""
    moved = lambda s: log.select(F.col("id_in").alias(f"{s}_id"), F.col("id_out").alias(f"_{s}"))
    both = incoming.join(moved("source"), "source_id", "left").join(moved("target"), "target_id", "left")
    both = both.withColumns({f"{s}_id": F.coalesce(f"_{s}", f"{s}_id") for s in ("source", "target")}).drop("_source", "_target")
    ids = vertices.select(F.col("id").alias("_v")).distinct()
    for s in ("source", "target"):
        both = both.join(ids.select(F.col("_v").alias(f"{s}_id"), F.lit(True).alias(f"_{s}_there")), f"{s}_id", "left")
    known = edges.select("type", "source_id", "target_id").distinct().withColumn("_dup", F.lit(True))
    both = both.join(known, ["type", "source_id", "target_id"], "left")
    warning = F.when(F.col("_source_there").isNull() | F.col("_target_there").isNull(), "orphan").when(F.col("_dup"), "duplicate")
    judged = both.withColumn("warning", warning)
    good = judged.where("warning is null").select([c for c in edges.columns if c in judged.columns])
    return edges.unionByName(good, allowMissingColumns=True), judged.where("warning is not null").select("id", "warning")


def bulk_import(graph: Graph, vertices: DataFrame, edges: DataFrame, all_or_nothing: bool = False) -> tuple[Graph, DataFrame]:
    """Upserts rows by id, the last by `ord` (if there is one) winning; errors are kind, id and code: an edge without
    one of its ends, or an edge id that exists with other ends or type. all_or_nothing refuses everything then."""

    def last(f: DataFrame) -> DataFrame:
        if "ord" not in f.columns:
            return f.dropDuplicates(["id"])
        n = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("ord")))
        return f.withColumn("_n", n).where("_n = 1").drop("_n", "ord")

    new_v, new_e = last(vertices), last(edges)
    all_v = graph.vertices.join(new_v.select("id"), "id", "left_anti").unionByName(new_v, allowMissingColumns=True)
    ids = all_v.select(F.col("id").alias("_v"))
    old = graph.edges.select("id", F.struct("type", "source_id", "target_id").alias("_was"))
    judged = new_e.join(ids.select(F.col("_v").alias("source_id"), F.lit(True).alias("_s")), "source_id", "left").join(ids.select(F.col("_v").alias("target_id"), F.lit(True).alias("_t")), "target_id", "left").join(old, "id", "left")
    code = F.when(F.col("_s").isNull() | F.col("_t").isNull(), "missing_end").when(F.col("_was").isNotNull() & (F.col("_was") != F.struct("type", "source_id", "target_id")), "id_reused")
    judged = judged.withColumn("code", code)
    errors = judged.where("code is not null").select(F.lit("edge").alias("kind"), "id", "code")
    if all_or_nothing and not errors.isEmpty():
        return graph, errors
    good = judged.where("code is null").select([c for c in graph.edges.columns if c in judged.columns])
    return Graph(all_v, graph.edges.join(good.select("id"), "id", "left_anti").unionByName(good, allowMissingColumns=True)), errors


def import_waves(rows: DataFrame, order: str = "ord") -> DataFrame:
    """rows with the wave in which each can be written: rows that share an id go one after the other."""
    return rows.withColumn("wave", F.row_number().over(Window.partitionBy("id").orderBy(order)))


def import_statistics(log: DataFrame) -> DataFrame:
    return log.groupBy("action").agg(F.count(F.lit(1)).alias("n"))
