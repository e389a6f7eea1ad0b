"""Scans, point reads, filters and pages over a graph's vertices and edges."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphspark.functions.props import Filter, all_of
from graphspark.model import DETAIL, Graph, Page, Vocabulary
from graphspark.operators.aggregate import statistics
from graphspark.operators.halfedges import half_edges
from graphspark.plans.scratch import stored

FIND_LIMIT, FIND_MOST, OFFSET_MOST = 10, 50, 1000


def detail(vertices: DataFrame, level: str = "summary") -> DataFrame:
    """The columns of a level of detail that the frame has; never the embedding."""
    return vertices.select(*[c for c in DETAIL[level] if c in vertices.columns])


def scan(vertices: DataFrame, embeddings: bool = False) -> DataFrame:
    """All vertices by id; the light form leaves the embedding unread."""
    return (vertices if embeddings else vertices.drop("embedding")).orderBy("id")


def by_id(frame: DataFrame, id_: str) -> DataFrame:
    return frame.where(F.col("id") == id_)


def by_slug(vertices: DataFrame, slug: str) -> DataFrame:
    return vertices.where(F.col("slug") == slug)


def by_ids(frame: DataFrame, ids: list[str], most: int | None = 50) -> DataFrame:
    """Rows of the given ids; unknown ones are silently missing."""
    if most is not None and len(ids) > most:
        raise ValueError(f"at most {most} ids")
    return frame.where(F.col("id").isin(ids)) if ids else frame.where("false")


@dataclass(frozen=True)
class ProvenanceFilter:
    """All given groups must hold; a group holds if the creation or the change matches."""

    conversations: tuple[str, ...] = ()
    actors: tuple[str, ...] = ()
    start: str | None = None
    end: str | None = None

    def on(self, p: Column) -> Column:
        held = F.lit(True)
        if self.conversations:
            held &= F.coalesce(p["created_in_conversation"].isin(*self.conversations), F.lit(False)) | F.coalesce(p["modified_in_conversation"].isin(*self.conversations), F.lit(False))
        if self.actors:
            held &= F.coalesce(p["created_by"].isin(*self.actors), F.lit(False)) | F.coalesce(p["modified_by"].isin(*self.actors), F.lit(False))
        if self.start is not None or self.end is not None:
            inside = lambda t: F.coalesce((t >= (self.start or "")) & (t <= F.lit(self.end) if self.end is not None else t >= (self.start or "")), F.lit(False))
            held &= inside(p["created_at"]) | inside(p["modified_at"])
        return held


def matching(vertices: DataFrame, types: list[str] | None = None, term: str | None = None, properties: dict[str, Any] | None = None, filters: tuple[Filter, ...] = (), provenance: ProvenanceFilter | None = None) -> DataFrame:
    """Vertices that meet all conditions. No types means any; the term is a literal, case-insensitive part of
    label or summary."""
    out = vertices
    if types:
        out = out.where(F.col("type").isin(types))
    if term:
        low = F.lit(term.lower())
        out = out.where(F.contains(F.lower("label"), low) | F.contains(F.lower(F.coalesce("summary", F.lit(""))), low))
    wanted = (*(Filter(k, "eq", v) for k, v in (properties or {}).items()), *filters)
    if wanted:
        out = out.where(all_of(wanted, F.col("properties")))
    if provenance is not None:
        out = out.where(provenance.on(F.col("provenance")))
    return out


def page(frame: DataFrame, limit: int = FIND_LIMIT, offset: int = 0, order: tuple[Any, ...] = ("id",)) -> Page:
    """An ordered page: a top-k of limit + offset rows, not a sort of everything."""
    if offset < 0 or limit < 1:
        raise ValueError("limit must be positive and offset not negative")
    return Page(frame.orderBy(*order).offset(offset).limit(limit) if offset else frame.orderBy(*order).limit(limit), frame, limit, offset)


def find(graph: Graph, limit: int = FIND_LIMIT, offset: int = 0, level: str = "summary", **conditions: Any) -> Page:
    """A page of matching vertices, at most FIND_MOST of them."""
    return page(detail(matching(graph.vertices, **conditions), level), min(limit, FIND_MOST), min(offset, OFFSET_MOST))


def relationships(graph: Graph, id_: str, direction: str = "both", types: list[str] | None = None, filters: tuple[Filter, ...] = ()) -> DataFrame:
    """Edges of a vertex. A bidirectional edge counts as outgoing and incoming at both ends; a self-loop once."""
    source, target, both = F.col("source_id") == id_, F.col("target_id") == id_, F.col("bidirectional")
    side = {"out": source | (both & target), "in": target | (both & source), "both": source | target}[direction]
    out = graph.edges.where(side)
    if types:
        out = out.where(F.col("type").isin(types))
    return out.where(all_of(filters, F.col("properties"))) if filters else out


def relationships_of(graph: Graph, ids: DataFrame, direction: str = "both") -> DataFrame:
    """Edges of many vertices (column id), each edge once."""
    near = half_edges(graph.edges, direction).join(ids.select(F.col("id").alias("a")).distinct(), "a", "left_semi")
    return graph.edges.join(near.select(F.col("edge_id").alias("id")).distinct(), "id", "left_semi")


def enriched(graph: Graph, edges: DataFrame) -> DataFrame:
    """edges with the labels of both ends, and their slugs if vertices have any; an unknown end shows its id."""
    names = [c for c in ("slug", "label") if c in graph.vertices.columns]
    out = edges
    for side in ("source", "target"):
        own = graph.vertices.select(F.col("id").alias(f"{side}_id"), *[F.col(c).alias(f"{side}_{c}") for c in names])
        out = out.join(own, f"{side}_id", "left")
    return out.withColumns({f"{s}_{c}": F.coalesce(f"{s}_{c}", f"{s}_id") for s in ("source", "target") for c in names})


@dataclass(frozen=True)
class GraphPage:
    """A page of a whole graph: its vertices, the edges at them (named, up to a cap), where the next page starts, the
    whole graph's statistics (kind, type, n) and its vocabulary."""

    vertices: DataFrame
    edges: DataFrame
    total_edges: int
    truncated: bool
    cursor: str | None
    statistics: DataFrame
    vocabulary: Vocabulary | None = None


def graph_page(graph: Graph, limit: int = 200, offset: int = 0, level: str = "summary", most_edges: int = 1000, vocabulary: Vocabulary | None = None) -> GraphPage:
    """The page of vertices by id from the offset, and the edges with an end on it. Ends on other pages show their ids."""
    rows = detail(graph.vertices, level).orderBy("id").offset(offset).limit(limit)
    near = relationships_of(graph, rows)
    total = near.count()
    named = enriched(Graph(rows, near), near.orderBy("id").limit(most_edges))
    counts = statistics(graph)
    more = offset + limit < (counts.where("kind = 'entity' and type is null").agg(F.sum("n")).first()[0] or 0)
    return GraphPage(rows, named, total, total > most_edges, f"offset:{offset + limit}" if more else None, counts, vocabulary)


def induced(graph: Graph, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ids (column id)."""
    some = ids.select(F.col("id").alias("_v")).distinct()
    return graph.edges.join(some, F.col("source_id") == F.col("_v"), "left_semi").join(some, F.col("target_id") == F.col("_v"), "left_semi")


def without_inbound(graph: Graph, types: list[str], edge_types: list[str] | None = None) -> DataFrame:
    """Vertices of the given types that no edge (of the given types) points to."""
    edges = graph.edges if edge_types is None else graph.edges.where(F.col("type").isin(edge_types))
    return graph.vertices.where(F.col("type").isin(types)).join(edges.select(F.col("target_id").alias("id")).distinct(), "id", "left_anti")


def chunks(frame: DataFrame, size: int = 100, ranges: int | None = None) -> DataFrame:
    """frame with the sequence number of its chunk of `size` rows in order of id, and whether it is the last.

    Row numbers come in two levels, within ranges of ids and over the ranges' counts, so no task sorts all rows.
    There is a range for every million rows, and as many as shuffle partitions at least."""
    if ranges is None:
        ranges = max(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), frame.count() // 1_000_000)
    # written once: the bounds of ranges are sampled, and must be the same for counts and rows
    ordered = stored(frame.repartitionByRange(ranges, "id").withColumn("_part", F.spark_partition_id()), "chunks")
    counts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"), F.sum("n").over(Window.partitionBy(F.lit(1))).alias("_all"))
    at = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy("id")) - 1
    numbered = ordered.join(F.broadcast(before), "_part").withColumn("sequence", F.floor(at / size).cast("long"))
    return numbered.withColumn("is_last", F.col("sequence") == F.floor((F.col("_all") - 1) / size)).drop("_part", "_before", "_all")
