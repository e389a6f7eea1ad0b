"""Neighbourhoods and paths by level-synchronous search over half-edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphspark.functions.props import Filter, all_of
from graphspark.model import Graph
from graphspark.operators.halfedges import half_edges
from graphspark.plans.scratch import stored

EXPLORE_DEPTH, PATH_DEPTH = 3, 5


def _usable(graph: Graph, direction: str, types: list[str] | None, filters: tuple[Filter, ...], honour: bool = True) -> DataFrame:
    edges = graph.edges
    if types:
        edges = edges.where(F.col("type").isin(types))
    if filters:
        edges = edges.where(all_of(filters, F.col("properties")))
    return half_edges(edges, direction, honour).select("a", "b", "edge_id", F.col("type").alias("relationship_type"), "dir")


def layers(graph: Graph, start: str, depth: int = 1, direction: str = "both", relationship_types: list[str] | None = None, entity_types: list[str] | None = None, filters: tuple[Filter, ...] = ()) -> DataFrame:
    """depth, relationship_type, id, type and label of what each layer reaches from `start`.

    A layer never returns to earlier layers, but may reach one vertex under several relationship types. Filters on
    edges and on entity types prune the expansion; an empty list of types is no filter."""
    if not 1 <= depth <= EXPLORE_DEPTH:
        raise ValueError(f"depth must be 1 to {EXPLORE_DEPTH}")
    halves = _usable(graph, direction, relationship_types, filters)
    vertices = graph.vertices.select("id", "type", "label")
    if entity_types:
        vertices = vertices.where(F.col("type").isin(entity_types))
    spark = graph.spark
    visited = frontier = spark.createDataFrame([(start,)], "a string")
    out = None
    for level in range(1, depth + 1):
        # the first frontier is one literal row: a filter on the edges, not a join
        step = halves.where(F.col("a") == start) if level == 1 else halves.join(frontier, "a", "left_semi")
        step = step.where(F.col("b") != start) if level == 1 else step.join(visited.withColumnRenamed("a", "b"), "b", "left_anti")
        found = step.select("relationship_type", F.col("b").alias("id")).distinct().join(vertices, "id")
        if level < depth:  # read again by the result, the next frontier and the visited set: computed once
            found = stored(found, "layer")
        layer = found.select(F.lit(level).alias("depth"), "relationship_type", "id", "type", "label")
        out = layer if out is None else out.unionByName(layer)
        frontier = found.select(F.col("id").alias("a")).distinct()
        visited = visited.unionByName(frontier)
    return out


def limited(found: DataFrame, limit_per_type: int, offset_per_type: int = 0) -> DataFrame:
    """For each layer and relationship type the rows in order of id from the offset, with the type's total.

    Totals are counted apart; a rank needs the rows of a type together, so only as many as the limit
    leaves are kept on each side of the shuffle."""
    keys = ["depth", "relationship_type"]
    totals = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
    kept = found.withColumn("position", rank).where((F.col("position") > offset_per_type) & (F.col("position") <= offset_per_type + limit_per_type))
    return kept.join(F.broadcast(totals), keys).drop("position")


def explore(graph: Graph, start: str, depth: int = 1, limit_per_type: int = 10, offset_per_type: int = 0, **conditions: object) -> DataFrame:
    """layers(), limited in each layer and type; total counts all."""
    return limited(layers(graph, start, depth, **conditions), limit_per_type, offset_per_type)


def explore_statistics(found: DataFrame, limit_per_type: int) -> DataFrame:
    """depth, relationship_type, total, returned and truncated of a neighbourhood."""
    totals = found.groupBy("depth", "relationship_type").agg(F.count(F.lit(1)).alias("total"))
    return totals.select("depth", "relationship_type", "total", F.least("total", F.lit(limit_per_type)).cast("long").alias("returned"), (F.col("total") > limit_per_type).alias("truncated"))


def paths(graph: Graph, source: str, target: str, max_depth: int = 3, mode: str = "bfs_pruned", relationship_types: list[str] | None = None, entity_types: list[str] | None = None, filters: tuple[Filter, ...] = (), strict_endpoints: bool = False) -> DataFrame:
    """hops, vertex_path and edge_path (arrays of ids) and directions of the simple paths of at most max_depth edges.

    Edges are walked either way. mode "bfs_pruned": each vertex between lies at its own distance from the source (in
    the filtered graph without the target); "all_simple": all paths without a repeated vertex. Parallel edges give
    paths of their own; source = target gives one path of no edges. entity_types restricts the vertices between,
    with strict_endpoints also the ends."""
    if not 1 <= max_depth <= PATH_DEPTH:
        raise ValueError(f"depth must be 1 to {PATH_DEPTH}")
    if mode not in ("bfs_pruned", "all_simple"):
        raise ValueError(f"unknown mode {mode}")
    spark = graph.spark
    schema = "hops int, vertex_path array<string>, edge_path array<string>, directions array<string>"
    if source == target:
        out = spark.createDataFrame([(0, [source], [], [])], schema)
        return _ends_allowed(graph, out, source, target, entity_types) if strict_endpoints and entity_types else out
    halves = _usable(graph, "both", relationship_types, filters, honour=False).where((F.col("a") != target) & (F.col("b") != source) & (F.col("a") != F.col("b")))
    halves = halves.select("a", F.col("b").alias("nxt"), "edge_id", "dir")
    allowed = graph.vertices.where(F.col("type").isin(entity_types)).select(F.col("id").alias("nxt")) if entity_types else None
    walk = spark.createDataFrame([(source, [source], [], [])], "a string, vertex_path array<string>, edge_path array<string>, directions array<string>")
    seen = spark.createDataFrame([(source,)], "nxt string")
    found = None
    for level in range(1, max_depth + 1):
        steps = halves.where(F.col("a") == source) if level == 1 else halves
        grown = walk.join(steps, "a").select(
            F.col("nxt"), F.array_append("vertex_path", F.col("nxt")).alias("vertex_path"), F.array_append("edge_path", F.col("edge_id")).alias("edge_path"), F.array_append("directions", F.col("dir")).alias("directions"), F.array_contains("vertex_path", F.col("nxt")).alias("again")
        ).where("not again").drop("again")
        done = grown.where(F.col("nxt") == target).select(F.lit(level).alias("hops"), "vertex_path", "edge_path", "directions")
        found = done if found is None else found.unionByName(done)
        if level == max_depth:
            break
        grown = grown.where(F.col("nxt") != target)
        if allowed is not None:
            grown = grown.join(allowed, "nxt", "left_semi")
        if mode == "bfs_pruned":
            grown = stored(grown.join(seen, "nxt", "left_anti"), "paths")
            seen = seen.unionByName(grown.select("nxt").distinct())
        walk = grown.withColumnRenamed("nxt", "a")
    return _ends_allowed(graph, found, source, target, entity_types) if strict_endpoints and entity_types else found


def _ends_allowed(graph: Graph, found: DataFrame, source: str, target: str, entity_types: list[str]) -> DataFrame:
    ends = graph.vertices.where(F.col("id").isin(source, target) & F.col("type").isin(entity_types)).select("id").distinct().groupBy().agg(F.count(F.lit(1)).alias("_ends"))
    return found.crossJoin(F.broadcast(ends)).where(F.col("_ends") == len({source, target})).drop("_ends")


def path_text(ids: Column) -> Column:
    return F.array_join(ids, ">")
